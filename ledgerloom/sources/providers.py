"""Providers: engines outside this library that read pages, recognise text or find tables.

A provider is a function from a file's bytes to rows, run on the executors; it is loaded once per worker. What
comes after its rows is in ``operators.pages`` and needs no provider. Without a registered one a file has
no rows and an error that says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: What each kind of provider returns, one dictionary a row; ``doc`` and ``error`` are added.
KINDS = {
    "pages": "page long, width double, height double, text string",
    "words": "page long, word_ord long, text string, x0 double, top double, x1 double, bottom double",
    "chars": "page long, char_ord long, text string, size double, fontname string, top double, x0 double, x1 double",
    "tables": "page long, table_ord long, headers array<string>, rows array<array<string>>, bx0 double, by0 double, bx1 double, by1 double",
    "figures": "page long, pic_ord long, x0 double, top double, x1 double, bottom double, content binary",
    "ocr": "page long, word_ord long, text string, x0 double, y0 double, x1 double, y1 double",
    "pixels": "page long, pixels array<double>",
}
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<array<string>>": pa.list_(pa.list_(pa.string())), "array<double>": pa.list_(pa.float64())}
_LOADERS: dict[str, Callable[[], Callable[[bytes], list[dict[str, Any]]]]] = {}
_loaded: dict[str, Any] = {}


def register(kind: str, loader: Callable[[], Callable[[bytes], list[dict[str, Any]]]]) -> None:
    """``loader`` builds the engine, on a worker, when its first file comes; it must be importable or picklable there."""
    if kind not in KINDS:
        raise ValueError(f"Unknown kind of provider: {kind}. Known: {sorted(KINDS)}")
    _LOADERS[kind] = loader


def available() -> list[str]:
    return sorted(_LOADERS)


def device() -> str:
    """Where a model would run: a graphics card that Spark has assigned to the task, or the processor."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return "cuda" if context is not None and "gpu" in context.resources() else "cpu"


def rows(files: DataFrame, kind: str, name_col: str = "filename", content_col: str = "content") -> DataFrame:
    """(doc, the columns of ``kind``, ``error``): the provider's rows of each file.

    An engine that could not be loaded stays so for the worker; that, and a file that it fails on, is an error row.
    """
    ship(files.sparkSession)
    fields = [f.split(" ", 1) for f in KINDS[kind].split(", ")]
    schema = pa.schema([("doc", pa.string()), *[(n, _ARROW[t]) for n, t in fields], ("error", pa.string())])
    loader = _LOADERS.get(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if loader is None:
                        raise RuntimeError(f"no provider of {kind} is registered")
                    if kind not in _loaded:
                        try:
                            _loaded[kind] = loader()
                        except Exception as e:
                            _loaded[kind] = e
                    if isinstance(_loaded[kind], Exception):
                        raise RuntimeError(f"provider of {kind} failed to load: {_loaded[kind]}")
                    found = [{"doc": name, "error": None, **r} for r in _loaded[kind](content or b"")]
                except Exception as e:  # a file's failure is its result
                    found = [{"doc": name, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(found, schema)

    out = files.select(F.col(name_col).cast("string"), content_col)
    return out.mapInArrow(run, f"doc string, {KINDS[kind]}, error string")

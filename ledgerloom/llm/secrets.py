"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a maximal run of characters that keys are made of. Within it, runs of
hexadecimal and of base64 characters are scanned with a window of fixed length whose
character counts are updated as it moves, so each step costs two table look-ups. Windows
whose Shannon entropy reaches the class's bound are merged into spans. The allow-list
suppresses strings that look random without being secret; where it knows only a part of a
candidate, the rest is scanned.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

WINDOW = 20
#: Least entropy in bits per character, by class; 20 characters have log2(20) = 4.32 at most.
BOUNDS = {"hexrand": 3.0, "base64rand": 3.9}
KINDS = ["assign", "access", "hex", "hexrand", "base64rand"]

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_CLASSES = {"hexrand": re.compile(r"[0-9A-Fa-f]{20,}"), "base64rand": re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")}
#: Suppressed as a whole: path-like strings, words.
ALLOW = re.compile(r"^(?:[a-z]+[/_-])+[a-z]*$|^[a-z]+$|^[A-Z]+$|^[A-Z]?[a-z]+(?:[A-Z][a-z]+)+$")
#: Suppressed where they stand, with the windows that overlap them: a documentation sample, UUIDs, markers, runs of a sequence.
ALLOW_PART = re.compile(
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|EXAMPLE|example|0123456789"
    + "".join(f"|{x[:10]}{'?'.join(x[10:])}?" for x in (string.ascii_lowercase, string.ascii_uppercase))
)
_PLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def windows(text: str, bound: float, size: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``text`` whose entropy is at least ``bound``."""
    if len(text) < size:
        return []
    counts: dict[str, int] = {}
    for c in text[:size]:
        counts[c] = counts.get(c, 0) + 1
    plog = _PLOG if size == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, size + 1)]
    total, spans, full = sum(plog[c] for c in counts.values()), [], math.log2(size)
    least = (full - bound) * size + 1e-9
    for i in range(len(text) - size + 1):
        if i:
            old, new = text[i - 1], text[i + size - 1]
            if old != new:
                n = counts[old]
                total += plog[n - 1] - plog[n]
                counts[old] = n - 1
                n = counts.get(new, 0)
                total += plog[n + 1] - plog[n]
                counts[new] = n + 1
        if total <= least:
            if spans and i <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + size)
            else:
                spans.append((i, i + size))
    return spans


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans as (start, kind's place in ``KINDS``, end), each sorted."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of 24 or more is the maximal run that the base pattern matches.
    base += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    added = []
    for candidate in _CANDIDATE.finditer(text):
        own = candidate[0]
        if ALLOW.search(own):
            continue
        ends = [0, *(x for m in ALLOW_PART.finditer(own) for x in m.span()), len(own)]
        for start, end in zip(ends[::2], ends[1::2]):
            for kind, pattern in _CLASSES.items():
                for m in pattern.finditer(own, start, end):
                    if kind == "base64rand" and (m[0].isalpha() and (m[0].islower() or m[0].isupper()) or _CLASSES["hexrand"].fullmatch(m[0])):
                        continue
                    at = candidate.start() + m.start()
                    added += [(at + a, KINDS.index(kind), at + b) for a, b in windows(m[0], BOUNDS[kind])]
    return sorted(base), sorted(added)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the base kinds, ``base_sha256`` and ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by start, then
    by kind. Null and empty texts have no spans; repeated rows give repeated results;
    only the two named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = find(text or "")
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added)))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[k] for r in rows], types[k]) for k in range(5)]],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    named = docs.selectExpr(f"cast(`{id_col}` as long) as `{id_col}`", f"cast(`{text_col}` as string) as `{text_col}`")
    return map_arrow(named, run, f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9(docs: DataFrame) -> DataFrame:
    return scan(docs)

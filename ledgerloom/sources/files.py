"""Files of any supported kind: bytes to text, MHTML archives to HTML, metadata and images."""

from __future__ import annotations

import email
import email.utils
import io
import zipfile
from collections.abc import Iterator
from email.message import Message
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import front_matter, markdown_name, postprocess_markdown
from ..shipping import ship
from . import dom
from .html import text_of

#: Extensions by kind; the namespace of word-processing documents.
ARCHIVES, PAGES, WORDS = ("mhtml", "mht"), ("html", "htm"), ("docx",)
#: Files whose contents add up to so many bytes leave a worker together.
GROUP_BYTES = 4 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(name: Column) -> Column:
    """Lower-case extension without the dot; empty without one, and for a leading dot alone."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The files below ``path``: path, modificationTime, length, content, filename, ext."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("filename", name).withColumn("ext", extension(name))


def docx_text(content: bytes) -> str:
    """Paragraphs with text, one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/document.xml" not in z.namelist():
            raise ValueError("Invalid DOCX: no word/document.xml found")
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
    return "\n".join(filter(None, lines))


def _saved(date: str) -> str:
    try:
        return email.utils.parsedate_to_datetime(date).strftime("%Y-%m-%d")
    except (TypeError, ValueError):
        return date


def archive(content: bytes) -> tuple[str, dict[str, str], dict[str, tuple[str, bytes]]]:
    """HTML, metadata of the envelope, and images by location; of equal locations the last counts.

    Without an HTML part that has content, the whole archive is taken for HTML.
    """
    whole = content.decode("utf-8", "ignore")
    message: Message = email.message_from_string(whole)
    head = {key: message.get(field, "").strip() for key, field in (("title", "Subject"), ("source", "Content-Location"), ("saved", "Date"))}
    if head["saved"]:
        head["saved"] = _saved(head["saved"])
    page, images = None, {}
    for part in message.walk():
        kind, data = part.get_content_type(), None if part.is_multipart() else part.get_payload(decode=True)
        if not data:
            continue
        if kind == "text/html" and page is None:
            page = data.decode("utf-8", "ignore")
        elif kind.startswith("image/") and (at := part.get("Content-Location", "").strip()):
            images[at] = (kind, data)
    return page or whole, {k: v for k, v in head.items() if v}, images


_PARSED = pa.schema(
    [
        ("text", pa.string()),
        ("html", pa.string()),
        ("meta", pa.map_(pa.string(), pa.string())),
        ("images", pa.list_(pa.struct([("part_ord", pa.int32()), ("location", pa.string()), ("mime", pa.string()), ("data", pa.binary())]))),
        ("error", pa.string()),
    ]
)


def _parsed(name: str, ext: str, content: bytes | None) -> dict:
    row: dict = dict.fromkeys(_PARSED.names)
    try:
        if content is None:
            row["error"] = "No content"
        elif ext in ARCHIVES:
            row["html"], meta, images = archive(content)
            row["meta"] = list(dom.head_metadata(dom.parse(row["html"]), meta).items())
            row["text"] = text_of(row["html"])
            row["images"] = [{"part_ord": k, "location": at, "mime": mime, "data": data} for k, (at, (mime, data)) in enumerate(images.items())]
        elif ext in PAGES:
            row["html"] = content.decode("utf-8", "ignore")
            row["text"] = text_of(row["html"])
        elif ext in WORDS:
            row["text"] = docx_text(content)
        else:
            row["error"] = "Unsupported file type"
    except Exception as e:  # a broken file is a result, not the end of the job
        row["error"] = f"{type(e).__name__}: {e}"
    return row


def parse(files: DataFrame, name_col: str = "filename", content_col: str = "content") -> DataFrame:
    """One row per file: filename, ext, text, html, meta, images, error.

    ``text`` is that of the page, archive or document; a file of another kind, without
    content or broken has a null text and says why in ``error``. An empty page has an
    empty text. Other columns are not read.
    """
    ship(files.sparkSession)
    rows = files.select(F.col(name_col).alias("filename"), extension(F.col(name_col)).alias("ext"), F.col(content_col).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("filename", pa.string()), ("ext", pa.string()), *_PARSED])
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):  # files may be large: rows leave by their bytes
                name, ext, content = (batch.column(i)[k].as_py() for i in range(3))
                held.append({"filename": name, "ext": ext, **_parsed(name, ext, content)})
                size += len(content or b"")
                if size >= GROUP_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0

    return rows.mapInArrow(
        run,
        "filename string, ext string, text string, html string, meta map<string,string>, "
        "images array<struct<part_ord:int,location:string,mime:string,data:binary>>, error string",
    )


def archives_markdown(files: DataFrame, name_col: str = "filename", content_col: str = "content", keys: tuple[str, ...] = ()) -> DataFrame:
    """Archives as Markdown: ``keys``, filename (the output's), ``text`` with front matter, ``meta``.

    An archive that cannot be converted has a text that says so and no metadata.
    """
    ship(files.sparkSession)

    def of(content: bytes | None) -> tuple[str | None, dict[str, str], str | None]:
        try:
            page, meta, images = archive(content or b"")
            return dom.markdown_of(page, [(at, len(data)) for at, (_, data) in images.items()]), dom.head_metadata(dom.parse(page), meta), None
        except Exception as e:
            return None, {}, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(x) for x in batch.column(len(keys) + 1).to_pylist()]
            added = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([list(f[1].items()) for f in found], pa.map_(pa.string(), pa.string())),
                pa.array([f[2] for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*keys, "filename", "raw", "meta", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in files.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " * bool(keys) + "filename string, raw string, meta map<string,string>, error string"
    rows = files.select(*keys, F.col(name_col).cast("string").alias("filename"), content_col).mapInArrow(run, schema)
    front = front_matter(F.col("meta"))
    text = F.concat(F.when(front != "", F.concat(front, F.lit("\n\n"))).otherwise(F.lit("")), postprocess_markdown(F.col("raw")))
    text = F.coalesce(text, F.concat(F.lit("*Conversion failed: "), "error", F.lit("*")))
    return rows.select(*keys, markdown_name(F.col("filename"), "mhtml2md").alias("filename"), text.alias("text"), "meta")

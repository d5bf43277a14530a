"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a skippable
frame that holds the seek table (the public seekable format). An index maps record ids to
bundle, frame and offset within the frame, so one record is read by decompressing one
frame.

Each task writes bundles under names of its own and returns the index rows; only
bundles that the committed index names count, so a repeated task leaves nothing behind that
is read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, folder_of, map_arrow, shared_dir

#: Uncompressed bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME = 1 << 20
BUNDLE = 128 << 20
#: Frames that a reading task opens on average.
FRAMES_PER_TASK = 32
#: Pieces into which the rows of one payload are dealt.
SALT = 32

# Fixed values of the seekable format.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_HEAD = "page_id long, bundle string, frame int, frame_at long, frame_bytes long, record_at long, record_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page, url: str | None, payload: bytes, first, date: str) -> bytes:
    """A response record, or with ``first`` a revisit of that page's payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if first is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if first is not None:
        head += [f"WARC-Refers-To: {_urn(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class Bundle:
    """Writes one bundle; ``add`` returns the record's frame and its offset within it."""

    def __init__(self, stream) -> None:
        self.stream, self.table, self.open, self.at = stream, [], [], 0
        self.waiting = 0
        self.squeeze = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, raw: bytes) -> tuple[int, int]:
        place = len(self.table), self.waiting
        self.open.append(raw)
        self.waiting += len(raw)
        return place

    def close_frame(self) -> tuple[int, int]:
        """Offset and size of the frame in the bundle."""
        packed = self.squeeze.compress(b"".join(self.open))
        self.stream.write(packed)
        self.table.append((len(packed), self.waiting))
        place = self.at, len(packed)
        self.at += len(packed)
        self.open, self.waiting = [], 0
        return place

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0, _SEEKABLE))
        self.stream.close()


def seek_table(raw_end: bytes) -> list[tuple[int, int]]:
    """Compressed and uncompressed sizes of the frames, from a bundle's last bytes."""
    n, _, magic = struct.unpack("<IBI", raw_end[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    entries = raw_end[-9 - 8 * n : -9]
    return [struct.unpack_from("<II", entries, 8 * k) for k in range(n)]


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) under ``path``; returns the index.

    ``path`` is a folder that all executors share: a local path or any URI that
    pyarrow's file systems know. The row with the smallest page_id among equal payloads
    becomes the response, the others revisit it; rows repeated with that page_id are all
    responses. Null html is an empty payload, a null url an empty one; null page_ids are
    written without a number, are never the smallest, and are responses if all ids of their
    payload are null; other columns are not read.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    firsts = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # A payload may be that of a third of all pages: its rows are dealt into pieces.
    firsts = firsts.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    rows = rows.join(firsts, ["sha", "salt"], "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id") == F.col("first"), None).otherwise(F.col("first")).alias("first")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = folder_of(path)
        fs.create_dir(root, recursive=True)
        out, name, waiting = None, "", []

        def closed() -> pa.RecordBatch:
            at, size = out.close_frame()
            rows = [(p, name, f, at, size, o, n) for p, f, o, n in waiting]
            waiting.clear()
            types = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], types[k]) for k in range(7)], names=[x.split()[0] for x in _HEAD.split(", ")]
            )

        for batch in batches:
            for page, url, payload, first in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = Bundle(fs.open_output_stream(f"{root}/{name}", compression=None))
                raw = record(page, url, payload, first, date)
                f, o = out.add(raw)
                waiting.append((page, f, o, len(raw)))
                if out.waiting >= frame:
                    yield closed()
                    if out.at >= bundle:
                        out.close()
                        out = None
        if out is not None:
            if waiting:
                yield closed()
            out.close()

    return cut(map_arrow(rows, run, _HEAD))


def read(index: DataFrame, path: str) -> DataFrame:
    """The records that ``index`` names: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    Each frame is fetched by its offset and decompressed once. A revisit has no payload
    of its own; its size and digest are those of the full one.
    """
    frames = index.groupBy("bundle", "frame_at", "frame_bytes").agg(F.sort_array(F.collect_list(F.struct("record_at", "record_bytes"))).alias("records"))
    # An index row stands for a megabyte to decompress, which its own size does not tell Spark.
    n = index.select("bundle", "frame_at").distinct().count()
    frames = frames.repartition(max(1, -(-n // FRAMES_PER_TASK)), "bundle", "frame_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = folder_of(path)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, at, size, records in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{root}/{bundle}") as f:
                    f.seek(at)
                    raw = unpack.decompress(f.read(size))
                rows = []
                for r in records:
                    fields, http, payload = parse(raw[r["record_at"] : r["record_at"] + r["record_bytes"]])
                    number = lambda urn: int(urn[10:-1]) if urn and urn[10:-1] else None
                    response = fields["WARC-Type"] == "response"
                    rows.append(
                        (
                            number(fields["WARC-Record-ID"]),
                            int(http["Content-Length"]),
                            digest(payload) if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                            fields["WARC-Type"],
                            number(fields.get("WARC-Refers-To")),
                            payload if response else None,
                        )
                    )
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(6)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return map_arrow(frames, run, schema)


def op7(pages: DataFrame) -> DataFrame:
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, path), path).drop("payload")


ORACLE = r"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
s as (select page_id, octet_length(b) as n, sha1(b) as h from p),
f as (select h, min(page_id) as first from s group by h),
bits as (select h, string_agg(lpad(bin(('0x' || substr(h, i, 5))::bigint), 20, '0'), '' order by i) as z from (select distinct h from s), unnest(range(1, 41, 5)) as t(i) group by h),
d as (select h, list_aggregate(list_transform(range(1, 161, 5), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(z, k, 5))::bigint, 1)), 'string_agg', '') as g from bits)
select page_id, n::bigint as payload_bytes, g as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from s join f using (h) join d using (h)
"""

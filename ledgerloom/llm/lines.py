"""Line deduplication with an edit bound, by deletion neighbourhoods.

A line is a sequence of units: words, or for lines of fewer than ``MIN_WORDS`` words the
characters of its words joined by spaces. Two lines of one kind within one edit (a unit replaced,
inserted or dropped) share a variant: the line itself or the line less one unit. Lines
emit hashed keys for their variants; lines with an equal variant are compared unit by
unit, and of two near-equal lines the later goes. Equal lines are merged first, so that
a line that occurs everywhere is one row.

The bound grows with the line: one word of at least ``MIN_WORDS``, one character of at least
``MIN_CHARS``; shorter lines, of which one edit makes another line ("Part 1", "Part 2"), have a
bound of none and are compared for equality.

A line of 40 words has 41 variants, so the join is preceded by a lossless sieve: of two lines
within one edit, either the first or the last half is equal unit for unit. Only lines that
share such a half with another line emit variants, and only those that drop a unit of
the other half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, fresh, map_arrow
from .hashing import scramble, word_hashes

#: Lines of so many words are compared by words, with a bound of one.
MIN_WORDS = 8
#: Lines of fewer words but so many characters are compared by characters, with a bound of one.
MIN_CHARS = 12
#: Units and variants that a worker gathers before it passes rows on, whatever the length of a line.
CHUNK = 1 << 19
EQUAL, BY_CHARS, BY_WORDS = range(3)
_WHITE = b" \t\n\r\x0b\x0c"
_BASE = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) <= n:
        out = np.empty(2 * n + 1, np.uint64)
        p = 1
        for i in range(len(out)):
            out[i] = p
            p = p * _BASE & _M
        _powers = out
    return _powers


def _inverse(n: int) -> np.ndarray:
    """Inverse powers of the base modulo 2**64."""
    global _inverses
    if len(_inverses) <= n:
        out = np.empty(2 * n + 1, np.uint64)
        p, q = 1, pow(_BASE, -1, 1 << 64)
        for i in range(len(out)):
            out[i] = p
            p = p * q & _M
        _inverses = out
    return _inverses


def units(line: bytes) -> tuple[int, list]:
    """Kind and units of a line: lower-case words, or the characters of its words joined by spaces."""
    words = line.split()
    if len(words) >= MIN_WORDS:
        return BY_WORDS, words
    text = b" ".join(words).decode()
    return (BY_CHARS if len(text) >= MIN_CHARS else EQUAL), list(text)


class Sequences:
    """Running polynomial hashes over the units of many lines at once."""

    def __init__(self, found: list, sizes: np.ndarray, kinds: np.ndarray) -> None:
        self.sizes, self.kinds = sizes, kinds.astype(np.uint64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        longest = int(sizes.max(initial=0))
        power, self.inverse = _power(longest), _inverse(longest)
        self.place = np.arange(len(found)) - np.repeat(self.start, sizes)
        self.run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes(found) * power[self.place], dtype=np.uint64)])

    def _mark(self, n: np.ndarray) -> np.ndarray:
        return (n.astype(np.uint64) << np.uint64(2)) | self.kinds

    def keys(self) -> np.ndarray:
        return scramble((self.run[self.end] - self.run[self.start]) ^ self._mark(self.sizes))

    def halves(self) -> np.ndarray:
        """Four hashes of halves for each line.

        Partners of a line of n units have n - 1, n or n + 1, and halves are taken of the
        shorter length, m = n - 1 or n: the first m // 2 units, or the last m - m // 2.
        """
        out = []
        for m in (self.sizes - 1, self.sizes):
            k = m // 2
            tail = self.sizes - (m - k)
            mark = self._mark(m) << np.uint64(1)
            out.append(scramble((self.run[self.start + k] - self.run[self.start]) ^ mark))
            out.append(scramble(((self.run[self.end] - self.run[self.start + tail]) * self.inverse[tail]) ^ mark ^ np.uint64(1)))
        return np.stack(out)

    def variants(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, line and dropped place of the variants that ``shared`` (a bit for each half) calls for."""
        line = np.repeat(np.arange(len(self.sizes)), self.sizes)
        n, bits, i = self.sizes[line], shared[line], self.place
        of_less, of_same = (n - 1) // 2, n // 2
        asked = ((bits & 1) > 0) & (i >= of_less) | ((bits & 2) > 0) & (i <= of_less)
        asked |= ((bits & 4) > 0) & (i >= of_same) | ((bits & 8) > 0) & (i < of_same)
        at = np.flatnonzero(asked)
        line, i = line[at], i[at]
        first, last = self.start[line], self.end[line]
        # Units after the dropped one move down by one power: the base has an inverse modulo 2**64.
        left = (self.run[first + i] - self.run[first]) + (self.run[last] - self.run[first + i + 1]) * self.inverse[1]
        return scramble(left ^ self._mark(self.sizes - 1)[line]), line, i


def within_one(x, y) -> bool:
    """Whether two sequences of units are within one edit."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    if len(x) == len(y):
        return x[i + 1 :] == y[i + 1 :]
    return x[i:] == y[i + 1 :]


def near(x: str, y: str) -> bool:
    """Whether two lines are of one kind and within its bound; words are runs of other than ASCII white space."""
    (kind, a), (other, b) = (units(t.encode("utf-8", "replace").lower()) for t in (x, y))
    return kind == other and (a == b or kind != EQUAL and within_one(a, b))


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split(b"\n")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> one row per line with a word: id, hash of the text, line number, key, halves of lines with a bound."""

    def packed(rows, found) -> pa.RecordBatch:
        ids, texts, numbers, sizes, kinds = rows
        kinds = np.array(kinds, np.int8)
        own = Sequences(found, np.array(sizes, np.int64), kinds)
        columns = [pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(numbers, pa.int32()), pa.array(own.keys().view(np.int64))]
        columns += [pa.array(np.ascontiguousarray(h).view(np.int64), mask=kinds == EQUAL) for h in own.halves()]
        return pa.RecordBatch.from_arrays(columns, names=["id", "own", "line", "key", "h0", "h1", "h2", "h3"])

    for batch in batches:
        rows, found = ([], [], [], [], []), []
        for doc, own, text in zip(*(c.to_pylist() for c in batch.columns)):
            for k, line in enumerate(_lines(text)):
                kind, parts = units(line)
                if parts:
                    for column, x in zip(rows, (doc, own, k, len(parts), kind)):
                        column.append(x)
                    found += parts
                    if len(found) >= CHUNK:
                        yield packed(rows, found)
                        rows, found = ([], [], [], [], []), []
        if found:
            yield packed(rows, found)


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, own, text, lines asked for as (line, key, shared)) -> a row per line with its words."""
    for batch in batches:
        rows = ([], [], [], [], [], [])
        for doc, own, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
            lines = _lines(text)
            for x in asked:
                words = b" ".join(lines[x["line"]].split()).decode()
                for column, value in zip(rows, (doc, own, x["line"], x["key"], x["shared"], words)):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
        names = ["id", "own", "line", "key", "shared", "words"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, own, line, shared, words) -> the line itself (place -1) and its variants."""

    def packed(rows, found, sizes, kinds) -> Iterator[pa.RecordBatch]:
        own = Sequences(found, np.array(sizes, np.int64), np.array(kinds, np.int8))
        hashes, at, places = own.variants(np.array(rows[-1], np.int64))
        hashes = np.concatenate([own.keys(), hashes]).view(np.int64)
        at = np.concatenate([np.arange(len(sizes)), at])
        places = np.concatenate([np.full(len(sizes), -1), places]).astype(np.int32)
        columns = [pa.array(np.array(c, k)) for c, k in zip(rows[:4], (np.int64, np.int64, np.int64, np.int32))]
        for k in range(0, len(at), CHUNK):
            some = pa.array(at[k : k + CHUNK])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[k : k + CHUNK]), pa.array(places[k : k + CHUNK]), *[c.take(some) for c in columns]],
                names=["variant", "place", "key", "id", "own", "line"],
            )

    for batch in batches:
        rows, found, sizes, kinds = ([], [], [], [], []), [], [], []
        for *row, words in zip(*(c.to_pylist() for c in batch.columns)):
            kind, parts = units(words.encode())
            for column, x in zip(rows, row):
                column.append(x)
            found += parts
            sizes.append(len(parts))
            kinds.append(kind)
            if len(found) >= CHUNK:
                yield from packed(rows, found, sizes, kinds)
                rows, found, sizes, kinds = ([], [], [], [], []), [], [], []
        if found:
            yield from packed(rows, found, sizes, kinds)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, x, y = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, a, b in zip(key, x, y) if near(a, b)], pa.int64())], names=["key"])


_NO_ID = -(2**63)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, with a number for null, ``own``, a hash of the text, and ``text``."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("own"),
        F.col(text_col).cast("string").alias("text"),
    )


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that keeps a line or loses one to a near-equal one: ``id``, ``own``, ``kept`` (line numbers), ``n_near``.

    A line goes if an earlier one, by id, then hash of the text, then line number, has the same
    words or is within its bound, be that one kept or not. Words are runs of other
    characters than ASCII white space, A-Z lower-cased. Lines without words are not listed;
    a null id (-2**63) comes first of all; rows with equal id and text are one document;
    rows with one id and different texts are documents of their own, with ``own`` their
    text's hash. Null and empty texts have no row; nor has an empty table.
    """
    docs = _identified(docs, id_col, text_col)
    with Tables(docs.sparkSession) as tables:
        rows = map_arrow(docs, _split, "id long, own long, line int, key long, h0 long, h1 long, h2 long, h3 long")
        halves = ["h0", "h1", "h2", "h3"]
        # The halves follow from the key.
        distinct = tables.write(rows.groupBy("key").agg(F.min(F.struct("id", "own", "line")).alias("first"), *[F.min(h).alias(h) for h in halves]))
        each = distinct.where("h0 is not null").select("key", F.posexplode(F.array(*halves)).alias("side", "half"))
        shared = each.groupBy("half").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("half")
        shared = tables.write(shared)
        sides = each.join(shared, "half").groupBy("key").agg(F.bit_or(F.expr("shiftleft(1, side)")).alias("shared"))
        wanted = distinct.select("key", "first").join(sides, "key").select("first.*", "key", "shared")
        # Fetch the words of each wanted line from its first occurrence.
        asked = wanted.groupBy("id", "own").agg(F.collect_list(F.struct("line", "key", "shared")).alias("asked"))
        texts = docs.join(asked, ["id", "own"]).select("id", "own", "text", "asked")
        words = tables.write(map_arrow(texts, _texts_of, "id long, own long, line int, key long, shared int, words string"))
        gone = _near(tables, words)
        lines = distinct.select("key", "first").join(gone.withColumn("gone", F.lit(True)), "key", "left").select("first.*", "gone")
        return tables.keep(
            lines.groupBy("id", "own").agg(
                F.sort_array(F.collect_list(F.when(F.col("gone").isNull(), F.col("line")))).alias("kept"), F.count("gone").alias("n_near")
            )
        )


def _near(tables: Tables, words: DataFrame) -> DataFrame:
    """Keys of the lines that have an earlier one within their bound.

    Lines that drop a unit at one place and agree in the rest are all within one replacement of
    each other, so the earliest of them settles the others. A line that another one becomes by
    dropping a unit is within one insertion of it; as each line occurs once, that join is
    linear too. No other two lines are within one edit. Variants are counted first, with
    partial counts, so that only those that occur twice are joined, and a variant that a
    third of all lines have is split as any large side of a join.
    """
    rows = words.select("key", "id", "own", "line", "shared", "words")
    variants = map_arrow(rows, _variants, "variant long, place int, key long, id long, own long, line int")
    often = variants.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1").select("variant")
    met = tables.write(variants.join(often, "variant").withColumn("first", F.struct("id", "own", "line")).drop("id", "own", "line"))
    dropped = met.where("place >= 0")
    lead = dropped.groupBy("variant", "place").agg(F.min(F.struct("first", "key")).alias("lead"))
    replaced = dropped.join(lead, ["variant", "place"]).where("lead.key <> key").select("key", F.col("lead.key").alias("rival"))
    whole = met.where("place < 0").select("variant", F.col("key").alias("whole"), F.col("first").alias("whole_first"))
    later = F.col("whole_first") < F.col("first")
    inserted = dropped.join(whole, "variant").select(
        F.when(later, F.col("key")).otherwise(F.col("whole")).alias("key"), F.when(later, F.col("whole")).otherwise(F.col("key")).alias("rival")
    )
    pairs = replaced.union(inserted).distinct().join(words.select("key", "words"), "key")
    pairs = pairs.join(words.select(F.col("key").alias("rival"), F.col("words").alias("others")), "rival")
    return tables.write(map_arrow(pairs.select("key", "words", "others"), _confirmed, "key long").distinct())


def _with_lines(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the text left, and columns n_lines, n_kept, n_near under names that are free."""
    names = {x: fresh(docs, f"{x}_") for x in ("id", "own", "kept", "n_lines", "n_near", "n_kept")}
    found = repeated_lines(docs, id_col, text_col)
    found = found.select(*[F.col(x).alias(names[x]) for x in ("id", "own", "kept", "n_near")])
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)) == found[names["id"]]) & (F.xxhash64(docs[text_col].cast("string")) == found[names["own"]])
    joined = docs.join(found, same, "left").drop(names["id"], names["own"])
    joined = joined.withColumns({names["n_lines"]: F.lit(0).cast("long"), names["n_kept"]: F.lit(0).cast("long")})
    at, kept_at, lines_at, left_at = (joined.columns.index(x) for x in (text_col, *(names[x] for x in ("kept", "n_lines", "n_kept"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = _WHITE.decode()
        for batch in batches:
            texts, n_lines, n_kept = [], [], []
            for text, kept in zip(batch.column(at).to_pylist(), batch.column(kept_at).to_pylist()):
                kept = set(kept or ())
                lines = (text or "").split("\n")
                full = [bool(x.strip(white)) for x in lines]
                if text:
                    text = "\n".join(x for k, x in enumerate(lines) if k in kept or not full[k])
                texts.append(text)
                n_lines.append(sum(full))
                n_kept.append(len(kept))
            for k, column in ((at, pa.array(texts, pa.string())), (lines_at, pa.array(n_lines, pa.int64())), (left_at, pa.array(n_kept, pa.int64()))):
                batch = batch.set_column(k, batch.schema.names[k], column)
            yield batch

    return map_arrow(joined, run, joined.schema), names


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of their texts, all other columns as they are.

    Lines without words stay. Documents that had words and lose every line go, as all they
    held stays elsewhere; null and empty texts stay. See ``repeated_lines`` for which lines
    go, repeated ids and nulls.
    """
    left, names = _with_lines(docs, id_col, text_col)
    return left.where((F.col(names["n_lines"]) == 0) | (F.col(names["n_kept"]) > 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4(docs: DataFrame) -> DataFrame:
    """Per document: lines with words, those kept, those that went for a near-equal line, digest of the text left.

    Null and empty texts have no lines; see ``repeated_lines`` for the rest.
    """
    left, names = _with_lines(docs.select("doc_id", "text"), "doc_id", "text")
    count = lambda x: F.coalesce(F.col(names[x]), F.lit(0)).cast("long").alias(x)
    return left.select(F.col("doc_id").cast("long").alias("doc_id"), count("n_lines"), count("n_kept"), count("n_near"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))

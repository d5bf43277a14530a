"""Document quality: fixed rules, then the perplexity of a modified Kneser-Ney model.

The model counts word bigrams of all documents, cased, and grows with them. No task holds
it whole: each chunk of documents sends its distinct bigrams, as sorted hashes, to the
buckets that hold the totals, and each bucket sends the totals back in the order asked;
words go the same way for what their contexts and continuations need. A chunk's answers,
sorted arrays beside its own sorted hashes, are all that it needs to be scored. Every
occurrence is scored as if it had not been counted itself, so that words which only one
document has are as improbable as they are elsewhere. Log perplexities form a histogram
per language, whose quartiles set a lower and an upper limit for that language.

A chunk is a run of rows of an input partition. Documents are read two or three times, and must
come in the same partitions each time, as they do from files; an input that a plan shuffles
is written to a table first. A sum over each chunk is compared, so an input that
changes none the less is an error.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Tables, folder_of, map_arrow, release, shared_dir, small
from .hashing import distinct, mix, text_hashes, unmix

#: Characters of text that make a chunk; a longer text is a chunk of its own.
CHUNK = 1 << 25
#: Bytes of text for each bucket of the model.
BUCKET_BYTES = 16 << 20
#: A language's band extends beyond each quartile by so many times that quartile's distance from the median.
SPREAD = 5.0
#: Further width in nats, divided by the root of a document's words: means of short texts scatter more.
MARGIN = 2.0
#: Bits of a word's hash; a bigram has twice as many.
WORD_BITS = 30
#: Histogram bins per nat.
BINS = 1000
MIN_WORDS = 50
REPEATED_PERCENT = 50

_WHITE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
#: Kinds of messages: totals of bigrams, figures of words, a chunk's sum, parts of words' figures, scalars.
PAIRS, WORDS, CHECK, PARTS, SCALARS = range(5)
_MESSAGE = "kind byte, bucket int, chunk long, keys binary, data binary"
_FIELDS = _MESSAGE.replace(" byte", "").replace(" int", "").replace(" long", "").replace(" binary", "").split(", ")
_TYPES = [pa.int8(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def word_ids(text: str) -> np.ndarray:
    """Hashes of the words of a text, none 0, which stands for its start."""
    return np.maximum(text_hashes(text.encode("utf-8", "replace"), cased=True) >> np.uint64(64 - WORD_BITS), np.uint64(1)).astype(np.uint32)


class Chunk:
    """Documents that ask together: the words of each; hashes of their bigrams are made as they are needed."""

    def __init__(self, number: int) -> None:
        self.number, self.docs, self.size = number, [], 0

    def add(self, text: str) -> None:
        self.docs.append(word_ids(text))
        self.size += len(text) + 1

    def close(self) -> Chunk:
        self.sizes = np.array([len(d) for d in self.docs], np.int64)
        self.words = np.concatenate([np.empty(0, np.uint32), *self.docs])
        self.docs = []
        self.starts = np.zeros(len(self.words), bool)
        self.starts[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = True
        pairs = self.pairs()
        self.check = int(np.bitwise_xor.reduce(pairs, initial=np.uint64(len(self.sizes))).view(np.int64))
        return self

    def pairs(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Hashes of the bigrams that end at the words from ``first`` to ``last``."""
        words, starts = self.words[first:last], self.starts[first:last]
        before = np.zeros(len(words), np.uint64)
        before[1:] = words[:-1]
        if first and len(words):
            before[0] = self.words[first - 1]
        before[starts] = 0
        return mix(before << np.uint64(WORD_BITS) | words, 2 * WORD_BITS)

    def distinct_words(self) -> np.ndarray:
        return distinct(np.append(self.words, np.uint32(0)))


def packed(values: np.ndarray) -> bytes:
    """Numbers column by column and byte by byte, highest bytes last, compressed: small numbers take little."""
    planes = np.ascontiguousarray(values.astype("<i8").reshape(len(values), -1).T).view(np.uint8).reshape(-1, 8)
    return zstandard.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def unpacked(blob: bytes, columns: int = 1) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view("<i8").reshape(columns, -1)
    return np.ascontiguousarray(values.T) if columns > 1 else values[0]


def packed_sorted(values: np.ndarray, floor: int) -> bytes:
    """Sorted numbers of 64 bits from ``floor`` on, as steps."""
    return packed(np.diff(values, prepend=np.uint64(floor)).view(np.int64))


def unpacked_sorted(blob: bytes, floor: int) -> np.ndarray:
    return np.cumsum(unpacked(blob).view(np.uint64), dtype=np.uint64) + np.uint64(floor)


def chunks(texts: Iterator[str | None], chunk: int) -> Iterator[tuple[int, Chunk | None]]:
    """Numbers the chunk of each text; with the last text of a chunk comes the chunk itself.

    As the last of all texts is known only behind it, a chunk that is not full comes alone, with number -1.
    """
    context = TaskContext.get()
    own = Chunk((context.partitionId() if context else 0) << 24)
    for text in texts:
        own.add(text or "")
        number, full = own.number, own.size >= chunk
        yield number, own.close() if full else None
        if full:
            own = Chunk(number + 1)
    if own.docs:
        yield -1, own.close()


def _slices(values: np.ndarray, bits: int, width: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted values by their first ``bits`` of ``width``."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)
    at = [0, *np.searchsorted(values, edges).tolist(), len(values)]
    return [(k, a, b) for k, (a, b) in enumerate(zip(at, at[1:])) if b > a]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names=_FIELDS)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs; sorts ``x`` itself."""
    x.sort()
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
    return x[starts], np.diff(np.append(starts, len(x)))


def _ask(bits: int, chunk: int):
    """Texts -> what each chunk asks: bigrams with their counts, and words, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in chunks((x for batch in batches for x in batch.column(0).to_pylist()), chunk):
            if own is None:
                continue
            pairs, n = _counted(own.pairs())
            rows = [(PAIRS, k, own.number, packed_sorted(pairs[a:b], k << (2 * WORD_BITS - bits)), packed(n[a:b])) for k, a, b in _slices(pairs, bits, 2 * WORD_BITS)]
            words = own.distinct_words()
            rows += [(WORDS, k, own.number, packed_sorted(words[a:b].astype(np.uint64), k << (WORD_BITS - bits)), None) for k, a, b in _slices(words, bits, WORD_BITS)]
            rows.append((CHECK, 0, own.number, None, packed(np.array([own.check]))))
            yield _packed(rows)

    return run


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts, starts of equal runs in it, and the distinct keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), ordered[1:] != ordered[:-1]]))
    return order, starts, ordered[starts]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _tally(n: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(n == k)) for k in (1, 2, 3, 4)]


def _total_pairs(bits: int):
    """One bucket of bigrams: answers totals to every chunk, and parts of the figures of their words."""

    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        if kind != PAIRS:
            return table
        asked = [unpacked_sorted(x, bucket << (2 * WORD_BITS - bits)) for x in table.column("keys").to_pylist()]
        keys, sizes = np.concatenate(asked), np.array([len(x) for x in asked])
        del asked
        counts = np.concatenate([unpacked(x) for x in table.column("data").to_pylist()])
        order, starts, found = _grouped(keys)
        totals = _sums(counts[order], starts)
        answer = np.empty(len(keys), np.int64)
        answer[order] = np.repeat(totals, np.diff(np.append(starts, len(keys))))
        ends = np.cumsum(sizes)
        rows = [(PAIRS, bucket, c, None, packed(answer[e - n : e])) for c, e, n in zip(table.column("chunk").to_pylist(), ends, sizes)]
        both = unmix(found, 2 * WORD_BITS)
        before, word = both >> np.uint64(WORD_BITS), both & np.uint64((1 << WORD_BITS) - 1)
        figures = np.zeros((2 * len(found), 5), np.int64)
        figures[: len(found), 0] = totals
        for k in (1, 2, 3):
            figures[: len(found), k] = (totals == k) if k < 3 else (totals >= 3)
        figures[len(found) :, 4] = 1
        order, starts, names = _grouped(np.concatenate([before, word]))
        figures = np.add.reduceat(figures[order], starts) if len(starts) else figures[:0]
        rows += [(PARTS, k, 0, packed_sorted(names[a:b], k << (WORD_BITS - bits)), packed(figures[a:b])) for k, a, b in _slices(names, bits, WORD_BITS)]
        rows.append((SCALARS, 0, 0, None, packed(np.array([*_tally(totals), len(found), 0]))))
        del keys, counts, order, answer, both, before, word, figures, names
        release()
        return pa.Table.from_batches([_packed(rows)])

    return run


def _total_words(bits: int):
    """One bucket of words: sums the parts of their figures, and answers every chunk."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        kinds = np.array(table.column("kind").to_pylist())
        parts, asked = table.filter(pa.array(kinds == PARTS)), table.filter(pa.array(kinds == WORDS))
        names = [unpacked_sorted(x, bucket << (WORD_BITS - bits)) for x in parts.column("keys").to_pylist()]
        figures = [unpacked(x, 5) for x in parts.column("data").to_pylist()]
        order, starts, names = _grouped(np.concatenate([np.empty(0, np.uint64), *names]))
        figures = np.concatenate([np.empty((0, 5), np.int64), *figures])
        figures = np.add.reduceat(figures[order], starts) if len(starts) else figures
        rows = []
        for chunk, blob in zip(asked.column("chunk").to_pylist(), asked.column("keys").to_pylist()):
            at = np.searchsorted(names, unpacked_sorted(blob, bucket << (WORD_BITS - bits)))
            # A word that only starts nothing and follows nothing is in no bigram: the start of no text.
            answer = np.concatenate([figures, np.zeros((1, 5), np.int64)])[at]
            rows.append((WORDS, bucket, chunk, None, packed(answer)))
        n = figures[:, 4]
        rows.append((SCALARS, 1, 0, None, packed(np.array([*_tally(n), np.count_nonzero(n), n.sum()]))))
        return pa.Table.from_batches([_packed(rows)])

    return run


def _discounts(tally: list[int]) -> np.ndarray:
    """Discounts for counts 1, 2 and 3 or more (Chen and Goodman, 1999)."""
    t = [float(x) for x in tally]
    if not all(t):  # too little text to estimate them
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = t[0] / (t[0] + 2 * t[1])
    return np.clip([0.0, 1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]], 0.0, [0, 0.999, 1.999, 2.999])


class Model:
    """What all chunks share: discounts of bigram counts and of words' kinds of contexts, and totals."""

    def __init__(self, pairs: list[int], words: list[int]) -> None:
        self.of_pairs, self.of_words = _discounts(pairs[:4]), _discounts(words[:4])
        self.n_words, self.kinds = max(1, words[4]), max(1, words[5])
        d = self.of_words
        self.spare = (d[1] * words[0] + d[2] * words[1] + d[3] * max(0, words[4] - words[0] - words[1])) / self.kinds

    def logs(self, count: np.ndarray, before: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Log probabilities of occurrences, each left out of the counts.

        ``count`` is the bigram's, ``before`` the first word's figures (count, followers seen once, twice, more
        often), ``kinds`` the number of words that the second one follows.
        """
        left = count - 1
        context = before[:, 0] - 1
        known = context > 0
        seen = np.maximum(left - self.of_pairs[np.minimum(left, 3)], 0) / np.maximum(context, 1)
        back = np.where(known, before[:, 1:4] @ self.of_pairs[1:] / np.maximum(before[:, 0], 1), 1.0)
        others = kinds - (count == 1)
        lower = np.maximum(others - self.of_words[np.minimum(others, 3)], 0) / self.kinds + self.spare / self.n_words
        return np.log(np.where(known, seen, 0) + back * np.maximum(lower, 1e-12))

    def score(self, own: Chunk, totals: np.ndarray, figures: np.ndarray) -> np.ndarray:
        """Mean log perplexity of each document of a chunk, by the answers to it; 0 without words."""
        pairs, words = _counted(own.pairs())[0], own.distinct_words()
        if (len(pairs), len(words)) != (len(totals), len(figures)):
            raise RuntimeError(_CHANGED)
        run, last = np.zeros(len(own.words) + 1), 0
        for k in range(0, len(own.words), _STEP):
            end = min(k + _STEP, len(own.words))
            place = np.searchsorted(words, own.words[k:end])
            before = np.append(last, place[:-1])
            last = place[-1]
            before[own.starts[k:end]] = 0
            count = totals[np.searchsorted(pairs, own.pairs(k, end))].astype(np.int64)
            run[k + 1 : end + 1] = self.logs(count, figures[before], figures[place, 4])
        np.cumsum(run, out=run)
        ends = np.cumsum(own.sizes)
        return -(run[ends] - run[ends - own.sizes]) / np.maximum(own.sizes, 1)


_CHANGED = "the documents came in other partitions than before; write them to a table first"
#: Words that are scored at once.
_STEP = 1 << 19


class Answers:
    """Reads a chunk's answers from the shared folder."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = folder_of(path)

    def of(self, own: Chunk) -> tuple[np.ndarray, np.ndarray]:
        rows = self.rows(own.number)
        blobs = lambda kind: [r["data"] for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["bucket"])]
        if int(unpacked(blobs(CHECK)[0])[0]) != own.check:
            raise RuntimeError(_CHANGED)
        totals = np.concatenate([np.empty(0, np.uint32), *[np.minimum(unpacked(x), 0xFFFFFFFF).astype(np.uint32) for x in blobs(PAIRS)]])
        return totals, np.concatenate([np.empty((0, 5), np.int64), *[unpacked(x, 5) for x in blobs(WORDS)]])

    def rows(self, number: int) -> list[dict]:
        place = f"{self.root}/chunk={number}"
        if self.fs.get_file_info(place).type == pa.fs.FileType.NotFound:
            raise RuntimeError(_CHANGED)
        found = [f.path for f in self.fs.get_file_info(pa.fs.FileSelector(place)) if f.path.endswith(".parquet")]
        return [r for f in sorted(found) for r in pq.ParquetFile(self.fs.open_input_file(f)).read().to_pylist()]


def fit(tables: Tables, texts: DataFrame) -> tuple[Model, str]:
    """The model's shared figures, and the folder of the answers to each chunk of a one-column frame of texts."""
    total = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    bits = max(3, int(total // BUCKET_BYTES).bit_length())
    asked = map_arrow(texts, _ask(bits, CHUNK), _MESSAGE)
    first = tables.write(asked.groupBy("kind", "bucket").applyInArrow(_total_pairs(bits), _MESSAGE))
    words = first.where(F.col("kind").isin(WORDS, PARTS)).groupBy("bucket").applyInArrow(_total_words(bits), _MESSAGE)
    second = tables.write(words)
    both = first.where(F.col("kind").isin(PAIRS, CHECK)).unionByName(second.where(F.col("kind") == WORDS)).select("kind", "bucket", "chunk", "data")
    path = tables.folder()
    both.repartition("chunk").write.partitionBy("chunk").option("compression", "zstd").parquet(path)
    sums = [[0] * 6, [0] * 6]
    # A row of six numbers for each bucket.
    for r in first.unionByName(second).where(F.col("kind") == SCALARS).select("bucket", "data").toLocalIterator():
        sums[r["bucket"]] = [a + int(b) for a, b in zip(sums[r["bucket"]], unpacked(r["data"]))]
    tables.drop(first)
    tables.drop(second)
    return Model(*sums), path


def rules(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    white = len(raw) - len(raw.translate(None, _WHITE))
    marks = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_WHITE)]
    repeated = 0
    n = len(words)
    if n >= 4:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        if len(ids) < n:
            m = len(ids) + 1
            if m < 2_000_000:
                keys = (w[:-2] * m + w[1:-1]) * m + w[2:]
            else:
                pair = np.unique(w[:-2] * m + w[1:-1], return_inverse=True)[1]
                keys = pair * m + w[2:]
            _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
            at = np.flatnonzero(count[place] > 1)
            if len(at):
                hit = np.zeros(n, bool)
                for j in range(3):
                    hit[at + j] = True
                repeated = int(hit.sum())
    return n, len(text) - white, marks, len(lines) - len(set(lines)), repeated


_FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"]


def _scored(docs: DataFrame, model: Model, path: str) -> DataFrame:
    """(chunk, place in it, id, lang, the rules' figures, log perplexity) of (id, lang, text)."""
    shared, chunk = docs.sparkSession.sparkContext.broadcast(model), CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, held = Answers(path), []

        def texts() -> Iterator[str | None]:
            for batch in batches:
                for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                    held.append((doc, lang, *rules(text or "")))
                    yield text

        for _, own in chunks(texts(), chunk):
            if own is None:
                continue
            logs = np.round(shared.value.score(own, *answers.of(own)), 6)
            columns = [pa.array(np.full(len(held), own.number)), pa.array(np.arange(len(held), dtype=np.int32))]
            columns += [pa.array([r[k] for r in held], t) for k, t in enumerate([pa.int64(), pa.string(), *[pa.int64()] * 5])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(logs, pa.float64())], names=["chunk", "place", "id", "lang", *_FIGURES])
            held.clear()

    figures = ", ".join(f"{x} {'double' if x == 'log_perplexity' else 'long'}" for x in _FIGURES)
    return map_arrow(docs, run, f"chunk long, place int, id long, lang string, {figures}")


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat_words) > REPEATED_PERCENT * F.col(n_words))


def _in_band(log_perplexity: str, n_words: str, low: str, high: str) -> Column:
    scatter = MARGIN / F.sqrt(F.greatest(F.col(n_words), F.lit(1)))
    return F.coalesce(F.col(log_perplexity).between(F.col(low) - scatter, F.col(high) + scatter), F.lit(False))


def bands(scored: DataFrame) -> DataFrame:
    """Per language ``low`` and ``high``, from exact quartiles of the binned log perplexities."""
    bins = scored.where("not base_failed").select("lang", F.floor(F.col("log_perplexity") * BINS).alias("bin"))
    bins = bins.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(W.partitionBy("lang").orderBy("bin"))
    whole = F.sum("n").over(W.partitionBy("lang"))
    bins = bins.select("lang", "bin", up_to.alias("up_to"), whole.alias("whole"))
    quartile = lambda k: F.min(F.when(4 * F.col("up_to") >= k * F.col("whole"), F.col("bin"))) / BINS
    beyond = lambda q: F.col(q) + SPREAD * (F.col(q) - F.col("q2"))
    quartiles = bins.groupBy("lang").agg(*[quartile(k).alias(f"q{k}") for k in (1, 2, 3)])
    return quartiles.select("lang", beyond("q1").alias("low"), beyond("q3").alias("high"))


def steady(tables: Tables, docs: DataFrame) -> DataFrame:
    """``docs``, or where its plan shuffles, a written table of it, whose partitions are the same each time."""
    plan = docs._jdf.queryExecution().sparkPlan().toString()
    return tables.keep(docs) if re.search("Exchange|Join|Aggregate|Sort|Window|Limit|Repartition|Coalesce|Sample|Cartesian", plan) else docs


def _judged(tables: Tables, docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """All figures of all documents, with their bands and ``kept``, on a written table."""
    docs = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    model, path = fit(tables, docs.select("text"))
    scored = tables.keep(_scored(docs, model, path).withColumn("base_failed", base_failed()))
    limits, _ = small(bands(scored))
    return scored.join(limits, "lang", "left").withColumn("kept", ~F.col("base_failed") & _in_band("log_perplexity", "n_words", "low", "high"))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, the rules' figures, ``base_failed``, ``log_perplexity``, ``low``, ``high``, ``kept``.

    A document is kept if the rules pass and its perplexity lies in its language's band.
    Null and empty texts have no words and fail, with a log perplexity of 0; a null language is a language of its
    own; repeated rows count as often as they occur; an empty table gives no rows;
    other columns are not read.
    """
    with Tables(docs.sparkSession) as tables:
        judged = _judged(tables, steady(tables, docs.select(id_col, lang_col, text_col)), id_col, text_col, lang_col)
    return judged.select(F.col("id").alias(id_col), *_FIGURES[:5], "base_failed", "log_perplexity", "low", "high", "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns.

    The texts are not shuffled: each chunk reads the decisions about its rows, in their order.
    """
    spark = docs.sparkSession
    with Tables(spark) as tables:
        docs = steady(tables, docs)
        judged = _judged(tables, docs, id_col, text_col, lang_col)
        path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
        flags = judged.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "kept"))), lambda x: x["kept"]).alias("kept"))
        flags.repartition("chunk").write.partitionBy("chunk").parquet(path)
    at, chunk = docs.columns.index(text_col), CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, number, size, own, place = Answers(path), TaskContext.get().partitionId() << 24, 0, None, 0
        for batch in batches:
            keep = []
            for text in batch.column(at).to_pylist():
                if own is None:
                    own, place = [x for r in answers.rows(number) for x in r["kept"]], 0
                if place >= len(own):
                    raise RuntimeError(_CHANGED)
                keep.append(own[place])
                place += 1
                size += len(text or "") + 1
                if size >= chunk:
                    number, size, own = number + 1, 0, None
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def op10(docs: DataFrame) -> DataFrame:
    """Per document the rules' figures and whether it is kept; see ``assess`` for awkward rows."""
    return assess(docs)

"""Jaccard similarity join over word shingles (prefix filtering, after PPJoin+).

Shingles are ordered rare-first by the corpus frequency of their hash bucket. Two sets
of similarity ``t`` must share a gram within their prefixes, so documents meet only on
prefix grams; length, positional and suffix filters discard pairs before the exact
verification, which each pair passes once.

Groups of copies are not expanded: equal texts share one key, and within a gram every
document is first paired with the gram's centre (the one with the fewest rarer grams).
Only what those links leave in different components is then paired in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Tables, components, fresh, map_arrow, small
from .hashing import distinct, gram_hashes, scramble, text_hashes

SHINGLE = 5
#: Similarity bound in hundredths.
PERCENT = 80
#: Grams are ordered by the corpus frequency of a hash bucket, the last so many bits: a megabyte, whatever the corpus.
BITS = 16
BUCKETS = 1 << BITS
#: Bins of the suffix filter: in how many of a set's grams each value of six hash bits occurs, at most 65535.
BINS = 64
#: Earlier meetings that a row knows of, so that a pair is not formed again.
EARLIER = 32
#: Grams that a worker gathers before it passes rows on, whatever the length of texts.
CHUNK = 1 << 20


_places = scramble(np.arange(1, 1 << 16, dtype=np.uint64))


def shingles(text: str | None, size: int) -> tuple[int, np.ndarray]:
    """Key of the word sequence (0: no words) and the sorted distinct shingle hashes."""
    global _places
    h = text_hashes((text or "").encode("utf-8", "replace"))
    if not len(h):
        return 0, h
    if len(h) > len(_places):
        _places = scramble(np.arange(1, 2 * len(h), dtype=np.uint64))
    place = _places[: len(h)]
    key = np.bitwise_xor.reduce((h ^ place) * (place | np.uint64(1))) ^ np.uint64(len(h))
    return int(scramble(np.array([key]))[0]) or 1, distinct(gram_hashes(h, min(size, len(h))))


def ranks(frequency: np.ndarray) -> np.ndarray:
    """Place of each bucket in order of frequency."""
    order = np.lexsort((np.arange(len(frequency)), frequency))
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64)
    return rank


def rarest(own: np.ndarray, length: int, rank: np.ndarray) -> np.ndarray:
    """The ``length`` first grams by rank of the bucket, then by hash, as distinct numbers in that order.

    The rank takes the place of the bucket's bits and stands in front of the others.
    """
    bits = np.uint64(len(rank).bit_length() - 1)
    packed = (rank[(own & np.uint64(len(rank) - 1)).astype(np.int64)] << (np.uint64(64) - bits)) | (own >> bits)
    if length < len(packed):
        packed = np.partition(packed, length - 1)[:length]
    return np.sort(packed)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _profile(size: int):
    """Documents -> (kind 0: id, key, n, bins) and, per task, (kind 1: bucket, -, frequency, -)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            keys, ns, bins, found, held = [], [], [], [np.empty(0, np.uint64)], 0
            for text in batch.column(1):
                key, grams = shingles(text.as_py(), size)
                keys.append(key)
                ns.append(len(grams))
                bins.append(np.minimum(np.bincount((grams >> np.uint64(58)).astype(np.int64), minlength=BINS), 65535).astype("<u2").tobytes())
                found.append(grams & np.uint64(BUCKETS - 1))
                held += len(grams)
                if held >= CHUNK:
                    counts += np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS)
                    found, held = [np.empty(0, np.uint64)], 0
            counts += np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(keys), np.int8)), batch.column(0), pa.array(_signed(np.array(keys, np.uint64))), pa.array(np.array(ns, np.int64)), pa.array(bins, pa.binary())],
                names=["kind", "id", "key", "n", "bins"],
            )
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(seen), np.int8)), pa.array(seen.astype(np.int64)), pa.array(np.zeros(len(seen), np.int64)), pa.array(counts[seen]), pa.nulls(len(seen), pa.binary())],
            names=["kind", "id", "key", "n", "bins"],
        )

    return run


def _prefixes(size: int, percent: int, order):
    """Documents -> their prefix grams, once per task for equal word sequences; ``gram`` sorts rare-first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(columns) -> pa.RecordBatch:
            grams, keys, ns, places = map(np.concatenate, columns)
            return pa.RecordBatch.from_arrays(
                [pa.array(_signed(grams ^ np.uint64(1 << 63))), pa.array(_signed(keys)), pa.array(ns), pa.array(places)], names=["gram", "key", "n", "place"]
            )

        by_rank, seen = order.value, set()
        for batch in batches:
            columns, held = ([], [], [], []), 0
            for text in batch.column(0):
                key, own = shingles(text.as_py(), size)
                if not len(own) or key in seen:
                    continue
                seen.add(key)
                n = len(own)
                length = n - -(-percent * n // 100) + 1
                mine = (rarest(own, length, by_rank), np.full(length, key, np.uint64), np.full(length, n, np.int32), np.arange(length, dtype=np.int32))
                for column, x in zip(columns, mine):
                    column.append(x)
                held += length
                if held >= CHUNK:
                    yield packed(columns)
                    columns, held = ([], [], [], []), 0
            if held:
                yield packed(columns)

    return run


def _sets(size: int):
    """(centre, key, text) -> (centre, key, grams); rows whose text has another key go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(centres, keys, sets) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(centres, pa.int64()), pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["centre", "key", "grams"]
            )

        seen = set()
        for batch in batches:
            rows, held = ([], [], []), 0
            for centre, wanted, text in zip(*(batch.column(k) for k in range(3))):
                centre, wanted = centre.as_py(), wanted.as_py()
                if (centre, wanted) in seen:
                    continue
                key, own = shingles(text.as_py(), size)
                if int(np.uint64(key).view(np.int64)) != wanted:
                    continue
                seen.add((centre, wanted))
                for column, x in zip(rows, (centre, wanted, _signed(own))):
                    column.append(x)
                held += len(own)
                if held >= CHUNK:
                    yield packed(*rows)
                    rows, held = ([], [], []), 0
            if rows[0]:
                yield packed(*rows)

    return run


def _suffix(percent: int):
    """(centre, key, sizes n and m, bins p and q) -> the pairs that the bins don't rule out.

    |x - y| + |y - x| = n + m - 2 * overlap is at least the difference of the bins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            p, q = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, BINS).astype(np.int32) for k in (4, 5))
            apart = np.abs(p - q).sum(1)
            yield batch.select([0, 1]).filter(pa.array((100 + percent) * (both - apart) >= 2 * percent * both))

    return run


def _may_link(n: Column, place: Column, m: Column, other: Column, percent: int) -> Column:
    """Length filter and positional filter; the overlap needed is t / (1 + t) of both sizes."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (
        (100 + percent) * F.least(n - place, m - other) >= percent * (n + m)
    )


def _verified(tables: Tables, pairs: DataFrame, texts: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (centre, key) whose similarity reaches the bound; suffix filter, then intersection.

    The filter sees two sizes and 128 bytes of bins for each text. Only texts of pairs that
    pass are found, by one id of their key, and sent to their centres as sets. The
    ids are broadcast if their counted rows are within the bound.
    """
    ends = [texts.select(F.col("key").alias(k), F.col("n").alias(n), F.col("bins").alias(b)) for k, n, b in (("centre", "n", "p"), ("key", "m", "q"))]
    both_bins = pairs.join(ends[0], "centre").join(ends[1], "key").select("centre", "key", "n", "m", "p", "q")
    pairs = tables.write(map_arrow(both_bins, _suffix(percent), "centre long, key long"))
    both_ends = pairs.union(pairs.select("centre", F.col("centre").alias("key")).distinct())
    ids, _ = small(tables.write(both_ends.join(texts.select("key", "wanted"), "key").select("wanted", "centre", "key")))
    asked = docs.join(ids, F.expr("id <=> wanted")).select("centre", "key", "text")
    sets = map_arrow(asked, _sets(size), "centre long, key long, grams array<long>")
    left = sets.where("key <> centre").select("centre", "key", F.col("grams").alias("x"))
    right = sets.where("key = centre").select("centre", F.col("grams").alias("y"))
    both, overlap = F.size("x") + F.size("y"), F.size(F.array_intersect("x", "y"))
    linked = left.join(right, "centre").where(100 * overlap >= percent * (both - overlap))
    return tables.write(linked.select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct())


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``key`` of its word sequence, ``n_shingles``, ``component_id``.

    Documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100
    are linked; ``component_id`` is the smallest id that links reach. Null and empty
    texts have no shingles and link with nothing (key 0), not even each other; a text of
    fewer than ``size`` words is one shingle; equal texts, repeated rows included, are
    linked; null ids are never the smallest (a component of nothing else has a null
    id); other columns are not read; an empty table gives no rows.

    Word sequences and shingles are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with Tables(spark) as tables:
        profile = tables.keep(map_arrow(docs, _profile(size), "kind byte, id long, key long, n long, bins binary"))
        rows = profile.where("kind = 0").select("id", "key", "n")

        frequency = np.zeros(BUCKETS, np.int64)
        counted = profile.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row for each bucket
        frequency[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
        texts = profile.where("kind = 0 and key <> 0").groupBy("key").agg(F.min("id").alias("wanted"), F.first("n").alias("n"), F.first("bins").alias("bins"))
        labels = _labels(tables, docs, tables.write(texts), spark.sparkContext.broadcast(ranks(frequency)), size, percent)

        per_key = rows.where("key <> 0").groupBy("key").agg(F.min("id").alias("own")).join(labels, "key", "left")
        per_key = per_key.withColumn("label", F.coalesce("label", "key"))
        least = per_key.groupBy("label").agg(F.min("own").alias("least"))
        # Keys linked with nothing need no further look-up.
        per_key = tables.keep(per_key.join(least, "label").select("key", "least"))
    return rows.join(per_key, "key", "left").select(
        F.col("id").alias(id_col), "key", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id")
    )


def _labels(tables: Tables, docs: DataFrame, texts: DataFrame, order, size: int, percent: int) -> DataFrame:
    """(key, label) of all texts that are linked with another one."""
    grams = map_arrow(docs.select("text"), _prefixes(size, percent, order), "gram long, key long, n int, place int")
    by_gram = W.partitionBy("gram")
    # The shorter of two linked sets has the shared gram in its index prefix, for which the
    # overlap needed with longer ones is 2 t / (1 + t) of its own size; the others only probe.
    indexed = (100 + percent) * (F.col("n") - F.col("place")) >= 2 * percent * F.col("n")
    shared = (
        grams.withColumn("centre", F.min(F.struct("place", "n", "key")).over(by_gram))
        .withColumn("last", F.max("key").over(by_gram))
        .withColumn("first", F.min("key").over(by_gram))
        .withColumn("shortest", F.min(F.when(indexed, F.col("n"))).over(by_gram))
        .where("first <> last")
        .where(indexed | (F.col("shortest") < F.col("n")))
        .select("gram", "key", "n", "place", F.col("centre.place").alias("cplace"), F.col("centre.n").alias("cn"), F.col("centre.key").alias("ckey"))
    )
    # Tasks that met the same word sequence have each reported it.
    shared = tables.write(shared.dropDuplicates(["gram", "key"]))
    star = shared.where("key <> ckey").where(_may_link(F.col("n"), F.col("place"), F.col("cn"), F.col("cplace"), percent))
    star = tables.write(star.select(F.col("ckey").alias("centre"), "key").distinct())
    links = _verified(tables, star, texts, docs, size, percent)
    labels = components(tables, links)

    # What is left: prefix matches across components. Grams of one passage have the same
    # holders, which meet once for all of them, at the rarest: no pair is lost, and
    # grams whose holders are confused by a hash would only add pairs to verify.
    known = shared.select("gram", "key", "n", "place").join(labels.withColumnRenamed("node", "key"), "key", "left")
    known = known.withColumn("label", F.coalesce("label", "key"))
    known = tables.write(
        known.withColumn("low", F.min("label").over(by_gram))
        .withColumn("high", F.max("label").over(by_gram))
        .withColumn("holders", F.bit_xor(F.xxhash64("key")).over(by_gram))
        .withColumn("held", F.count("key").over(by_gram))
        .where("low <> high")
        .groupBy("holders", "held", "key")
        .agg(F.first("n").alias("n"), F.first("label").alias("label"), F.min("place").alias("place"), F.min("gram").alias("gram"))
    )
    tables.drop(shared)
    # The positional filter holds at the first gram that a pair has in common, where it is formed;
    # what is known of earlier meetings keeps most pairs from being formed at later ones.
    firsts = known.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("gram")), 1, EARLIER).alias("firsts"))
    known = known.join(firsts, "key").withColumn("earlier", F.expr("filter(firsts, g -> g < gram)")).drop("firsts")
    known = tables.write(known)
    x, y = known.alias("x"), known.alias("y")
    c = F.col
    rest = x.join(
        y,
        (c("x.holders") == c("y.holders"))
        & (c("x.held") == c("y.held"))
        & (c("x.label") != c("y.label"))
        & ((c("x.n") < c("y.n")) | ((c("x.n") == c("y.n")) & (c("x.key") < c("y.key"))))
        & _may_link(c("x.n"), c("x.place"), c("y.n"), c("y.place"), percent)
        & ~F.arrays_overlap("x.earlier", "y.earlier"),
    )
    rest = rest.select(F.least("x.key", "y.key").alias("centre"), F.greatest("x.key", "y.key").alias("key")).distinct()
    tried = star.union(star.select(F.col("key").alias("centre"), F.col("centre").alias("key")))
    rest = rest.join(tried, ["centre", "key"], "left_anti")
    links = links.union(_verified(tables, rest, texts, docs, size, percent))
    return components(tables, links).withColumnRenamed("node", "key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; of repeated rows one stays.

    Rows that share an id are one document. Texts without words all stay, once for each id.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    own, place = fresh(docs, "id_"), fresh(docs, "place_")
    ids = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(own)).distinct()
    rows = docs.join(ids, docs[id_col].cast("long").eqNullSafe(F.col(own)), "left_semi")
    # Of rows with one id and text the one whose columns hash lowest stays; rows equal in all of them are alike.
    alike = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    first = F.row_number().over(W.partitionBy(id_col, F.xxhash64(text_col)).orderBy(alike))
    return rows.withColumn(place, first).where(F.col(place) == 1).drop(place)


def op2(docs: DataFrame) -> DataFrame:
    """Per document: size of its shingle set and the smallest id that links reach; see ``near_duplicates`` for awkward rows."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
),
s as (
  select distinct doc_id, list_slice(w, i, i + 4) as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)
),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 80 * (x.n + y.n - o)),
r(doc_id, c) as (
  select doc_id, doc_id from d
  union
  select l.b, r.c from r join l on l.a = r.doc_id where r.c < l.b
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(c) from r where r.doc_id = d.doc_id) as component_id
from d left join n using (doc_id)
"""

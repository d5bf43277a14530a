"""Benchmark decontamination by winnowing, with DataFrame functions alone.

Of the nine 5-gram hashes inside each window of thirteen words only the smallest is kept
(Schleimer, Wilkerson and Aiken, 2003). Training and test windows are joined on that
fingerprint and every match is extended to the whole window by comparing its words, so
each shared span of at least ``window`` words is found and nothing else is.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small, text_or_empty

WINDOW = 13
K = 5

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_BREAKS = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null and empty give none."""
    plain = F.translate(text, _UPPER + _BREAKS, _LOWER + " " * len(_BREAKS))
    return F.array_remove(F.split(plain, " "), "")


def _grams(tokens: Column, at: Column, n: int) -> list[Column]:
    return [F.get(tokens, at + j) for j in range(n)]


def _with_fingerprint(df: DataFrame, n: int) -> DataFrame:
    """Adds ``fp``, the smallest k-gram hash of the ``n`` words from zero-based ``at``.

    The hashes of single words, of k-grams and their minimum are three projections, which
    code generation fuses into one loop over the windows.
    """
    k = min(K, n)
    keep = df.columns
    df = df.select(*keep, *[F.xxhash64(x).alias(f"h{j}") for j, x in enumerate(_grams(F.col("tokens"), F.col("at"), n))])
    hashes = [
        reduce(lambda acc, x: F.shiftleft(acc, 7).bitwiseXOR(F.shiftrightunsigned(acc, 57)).bitwiseXOR(x), [F.col(f"h{j + i}") for i in range(k)])
        for j in range(n - k + 1)
    ]
    return df.select(*keep, (F.least(*hashes) if len(hashes) > 1 else hashes[0]).alias("fp"))


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Every window of every item: ``size``, ``span`` (its words), ``item``.

    An item of fewer than ``window`` words, but not none, is one window.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(text_or_empty(text_col)).alias("tokens"))
    items = items.select("item", "tokens", F.size("tokens").alias("n")).where("n > 0")
    items = items.withColumn("size", F.least("n", F.lit(window)))
    items = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))))
    return items.select("item", "size", F.slice("tokens", F.col("at") + 1, F.col("size")).alias("tokens"), F.lit(0).alias("at"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``text_key``, ``n_words``, ``n_hit``, ``spans``, ``items``.

    ``spans`` are the zero-based word positions and sizes of all occurrences of benchmark
    windows, ``items`` the sorted ids of the items they belong to, ``n_hit`` the words
    they cover. Null and empty texts have no words and no hits; repeated rows give
    repeated results; an empty benchmark hits nothing; null item ids count as an
    item with an empty name; only the named columns are read. The words stay in one narrow
    pass: only windows that hit, and one row per document, are shuffled. The
    benchmark is broadcast if its counted windows are within the bound, else joined
    by a shuffle on the fingerprint.
    """
    items = item_windows(benchmark, window, item_col, item_text_col).withColumn("item", F.coalesce("item", F.lit("")))
    sizes = [r[0] for r in items.select("size").distinct().orderBy("size").collect()]
    base = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("key"), words(text_or_empty(text_col)).alias("tokens")
    ).select("doc", "key", "tokens", F.size("tokens").alias("n"))
    rows = []
    for size in sizes:
        spans = _with_fingerprint(items.where(F.col("size") == size), size).select(
            "fp", F.concat_ws(" ", "tokens").alias("span"), "item"
        )
        spans, fits = small(spans)
        # Row -1 stands for the document itself; it goes with the broadcast pass of the largest size.
        first = -1 if fits and size == sizes[-1] else 0
        at = base.select("*", F.explode(F.sequence(F.lit(first), F.greatest(F.col("n") - size, F.lit(first)))).alias("at"))
        at = _with_fingerprint(at, size)
        # As a range, not an equality, which would become a join key and be computed for every window.
        same = (at.fp == spans.fp) & F.concat_ws(" ", *_grams(at.tokens, at["at"], size)).between(spans.span, spans.span)
        if first:
            hit = at.join(spans, same & (at["at"] >= 0), "left").where("item is not null or at = -1")
        else:
            hit = at.where(F.col("n") >= size).join(spans, same)
        rows.append(hit.select("doc", "key", "n", "at", F.lit(size).alias("size"), "item"))
        if size == sizes[-1] and not first:
            rows.append(None)
    if not rows or rows[-1] is None:
        rows = [r for r in rows if r is not None]
        rows.append(base.select("doc", "key", "n", F.lit(-1).alias("at"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("item")))
    hits = reduce(DataFrame.union, rows)
    found = hits.groupBy("doc", "key", "n").agg(
        F.count_if(F.col("at") == -1).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("item").isNotNull(), F.struct("at", "size")))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["at"] + s["size"]).alias("end"),
            (acc["hit"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(acc["end"], s["at"]))).alias("hit"),
        ),
    )["hit"]
    return found.select(
        F.col("doc").alias(id_col),
        F.col("key").alias("text_key"),
        F.col("n").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        "spans",
        "items",
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def contaminated() -> Column:
    """A document is contaminated if benchmark windows cover a twentieth of its words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    own, key = fresh(docs, "id_"), fresh(docs, "key_")
    bad = decontaminate(docs, benchmark, id_col=id_col, text_col=text_col).where(contaminated())
    bad = bad.select(F.col(id_col).alias(own), F.col("text_key").alias(key)).distinct()
    same = (F.xxhash64(text_col) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(own))
    return docs.join(bad, same, "left_anti")


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
i as (select item_id, {_WORDS.format(text="coalesce(text, '')")} as w from benchmark),
iw as (
  select item_id, list_slice(w, s0, s0 + least(len(w), 13) - 1) as span, least(len(w), 13) as size
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s0 from i where len(w) > 0)
),
sizes as (select distinct size from iw),
dw as (
  select r, s0, size, list_slice(w, s0, s0 + size - 1) as span
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as s0 from d, sizes where len(w) >= size)
),
hits as (select dw.r, dw.s0, dw.size, iw.item_id from dw join iw on dw.size = iw.size and dw.span = iw.span),
n as (select r, count(distinct p) as n_hit from (select r, unnest(range(s0, s0 + size)) as p from hits) group by r),
its as (
  select r, count(*) as n_items, string_agg(x, ',' order by x) as ids
  from (select distinct r, item_id::varchar as x from hits) group by r
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join n using (r) left join its using (r)
"""

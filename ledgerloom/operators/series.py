"""Order statistics, runs and one-dimensional clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def upper_median(c: Column) -> Column:
    """The value at place n div 2 of the sorted values (zero-based): the upper of two middle ones; for small groups, as of a page."""
    a = F.array_sort(F.collect_list(c))
    return F.get(a, F.floor(F.size(a) / 2).cast("int"))


def nth_value(df: DataFrame, keys: list[str], value: str, bins: int = 1024) -> DataFrame:
    """(keys, ``n``, ``value``): the upper median of groups too large to be gathered in one place.

    A group's range is cut into ``bins``, which are counted; only the values of the bin that holds the
    median are ranked.
    """
    at = lambda c: F.least(F.lit(bins - 1), F.floor((c - F.col("_lo")) / F.col("_width"))).cast("int")
    spread = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0)
    spread = spread.withColumn("_width", width)
    rows = df.where(F.col(value).isNotNull()).join(spread, keys).withColumn("_bin", at(F.col(value)))
    counts = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"), F.first("n").alias("n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_bin")) - F.col("_n")
    middle = F.floor(F.col("n") / 2)
    chosen = counts.withColumn("_before", before).where((F.col("_before") <= middle) & (middle < F.col("_before") + F.col("_n")))
    inside = rows.drop("n").join(chosen.select(*keys, "_bin", "_before", "n"), [*keys, "_bin"])
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(value)) - 1 + F.col("_before")
    return inside.withColumn("_rank", rank).where(F.col("_rank") == middle).select(*keys, "n", value)


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: ``starts`` is true where a run begins."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w))


def single_link(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Clusters of values whose neighbours are within ``tolerance``: keys, ``mean``, ``n``."""
    w = W.partitionBy(*keys).orderBy(F.desc(value))
    gap = F.lag(value).over(w) - F.col(value)
    runs = df.withColumn("_gap", gap)
    runs = runs.withColumn("cluster", F.sum(F.when(F.col("_gap") <= tolerance, 0).otherwise(1)).over(w))
    return runs.groupBy(*keys, "cluster").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def anchored_tiers(values: Column, tolerance: float) -> Column:
    """Tiers of distinct values from the largest down; a tier ends where a value lies more than
    ``tolerance`` below its first one. Unlike runs, this depends on the tier's anchor, so it is a fold."""
    start = F.array().cast("array<double>")
    down = F.reverse(F.array_sort(F.array_distinct(values.cast("array<double>"))))
    return F.aggregate(down, start, lambda acc, x: F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1)) - x > tolerance), F.concat(acc, F.array(x))).otherwise(acc))


def anchored_groups(values: Column, tolerance: float) -> Column:
    """Group number of each value of an ascending array, by distance from the group's first value."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("g"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["anchor"].isNull() | (x - acc["anchor"] > tolerance)
        g = F.when(new, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(F.when(new, x).otherwise(acc["anchor"]).alias("anchor"), g.alias("g"), F.concat(acc["out"], F.array(g)).alias("out"))

    return F.aggregate(values.cast("array<double>"), start, step)["out"]


def fold_groups(items: Column, kind: str, starts: Callable[[Column, Column, Column], Column]) -> Column:
    """Numbers the groups of an ordered array: array of (``g``, ``item``).

    ``starts(first, last, item)`` says whether an item opens a group, given the first and last items of the one
    before; unlike runs found by the neighbour alone, a group can depend on where it began. ``kind`` is the items'
    type. For arrays of a page's size.
    """
    start = F.struct(
        F.lit(None).cast(kind).alias("first"), F.lit(None).cast(kind).alias("last"), F.lit(-1).alias("g"), F.array().cast(f"array<struct<g:int,item:{kind}>>").alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        new = (acc["g"] < 0) | starts(acc["first"], acc["last"], x)
        g = F.when(new, acc["g"] + 1).otherwise(acc["g"])
        grown = F.concat(acc["out"], F.array(F.struct(g.alias("g"), x.alias("item"))))
        return F.struct(F.when(new, x).otherwise(acc["first"]).alias("first"), x.alias("last"), g.alias("g"), grown.alias("out"))

    return F.aggregate(items, start, step, lambda acc: acc["out"])


def mode_first(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value per key; of equally frequent ones the first in ``order``."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(value), F.max("_n").alias("n"))


def heading_levels(clusters: DataFrame, keys: list[str], ratio: float = 1.15, top: int = 4) -> DataFrame:
    """Body = the most populous cluster (larger size on ties); the ``top`` largest clusters of at least
    ``ratio`` times its size are levels 1, 2, ..."""
    body = F.max(F.struct("n", "mean")).over(W.partitionBy(*keys))["mean"]
    found = clusters.withColumn("body", body).where(F.col("mean") >= ratio * F.col("body"))
    level = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("mean")))
    return found.withColumn("level", level).where(F.col("level") <= top)

"""Resharding with the least bytes moved.

Old shard sizes and new capacities form a transport problem, solved as a minimum-cost
flow; its transfers cut each old shard, taken in an order of falling row size, into
byte ranges. The first range stays where it is, so only the small rows at the end of a
shard move and range ends fall within a small row of where the flow puts them. Row
positions come from two-level prefix sums: totals of small blocks, then the rows
inside one block, so no task holds a whole shard.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, fresh, shared_dir, text_or_empty

#: Rows of one size class that a block holds on average, at most.
BLOCK_ROWS = 20_000


def min_cost_flow(
    sizes: Sequence[int], capacities: Sequence[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)
) -> list[dict[int, int]]:
    """For each old shard, the bytes that go to each new one, at the least total of bytes times cost.

    Successive shortest paths with potentials on the bipartite graph of old and new
    shards. The capacities must hold all sizes. Equal sums give the same plan.
    """
    n, m = len(sizes), len(capacities)
    if sum(sizes) > sum(capacities):
        raise ValueError("the capacities are too small for the shards")
    flow = [[0] * m for _ in range(n)]
    left, room = list(sizes), list(capacities)
    # Staying costs nothing in the default, so most bytes are placed at once; any start is
    # repaired by the residual arcs, but the potentials need one without negative cycles.
    potential = [0] * (n + m)
    while any(left):
        distance = [None] * (n + m)
        parent = [-1] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            distance[i] = 0
        heapq.heapify(heap)
        done = [False] * (n + m)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if u < n:
                arcs = ((n + j, cost(u, j)) for j in range(m))
            else:
                arcs = ((i, -cost(i, u - n)) for i in range(n) if flow[i][u - n])
            for v, c in arcs:
                e = d + c + potential[u] - potential[v]
                if distance[v] is None or e < distance[v]:
                    distance[v], parent[v] = e, u
                    heapq.heappush(heap, (e, v))
        far = max(d for d in distance if d is not None)
        potential = [p + (far if d is None else d) for p, d in zip(potential, distance)]
        end = min((n + j for j in range(m) if room[j] and distance[n + j] is not None), key=lambda v: (potential[v] - min(potential[:n]), v))
        path = [end]
        while parent[path[-1]] >= 0:
            path.append(parent[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n])
        for u, v in zip(path, path[1:]):
            if u >= n:
                amount = min(amount, flow[v][u - n])
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return [{j: x for j, x in enumerate(row) if x} for row in flow]


def equal_capacities(total: int, shards: int) -> list[int]:
    """Capacities whose sum is ``total`` and which differ by one byte at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def reshard(
    rows: DataFrame,
    capacities: Callable[[int], Sequence[int]],
    id_col: str = "doc_id",
    size_col: str = "size",
    old_col: str = "old_shard",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``rows`` with ``shard`` (new) and ``slot`` (gapless from 0 within it).

    ``capacities`` maps the total size to the new shards' capacities. Sizes must be
    positive. Ties of size are ordered by id and then by all columns, which must be
    orderable; repeated rows take slots of their own; null ids come first; an empty table
    gives no rows. Old shards are numbered from 0, a null one counts as 0. Columns named
    ``shard`` or ``slot`` are replaced; any others pass through.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("shard", "slot")]
    base = cut(
        rows.select(
            F.struct(*kept).alias("row"),
            F.col(id_col).alias("id"),
            F.col(size_col).cast("long").alias("size"),
            F.coalesce(F.col(old_col).cast("int"), F.lit(0)).alias("old"),
        )
    )
    sums = base.groupBy("old").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    sizes = [0] * (1 + max((r[0] for r in sums), default=-1))
    for r in sums:
        sizes[r[0]] = r["b"]
    parts = max(1, max((r["n"] for r in sums), default=0) // block_rows)
    plan = min_cost_flow(sizes, list(capacities(sum(sizes))))
    ranges = []
    for old, flows in enumerate(plan):
        at = 0
        for new in sorted(flows, key=lambda j: (j != old, j)):
            ranges.append((old, at, at + flows[new], new))
            at += flows[new]
    # At most as many ranges as there are pairs of shards; a basic plan has their sum.
    ranges = F.broadcast(rows.sparkSession.createDataFrame(ranges, "old int, lo long, hi long, shard int"))

    level = -F.floor(F.log2("size")).cast("int")
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    base = base.withColumn("level", level).withColumn("part", part)
    block = ["old", "level", "part"]
    tie = [F.desc("size"), F.col("id"), F.col("row")]
    inside = F.sum("size").over(W.partitionBy(*block).orderBy(*tie).rowsBetween(W.unboundedPreceding, 0))
    totals = base.groupBy(*block).agg(F.sum("size").alias("total"))
    before = F.sum("total").over(W.partitionBy("old").orderBy("level", "part")) - F.col("total")
    totals = totals.select(*block, before.alias("before"))
    middle = F.col("before") + F.col("end") - F.expr("(size + 1) div 2")
    placed = base.withColumn("end", inside).join(totals, block).withColumn("middle", middle).alias("p")
    placed = placed.join(ranges.alias("g"), F.expr("p.old = g.old and middle >= lo and middle < hi"))
    placed = cut(placed.select("row", "id", "size", "shard", "p.old", "level", "part"))
    counts = placed.groupBy("shard", *block).agg(F.count("*").alias("n"))
    counts = counts.withColumn("first", F.sum("n").over(W.partitionBy("shard").orderBy(*block)) - F.col("n"))
    at = F.row_number().over(W.partitionBy("shard", *block).orderBy(*tie)) - 1
    return (
        placed.withColumn("at", at)
        .join(counts.drop("n"), ["shard", *block])
        .select("row.*", "shard", (F.col("first") + F.col("at")).alias("slot"))
    )


def shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the shard files under ``path``; ``schema`` names all columns, the shard last."""
    return spark.read.schema(schema).parquet(path)


def rewrite(
    df: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", old_col: str = "old_shard", shard_col: str | None = None
) -> list[int]:
    """Writes the shards that gain or lose rows under ``path``/shard=N and returns their numbers.

    ``placed`` maps the ids of ``df``, which must be unique, to old and new shards; files
    of other shards are left as they are, and those of shards left without rows go.
    ``df`` may be read from ``path`` itself: its column ``shard_col`` of old shards is then
    replaced, and names the folders.
    """
    moved = placed.where(F.col("shard") != F.col(old_col))
    touched = moved.select(F.explode(F.array("shard", old_col)).alias("s")).distinct().orderBy("s")
    numbers = [r[0] for r in touched.collect()]  # shard numbers only
    df = df if shard_col is None else df.where(F.col(shard_col).isin(numbers)).drop(shard_col)
    shard = shard_col or fresh(df, "shard")
    key = fresh(df, "_id")
    ids = placed.where(F.col("shard").isin(numbers)).select(F.col(id_col).alias(key), F.col("shard").alias(shard))
    rows = df.join(ids.hint("merge"), df[id_col].eqNullSafe(ids[key])).drop(key)  # alike at every size
    _write(rows, path, shard)
    # Dynamic overwriting replaces only the folders that get rows.
    filled = {r[0] for r in ids.select(shard).distinct().collect()}
    context = df.sparkSession.sparkContext
    for n in set(numbers) - filled:
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/{shard}={n}")
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    return numbers


def _write(rows: DataFrame, path: str, shard: str) -> None:
    """Replaces the folders of the shards that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(shard).parquet(path)


#: Shards before and after in the query.
OLD, NEW = 32, 40


def op1(docs: DataFrame, old: int = OLD, new: int = NEW) -> DataFrame:
    """From ``old`` shards dealt by a hash of the id to ``new`` ones of near equal bytes (law ``bytes``).

    The old shards are laid out as files in the shared folder, with all columns of ``docs``;
    those that gain or lose rows are rewritten there, and size, checksum and shard are read
    back from the files.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    row, shard = fresh(docs, "row"), fresh(docs, "shard")
    # Ids may be null or repeated, so rows are numbered; the files keep the numbers.
    dealt = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(old)).cast("int")
    laid = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(shard, dealt)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in laid.schema])
    _write(laid, path, shard)
    before = shards(spark, path, schema)

    def figures(files: DataFrame, shard_name: str) -> DataFrame:
        return files.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"),
            F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
            F.col(shard).alias(shard_name),
            F.col(row).alias("row_number"),
        )

    placed = reshard(figures(before, "old_shard"), lambda total: equal_capacities(total, new))
    placed = cut(placed.select(F.col("row_number").alias(row), "old_shard", "shard", F.col("slot").cast("long").alias("slot")))
    rewrite(before, placed, path, row, "old_shard", shard)
    after = figures(shards(spark, path, schema), "shard")
    slots = placed.select(F.col(row).alias("row_number"), "slot", "old_shard")
    return after.join(slots.hint("merge"), "row_number").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )

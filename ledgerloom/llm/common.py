"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A side with at most this many rows, counted before the join, is broadcast.
BROADCAST_ROWS = 200_000


#: Settings while tables are written: Spark removes the shuffle files of a query when the query ends, and
#: Python workers get few rows at once, as texts may be long.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only a local master, as in tests, may
    leave that unset, and gets a local folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="ledgerloom-"))
    return sc.getCheckpointDir()


class Tables:
    """The written tables of one operator, as Parquet in the shared folder.

    A written table cuts the lineage, so that a lost executor costs no recomputation of earlier
    steps, and is read column by column. Within a ``with`` block the shuffle files of each step go when the step
    ends, and the tables when the block does, except those that ``keep`` wrote: frames
    that an operator returns still read them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Tables:
        self.before = {k: self.spark.conf.get(k, None) for k in _SETTINGS}
        for k, v in _SETTINGS.items():
            self.spark.conf.set(k, v)
        return self

    def __exit__(self, *_) -> None:
        for k, v in self.before.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
        for path in self.paths.values():
            delete(self.spark, path)
        self.paths.clear()

    def keep(self, df: DataFrame) -> DataFrame:
        return self._written(df)[0]

    def folder(self) -> str:
        """A folder of its own, which goes with the tables."""
        path = f"{shared_dir(self.spark)}/folder-{uuid.uuid4().hex}"
        self.paths[path] = path
        return path

    def write(self, df: DataFrame) -> DataFrame:
        out, path = self._written(df)
        self.paths[path] = path
        out._table_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing reads any more before the block ends."""
        delete(self.spark, self.paths.pop(df._table_path))

    def _written(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever store Spark knows it by."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, where it stays for the frames that read it."""
    with Tables(df.sparkSession) as tables:
        return tables.keep(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df``, and whether its counted rows stay within the broadcast bound."""
    fits = df.limit(limit + 1).count() <= limit
    return (F.broadcast(df) if fits else df), fits


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, however its own columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def components(tables: Tables, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: one row (node, label) per end of a link, label the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), which need
    O(log n) rounds; every round works on distinct edges, and a node's neighbours are never
    gathered in one place, only their minimum. Neither links nor labels reach the driver.
    The labels read a table of ``tables``.
    """
    edges = tables.write(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    digest = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = digest(edges)
    while before[0]:
        # Large star: neighbours larger than u are tied to the smallest of u's neighbourhood.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of u, and u itself, are tied to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").select(F.col("v").alias("x"), "m", "u")
        after = tables.write(
            small_star.select(F.col("x").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = digest(after)
        tables.drop(edges)
        edges = after
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        roots.select("node", F.col("node").alias("label"))
    )


def folder_of(path: str):
    """pyarrow's file system of a folder that a worker reads or writes, and the folder's path in it."""
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


def release() -> None:
    """Gives what a worker has freed back to the machine: workers stay for later tasks, but their peaks need not."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the workers' path."""
    ship(df.sparkSession)

    def whole(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(whole, schema)

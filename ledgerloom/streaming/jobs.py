"""The job stream: state folding, windows, ingest and retention on Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import latest_state


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only for a local master that names none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="ledgerloom-"))
    return sc.getCheckpointDir()


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums by event type and window; with ``late`` a watermark, for streams."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_end(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and stops; ``sink`` gets each batch and its number."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def fold_stream(spark: SparkSession, path: str) -> DataFrame:
    """Last status per job of a stream of job events, each batch reduced before it is stored.

    Batches are appended under their number, which a repeated batch overwrites, so a restart
    gives no duplicates; the stored partial states are folded once more when read.
    """
    base = f"{workspace(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    jobs = events.select("event_id", "ts", F.col("user_id").alias("job_id"), F.col("event_type").alias("status"))

    def sink(batch: DataFrame, number: int) -> None:
        partial = batch.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("last"), F.count("*").alias("n"))
        partial.write.mode("overwrite").parquet(f"{base}/state/batch={number}")

    run_to_end(jobs, sink, f"{base}/checkpoint")
    state = spark.read.parquet(f"{base}/state")
    return state.groupBy("job_id").agg(F.max("last").alias("last"), F.sum("n").alias("n_events")).select("job_id", "last.status", "n_events")


def stream_events(spark: SparkSession, folder: str, scheme: str = "raw", output_mode: str = "consolidated") -> DataFrame:
    """The progress feed of all files of a folder, read as a stream; a folder below it is a request.

    Each batch's rows are stored under its number, so a batch that is repeated after a failure counts once.
    """
    from ..engine import events

    base = f"{workspace(spark)}/events-{uuid.uuid4().hex}"
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    files = files.select(F.element_at(parts, -2).alias("request_id"), F.element_at(parts, -1).alias("filename"), "content")

    def sink(batch: DataFrame, number: int) -> None:
        ordered = batch.withColumn("file_ord", F.xxhash64("filename"))
        events(ordered, scheme, output_mode).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    run_to_end(files, sink, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/rows").drop("batch")


def stop(query, wait: float = 10.0) -> bool:
    """Ends a stream; whether it ended within ``wait`` seconds."""
    query.stop()
    return query.awaitTermination(wait) is not False


__all__ = ["fold_stream", "latest_state", "run_to_end", "stop", "stream_events", "tumbling", "workspace"]

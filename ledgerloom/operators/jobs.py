"""The job table: queue, history, estimates, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .series import nth_value

#: Seconds per page without and with OCR, seconds per job, days looked back and kept.
PER_PAGE, PER_OCR_PAGE, BASE = 12.0, 45.0, 4.0
LOOKBACK_DAYS, RETENTION_DAYS, LEAST_SAMPLES = 30, 7, 3
#: Beyond these a request is queued.
MAX_BYTES, MAX_PAGES = 2 * 1024 * 1024, 5


def queue_position(jobs: DataFrame) -> DataFrame:
    """Running jobs are at 0, queued ones at 1 + the number queued strictly before; others have none.

    Only queued rows meet in the ranking, counted per creation time first; sums run within
    a day, and over the days, of which there are few.
    """
    queued = jobs.where("status = 'queued'").groupBy("created_at").agg(F.count("*").alias("n")).withColumn("day", F.to_date("created_at"))
    days = queued.groupBy("day").agg(F.sum("n").alias("n"))
    days = days.select("day", (F.sum("n").over(W.orderBy("day")) - F.col("n")).alias("before"))
    within = F.sum("n").over(W.partitionBy("day").orderBy("created_at")) - F.col("n")
    ahead = queued.withColumn("within", within).join(F.broadcast(days), "day").select("created_at", (F.col("before") + F.col("within") + 1).alias("place"))
    out = jobs.join(ahead, "created_at", "left")
    place = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", F.col("place"))
    return out.select(*jobs.columns, place.cast("long").alias("position"))


def recent(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(max(1, min(100, limit)))


def claim(jobs: DataFrame) -> DataFrame:
    """The oldest queued job, now running."""
    return jobs.where("status = 'queued'").orderBy("created_at", "job_id").limit(1).withColumn("status", F.lit("running"))


def calibrated(history: DataFrame, now: Column) -> DataFrame:
    """Seconds per page by OCR flag: upper median of recent rates, from three samples on."""
    rate = F.col("actual_sec") / F.greatest(F.lit(1), F.col("page_count"))
    recent_rows = history.where(F.col("finished_at") >= now - F.expr(f"interval {LOOKBACK_DAYS} days"))
    out = nth_value(recent_rows.select("ocr_expected", rate.alias("rate")), ["ocr_expected"], "rate")
    return out.where(F.col("n") >= LEAST_SAMPLES)


def estimates(jobs: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """Adds ``estimate_sec``: base, and pages times the calibrated or default rate."""
    rates = calibrated(history, now).select("ocr_expected", "rate")
    default = F.when(F.col("ocr_expected"), PER_OCR_PAGE).otherwise(PER_PAGE)
    out = jobs.join(F.broadcast(rates), "ocr_expected", "left")  # two rows at most
    pages = F.coalesce("page_count", F.lit(0))
    return out.select(*jobs.columns, F.when(pages <= 0, F.lit(BASE)).otherwise(BASE + pages * F.coalesce("rate", default)).alias("estimate_sec"))


def expired(jobs: DataFrame, now: Column) -> Column:
    return F.col("finished_at").isNotNull() & (F.col("finished_at") < now - F.expr(f"interval {RETENTION_DAYS} days"))


def retained(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where(~expired(jobs, now))


def latest_state(events: DataFrame) -> DataFrame:
    """Last status of each job by time, then event number; also what a stream of events folds to."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n_events"))


def engine_of(pages: DataFrame) -> DataFrame:
    """The engine of a job's pages: its name, ``mixed`` for several, null for none."""
    names = F.collect_set("engine")
    return pages.groupBy("job_id").agg(F.when(F.size(names) == 1, F.get(names, F.lit(0))).when(F.size(names) > 1, "mixed").alias("engine"))


def route(files: DataFrame) -> DataFrame:
    """Requests (request_id, scheme, bytes, pages) -> inline or queued, by total bytes and pages."""
    out = files.groupBy("request_id", "scheme").agg(F.sum("bytes").alias("bytes"), F.sum("pages").alias("pages"))
    queued = (F.col("scheme") != "raw") & ((F.col("bytes") > MAX_BYTES) | F.coalesce(F.col("pages") > MAX_PAGES, F.lit(False)))
    return out.withColumn("route", F.when(queued, "queued").otherwise("inline"))


def elapsed(started: Column, finished: Column, now: Column) -> Column:
    """Seconds since the start, to one digit; 0 before it."""
    seconds = F.coalesce(finished, now).cast("double") - started.cast("double")
    return F.when(started.isNull(), 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), seconds), 1))

"""A job store on tables: jobs are submitted, claimed by one worker, finished, recovered and expired.

Every change is a row of the event table, appended under a number of its own; a job's state is its last row.
Appending is the only write, so readers never see half a change, and a change written twice under one
number counts once. As in any single-worker queue one process claims.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import RETENTION_DAYS, elapsed, estimates
from ..operators.statements import exists

SCHEMA = (
    "id string, seq long, created_at double, started_at double, finished_at double, status string, scheme string, output_mode string, "
    "source_filenames array<string>, page_count int, ocr_expected boolean, estimate_sec double, result_json string, error_detail string, engine_used string"
)
HISTORY = "job_id string, page_count int, ocr_expected boolean, actual_sec double, finished_at double"
INPUTS = "job_id string, filename string, content binary"
_DAY = 24 * 60 * 60
#: Fixed value: what a job that a dead process was running says.
DIED = "Process died while job was running"


class JobStore:
    """Jobs under ``path``: events, inputs and the history of rates; ``clock`` gives the seconds since the epoch."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock

    def _read(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame, name: str, number: str) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/change={number}")

    def jobs(self) -> DataFrame:
        """The current row of each job that was not expired."""
        rows = self._read("events", SCHEMA)
        names = [c for c in rows.columns if c != "id"]
        last = rows.groupBy("id").agg(F.max_by(F.struct(*names), "seq").alias("r")).select("id", "r.*")
        return last.where("status <> 'expired'")

    def _change(self, rows: DataFrame, **values: Column) -> None:
        """Appends ``rows`` of ``jobs`` with new values, as one change."""
        changed = rows.withColumns({**values, "seq": F.lit(time.time_ns())})
        self._append(changed.select(*[c.split()[0] for c in SCHEMA.split(", ")]), "events", uuid.uuid4().hex)

    def submit(self, scheme: str, output_mode: str, inputs: DataFrame, page_count: int | None = None, ocr_expected: bool = False) -> str:
        """Queues the files ``inputs`` (filename, content); returns the job's id, 32 hexadecimal digits."""
        job = uuid.uuid4().hex
        self._append(inputs.select(F.lit(job).alias("job_id"), "filename", "content"), "inputs", job)
        row = self.spark.createDataFrame([(job, self.clock(), "queued", scheme, output_mode, page_count, ocr_expected)], "id string, created_at double, status string, scheme string, output_mode string, page_count int, ocr_expected boolean")
        names = inputs.agg(F.array_sort(F.collect_list("filename")).alias("source_filenames"))  # of one request
        row = self.with_estimates(row.crossJoin(names))
        for c in SCHEMA.split(", "):
            name, kind = c.split()
            if name not in row.columns:
                row = row.withColumn(name, F.lit(None).cast(kind))
        self._change(row)
        return job

    def history(self) -> DataFrame:
        rows = self._read("history", HISTORY)
        cutoff = self.clock() - RETENTION_DAYS * _DAY
        latest = rows.groupBy("job_id").agg(F.max_by(F.struct("page_count", "ocr_expected", "actual_sec", "finished_at"), "finished_at").alias("r")).select("job_id", "r.*")
        return latest.where(F.col("finished_at") >= cutoff)

    def with_estimates(self, jobs: DataFrame) -> DataFrame:
        """Adds ``estimate_sec`` from at least three recent jobs of the same kind."""
        past = self.history().withColumn("finished_at", F.timestamp_seconds("finished_at"))
        return estimates(jobs.drop("estimate_sec"), past, F.timestamp_seconds(F.lit(self.clock())))

    def get(self, job: str) -> DataFrame:
        return self.jobs().where(F.col("id") == job)

    def load_inputs(self, job: str) -> DataFrame:
        """The files of a job that is not finished."""
        at = f"{self.path}/inputs/change={job}"
        return self.spark.read.schema(INPUTS).parquet(at).drop("job_id") if exists(self.spark, at) else self.spark.createDataFrame([], INPUTS).drop("job_id")

    def claim(self) -> str | None:
        """The id of the oldest queued job, now running; null if none is queued."""
        oldest = self.jobs().where("status = 'queued'").orderBy("created_at", "id").limit(1)
        found = oldest.select("id").collect()  # one id
        if not found:
            return None
        self._change(self.get(found[0][0]), status=F.lit("running"), started_at=F.lit(self.clock()))
        return found[0][0]

    def _finish(self, rows: DataFrame, job: str | None, **values: Column) -> None:
        self._change(rows, finished_at=F.lit(self.clock()), **values)
        if job:
            self._drop_inputs(job)

    def _drop_inputs(self, job: str) -> None:
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/inputs/change={job}")
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)

    def mark_done(self, job: str, result: dict, engine_used: str | None = None) -> None:
        """The job is done; its files go, and its rate joins the history if it was started and has pages."""
        self._finish(self.get(job), job, status=F.lit("done"), result_json=F.lit(json.dumps(result)), engine_used=F.lit(engine_used).cast("string"))
        row = self.get(job).where("started_at is not null and page_count > 0")
        self._append(row.select(F.col("id").alias("job_id"), "page_count", "ocr_expected", (F.col("finished_at") - F.col("started_at")).alias("actual_sec"), "finished_at"), "history", job)

    def mark_failed(self, job: str, error: str) -> None:
        self._finish(self.get(job), job, status=F.lit("failed"), error_detail=F.lit(error))

    def recover(self) -> int:
        """At a start: jobs still running belonged to a dead process and have failed. How many."""
        stuck = self.jobs().where("status = 'running'")
        n = stuck.count()
        if n:
            self._finish(stuck, None, status=F.lit("failed"), error_detail=F.lit(DIED))
        return n

    def cleanup(self) -> int:
        """Expires jobs finished over seven days ago; how many. The history forgets them by itself."""
        old = self.jobs().where(F.col("finished_at") < self.clock() - RETENTION_DAYS * _DAY)
        n = old.count()
        if n:
            self._change(old, status=F.lit("expired"), result_json=F.lit(None).cast("string"))
        return n

    def public(self, include_result: bool = True) -> DataFrame:
        """Jobs as readers see them, one JSON object each: id, ``json``. A result only of done jobs, an error only of failed ones."""
        j = self.jobs()
        now = F.lit(self.clock())
        fields = [F.col("id"), *[F.col(c) for c in ("status", "scheme", "output_mode", "source_filenames", "created_at", "started_at", "finished_at", "estimate_sec")]]
        fields += [elapsed(F.col("started_at"), F.col("finished_at"), now).alias("elapsed_sec"), F.col("page_count"), F.col("ocr_expected"), F.col("engine_used")]
        fields.append(F.when(F.col("status") == "failed", F.col("error_detail")).alias("error_detail"))
        if include_result:
            fields.append(F.when(F.col("status") == "done", F.try_parse_json("result_json")).alias("result"))
        return j.select("id", F.to_json(F.struct(*fields)).alias("json"))


def run_worker(store: JobStore, transforms: dict[str, Callable[[DataFrame, str], dict]], stop: Callable[[], bool], poll: float = 1.0) -> int:
    """Claims and runs jobs one by one until ``stop`` says so, or until no job is queued if ``poll`` is 0; how many ran.

    A transform gets the files and the output mode; whatever it raises fails its job alone.
    """
    ran = 0
    while not stop():
        job = store.claim()
        if job is None:
            if not poll:
                break
            time.sleep(poll)
            continue
        ran += 1
        row = store.get(job).first()
        try:
            inputs = store.load_inputs(job)
            if not inputs.limit(1).count():
                store.mark_failed(job, "input blob missing (job record corrupted)")
            elif row["scheme"] not in transforms:
                store.mark_failed(job, f"scheme '{row['scheme']}' not found (no longer registered?)")
            else:
                result = transforms[row["scheme"]](inputs, row["output_mode"])
                store.mark_done(job, result, engine_of_result(result))
        except Exception as e:  # one job's failure is its result
            store.mark_failed(job, f"{type(e).__name__}: {e}")
    return ran


def engine_of_result(result: dict) -> str | None:
    """The engine that made a result's pages, ``mixed`` for several, none without pages."""
    engines = {p["engine"] for p in (result.get("confidence") or {}).get("pages") or [] if p.get("engine")}
    return engines.pop() if len(engines) == 1 else "mixed" if engines else None



"""A queue of download jobs: one book at a time, with statuses in a durable table, and cancelling by Spark's job tags (CTL-01).

A job's work is a function that gives a DataFrame with a row for each chapter: item, and error, null where it went well. Running the job writes
these rows under its id; how many are done and failed are counts over what was written. Every change of a job's status is
a row of the status table, so that another driver can read them, and a driver that died leaves its jobs as it last saw them.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import durable, new_path, remove

WAITING, RUNNING, DONE, FAILED, CANCELLED, LOST = "waiting", "running", "done", "failed", "cancelled", "lost"
ENDED = (DONE, FAILED, CANCELLED, LOST)
_STATUS = "job string, queue string, place long, seq long, title string, status string, total long, done long, failed long, message string, at double"
_ITEMS = "item string, error string"


@dataclass
class _Job:
    id: str
    place: int
    title: str
    work: Callable[[SparkSession], DataFrame]
    total: int | None
    status: str = WAITING
    cancelled: threading.Event = field(default_factory=threading.Event)
    ended: threading.Event = field(default_factory=threading.Event)


class JobQueue:
    """Jobs of one driver. path: the folder of the status table and of the jobs' rows, shared with the cluster; queues may share one."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.id = spark, (path or new_path(spark, "jobs")).rstrip("/"), uuid.uuid4().hex[:12]
        self._jobs: dict[str, _Job] = {}
        self._waiting: deque[_Job] = deque()
        self._lock = threading.Lock()
        self._seq, self._worker = 0, None

    # ---------------------------------------------------------------- callers

    def submit(self, title: str, work: Callable[[SparkSession], DataFrame], total: int | None = None) -> str:
        """Put a job at the queue's end; its id."""
        with self._lock:
            job = _Job(f"job-{self.id}-{len(self._jobs)}", len(self._jobs), title, work, total)
            self._jobs[job.id] = job
            self._log(job)
            self._waiting.append(job)
            if self._worker is None:
                self._worker = threading.Thread(target=self._loop, daemon=True, name=f"jobs-{self.id}")
                self._worker.start()
        return job.id

    def cancel(self, id: str) -> bool:
        """Stop a job, at once if it waits, else by its tag; false if there is none or it has ended."""
        with self._lock:
            job = self._jobs.get(id)
            if job is None or job.status in ENDED:
                return False
            job.cancelled.set()
            if job.status == WAITING:
                self._end(job, CANCELLED)
                return True
        threading.Thread(target=self._stop, args=(job,), daemon=True).start()
        return True

    def _stop(self, job: _Job) -> None:
        """Only active Spark jobs are cancelled by their tag, and the work may just be about to start its next one."""
        while not job.ended.is_set():
            self.spark.sparkContext.cancelJobsWithTag(job.id)
            job.ended.wait(0.2)

    def cancel_all(self) -> int:
        return sum(self.cancel(id) for id in list(self._jobs))

    def wait(self, id: str, timeout: float | None = None) -> str:
        """A job's status when it has ended, or after so many seconds."""
        job = self._jobs[id]
        job.ended.wait(timeout)
        return job.status

    def statuses(self) -> DataFrame:
        """(job, title, status, total, done, failed, message, percent), the latest row of each job of this folder, the newest job first."""
        return latest(self.spark, self.path)

    def items(self, id: str) -> DataFrame:
        """(item, error) of an ended job's chapters."""
        return self.spark.read.schema(_ITEMS).parquet(f"{self.path}/items/{id}")

    def clear_ended(self) -> int:
        """Forget the jobs that have ended, their rows too; how many. Their status rows say so, the table being written to by others as well."""
        with self._lock:
            ended = [j for j in self._jobs.values() if j.status in ENDED and j.status != LOST]
            for job in ended:
                job.status = "cleared"
                self._log(job)
        for job in ended:
            remove(self.spark, f"{self.path}/items/{job.id}")
        return len(ended)

    # ---------------------------------------------------------------- the worker

    def _log(self, job: _Job, done: int | None = None, failed: int | None = None, message: str | None = None) -> None:
        self._seq += 1
        row = (job.id, self.id, job.place, self._seq, job.title, job.status, job.total, done, failed, message, time.time())
        self.spark.createDataFrame([row], _STATUS).coalesce(1).write.mode("append").parquet(f"{self.path}/status")

    def _end(self, job: _Job, status: str, **counts) -> None:
        job.status = status
        self._log(job, **counts)
        job.ended.set()

    def _loop(self) -> None:
        while True:
            with self._lock:
                if not self._waiting:
                    self._worker = None
                    return
                job = self._waiting.popleft()
                if job.status in ENDED:
                    continue
                job.status = RUNNING
                self._log(job)
            self._run(job)

    def _run(self, job: _Job) -> None:
        context, at = self.spark.sparkContext, f"{self.path}/items/{job.id}"
        context.addJobTag(job.id)
        try:
            rows = job.work(self.spark).select(F.col("item").cast("string").alias("item"), F.col("error").cast("string").alias("error"))
            if job.cancelled.is_set():
                raise InterruptedError
            rows.write.mode("overwrite").parquet(at)
            n = self.items(job.id).agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed")).first()
        except Exception as e:  # a job's failure is a status, and the next job's turn
            context.removeJobTag(job.id)
            with self._lock:
                self._end(job, CANCELLED if job.cancelled.is_set() else FAILED, message=f"{type(e).__name__}: {e}"[:500])
            return
        context.removeJobTag(job.id)
        with self._lock:
            job.total = job.total if job.total is not None else n["n"]
            self._end(job, DONE, done=n["n"] - n["failed"], failed=n["failed"])


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest status of each job in a folder; what was cleared is left out."""
    rows = spark.read.schema(_STATUS).parquet(f"{path.rstrip('/')}/status")
    last = rows.groupBy("job").agg(F.max_by(F.struct("queue", "place", "title", "status", "total", "done", "failed", "message", "at"), "seq").alias("s")).select("job", "s.*")
    percent = F.when(F.col("total") > 0, F.round(F.coalesce("done", F.lit(0)) * 100 / F.col("total"), 1)).otherwise(0.0)
    shown = last.where("status <> 'cleared'").withColumn("percent", percent)
    return shown.orderBy(F.desc("at"), F.desc("place")).select("job", "title", "status", "total", "done", "failed", "message", "percent")


def mark_lost(spark: SparkSession, path: str, alive: list[str]) -> int:
    """Give the jobs of queues that are gone, all but those named, the status that says so; how many."""
    rows = spark.read.schema(_STATUS).parquet(f"{path.rstrip('/')}/status")
    last = rows.groupBy("job").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "job")), "seq").alias("s")).select("job", "s.*")
    gone = last.where(F.col("status").isin(WAITING, RUNNING) & ~F.col("queue").isin(alive))
    lost = gone.withColumns({"status": F.lit(LOST), "seq": F.col("seq") + 1, "at": F.unix_micros(F.current_timestamp()) / 1e6}).select(*rows.columns)
    lost = durable(lost, "lost-jobs")
    lost.write.mode("append").parquet(f"{path.rstrip('/')}/status")
    return lost.count()

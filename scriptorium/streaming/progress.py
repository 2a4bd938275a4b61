"""Progress of streams as rows: a listener notes what each batch did, and writes it to a table (CTL-02)."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from scriptorium.session import new_path

_ROWS = "query string, run string, name string, batch long, at string, rows_in long, rows_late long, state_rows long, ms long, status string, error string"


class ProgressLog(StreamingQueryListener):
    """A context: `with ProgressLog(spark) as log: ...` notes the batches of all streams of the session, and writes them out in its end, or by flush().

    The listener itself runs no Spark job, since it is called between the batches; a row for each batch waits in the driver until it is written.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or new_path(spark, "stream-progress")).rstrip("/")
        self._rows: list[tuple] = []
        self._open: set[str] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self._changed:
            self._open.add(str(event.runId))
            self._rows.append((str(event.id), str(event.runId), event.name, None, event.timestamp, None, None, None, None, "started", None))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late, state = sum(s.numRowsDroppedByWatermark for s in p.stateOperators), sum(s.numRowsTotal for s in p.stateOperators)
        with self._changed:
            self._rows.append((str(p.id), str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, late, state, p.batchDuration, "batch", None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._open.discard(str(event.runId))
            self._rows.append((str(event.id), str(event.runId), None, None, None, None, None, None, None, "failed" if event.exception else "ended", event.exception))
            self._changed.notify_all()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.settle()
        self.spark.streams.removeListener(self)
        self.flush()

    def settle(self, timeout: float = 30) -> bool:
        """Wait until the streams that have stopped were reported as ended, since reports come later than the streams' ends."""
        active = {str(q.runId) for q in self.spark.streams.active}
        with self._changed:
            return self._changed.wait_for(lambda: self._open <= active, timeout)

    def flush(self) -> None:
        with self._changed:
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, _ROWS).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        """What was written: (query, run, name, batch, at, rows_in, rows_late, state_rows, ms, status, error)."""
        return self.spark.read.schema(_ROWS).parquet(self.path)


def progress(rows: DataFrame) -> DataFrame:
    """(run, name, batches, rows_in, rows_late, state_rows, status) of each run so far. A batch that is reported twice counts once."""
    once = rows.groupBy("run", "batch", "status").agg(F.max("name").alias("name"), F.max("rows_in").alias("rows_in"), F.max("rows_late").alias("rows_late"), F.max("state_rows").alias("state_rows"))
    is_batch = F.col("status") == "batch"
    ended = F.max(F.when(F.col("status").isin("ended", "failed"), F.col("status")))
    return once.groupBy("run").agg(
        F.max("name").alias("name"), F.count_if(is_batch & (F.col("rows_in") > 0)).alias("batches"), F.coalesce(F.sum("rows_in"), F.lit(0)).alias("rows_in"), F.coalesce(F.sum("rows_late"), F.lit(0)).alias("rows_late"),
        F.max_by("state_rows", F.when(is_batch, F.col("batch"))).alias("state_rows"), F.coalesce(ended, F.lit("running")).alias("status"),
    )

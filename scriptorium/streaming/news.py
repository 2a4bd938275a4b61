"""The same transforms over streams of articles or events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from scriptorium.operators import catalog, news


def dated(stream: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(dated rows, undated rows): an undated row can have no event time and takes a way of its own."""
    return stream.where(F.col(ts).isNotNull()), stream.where(F.col(ts).isNull())


def first_seen(stream: DataFrame, key: str, ts: str = "ts", horizon: str = "48 hours") -> DataFrame:
    """The first row of each key within the horizon; state older than that is dropped."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def day_counts(stream: DataFrame, category: str, ts: str = "ts", horizon: str = "48 hours") -> DataFrame:
    """Tumbling days by event time."""
    return stream.withWatermark(ts, horizon).groupBy(F.window(ts, "1 day").alias("w"), category).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), category, "n")


def sliding_counts(stream: DataFrame, category: str, ts: str = "ts", size: str = "1 day", step: str = "1 hour", horizon: str = "48 hours") -> DataFrame:
    return stream.withWatermark(ts, horizon).groupBy(F.window(ts, size, step).alias("w"), category).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), category, "n")


def sessions(stream: DataFrame, user: str, ts: str = "ts", gap: str = "30 minutes", horizon: str = "48 hours") -> DataFrame:
    return stream.withWatermark(ts, horizon).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_days(stream: DataFrame, path: str, key: str, size: str, arrival: str, source: str, checkpoint: str) -> DataStreamWriter:
    """Each batch merged into the stored days it touches: the longest of a key stays, which a first-wins state could not tell."""
    from pyspark.errors import AnalysisException

    from scriptorium.session import durable
    from scriptorium.sinks.writers import write_day

    def merge(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        days = batch.select("day").distinct()
        try:
            stored = spark.read.schema(batch.schema).parquet(path).join(F.broadcast(days), "day", "left_semi")
            both = batch.unionByName(stored.select(*batch.columns))
        except AnalysisException:  # nothing stored yet
            both = batch
        best = news.longest_first(both, key, F.length(size), arrival, source).drop("also_carried_by")
        write_day(durable(best.select(*batch.columns), "merged-days"), path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def unseen(stream: DataFrame, harvested: str, out: str, checkpoint: str) -> DataStreamWriter:
    """Files of watches that were not harvested before, added to `out` and to the harvested table.

    Each batch has a folder of its own in both, stream=.../batch=..., which a second try of the batch overwrites, and what it holds its files against
    leaves out its own folder: a failure at any point, between the two writes too, leaves neither doubles nor gaps.
    """
    import hashlib

    mine = hashlib.md5(checkpoint.encode()).hexdigest()[:12]  # a stream keeps its checkpoint; another one counts its batches anew

    def step(batch: DataFrame, number: int) -> None:
        from scriptorium.session import durable

        spark = batch.sparkSession
        known = harvested_files(spark, harvested).where(~((F.col("stream") == mine) & (F.col("batch") >= number)))
        fresh = durable(catalog.new_files(batch.dropDuplicates(["watch_id", "url"]), known), "fresh-files")
        folder = f"stream={mine}/batch={number}"
        fresh.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{folder}")
        fresh.select("watch_id", "url").write.mode("overwrite").parquet(f"{harvested.rstrip('/')}/{folder}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def harvested_files(spark: SparkSession, path: str) -> DataFrame:
    """(watch_id, url, stream, batch) of what was harvested so far."""
    from pyspark.errors import AnalysisException

    schema = "watch_id string, url string, stream string, batch long"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def start_harvested(files: DataFrame, path: str) -> None:
    """The files (watch_id, url) that were harvested before any stream."""
    files.select("watch_id", "url").distinct().write.mode("overwrite").parquet(f"{path.rstrip('/')}/stream=before/batch=-1")


class SessionProcessor(StatefulProcessor):
    """Arbitrary state by session: turns' JSON folded in their order of arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string, turns int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import json

        from scriptorium.operators.session import apply_turn

        stored = self.state.get() if self.state.exists() else None
        state, turns = (json.loads(stored[0]), stored[1]) if stored else ({}, 0)
        for pdf in rows:
            for raw in pdf.sort_values("turn")["state"]:
                turns += 1
                try:
                    turn = json.loads(raw) if raw else {}
                except ValueError:
                    turn = {}
                state = apply_turn(state, turn, turns) if isinstance(turn, dict) else state
        self.state.update((json.dumps(state, ensure_ascii=False), turns))
        yield pd.DataFrame({"session_id": [key[0]], "turns": [turns], "n_threads": [len(state.get("threads", []))]})

    def close(self) -> None:
        pass


def session_stream(turns: DataFrame) -> DataFrame:
    """(session_id, turns, n_threads) after each batch; needs the RocksDB state store."""
    return turns.groupBy("session_id").transformWithStateInPandas(SessionProcessor(), "session_id string, turns int, n_threads int", "Update", "None")

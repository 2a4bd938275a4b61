"""Whole rows by what was decided about them, whatever their columns are named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import durable


def keep_rows(docs: DataFrame, kept: DataFrame, key: Column, mark: Column, copies: str | None = None) -> DataFrame:
    """The rows of docs, all columns, that kept has by identifier and mark, as often as its column `copies` says (once without it).

    kept has doc_id, mark and times, how many rows of docs share both; one row stands for all of these.
    Identifiers may be null. Only rows that are repeated are shuffled a second time. Columns of docs may have any names.
    """
    kept = durable(kept.select(F.struct("doc_id", "mark").alias("k"), "times", (F.col(copies) if copies else F.lit(1)).cast("int").alias("copies")), "kept-rows")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.struct(key.alias("doc_id"), mark.alias("mark")).alias("k"))
    found = rows.join(kept, rows["k"].eqNullSafe(kept["k"])).select("row", rows["k"].alias("k"), "times", "copies")
    once = found.where("times = 1").select("row", "copies")
    more = found.where("times > 1").groupBy("k").agg(F.first("row").alias("row"), F.first("copies").alias("copies")).select("row", "copies")
    out = once.union(more)
    if copies:
        out = out.select("row", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("row.*")

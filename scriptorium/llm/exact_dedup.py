"""Exact deduplication by content sort, in DataFrame operations only.

Sampled splitters range-partition the texts, Spark's external sort puts equal texts side by side, and the
window operator compares neighbouring full texts: a group of copies is one run, decided there. A text whose
copies are too many for one task is cut into runs by identifier; the first row of each run carries the
whole text over, and runs of one text are joined by comparing these. A splitter is drawn from the sort
key's first two columns, the text's head and a hash of all of it, so that what the driver samples stays
small with texts of any length; equal texts agree in both, and nothing is decided by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import durable

SPLITTER_CHARS = 32
#: Copies and bytes of copies that one run may have; more of them are cut into several.
RUN_ROWS, RUN_BYTES = 1024, 64 << 20


def _order(keep: str) -> Column:
    if keep not in ("largest", "smallest"):
        raise ValueError(keep)
    return F.desc_nulls_last("doc_id") if keep == "largest" else F.asc_nulls_last("doc_id")


def _runs(rows: DataFrame, keep: str, *carried: Column) -> DataFrame:
    """(doc_id, carried columns, place, run_keep, run_size, text_sha256, head_body) of rows (doc_id, body, ...), sorted by content.

    place is 1 for the row of a run that stays. head_body is the text where that row's run is one of
    several of its text, else null; cut tells all rows of such runs.
    """
    hot = rows.groupBy(F.xxhash64("body").alias("mark")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("body")).alias("bytes"))
    runs = F.greatest(F.ceil(F.col("n") / RUN_ROWS), F.least(F.col("n"), F.ceil(F.col("bytes") / RUN_BYTES))).cast("int")
    hot = durable(hot.where((F.col("n") > 1) & ((F.col("n") > RUN_ROWS) | (F.col("bytes") > RUN_BYTES))).select("mark", runs.alias("runs")), "many-copies")
    keyed = rows.withColumns({"head": F.substring("body", 1, SPLITTER_CHARS), "mark": F.xxhash64("body")}).join(hot, "mark", "left")
    keyed = keyed.withColumns({"cut": F.col("runs").isNotNull(), "slice": F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("runs")), F.lit(0))})
    run = Window.partitionBy("head", "mark", "slice", "body")
    ordered = run.orderBy(_order(keep))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(ordered)
    return keyed.repartitionByRange("head", "mark", "slice").select(
        "doc_id", *carried, "cut", place.alias("place"), F.first("doc_id").over(whole).alias("run_keep"), F.count(F.lit(1)).over(whole).alias("run_size"),
        F.sha2("body", 256).alias("text_sha256"), F.when(F.col("cut") & (place == 1), F.col("body")).alias("head_body"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each input row.

    Null text counts as the empty text. Texts are equal when they are identical. keep is "largest"
    or "smallest": the identifier that stays. Rows that share text and identifier share their fate;
    a null identifier stays only where its group has no other. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    best = F.max if keep == "largest" else F.min
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    local = durable(_runs(rows, keep), "exact-runs")
    # Only runs of texts that were cut are left to be joined, by their full texts: few rows, which tell all others by the digest.
    whole = local.where("head_body IS NOT NULL").groupBy("head_body").agg(best("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"))
    whole = durable(whole.select(F.sha2("head_body", 256).alias("text_sha256"), "all_keep", "all_size"), "exact-groups")
    done = local.where("NOT cut").select("doc_id", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), "text_sha256")
    cut = local.where("cut").join(whole, "text_sha256").select("doc_id", "all_keep", "all_size", "text_sha256")
    return done.union(cut).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row of each group of equal texts, all columns; of rows that share text and identifier, one stays.

    Rows travel with their texts through the sort. Null texts form one group with empty ones; an empty table
    stays empty; columns may have any names.
    """
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), row)
    heads = durable(_runs(rows, keep, F.col("row")).where("place = 1").select("doc_id", "row", "head_body"), "exact-heads")
    last = F.row_number().over(Window.partitionBy("head_body").orderBy(_order(keep)))
    cut = heads.where("head_body IS NOT NULL").withColumn("place", last).where("place = 1")
    return heads.where("head_body IS NULL").select("row.*").union(cut.select("row.*"))

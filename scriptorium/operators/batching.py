"""Size-budgeted batches, blocks and even samples.

A greedy batch's start depends on all before it, so these fold over a group's sizes in order. Spark's
aggregate() over an ordered array keeps that in one expression, stretch by stretch, so that its time grows with the items; a group is one work's items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STATE = "struct<sum:bigint,n:bigint,batch:bigint,out:array<bigint>>"


#: Sizes that are folded before their batches are added to the others': adding copies what is there.
STRETCH = 512


def _fold(sizes: Column, step) -> Column:
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("batch"), none.alias("out"))

    def stretch(s, i):
        own = _state(s["sum"], s["n"], s["batch"], none)
        return F.aggregate(F.slice(sizes, i, F.lit(STRETCH)), own.cast(_STATE), step, lambda r: _state(r["sum"], r["n"], r["batch"], F.concat(s["out"], r["out"])))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(sizes)), F.lit(STRETCH)), start.cast(_STATE), stretch, lambda s: s["out"])


def _state(total: Column, n: Column, batch: Column, out: Column) -> Column:
    return F.struct(total.cast("bigint").alias("sum"), n.cast("bigint").alias("n"), batch.cast("bigint").alias("batch"), out.alias("out"))


def overshoot(sizes: Column, budget: int) -> Column:
    """Items until the sum reaches the budget, then the batch closes (WIN-10): batch numbers from 0."""

    def step(s, x):
        new = s["sum"] >= budget
        batch = F.when(new, s["batch"] + 1).otherwise(s["batch"])
        return _state(F.when(new, x).otherwise(s["sum"] + x), F.lit(1), batch, F.concat(s["out"], F.array(batch)))

    return _fold(sizes, step)


def within(sizes: Column, budget: int) -> Column:
    """A batch closes before it would overflow; a larger item stands alone (WIN-11)."""

    def step(s, x):
        new = (s["n"] > 0) & (s["sum"] + x > budget)
        batch = F.when(new, s["batch"] + 1).otherwise(s["batch"])
        return _state(F.when(new, x).otherwise(s["sum"] + x), F.lit(1), batch, F.concat(s["out"], F.array(batch)))

    return _fold(sizes, step)


def small(sizes: Column, budget: int = 1200, most: int = 8) -> Column:
    """At most `most` items and a sum below the budget (WIN-12); each item is in one batch."""

    def step(s, x):
        new = (s["n"] > 0) & ((s["n"] >= most) | (s["sum"] + x >= budget))
        batch = F.when(new, s["batch"] + 1).otherwise(s["batch"])
        return _state(F.when(new, x).otherwise(s["sum"] + x), F.when(new, 1).otherwise(s["n"] + 1), batch, F.concat(s["out"], F.array(batch)))

    return _fold(sizes, step)


def batches(items: DataFrame, by: str, order: str, size: str, rule, out: str = "batch") -> DataFrame:
    """(by, order, out): a rule over each group's sizes in order; only order and size go through the group."""
    rows = items.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, size))).alias("rows_"))
    numbered = rows.withColumn("batch_", rule(F.transform("rows_", lambda r: r[size].cast("bigint"))))
    zipped = F.explode(F.arrays_zip(F.col(f"rows_.{order}").alias("o"), F.col("batch_").alias("b"))).alias("z")
    return numbered.select(by, zipped).select(by, F.col("z.o").alias(order), F.col("z.b").alias(out))


def chunk(order: Column, by: list, k: int) -> Column:
    """Blocks of k in order, from 0 (WIN-13)."""
    return F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / k)


def even_sample(rows: DataFrame, by: str, order: str, size: int = 60) -> DataFrame:
    """The rows at int(i n / size) of groups larger than that, else all (OPS-04)."""
    w = Window.partitionBy(by)
    rows = rows.withColumn("at_", F.row_number().over(w.orderBy(order)) - 1).withColumn("n_", F.count(F.lit(1)).over(w))
    # A row is taken when some i has floor(i n / size) = at; the first i at or after at size / n decides.
    i = F.ceil(F.col("at_") * size / F.col("n_"))
    taken = (i < size) & (F.floor(i * F.col("n_") / size) == F.col("at_"))
    return rows.where((F.col("n_") <= size) | taken).drop("at_", "n_")


def last_n(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """WIN-14."""
    return rows.withColumn("at_", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("at_") <= n).drop("at_")

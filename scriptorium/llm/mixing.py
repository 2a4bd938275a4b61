"""Mixing of sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source's target is met by whole rounds of all its
documents and a remaining budget below one round. That budget is met by bounded-knapsack dynamic programming over
the lengths and their counts, around an even start that it can undo: no choice of documents comes nearer. The documents that fill each length's count are picked by a seeded hash; a length that many
documents share is dealt over buckets of that hash, so no group has to meet in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.rows import keep_rows
from scriptorium.session import durable

WORDS = r"[^\x20\x09-\x0D]+"
#: Sums on either side of its start that the dynamic program looks at first.
WINDOW = 1 << 16


def _nearest(sums: np.ndarray, free: int, most: int, unit: int, budget: int) -> tuple[int, int, int]:
    """(distance, the sum's place, copies of the free length) of the nearest total to the budget; sums are those of the other lengths, in units."""
    copies = np.stack([np.clip((budget // unit - sums) // free + i, 0, most) for i in (0, 1)])
    totals = unit * (sums + free * copies)
    far = np.abs(totals - budget)
    at = np.lexsort((totals.reshape(-1), far.reshape(-1)))[0]
    return int(far.reshape(-1)[at]), int(at % len(sums)), int(copies.reshape(-1)[at])


def fit_budget(lengths: list[int], counts: list[int], budget: int, seed: int = 0) -> list[int]:
    """How many documents of each length to take, so that their words come as near the budget as any choice can.

    Start: each length's share of the budget, topped up in seeded order. The program then reaches sums around it: a bit for each sum, and for
    each packet of 1, 2, 4, ... documents of a length a shift up, for documents more, or down, for fewer. The length with the most words is
    left out of it, since any number of its documents can be taken in the end. The sums looked at are first those within WINDOW of the start;
    if none is as near as the lengths' common divisor allows, four times as many, up to all that can matter: with a longest
    document of L, a choice that is nearest differs from the start in 4 L + 1 documents at most, as
    their lengths can be put in an order in which no partial sum leaves 2 L, and documents between two equal partial sums can be left out.
    """
    live = [i for i, (n, c) in enumerate(zip(lengths, counts)) if n > 0 and c > 0]
    taken = [0] * len(lengths)
    total = sum(lengths[i] * counts[i] for i in live)
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return [c if n > 0 else 0 for n, c in zip(lengths, counts)]
    unit = math.gcd(*(lengths[i] for i in live))
    allowed = min(budget % unit, unit - budget % unit)
    free = max(live, key=lambda i: (lengths[i] * counts[i], -lengths[i]))
    others = [live[i] for i in np.random.default_rng(seed).permutation(len(live)) if live[i] != free]
    for i in others:
        taken[i] = counts[i] * budget // total
    rest = budget - sum(lengths[i] * taken[i] for i in others)
    rest -= lengths[free] * min(counts[free], max(0, rest) // lengths[free])
    for i in others:
        more = min(counts[i] - taken[i], max(0, rest) // lengths[i])
        taken[i] += more
        rest -= more * lengths[i]
    start = sum(lengths[i] * taken[i] for i in others) // unit
    room = sum(lengths[i] * counts[i] for i in others) // unit
    longest = max(lengths[i] for i in live) // unit
    enough = min(max(start, room - start), (4 * longest + 1) * longest)
    window = min(WINDOW, enough)
    while True:
        mask = (1 << (2 * window + 1)) - 1
        reach, states = 1 << window, []

        def nearest(reach: int) -> tuple[int, int, int]:
            bits = np.unpackbits(np.frombuffer(reach.to_bytes(2 * window // 8 + 1, "little"), np.uint8), bitorder="little")
            offsets = np.flatnonzero(bits) - window
            far, at, copies = _nearest(start + offsets, lengths[free] // unit, counts[free], unit, budget)
            return far, int(offsets[at]), copies

        # A bit for each sum with which copies of the free length make a total as near as can be: the program ends as soon as it reaches one.
        wanted = np.zeros(2 * window + 1, np.uint8)
        for goal in {budget // unit, -(-budget // unit)}:
            if abs(unit * goal - budget) == allowed:
                step, far = lengths[free] // unit, goal - start
                least, most = max(0, -((window - far) // step)), min(counts[free], (window + far) // step)
                wanted[far - np.arange(least, most + 1, dtype=np.int64) * step + window] = 1
        goals = int.from_bytes(np.packbits(wanted, bitorder="little").tobytes(), "little")
        for i in others:
            for sign, left in ((1, counts[i] - taken[i]), (-1, taken[i])):
                size = 1
                while left > 0 and not reach & goals:
                    packet = min(size, left)
                    shift = packet * lengths[i] // unit
                    if shift > 2 * window:
                        break
                    states.append((reach, i, sign * packet))
                    reach |= (reach << shift) & mask if sign > 0 else reach >> shift
                    left -= packet
                    size *= 2
            if reach & goals:
                break
        best = nearest(reach)
        if best[0] == allowed or window >= enough:
            break
        window = min(4 * window, enough)
    _, offset, taken[free] = best
    at = offset + window
    for before, i, packet in reversed(states):
        if not before >> at & 1:
            taken[i] += packet
            at -= packet * lengths[i] // unit
    return taken


def _fit(source: pd.DataFrame, seed: int) -> pd.DataFrame:
    source = source.sort_values("size")
    lengths, counts = source["size"].astype(int).tolist(), source["n"].astype(int).tolist()
    total, target = int(source["source_size"].iloc[0]), float(source["target"].iloc[0])
    rounds = min(3, int(target // total)) if total else 0
    budget = 0 if rounds >= 3 else round(target - rounds * total)
    taken = fit_budget(lengths, counts, budget, seed + int(source["place"].iloc[0]))
    return source.assign(rounds=rounds, extra=taken)[["source", "size", "source_size", "target", "rounds", "extra"]]


def with_place(df: DataFrame, col: str, name: str) -> DataFrame:
    """A number from 0 for each row in the order of a column (nulls last), by range partitions and their counts."""
    ranged = durable(df.repartitionByRange(F.col(col).asc_nulls_last()).withColumn("part_", F.spark_partition_id()), "places")
    parts = ranged.groupBy("part_").agg(F.count(F.lit(1)).alias("rows_"))  # a row for each partition
    before = parts.select("part_", (F.sum("rows_").over(Window.orderBy("part_")) - F.col("rows_")).alias("before_"))
    own = F.row_number().over(Window.partitionBy("part_").orderBy(F.col(col).asc_nulls_last()))
    return ranged.withColumn("own_", own).join(before, "part_").withColumn(name, F.col("before_") + F.col("own_") - 1).drop("part_", "own_", "before_")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, place, target): shares by weight, none above `most` times its source's size."""
    sources = durable(
        with_place(totals, "source", "place").withColumn(
            "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
        ),
        "sources",
    )
    cap = F.col("source_size") * most
    level, free = 0.0, None
    while True:
        # The capped sources keep their cap; the others share the rest by weight. The level only rises, so this ends.
        over = cap < F.col("weight") * F.lit(level) if free is not None else F.lit(False)
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, cap).otherwise(0)).alias("capped"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(over.cast("long")).alias("n"),
        ).first()
        if not row["all"] or not row["weights"] or row["n"] == free:
            break
        level, free = (row["all"] - row["capped"]) / row["weights"], row["n"]
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", "place", target.alias("target"))


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, mark, size, source_size, target, copies, taken), a row for each input row.

    size counts the words of a text (null: 0); null sources form one source, the last. Sources without
    words have target 0 and take nothing. A source that can't meet its target exactly, as one with a
    single document, comes as near as whole documents allow. Repeated rows count each for itself.
    The same rows give the same mix. mark is xxhash64 of the text, copies the times it is taken. An empty table gives no rows; other columns are ignored.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("mark"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
    )
    sized = durable(sized, "sizes")
    counted = durable(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    targets = source_targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    t = targets.withColumnRenamed("source", "t_source")
    planned = counted.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    plan = planned.groupBy("source").applyInPandas(
        lambda pdf: _fit(pdf, seed), "source string, size long, source_size long, target double, rounds int, extra long"
    )
    p = durable(plan, "mixing-plan").withColumnsRenamed({"source": "p_source", "size": "p_size"})
    marked = sized.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.shiftrightunsigned("draw", 56))
    group = Window.partitionBy("source", "size").orderBy("bucket")
    buckets = (
        marked.groupBy("source", "size", "bucket")
        .agg(F.count(F.lit(1)).alias("m"))
        .select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), (F.sum("m").over(group) - F.col("m")).alias("before"))
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw", "doc_id", "mark"))
    ranked = marked.withColumn("rank", rank)
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket"))
    planned_rows = ranked.join(buckets, same).join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    copies = F.col("rounds") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("long")
    return planned_rows.select("doc_id", "mark", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, each as many times as the mix takes it. Texts without words cost nothing and stay once.

    Rows that share identifier and text are the same to the mix: one of them stands for all their copies.
    Nulls and empty tables are handled as by mix; columns may have any names.
    """
    mixed = mix(docs, id_col=id_col, text_col=text_col, **options)
    wanted = F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies")))
    kept = mixed.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("times"), wanted.alias("copies")).where("copies > 0")
    return keep_rows(docs, kept, F.col(id_col), F.xxhash64(text_col), "copies")

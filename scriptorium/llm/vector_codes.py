"""Compression of vectors to codes of product quantisation, in integers, with Exponion search.

Components become integers floor(scale * x). A vector is cut into equal parts, and each part position has a codebook
of its own. In each round every part looks for its nearest entry: it starts at the entry that it had before, at
distance u, and scans that entry a's list of all entries by their distance from a. An entry further from a than
u + b, b being the best distance so far, can't be as near (triangle inequality), nor can any that follows it in the
list. Distances are exact integers; ties go to the smaller index.

A round is one pass of tasks that know the codebooks (entries x components numbers): it writes the
vectors with their new entries and, once a task, the sums and counts of the parts of each entry, which Spark adds up
to the next codebooks. Vectors are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.workers import forget
from scriptorium.session import durable, new_path, remove

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components must be smaller than this, so that a task's sums fit 64 bits.
MOST = 1 << 40
#: Vectors that a task works on at once, and those whose sums it holds before it gives them out.
HELD, SUMMED = 16384, 1 << 22
#: Entries of a list that are looked at before the radius is drawn in again: so many first, then twice as many.
FIRST_SCAN = 16


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the values, where each row's begin and the last one's end) of lists without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _integers(scale: int):
    """(vec_id, label, vector) to (vec_id, label, d, ints): the rows with a vector of finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            column = batch.column(2).cast(pa.list_(pa.float64()))
            flat, offsets = _lists(column)  # null components become NaN
            flat, offsets = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
            sizes = np.diff(offsets)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
            rows = np.flatnonzero(good)
            with np.errstate(over="ignore"):
                whole = np.floor(flat[np.repeat(good, sizes)] * float(scale))
            if (np.abs(whole) >= MOST).any():
                raise ValueError(f"a component's integer is {MOST} or larger")
            kept = sizes[rows]
            ints = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(whole.astype(np.int64)))
            some = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(kept.astype(np.int32)), ints], names=["vec_id", "label", "d", "ints"])

    return run


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all of y, as exact integers."""
    high = 2 * max((int(np.abs(z).max()) for z in (x, y) if z.size), default=0)
    bound = high * high * max(1, x.shape[1])
    if bound < 1 << 53:  # every product and sum is exact in doubles
        a, b = x.astype(np.float64), y.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    if bound >= 1 << 63:
        x, y = x.astype(object), y.astype(object)
    out = np.zeros((len(x), len(y)), x.dtype)
    for i in range(x.shape[1]):
        out += np.subtract.outer(x[:, i], y[:, i]) ** 2
    return out


class Codebook:
    """The entries of a part position, and each entry's list of all by distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = squares(entries, entries)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest entry and its squared distance, searched from the entry at start; and how many distances that took."""
        entry, best, looked = start.astype(np.int64), None, len(x)
        by = np.argsort(start, kind="stable")
        edges = np.flatnonzero(np.diff(start[by], prepend=-1))
        for lo, hi in zip(edges, np.append(edges[1:], len(by))):
            rows, a = by[lo:hi], int(start[by[lo]])
            own, order = x[rows], self.order[a]
            first = squares(own, self.entries[a : a + 1])[:, 0]
            if best is None:
                best = np.zeros(len(x), first.dtype)
            near, at, reach = first.copy(), np.full(len(rows), a), np.sqrt(first.astype(np.float64))
            gaps = np.sqrt(self.gaps[a].astype(np.float64))
            i, n = 0, FIRST_SCAN
            while i < len(order):
                # The slack covers the roots' rounding.
                live = np.flatnonzero(gaps[i] <= (reach + np.sqrt(near.astype(np.float64))) * (1 + 1e-9) + 1e-9)
                if not len(live):
                    break
                some = order[i : i + n]
                far = squares(own[live], self.entries[some])
                looked += far.size
                least = far.min(axis=1)
                index = np.where(far == least[:, None], some[None, :], len(order)).min(axis=1)
                better = (least < near[live]) | ((least == near[live]) & (index < at[live]))
                near[live[better]], at[live[better]] = least[better], index[better]
                i, n = i + n, 2 * n
            entry[rows], best[rows] = at, near
        return entry, np.zeros(0, np.int64) if best is None else best, looked


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _assign(books: list[np.ndarray], d: int, label: str):
    """(vec_id, label, ints, codes) to the same with new codes and the error, and the sums and counts of each entry's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = d // len(books)
        known = [Codebook(b) for b in books]
        sums, counts, seen = np.zeros((len(books), len(books[0]), w), np.int64), np.zeros((len(books), len(books[0])), np.int64), 0

        def given() -> pa.RecordBatch:
            part, entry = np.nonzero(counts)
            n, none = len(part), pa.nulls
            flat = pa.array(sums[part, entry].reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w, pa.int32()), flat)
            columns = [pa.array(np.ones(n, np.int32)), none(n, pa.int64()), none(n, kind), none(n, pa.list_(pa.int64())), none(n, pa.list_(pa.int32())), none(n, pa.int64())]
            columns += [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), lists]
            return pa.RecordBatch.from_arrays(columns, names=names)

        names = ["kind", "vec_id", "label", "ints", "codes", "error", "part", "entry", "n", "sums"]
        kind = pa.null()
        for table in _gathered(batches):
            kind = table.schema.field("label").type
            flat, offsets = _lists(table.column("ints").combine_chunks())
            x = flat[offsets[0] : offsets[-1]].reshape(len(table), d)
            flat, offsets = _lists(table.column("codes").combine_chunks())
            before = flat[offsets[0] : offsets[-1]].reshape(len(table), len(books))
            codes, error = np.empty((len(table), len(books)), np.int32), 0
            for p, book in enumerate(known):
                own = np.ascontiguousarray(x[:, p * w : (p + 1) * w])
                codes[:, p], far, _ = book.nearest(own, before[:, p])
                error = error + far
                np.add.at(sums[p], codes[:, p], own)
                counts[p] += np.bincount(codes[:, p], minlength=counts.shape[1])
            n = len(table)
            columns = [pa.array(np.zeros(n, np.int32)), table.column("vec_id").combine_chunks(), table.column("label").combine_chunks(), table.column("ints").combine_chunks()]
            columns += [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(books), pa.int32()), pa.array(codes.reshape(-1))), pa.array(error.tolist(), pa.int64())]
            columns += [pa.nulls(n, pa.int32())] * 2 + [pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            seen += n
            if seen >= SUMMED:
                yield given()
                sums[:], counts[:], seen = 0, 0, 0
        if seen:
            yield given()

    return run, f"kind int, vec_id long, label {label}, ints array<long>, codes array<int>, error long, part int, entry int, n long, sums array<long>"


def next_books(rounds: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry becomes the floor of the mean of its parts, component by component; unused ones stay. A row for each entry reaches the driver."""
    w = books[0].shape[1]
    total = rounds.where("kind = 1").groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(w)))
    out = [b.copy() for b in books]
    for row in total.collect():
        out[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(w)]
    return out


def train_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, codes, error) for each kept row, the final codebooks).

    codes are the entries' indexes in the order of the parts. Rows whose vector is null or holds null or non-finite
    components are left out; zero and empty vectors are kept. The first codebooks are the vectors with the smallest identifiers, a null one
    coming last, ties by the vectors; with fewer vectors than entries there are as many entries as vectors. Repeated rows count each for itself.
    Kept vectors must have one length, a multiple of the parts, and components whose integers are below 2^40; anything else raises.
    Other columns are ignored. An empty table gives no rows and empty codebooks.
    """
    spark = vectors.sparkSession
    label = vectors.schema[label_col].dataType.simpleString()
    source = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("vec_id"), vectors[f"`{label_col}`"].alias("label"), vectors[f"`{vector_col}`"].alias("v"))
    kept = durable(source.mapInArrow(_integers(scale), f"vec_id long, label {label}, d int, ints array<long>"), "vector-integers")
    lengths = [r["d"] for r in kept.select("d").distinct().limit(2).collect()]
    if not lengths:
        return kept.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), []
    if len(lengths) > 1 or lengths[0] % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}; found {sorted(lengths)}")
    d, w = lengths[0], lengths[0] // parts
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    seeds = np.array([r["ints"] for r in first], np.int64).reshape(len(first), d)
    books = [np.ascontiguousarray(seeds[:, p * w : (p + 1) * w]) for p in range(parts)]
    now, old = kept.withColumn("codes", F.array_repeat(F.lit(0), parts)), None
    for i in range(rounds + 1):
        run, schema = _assign(books, d, label)
        path = new_path(spark, f"vector-round-{i}")
        now.select("vec_id", "label", "ints", "codes").mapInArrow(run, schema).write.parquet(path)
        if old:
            remove(spark, old)  # the new table holds all that it held
        old, table = path, spark.read.schema(schema).parquet(path)
        if i < rounds:
            books = next_books(table, books)
        now = table.where("kind = 0")
    return now.select("vec_id", "label", "codes", "error"), books


def books_text(books: list[np.ndarray]) -> str:
    """All components by part, entry and position, as decimal numbers joined by commas."""
    return ",".join(str(x) for book in books for x in book.reshape(-1).tolist())


def compress(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each kept vector; null labels are one label.

    Cases and options are those of train_codes. Labels are summed up before they are joined, so a common one is no group.
    """
    coded, books = train_codes(vectors, **options)
    byte = lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    code = F.array_join(F.transform("codes", byte), "").alias("code")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", code, "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

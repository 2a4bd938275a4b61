"""Approximate nearest neighbours by cosine with cross-polytope hashing.

Vectors are turned by fast Hadamard pseudo-rotations (three rounds of random signs and a Hadamard
transform) and land in the bucket of the nearest signed axis, or of one axis in each of several rotations
where the vectors are so many that a bucket of one axis would be large. A query probes the nearest buckets in
each of several tables; how many is measured: a bounded sample of queries is compared with all vectors, and as
many buckets are probed as their true neighbours need for the recall aimed at. Where even all probes that may be
made fall short of it, every query is compared with all. Bucket and query blocks of bounded size meet in one task each and give their best pairs,
scored on the original vectors in double precision. Equal vectors are one entry with their smallest
identifiers, so neither a very common vector nor its queries fill a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import durable

NEAREST = 5
#: Tables, and buckets probed in each at most.
TABLES, MOST_PROBES = 4, 1024
#: Queries whose true neighbours the number of probes is measured on, and the share of these to be found.
SAMPLE_QUERIES, RECALL = 256, 0.96
ROUNDS = 3
#: Entries and queries that meet in one task at most, about.
ENTRY_BLOCK, QUERY_BLOCK = 8192, 2048


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors in double precision) for each length of the usable vectors: not null, of finite components, not all zero."""
    lists = column.cast(pa.list_(pa.float64()))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)  # null components become NaN
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        x = flat[offsets[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """A pseudo-rotation of unit vectors, padded to a power of two."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    random = np.random.default_rng([table, d, 977])
    for _ in range(ROUNDS):
        y *= random.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            y = y.reshape(len(x), -1, 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), d)
            h *= 2
        y /= np.sqrt(d)
    return y


def axes(y: np.ndarray, n: int) -> np.ndarray:
    """The n nearest signed axes of each row: 2 axis + (1 if negative)."""
    signed = np.stack([y, -y], axis=2).reshape(len(y), -1)
    n = min(n, signed.shape[1])
    return np.argsort(-signed, axis=1, kind="stable")[:, :n]


def depth_of(entries: int, d: int) -> int:
    """Rotations that make up a bucket, so that one of them holds about ENTRY_BLOCK of uniform vectors or more."""
    signed, depth = 2 << max(0, int(d - 1).bit_length()), 1
    while entries / signed ** (depth + 1) >= ENTRY_BLOCK / signed:
        depth += 1
    return depth


def buckets(x: np.ndarray, table: int, depth: int, n: int) -> np.ndarray:
    """The n nearest buckets of unit vectors in a table: the sums of their axes' lengths order combinations of one axis a rotation."""
    code, length = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for j in range(depth):
        y = rotate(x, table * depth + j)
        top = axes(y, n)
        own = np.take_along_axis(np.stack([y, -y], axis=2).reshape(len(y), -1), top, 1)
        code = (code[:, :, None] * (2 * y.shape[1]) + top[:, None, :]).reshape(len(x), -1)
        length = (length[:, :, None] + own[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-length, axis=1, kind="stable")[:, :n]
        code, length = np.take_along_axis(code, best, 1), np.take_along_axis(length, best, 1)
    return code


def probes_for(queries: np.ndarray, found: np.ndarray, tables: int, depth: int, recall: float = RECALL, most: int = MOST_PROBES) -> int | None:
    """The least number of probes a table that finds so many of the pairs (a query and a true neighbour, as unit vectors); null if none does."""
    need = np.full(len(queries), most)
    for t in range(tables):
        for i in range(0, len(queries), 64):  # the queries' buckets are `most` numbers each
            at = buckets(queries[i : i + 64], t, depth, most) == buckets(found[i : i + 64], t, depth, 1)
            need[i : i + 64] = np.minimum(need[i : i + 64], np.where(at.any(axis=1), at.argmax(axis=1), most))
    need = np.sort(need)
    last = int(need[max(0, int(np.ceil(recall * len(need))) - 1)]) + 1
    return last if last <= most else None


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in matrices(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(np.full(len(rows), x.shape[1], np.int32))], names=["vec_id", "vector", "d"]
            )


def _dealt(tables: int, depth: int, probes: int):
    """(key, vector, ...) to a row for each table and probed bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            d = batch.column("d").to_numpy()
            for size in np.unique(d):
                rows = np.flatnonzero(d == size)
                x = unit(np.frombuffer(b"".join([vectors[i] for i in rows])).reshape(len(rows), size))
                for t in range(tables):
                    found = buckets(x, t, depth, probes)
                    part = batch.take(pa.array(np.repeat(rows, found.shape[1])))
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, t, np.int32)), pa.array(found.reshape(-1)), *part.columns], names=["table", "bucket", *part.schema.names]
                    )

    return run


def _best(most: int):
    """The best `most` identifiers of a block of entries for each query of a block."""

    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(queries) and len(entries):
            d = queries.column("d")[0].as_py()
            keys, ids = queries.column("key").to_pylist(), entries.column("ids").to_pylist()
            q = unit(np.frombuffer(b"".join(queries.column("vector").to_pylist())).reshape(-1, d))
            v = unit(np.frombuffer(b"".join(entries.column("vector").to_pylist())).reshape(-1, d))
            for start in range(0, len(q), 256):
                rough = q[start : start + 256] @ v.T
                bar = np.partition(rough, -most, axis=1)[:, -most] if rough.shape[1] > most else np.full(len(rough), -np.inf)
                for i, row in enumerate(rough):
                    at = np.flatnonzero(row >= bar[i] - 1e-9)
                    exact = np.einsum("ij,j->i", v[at], q[start + i])
                    found = sorted((-s, n) for a, s in zip(at, exact.tolist()) for n in ids[a])[:most]
                    out[0].extend([keys[start + i]] * len(found))
                    out[1].extend(n for _, n in found)
                    out[2].extend(-s for s, _ in found)
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["key", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = NEAREST, tables: int = TABLES, probes: int | None = None, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of the candidates found, best first, ties to the smaller identifier.

    is_query is a condition on the identifier. probes: buckets probed in each table; if null, as many as a sample of
    SAMPLE_QUERIES queries needs for the recall. Candidates are all rows but the query's own. Vectors that
    are null, zero, empty or hold null or non-finite components take no part, nor do rows without an
    identifier; only vectors of equal length are compared. A query whose probes find fewer than k is
    compared with all vectors, in blocks. A repeated identifier counts once for each distinct vector.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    most = k + 1  # one of the best may be the query itself
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id IS NOT NULL").mapInArrow(_usable, "vec_id long, vector binary, d int")
    rows = durable(usable.withColumn("key", F.unhex(F.md5("vector"))).distinct(), "vectors")
    # The smallest identifiers of each vector; the limit is applied before the shuffle, too.
    place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    entries = rows.withColumn("place", place).where(F.col("place") <= most).groupBy("key").agg(F.first("vector").alias("vector"), F.first("d").alias("d"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = durable(entries, "entries")
    asked = rows.where(is_query(F.col("vec_id"))).select("vec_id", "key")
    queries = durable(entries.join(asked.select("key").distinct(), "key", "left_semi").select("key", "vector", "d"), "queries")

    def meet(q: DataFrame, v: DataFrame, keys: list[str]) -> DataFrame:
        """Blocks of queries against blocks of entries under equal keys; the counts have a row for each key."""
        nv = v.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ENTRY_BLOCK).cast("int").alias("nv"))
        nq = q.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("nq"))
        blocks = nv.join(nq, keys)
        mark = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        qs = q.join(blocks, keys).withColumn("qb", mark("nq")).withColumn("vb", every("nv")).drop("nv", "nq")
        vs = v.join(blocks, keys).withColumn("vb", mark("nv")).withColumn("qb", every("nq")).drop("nv", "nq")
        by = [*keys, "qb", "vb"]
        return qs.groupBy(*by).cogroup(vs.groupBy(*by)).applyInArrow(_best(most), "key binary, vec_id long, score double")

    sizes = entries.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    depth = depth_of(sizes["n"], sizes["d"]) if sizes else 1
    if probes is None:
        # Bounded: SAMPLE_QUERIES queries and k neighbours of each, for one length of vectors.
        sample = queries.where(F.col("d") == (sizes["d"] if sizes else 0)).orderBy("key").limit(SAMPLE_QUERIES)
        sample = durable(sample, "sampled-queries")
        truth = meet(sample, entries.where(F.col("d") == (sizes["d"] if sizes else 0)).select("key", "vector", "d", "ids"), ["d"]).distinct()
        nearest_first = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
        truth = truth.withColumn("at", F.row_number().over(nearest_first)).where(F.col("at") <= most).select("key", "vec_id")
        other = rows.select("vec_id", F.col("key").alias("other"), F.col("vector").alias("found"))
        pairs = truth.join(other, "vec_id").where("key <> other").join(sample.select("key", "vector"), "key").select("vector", "found").collect()
        stacked = lambda name: unit(np.stack([np.frombuffer(p[name]) for p in pairs]))
        probes = probes_for(stacked("vector"), stacked("found"), tables, depth, recall) if pairs else 1
    if probes is None:
        found = durable(meet(queries, entries.select("key", "vector", "d", "ids"), ["d"]).distinct(), "candidates")
    else:
        dealt_q = queries.mapInArrow(_dealt(tables, depth, probes), "table int, bucket long, key binary, vector binary, d int")
        dealt_v = entries.mapInArrow(_dealt(tables, depth, 1), "table int, bucket long, key binary, vector binary, d int, ids array<long>")
        found = durable(meet(dealt_q, dealt_v, ["d", "table", "bucket"]).distinct(), "candidates")
    few = queries.join(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most), "key", "left_anti")
    few = durable(few, "few-found")
    if not few.isEmpty():
        found = found.union(meet(few, entries.select("key", "vector", "d", "ids"), ["d"])).distinct()
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).select("key", F.struct("vec_id", "score", "at").alias("hit"))
    # One row for each vector asked for, so that its queries, however many, are a join and not a group.
    lists = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("hit.at", "hit.vec_id", "hit.score"))).alias("hits"))
    own = asked.join(lists, "key").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("vec_id")), 1, k).alias("hits"))
    return own.select("query_id", F.posexplode("hits").alias("i", "h")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))

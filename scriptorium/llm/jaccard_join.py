"""Near duplicates by a size-aware heavy-light set similarity join on word shingles.

1. Every text becomes its set of shingle hashes. Texts with equal sets form a class; only classes are
   joined, so copies are never paired.
2. All shingles are counted: texts are worked on in chunks, a chunk's distinct shingles are dealt out by
   ranges of slots, several for each shingle of the input, summed up there, and every chunk gets back how
   common its own are. Each set is ordered from rare to common; the order only has to be the same for all,
   so shingles that share a slot cost time, never links. What no other set has is not indexed at all.
3. With J >= t, a set of n shares at least o = ceil(t n) elements with any partner, and two sets that
   share o elements share l of their first n - o + l. Small (light) sets are indexed by all pairs (l = 2)
   of those, large (heavy) sets by single elements (l = 1), and light sets that may meet a heavy one by
   both. The boundary is the size at which pairs stop being cheaper than scanning inverted lists, by the
   mean length of the lists that were counted.
4. In each inverted list, every class is first compared with two others only: the one whose elements are
   the commonest, and one by a hash that changes from turn to turn. Classes linked that way form components; when few pairs of different
   components are left that meet in a list, these are compared. Members of one component need no further comparison, so a group of near copies
   costs comparisons in proportion to its size, and no link between components is lost.
5. Pairs are pruned by length, by their position in the order, and by a lower bound on the symmetric
   difference from parity bits; what is left is compared on the full sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.components import components
from scriptorium.llm.rows import keep_rows
from scriptorium.llm.words import chunks, grams, mix, pack_sorted, unpack_sorted, words
from scriptorium.llm.workers import forget
from scriptorium.session import durable

SHINGLE = 5
PERCENT = 75
PARITY_BITS = 1024
#: Bytes of text in a chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Bytes of text for each shingle, about, the slots for each, and the shingles that are summed up in one range, about.
SHINGLE_BYTES, SLOTS_EACH, RANGE_SHINGLES = 6, 8, 1 << 21
#: Ranges at least, so that all cores have some.
LEAST_RANGES = 64
#: A list of more entries is dealt out by class while lists of one class are dropped.
LIST_ROWS = 20_000
LIGHT_LIMIT = 64
#: Positions in a set's order that are told apart; the filter by position only gets weaker beyond.
PLACES = (1 << 20) - 1
#: Pairs of different groups in a list that may be left for each of its entries when stars end.
PAIRS_A_POSTING = 16


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; a shorter text has its whole sequence as the only one, one without words none."""
    for w in words(column, lower=True):
        all_grams = grams(w.hashes, k)
        for i, (a, b) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist())):
            if b - a >= k:
                yield w.first + i, np.unique(all_grams[a : b - k + 1])
            elif b > a:
                yield w.first + i, grams(w.hashes[a:b], b - a, salt=0x5EED)
            else:
                yield w.first + i, np.zeros(0, np.uint64)


def least_overlap(n, percent: int = PERCENT):
    """The elements that a set of n shares with any partner at least."""
    return (percent * n + 99) // 100


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def class_of(s: np.ndarray) -> tuple[int, int, int]:
    """(class, sum, sum): the class is a hash of two independent sums over the set, which tell apart what the hash may not."""
    a, b = mix(s, 1).sum(dtype=np.uint64), mix(s, 2).sum(dtype=np.uint64)
    cls = mix(np.array([a, b, len(s)], np.uint64), 3)
    return _signed(int(cls[0] ^ (cls[1] >> np.uint64(1)) ^ cls[2])), _signed(int(a)), _signed(int(b))


_SUMMARY = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("parity", pa.binary()), ("part", pa.int32()), ("packed", pa.binary())])
_LEVEL = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("packed", pa.binary()), ("total", pa.float64()), ("squares", pa.float64())])
_INDEX = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("cls", pa.int64()), ("meta", pa.int64()), ("elements", pa.binary())])
_SUMMARY_SQL = "chunk long, doc_id long, mark long, n long, cls long, s1 long, s2 long, parity binary, part int, packed binary"
_LEVEL_SQL = "chunk long, part int, packed binary, total double, squares double"
_INDEX_SQL = "token long, salt int, cls long, meta long, elements binary"


def _rows_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """Those columns, the schema's others null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _opened(packed, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batches of a chunk of (doc_id, mark, text), and their sets."""
    for rows in pa.ipc.open_stream(packed):
        yield rows, [s for _, s in shingle_sets(rows.column(2), k)]


def _slots(sets: list[np.ndarray], bits: int) -> np.ndarray:
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)) >> np.uint64(64 - bits)


def _summaries(k: int, bits: int, range_bits: int):
    """Chunks to a row for each document, and one for each range with the slots of the chunk's classes, repeated as often as they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("packed")):
                classes: dict[int, np.ndarray] = {}
                for rows, sets in _opened(packed.as_buffer(), k):
                    cols: list[list] = [[] for _ in range(5)]
                    for s in sets:
                        bits_of = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
                        cls = class_of(s)
                        for col, x in zip(cols, (len(s), *cls, np.packbits(bits_of.astype(np.uint8)).tobytes())):
                            col.append(x)
                        if len(s) > 1:
                            classes[cls[0]] = s
                    yield _rows_of(_SUMMARY, chunk=np.full(len(rows), chunk), doc_id=rows.column(0), mark=rows.column(1), **dict(zip(("n", "cls", "s1", "s2", "parity"), cols)))
                slots = _slots(list(classes.values()), bits)
                slots.sort()
                edges = np.searchsorted(slots >> np.uint64(bits - range_bits), np.arange((1 << range_bits) + 1, dtype=np.uint64))
                found = [i for i in range(1 << range_bits) if edges[i] < edges[i + 1]]
                if found:
                    yield _rows_of(_SUMMARY, chunk=np.full(len(found), chunk), part=found, packed=[pack_sorted(slots[edges[i] : edges[i + 1]]) for i in found])

    return run


def _levels(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's slots of all chunks to how common they are, for each chunk at its own distinct slots.

    0 stands for a slot that occurs once, else there are four levels for each doubling. A row without a
    chunk has the entries of lists of two and more, and the sum of these lists' squared lengths.
    """
    of, parts = [], []
    for batch in tables:
        of += batch.column("chunk").to_pylist()
        parts += [unpack_sorted(x) for x in batch.column("packed").to_pylist()]
    known, counts = np.unique(np.concatenate(parts), return_counts=True)
    levels = np.where(counts > 1, 1 + np.floor(4 * np.log2(counts)), 0).astype(np.uint8)
    many = counts[counts > 1].astype(float)
    yield _rows_of(_LEVEL, part=[key[0].as_py()], total=[many.sum()], squares=[(many * many).sum()])
    for chunk, x in zip(of, parts):
        own = x[np.append(True, x[1:] != x[:-1])]
        yield _rows_of(_LEVEL, chunk=[chunk], part=[key[0].as_py()], packed=[zstandard.compress(levels[np.searchsorted(known, own)].tobytes(), 1)])


def light_boundary(list_rows: float, percent: int = PERCENT) -> int:
    """The largest size up to which the pairs of a set cost less than scanning its inverted lists."""
    found = 1
    for n in range(2, LIGHT_LIMIT + 1):
        spare = n - int(least_overlap(n, percent))
        if (spare + 2) * (spare + 1) / 2 > (spare + 1) * list_rows:
            break
        found = n
    return found


def _index(k: int, percent: int, bits: int, boundary: int):
    """A chunk's texts, levels and own classes to index entries, and to the sets of the classes that have some.

    meta is n << 32 | commonness << 20 | position in the order. A set's commonness is the mean level of its
    elements: in a group of near copies, the text that the others were made from has the highest.
    """

    def run(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        levels: dict[int, bytes] = {}
        text, own = None, set()
        for batch in tables:
            for part, cls, packed in zip(*(batch.column(x).to_pylist() for x in ("part", "cls", "packed"))):
                if cls is not None:
                    own.add(cls)
                elif part is not None:
                    levels[part] = zstandard.decompress(packed)
                else:
                    text = packed
        table = np.frombuffer(b"".join(levels.pop(i) for i in sorted(levels)), np.uint8)
        classes: dict[int, np.ndarray] = {}
        for _, sets in _opened(text, k):
            classes |= {class_of(s)[0]: s for s in sets if len(s) > 1}
        distinct, of = np.unique(_slots(list(classes.values()), bits), return_inverse=True)
        if len(distinct) != len(table):
            raise ValueError("a chunk's levels are not those of its slots")
        out, size, start = [], 0, 0
        for cls, s in classes.items():
            n, level = len(s), table[of[start : start + len(s)]]
            start += n
            if cls not in own:
                continue
            o = int(least_overlap(n, percent))
            first = np.lexsort((s, level))[: n - o + 2]
            common = level[first] > 0
            if not common.any():
                continue
            meta, made = (n << 32) + (int(16 * level.mean()) << 20), []
            if n <= boundary:
                x = s[first[common]]
                i, j = np.triu_indices(len(x), 1)
                pairs = mix(np.minimum(x[i], x[j]) * np.uint64(3) + np.maximum(x[i], x[j]), 0xBA5E)
                made.append((pairs, np.zeros(len(pairs), np.int32), np.full(len(pairs), meta)))
            if n > boundary or 100 * n >= percent * (boundary + 1):
                places = np.flatnonzero(common[: n - o + 1])
                at = first[places]
                lists = np.ceil(2.0 ** ((level[at] - 1) / 4.0) / LIST_ROWS).astype(np.int64)
                # Dealt lists are numbered from 1: only undealt ones may be dropped for having one class.
                salt = np.where(lists > 1, 1 + (cls & 0x7FFFFFFF) % np.maximum(lists, 1), 0).astype(np.int32)
                made.append((s[at], salt, meta + np.minimum(places, PLACES)))
            if sum(len(x[0]) for x in made):
                out += [(cls, *x) for x in made]
                yield _rows_of(_INDEX, cls=[cls], elements=[s.tobytes()])
                size += sum(len(x[0]) for x in made)
            if size > 1 << 18:
                yield entries(out)
                out, size = [], 0
        if out:
            yield entries(out)

    def entries(out: list[tuple]) -> pa.RecordBatch:
        cls = np.repeat(np.array([x[0] for x in out], np.int64), [len(x[1]) for x in out])
        return _rows_of(_INDEX, token=np.concatenate([x[1] for x in out]).view(np.int64), salt=np.concatenate([x[2] for x in out]), cls=cls, meta=np.concatenate([x[3] for x in out]))

    # Spark reads how groups are passed from the hints, which are not in a closure's reach as names.
    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "tables": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _compare(percent: int):
    """(a, b, set of a, set of b) to the (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for i, (p, q) in enumerate(zip(x, y)):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(p) + len(q)
                shared = both - len(np.unique(np.concatenate([p, q])))
                if 100 * shared >= percent * (both - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def _can_link(percent: int):
    """Whether lengths and parity bits leave room for a link: the bits that differ are at most the symmetric difference."""

    @F.pandas_udf("boolean")
    def check(n: pd.Series, m: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(p), np.uint64).reshape(len(p), -1) ^ np.frombuffer(b"".join(q), np.uint64).reshape(len(q), -1)
        total = (n + m).to_numpy()
        shared = (percent * total + 99 + percent) // (100 + percent)  # ceil(t / (1 + t) (n + m))
        return pd.Series(np.bitwise_count(x).sum(axis=1) <= total - 2 * shared)

    return check


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, n_shingles, component_id), a row for each input row; mark is xxhash64 of the text.

    Two documents link when 100 |A & B| >= percent |A | B| for their sets of shingle hashes (64 bits);
    component_id is the smallest identifier reachable by links. Null texts and texts without words have
    no shingles and are linked with nothing; texts with fewer words than a shingle have one, and link
    only with the same sequence. Texts are read whole. Repeated rows and copies fall in one class. A null
    identifier joins its group without naming it. An empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    # Written out, so that counts and index are those of one reading.
    held = durable(texts.mapInArrow(chunks(CHUNK_BYTES, 2), "chunk long, packed binary"), "shingled-chunks")
    shingles = 1 + (docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0) // SHINGLE_BYTES
    range_bits = max(LEAST_RANGES, shingles // RANGE_SHINGLES).bit_length() - 1
    bits = max(range_bits, math.ceil(math.log2(shingles * SLOTS_EACH)))
    summaries = durable(held.mapInArrow(_summaries(shingle, bits, range_bits), _SUMMARY_SQL), "shingle-sets")
    light = summaries.where("part IS NULL").drop("part", "packed")
    levels = durable(summaries.where("part IS NOT NULL").select("chunk", "part", "packed").groupBy("part").applyInArrow(_levels, _LEVEL_SQL), "shingle-levels")
    lists = levels.where("chunk IS NULL").agg(F.sum("total"), F.sum("squares")).first()
    boundary = light_boundary(lists[1] / lists[0] if lists[0] else 1.0, percent)

    # A class is a set; one document stands for it, and one chunk indexes it.
    classes = light.where("n > 0").groupBy("cls", "n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("parity").alias("parity"), F.min("chunk").alias("chunk"))
    classes = durable(classes, "shingle-classes")
    none = lambda kind: F.lit(None).cast(kind)
    told = levels.where("chunk IS NOT NULL").select("chunk", "part", none("long").alias("cls"), "packed")
    told = told.union(held.select("chunk", none("int"), none("long"), "packed")).union(classes.where("n > 1").select("chunk", none("int"), "cls", none("binary")))
    index = durable(told.groupBy("chunk").applyInArrow(_index(shingle, percent, bits, boundary), _INDEX_SQL), "shingle-index")
    sets = index.where("token IS NULL").select("cls", "elements")
    lists = Window.partitionBy("token", "salt")
    shared = index.where("token IS NOT NULL").select("token", "salt", "cls", "meta").withColumns({"low": F.min("cls").over(lists), "high": F.max("cls").over(lists)}).where("low <> high OR salt > 0")
    shared = durable(shared.select("token", "cls", "meta"), "shared-postings")

    size = lambda c: F.shiftright(c, 32)
    place = lambda c: F.col(c).bitwiseAND(PLACES)
    common = F.shiftright("meta", 20).bitwiseAND(0xFFF)
    known = classes.select("cls", "n", "parity")

    def fitting(pairs: DataFrame) -> DataFrame:
        """Distinct (a, b) that lengths and parity bits allow."""
        x, y = known.toDF("a", "n", "p"), known.toDF("b", "m", "q")
        close = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
        return pairs.join(x, "a").join(y, "b").where(close).where(_can_link(percent)("n", "m", "p", "q")).select("a", "b").distinct()

    def links(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_compare(percent), "a long, b long")

    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    found = tested = None
    before = float("inf")
    own = shared.withColumn("grp", F.col("cls"))
    for turn in itertools.count():
        # Every class against the list's commonest class and one that is another each turn, where these are of other groups.
        mark = F.xxhash64(F.lit(turn), "cls")
        ends = own.groupBy("token").agg(
            F.max(F.struct(common.alias("x"), mark.alias("r"), "cls", "grp"))["cls"].alias("core"), F.max(F.struct(mark.alias("r"), "cls"))["cls"].alias("other"),
            F.max(F.struct(common.alias("x"), mark.alias("r"), "cls", "grp"))["grp"].alias("core_grp"), F.max(F.struct(mark.alias("r"), "cls", "grp"))["grp"].alias("other_grp"),
        )
        end = F.explode(F.array(F.struct(F.col("core").alias("cls"), F.col("core_grp").alias("grp")), F.struct(F.col("other").alias("cls"), F.col("other_grp").alias("grp")))).alias("end")
        star = own.select("token", "cls", "grp").join(durable(ends, "list-ends"), "token").select("cls", "grp", end).where("grp <> end.grp")
        star = star.select(*ordered("cls", "end.cls")).distinct()
        star = fitting(star if tested is None else star.join(tested, ["a", "b"], "left_anti"))
        star = durable(star, "star-pairs")
        fresh = star.isEmpty()
        new = star if fresh else durable(links(star), "star-links")
        tested = star if tested is None else tested.union(star)
        found = new if found is None else found.union(new)
        groups = durable(components(found, "a", "b").withColumnRenamed("node", "cls"), "components")
        own = shared.join(groups, "cls", "left").select("token", "cls", "meta", F.coalesce("component", "cls").alias("grp"))
        mixed = own.groupBy("token", "grp").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
        mixed = durable(mixed.where("n * n > within"), "mixed-lists")
        own = durable(own.join(mixed.select("token"), "token"), "mixed-postings")
        left = mixed.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("within")) / 2), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        # Once few pairs are left for the lists' length, or a turn doesn't halve them, they are compared one by one.
        if left["pairs"] <= PAIRS_A_POSTING * left["rows"] or left["pairs"] > before / 2 or fresh:
            break
        before = left["pairs"]

    # Then what still meets in a list across groups.
    x, y = own.toDF("token", "a", "am", "ag"), own.toDF("token", "b", "bm", "bg")
    n, m = size("am"), size("bm")
    need = F.expr(f"({percent} * (shiftright(am, 32) + shiftright(bm, 32)) + {99 + percent}) div {100 + percent}")
    room = F.least(n - place("am"), m - place("bm")) >= need
    cross = x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("ag") != F.col("bg")) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & room)
    cross = durable(fitting(cross.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")), "cross-pairs")
    if not cross.isEmpty():
        groups = durable(components(durable(found.union(links(cross)), "links"), "a", "b").withColumnRenamed("node", "cls"), "components")

    grouped = durable(classes.join(groups, "cls", "left").select("cls", "n", "s1", "s2", "rep", F.coalesce("component", "cls").alias("grp")), "grouped-classes")
    named = grouped.join(grouped.groupBy("grp").agg(F.min("rep").alias("component_id")), "grp").select("cls", "n", "s1", "s2", "component_id")
    return light.where("n > 0").join(named, ["cls", "n", "s1", "s2"]).select("doc_id", "mark", F.col("n").alias("n_shingles"), "component_id").union(
        light.where("n = 0").select("doc_id", "mark", "n", "doc_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of linked documents, all columns: the one with the smallest identifier. Texts without words stay, one for each identifier.

    Handling of nulls, repeated rows and empty tables is that of near_duplicates; columns may have any names.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark"))
    kept = found.groupBy("component_id", F.col("n_shingles") > 0).agg(least.alias("kept")).select("kept.doc_id", "kept.mark")
    times = found.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("times"))
    kept = kept.join(times, kept["doc_id"].eqNullSafe(times["doc_id"]) & (kept["mark"] == times["mark"])).select(kept["doc_id"], kept["mark"], "times")
    return keep_rows(docs, kept, F.col(id_col).cast("long"), F.xxhash64(text_col))

"""Phrase collocations by merged count-min sketches and an exact second pass.

Texts are cut at sentence punctuation and line ends into pieces, pieces into words, and every run of one to four words of a
piece is an n-gram of its language. The first pass sketches: every few MB of text, a task adds its n-grams, by hash, to slots in each of
ROWS rows of counters. The rows are as wide as the corpus needs (a slot for every 32 bytes of text, or some four n-grams that no other equals),
and are dealt out in ranges of slots: a range's task merges all tasks' lists of slots and keeps those that reached the threshold. Sums
of slots never are below an n-gram's own count, so nothing frequent is lost. The second pass counts only the n-grams whose slots
reached it in all rows, by the words themselves, and Spark adds these counts up exactly.

How the second pass learns of the slots depends on their number: up to KNOWN_SLOTS they are sent to every task; beyond that, or over more than KNOWN_TEXT, texts are
put in chunks and dealt out in shares. A range's task then adds up the chunks' lists and gives each share back those of its own slots that reached
the threshold, so that no slot meets a text without it, and the work grows with the text alone.

A phrase's score compares its count with those of the two parts that its worst cut leaves. Parts of a frequent phrase are at
least as frequent, so all counts that are needed are among the survivors. Phrases that mostly occur in one longer phrase are subsumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.words import byte_table, chunks, lower_az, mix, numbered, pack_sorted, slices, span_texts, spans, unpack_sorted
from scriptorium.llm.workers import forget, remembered
from scriptorium.session import durable

LONGEST, LEAST, TOP, SUBSUMED = 4, 30, 2000, 80
#: What ends a piece, and what else ends a word.
BREAKS = byte_table(b".,;:!?\n\x0b\x0c\r")
SPACES = byte_table(b" \t")
#: Rows of counters, bits of the number of counters in a range, and bytes of text for each range.
ROWS, RANGE_BITS, RANGE_TEXT = 2, 20, 1 << 25
#: Bytes of text in a chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Slots that are sent to every task at most, and bytes of text over which they are looked for at all: larger corpora have more.
KNOWN_SLOTS, KNOWN_TEXT = 4_000_000, 1 << 30
#: Bytes of text that a task of the second pass counts at least, where there are twice as many tasks as cores: a phrase is a row of each task that meets it.
COUNT_TEXT = 64 << 20
#: Bytes of text in a share, about.
SHARE_TEXT = 12 << 20
#: New counts that a task adds up at once, or as many as it holds, and phrases whose sums it holds before it gives them out.
NEW_COUNTS, HELD_PHRASES = 400_000, 1_500_000

_SLOTS = "row int, part int, packed binary"
_HITS = "share int, row int, part int, packed binary"
_COUNTED = "lang string, phrase string, n long"


def _grams(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, list[tuple[np.ndarray, np.ndarray]]]]:
    """(lang, text) to, some documents at a time: each word's language and number, the words and the languages by number, and for k = 1 to LONGEST
    the first words' places of all n-grams of k words, and their hashes."""
    langs = rows.column(0).cast(pa.string()).dictionary_encode()
    names = langs.dictionary
    of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lang_hash = mix(pd.util.hash_array(np.array(names.to_pylist(), object), categorize=False), 31) if len(names) else np.zeros(0, np.uint64)
    for s in spans(rows.column(1), BREAKS | SPACES):
        size = np.diff(s.at)
        if not len(s.starts):
            continue
        ids, known = numbered(span_texts(lower_az(s.data), s.inside, s.ends - s.starts))
        word = pd.util.hash_array(np.array(known.to_pylist(), object), categorize=False)[ids]
        lang = np.repeat(of[s.first : s.first + len(size)], size)
        doc = np.repeat(np.arange(len(size)), size)
        breaks = np.cumsum(BREAKS[s.data])[s.starts]
        gram, at, found = mix(word ^ lang_hash[lang], 32), np.arange(len(ids)), []
        for k in range(1, LONGEST + 1):
            if k > 1:
                n = len(ids) - k + 1
                if n <= 0:
                    break
                gram = mix(gram[:n] * np.uint64(0x9E3779B97F4A7C15) + word[k - 1 :], 32 + k)
                at = np.flatnonzero((breaks[:n] == breaks[k - 1 :]) & (doc[:n] == doc[k - 1 :]))
            found.append((at, gram[at]))
        yield lang, ids, known, names, found


def slots(grams: np.ndarray, row: int, ranges: int) -> np.ndarray:
    """Their counters in a row: the range in the upper bits."""
    h = mix(grams, 41 + row)
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32) << np.uint64(RANGE_BITS)) | (h & np.uint64((1 << RANGE_BITS) - 1))


def _lists(found: list[np.ndarray], ranges: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, range, sorted slots in it, repeats included) of n-grams."""
    every = np.concatenate(found)
    found.clear()
    low = np.uint64((1 << RANGE_BITS) - 1)
    for row in range(ROWS):
        own = np.sort(slots(every, row, ranges))
        edges = np.searchsorted(own, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(RANGE_BITS))
        for i in np.flatnonzero(np.diff(edges)):
            yield row, int(i), pack_sorted(own[edges[i] : edges[i + 1]] & low)


def _batch(rows: list[tuple], **kinds) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def _sketch(ranges: int, most: int):
    """(lang, text) to the lists of their n-grams' slots, `most` bytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        found, size = [], 0
        for batch in batches:
            for i, j in slices(batch.column(1)):
                part = batch.slice(i, j - i)
                for *_, grams in _grams(part):
                    found += [g for _, g in grams]
                size += part.column(1).nbytes
                if found and size >= most:
                    yield _batch(list(_lists(found, ranges)), row=pa.int32(), part=pa.int32(), packed=pa.binary())
                    size = 0
        if found:
            yield _batch(list(_lists(found, ranges)), row=pa.int32(), part=pa.int32(), packed=pa.binary())

    return run


def _merge(least: int):
    """A range's lists to its slots whose sums are least or more; lists are added one by one."""

    def run(key: tuple[pa.Scalar, ...], lists: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << RANGE_BITS, np.int64)
        for batch in lists:
            for packed in batch.column("packed"):
                own = unpack_sorted(packed.as_py())
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                counters[own[first]] += np.diff(first, append=len(own))
        reached = np.flatnonzero(counters >= least).astype(np.uint64)
        if len(reached):
            yield _batch([(key[0].as_py(), key[1].as_py(), len(reached), pack_sorted(reached))], row=pa.int32(), part=pa.int32(), n=pa.int64(), packed=pa.binary())

    # Spark reads how groups are passed from the hints, which are not in a closure's reach as names.
    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "lists": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


class Reached:
    """The slots of each row that reached the threshold; most others are told by a table of bits of their numbers."""

    def __init__(self, found: list[tuple[int, int, bytes]], ranges: int):
        self.ranges = ranges
        self.rows, self.maybe = [], []
        for row in range(ROWS):
            parts = [unpack_sorted(packed) + (np.uint64(part) << np.uint64(RANGE_BITS)) for r, part, packed in found if r == row]
            self.rows.append(np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64))
            table = np.zeros(1 << max(10, min(25, (16 * len(self.rows[-1])).bit_length())), bool)
            table[self.rows[-1] & np.uint64(len(table) - 1)] = True
            self.maybe.append(table)

    def holds(self, grams: np.ndarray) -> np.ndarray:
        """Which places of these n-grams have slots among them in all rows."""
        at = np.arange(len(grams))
        for row, (known, maybe) in enumerate(zip(self.rows, self.maybe)):
            if not len(known):
                return at[:0]
            own = slots(grams, row, self.ranges)
            some = np.flatnonzero(maybe[own & np.uint64(len(maybe) - 1)])
            own = own[some]
            some = some[known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own]
            at, grams = at[some], grams[some]
        return at


def _number(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, return_inverse=True)[1]


def phrases(ids: np.ndarray, known: pa.Array, lang: np.ndarray, names: pa.Array, at: np.ndarray, k: int) -> pa.Table:
    """(lang, phrase, n): how often the n-grams of k words that begin at these places occur, told apart by their words."""
    columns = [ids[at + i] for i in range(k)]
    key, wide = columns[0], len(known)
    if k > 1:
        key, wide = _number(key * wide + columns[1]), len(at)
    if k > 2:
        rest = columns[2] if k == 3 else _number(columns[2] * len(known) + columns[3])
        key = _number(key * max(len(known), len(at)) + rest)
    _, first, n = np.unique(key * len(names) + lang[at], return_index=True, return_counts=True)
    words = [known.take(pa.array(c[first])) for c in columns]
    text = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if k > 1 else words[0]
    return pa.table({"lang": names.take(pa.array(lang[at][first])), "phrase": text, "n": n})


def _counts(rows: pa.RecordBatch, reached: Reached) -> Iterator[pa.Table]:
    """(lang, text) to the counts of the n-grams that may be frequent, and of all words with a null phrase."""
    for lang, ids, words, names, grams in _grams(rows):
        yield pa.table({"lang": names, "phrase": pa.nulls(len(names), pa.large_string()), "n": np.bincount(lang, minlength=len(names))})
        for k, (at, gram) in enumerate(grams, 1):
            live = reached.holds(gram)
            if len(live):
                yield phrases(ids, words, lang, names, at[live], k)


def _summed(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])


def _given(total: pa.Table) -> Iterator[pa.RecordBatch]:
    for b in total.to_batches(max_chunksize=50_000):
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("phrase").cast(pa.string()), b.column("n")], names=["lang", "phrase", "n"])


def _added(tables: Iterator[pa.Table], new: int = NEW_COUNTS) -> Iterator[pa.RecordBatch]:
    """Counts added up as long as they are few, `new` of them at once."""
    total, held = None, []
    for table in tables:
        held.append(table)
        if sum(map(len, held)) > max(new, 0 if total is None else len(total)):
            total, held = _summed(held if total is None else [total, *held]), []
            if len(total) > HELD_PHRASES:
                yield from _given(total)
                total = None
    if held or total is not None:
        yield from _given(_summed(held if total is None else [total, *held]))


def _count(found: list[tuple[int, int, bytes]], ranges: int):
    """(lang, text) to the counts of what may be frequent."""
    mark = uuid.uuid4().hex  # a worker keeps the table of one plan between its tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = remembered(("phrases", mark), lambda: Reached(found, ranges))
        yield from _added(table for batch in batches for table in _counts(batch, reached))

    return run


def _own_slots(ranges: int):
    """(share, packed) of chunks to the lists of their n-grams' slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for share, text in zip(batch.column("share").to_pylist(), batch.column("packed")):
                found = [g for rows in pa.ipc.open_stream(text.as_buffer()) for *_, grams in _grams(rows) for _, g in grams]
                if found:
                    yield _batch([(share, *x) for x in _lists(found, ranges)], share=pa.int32(), row=pa.int32(), part=pa.int32(), packed=pa.binary())

    return run


def _give_back(least: int):
    """A range's lists to those of each share's slots whose sums over all shares are least or more. A range's lists are of bounded size, however many there are."""

    def run(key: tuple[pa.Scalar, ...], lists: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, held = np.zeros(1 << RANGE_BITS, np.int64), {}
        for batch in lists:
            for share, packed in zip(batch.column("share").to_pylist(), batch.column("packed")):
                own = unpack_sorted(packed.as_py())
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                counters[own[first]] += np.diff(first, append=len(own))
                held.setdefault(share, []).append(pack_sorted(own[first]))
        reached = counters >= least
        for share in sorted(held):
            own = np.zeros(1 << RANGE_BITS, bool)
            for packed in held.pop(share):
                own[unpack_sorted(packed)] = True
            found = np.flatnonzero(own & reached).astype(np.uint64)
            if len(found):
                yield _batch([(share, key[0].as_py(), key[1].as_py(), pack_sorted(found))], share=pa.int32(), row=pa.int32(), part=pa.int32(), packed=pa.binary())

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "lists": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _count_share(ranges: int):
    """A share's chunks and its slots that reached the threshold to the counts of what may be frequent."""

    def run(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        found, texts = [], []
        for batch in tables:
            for row, part, packed in zip(*(batch.column(c).to_pylist() for c in ("row", "part", "packed"))):
                if row is None:
                    texts.append(packed)
                else:
                    found.append((row, part, packed))
        reached = Reached(found, ranges)
        found.clear()
        for text in texts:  # Spark adds up the chunks' counts, faster than a task here would again and again
            yield from _added((table for rows in pa.ipc.open_stream(text) for table in _counts(rows, reached)), 5 * NEW_COUNTS)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "tables": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def frequent(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", chunk_bytes: int = CHUNK_BYTES, known_slots: int = KNOWN_SLOTS) -> DataFrame:
    """(lang, phrase, n): the exact counts of all n-grams of one to LONGEST words that occur `least` times or more in a language; a null phrase has all its words."""
    rows = docs.select(F.coalesce(docs[f"`{lang_col}`"], F.lit("und")).alias("lang"), docs[f"`{text_col}`"].alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(1, -(-size // RANGE_TEXT))
    cores, counted = docs.sparkSession.sparkContext.defaultParallelism, None
    if size <= KNOWN_TEXT:
        merged = rows.mapInArrow(_sketch(ranges, chunk_bytes), _SLOTS).groupBy("row", "part").applyInArrow(_merge(least), "row int, part int, n long, packed binary")
        reached = durable(merged, "phrase-slots")
        if (reached.agg(F.sum("n").alias("n")).first()["n"] or 0) <= known_slots:
            found = [(r["row"], r["part"], bytes(r["packed"])) for r in reached.collect()]  # bounded: about two bytes for each of known_slots
            tasks = max(2 * cores, -(-size // COUNT_TEXT))
            counted = rows.coalesce(tasks).mapInArrow(_count(sorted(found), ranges), _COUNTED)
    if counted is None:
        # Written out, so that both passes see the same chunks.
        share = F.pmod(F.xxhash64("chunk"), F.lit(max(2 * cores, -(-size // SHARE_TEXT)))).cast("int").alias("share")
        held = durable(rows.mapInArrow(chunks(chunk_bytes, 1), "chunk long, packed binary").select(share, "packed"), "phrase-chunks")
        hits = durable(held.mapInArrow(_own_slots(ranges), _HITS).groupBy("row", "part").applyInArrow(_give_back(least), _HITS), "phrase-hits")
        none = F.lit(None).cast("int")
        counted = hits.union(held.select("share", none.alias("row"), none.alias("part"), "packed")).groupBy("share").applyInArrow(_count_share(ranges), _COUNTED)
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull())


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to LONGEST words.

    a, l and r count the phrase and the parts of its lowest-scoring cut, ties to the shorter first part; n counts all words. score is floor(2000000 a / (l + r)). Phrases
    within a longer one of at least `subsumed` hundredths of their count are left out. Order: score and a descending, phrase ascending in
    UTF-8 bytes. A null language is `und`, together with rows that say so; null and empty texts have no words; texts of any length are read whole; repeated rows count
    each time. An empty table gives no rows; other columns are ignored.
    """
    counted = durable(frequent(docs, least, **options), "phrase-counts")
    words = F.split("phrase", " ")
    found = counted.where("phrase IS NOT NULL").withColumn("ws", words).withColumn("size", F.size("ws"))
    join = lambda ws, start, n: F.array_join(F.slice(ws, start, n), " ")
    cuts = found.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), "ws", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.col("ws"), F.lit(1), F.col("k")).alias("left"), join(F.col("ws"), F.col("k") + 1, F.size("ws") - F.col("k")).alias("right"))
    part = lambda side, name: counted.select(F.col("lang").alias(f"{side}_lang"), F.col("phrase").alias(f"{side}_phrase"), F.col("n").alias(name))
    l, r = part("left", "l"), part("right", "r")  # noqa: E741
    both = cuts.join(l, (F.col("lang") == F.col("left_lang")) & (F.col("left") == F.col("left_phrase"))).join(r, (F.col("lang") == F.col("right_lang")) & (F.col("right") == F.col("right_phrase")))
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * 2000000) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    scored = both.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: join(F.col("ws"), i, m))))
    within = found.where("size > 2").select(F.col("lang").alias("w_lang"), F.explode(inner).alias("w_phrase"), "n").groupBy("w_lang", "w_phrase").agg(F.max("n").alias("longer"))
    left = scored.join(within, (F.col("lang") == F.col("w_lang")) & (F.col("phrase") == F.col("w_phrase")), "left")
    left = left.where(F.expr(f"longer IS NULL OR 100 * CAST(longer AS DECIMAL(19,0)) < {subsumed} * CAST(a AS DECIMAL(19,0))"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counted.where("phrase IS NULL").select(F.col("lang").alias("n_lang"), "n")
    out = best.join(totals, F.col("lang") == F.col("n_lang"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))

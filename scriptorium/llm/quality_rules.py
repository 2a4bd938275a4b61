"""Quality rules with distribution divergence: texts whose make-up differs from that of their language are left out.

A first pass over the texts takes each document's counts: words, symbols, repeated lines and windows, and how many characters of each
class it has; and, for each task's chunk and language, how often each word occurs. From these come the language references: the shares of
the character classes, and those of the common words, that is all that are one in COMMON_IN of the language's words or more (so there are
at most COMMON_IN of them). Base failures don't count there, and a text that is more than one in COPIES_IN of a language's documents
counts once. A second pass holds each document against its own language's reference by the Jensen-Shannon distance of both
histograms. Short texts, and languages with few words, aren't judged by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.words import Spans, byte_table, lower_az, numbered, span_texts, spans
from scriptorium.llm.workers import forget
from scriptorium.session import durable

SPACE = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
SYMBOLS = byte_table(b"#*$%&|<>")
#: Texts with fewer words, or more repeated words of a hundred, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Classes of characters, by their first byte in UTF-8; the last is what is in none of the others.
CLASSES = {
    "lower": range(ord("a"), ord("z") + 1),
    "upper": range(ord("A"), ord("Z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "space": [0x20, *range(0x09, 0x0E)],
    "stop": b".,;:!?",
    "quote": b"'\"()-",
    "symbol": b"#*$%&|<>",
    "latin": range(0xC2, 0xCC),  # to U+02FF
    "scripts": range(0xCC, 0xE0),  # to U+07FF
    "far": range(0xE0, 0xF0),  # to U+FFFF
    "beyond": range(0xF0, 0xF5),
    "other": (),
}
#: A word is common in a language if it is one in so many of its words, or more.
COMMON_IN = 500
#: A text that is one in fewer than so many of a language's documents, and there more than once, counts once in its reference.
COPIES_IN = 1000
#: Words that a language must have for a reference, and characters and words that a text must have to be held against it.
LEAST_REFERENCE, LEAST_CHARS, LEAST_JUDGED = 5000, 300, 50
#: Distances beyond which a text differs: that of the classes, and that of the words, to which sampling adds about 1 / sqrt(words).
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE, SAMPLING = 0.32, 0.2, 2.0
#: Words and languages whose counts a task holds before it gives them out.
HELD_WORDS = 400_000

_CLASS_OF = np.full(256, len(CLASSES) - 1, np.int64)
for _i, _members in enumerate(CLASSES.values()):
    _CLASS_OF[list(_members)] = _i
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def repeated_words(ids: np.ndarray, at: np.ndarray, k: int = 3) -> np.ndarray:
    """For each document, its words in windows of k words that it has twice or more; ids number the words, document i has at[i] to at[i + 1]."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(len(at) - 1, np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = doc[:n] == doc[k - 1 :]
    window = ids[:n]
    for i in range(1, k):
        _, window = np.unique(window * (int(ids.max()) + 1) + ids[i : i + n], return_inverse=True)
    _, of, counts = np.unique(np.where(whole, doc[:n], -1) * (int(window.max()) + 1) + window, return_inverse=True, return_counts=True)
    twice = whole & (counts[of] > 1)
    covered = np.zeros(len(ids), bool)
    for i in range(k):
        covered[i : i + n] |= twice
    return np.bincount(doc[covered], minlength=len(at) - 1)


def repeated_lines(data: np.ndarray, edges: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each document, its lines with a word that equal an earlier line of it; starts are the words' first bytes."""
    breaks = np.flatnonzero(data == 0x0A)
    begins = np.union1d(edges[:-1][np.diff(edges) > 0], breaks + 1)
    begins = begins[begins < len(data)]
    if not len(begins):
        return np.zeros(len(edges) - 1, np.int64)
    ends = np.append(begins[1:], len(data))
    ends = ends - (data[ends - 1] == 0x0A)
    worded = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    doc = np.searchsorted(edges, begins, "right") - 1
    ids, _ = numbered(span_texts(data, data != 0x0A, ends - begins))
    own, docs = ids[worded], doc[worded]
    wide, n = int(ids.max()) + 1, len(edges) - 1
    distinct = np.unique(docs * wide + own)
    return np.bincount(docs, minlength=n) - np.bincount(distinct // wide, minlength=n)


def _sums(of: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many of the marked bytes each document has."""
    total = np.concatenate([[0], np.cumsum(of)])
    return total[edges[1:]] - total[edges[:-1]]


def _class_counts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    first = ~_CONTINUES[data]
    return np.bincount((doc * len(CLASSES) + _CLASS_OF[data])[first], minlength=(len(edges) - 1) * len(CLASSES)).reshape(-1, len(CLASSES))


def _counts(s: Spans) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(words, their characters, symbols, repeated lines, repeated words; classes; which pass) of each document."""
    sizes = np.diff(s.at)
    ids, _ = numbered(span_texts(s.data, s.inside, s.ends - s.starts))
    repeats = repeated_words(ids, s.at)
    counts = [sizes, _sums(s.inside & ~_CONTINUES[s.data], s.edges), _sums(SYMBOLS[s.data], s.edges), repeated_lines(s.data, s.edges, s.starts), repeats]
    return counts, _class_counts(s.data, s.edges), (sizes >= LEAST_WORDS) & (100 * repeats <= MOST_REPEATED * sizes)


_MEASURED = "lang string, mark long, classes array<long>, word string, n long"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, mark, text) to a row for each document that has a language and doesn't fail, and one for each word and language of these."""
    forget()
    names = [x.split(" ")[0] for x in _MEASURED.split(", ")]
    held: list[pa.Table] = []

    def given() -> Iterator[pa.RecordBatch]:
        if held:
            total = pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")])
            held.clear()
            for b in total.to_batches(max_chunksize=50_000):
                rows = len(b)
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.list_(pa.int64())), b.column("word").cast(pa.string()), b.column("n_sum")], names=names)

    for batch in batches:
        lang = batch.column(0).cast(pa.string())
        for s in spans(batch.column(2), SPACE):
            sizes = np.diff(s.at)
            _, classes, good = _counts(s)
            of = lang.slice(s.first, len(sizes))
            good &= of.is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(good)
            if not len(rows):
                continue
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(CLASSES), pa.int32()), pa.array(classes[rows].reshape(-1)))
            yield pa.RecordBatch.from_arrays([of.take(pa.array(rows)), batch.column(1).take(pa.array(rows + s.first)), lists, pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.int64())], names=names)
            token = np.repeat(good, sizes)
            words = span_texts(lower_az(s.data), s.inside, s.ends - s.starts).filter(pa.array(token))
            langs = of.dictionary_encode()
            which = np.repeat(langs.indices.fill_null(0).to_numpy(zero_copy_only=False), sizes)[token]
            pairs = pa.table({"lang": pa.DictionaryArray.from_arrays(pa.array(which), langs.dictionary).cast(pa.string()), "word": words})
            held.append(pairs.group_by(["lang", "word"]).aggregate([([], "count_all")]).rename_columns(["lang", "word", "n"]))
            if sum(len(x) for x in held) > HELD_WORDS:
                yield from given()
    yield from given()


def _plain_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text, less) to the counts of its words, each times less."""
    for batch in batches:
        for s in spans(batch.column(1), SPACE):
            words = span_texts(lower_az(s.data), s.inside, s.ends - s.starts)
            row = np.repeat(np.arange(s.first, s.first + len(s.at) - 1), np.diff(s.at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), words.cast(pa.string()), pc.negate(batch.column(2).take(pa.array(row)))], names=["lang", "word", "n"])


def references(docs: DataFrame, measured: DataFrame) -> DataFrame:
    """(lang, classes, words, shares): the character classes' shares, and the common words and theirs, of each language with words enough.

    docs has mark, lang and text, measured what _measure made of them. Texts without a language teach nothing.
    """
    good = measured.where(F.col("word").isNull())
    # A text of which there are very many copies counts once: the others' words and characters are taken off again. Fewer than COPIES_IN texts of a language are so.
    per_text = good.groupBy("lang", "mark").agg(F.count(F.lit(1)).alias("n"), F.first("classes").alias("classes"))
    rows = durable(good.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "reference-rows")
    hot = durable(per_text.where("n > 1").join(rows, "lang").where(F.col("n") * COPIES_IN > F.col("rows")).select("lang", "mark", (F.col("n") - 1).alias("less"), "classes"), "hot-texts")
    hot_key = hot.select(F.col("lang").alias("h_lang"), F.col("mark").alias("h_mark"), "less")
    texts = docs.join(hot_key, (F.col("lang") == F.col("h_lang")) & (F.col("mark") == F.col("h_mark"))).groupBy("lang", "mark").agg(F.first("text").alias("text"), F.first("less").alias("less"))
    off = texts.select("lang", "text", "less").mapInArrow(_plain_words, "lang string, word string, n long")
    counted = measured.where(F.col("word").isNotNull()).select("lang", "word", "n").union(off).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = durable(counted.where("n > 0"), "word-counts")
    # Written out, so that Spark knows how few they are and need not shuffle words by their language.
    totals = durable(counted.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= LEAST_REFERENCE), "word-totals")
    common = counted.join(totals, "lang").where(F.col("n") * COMMON_IN >= F.col("total"))
    words = common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", (F.col("n") / F.col("total")).alias("share")))).alias("common"))
    each = lambda rows, sign: rows.select("lang", *(((F.col("classes")[i]) * sign).alias(c) for i, c in enumerate(CLASSES)))
    classes = each(good, F.lit(1)).union(each(hot, -F.col("less"))).groupBy("lang").agg(*(F.sum(c).alias(c) for c in CLASSES))
    shares = F.array(*(F.col(c) / sum((F.col(x) for x in list(CLASSES)[1:]), F.col("lower")) for c in CLASSES))
    return durable(classes.join(totals, "lang").join(words, "lang", "left").select("lang", shares.alias("classes"), F.coalesce(F.col("common.word"), F.array().cast("array<string>")).alias("words"), F.coalesce(F.col("common.share"), F.array().cast("array<double>")).alias("shares")), "references")


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances, in base 2, of the rows of p from those of q (or its only one); rows are histograms, of any total."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1)
        return np.sqrt(np.maximum((part(p) + part(q)) / 2, 0.0))


_JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, lang, classes, words, shares), the last four of the reference or null, to a row for each document."""
    forget()
    for batch in batches:
        # A language's rows bring the same reference each; it is read once a batch.
        keys, known = batch.column(2).to_pylist(), {}
        for i, k in enumerate(keys):
            if k is not None and k not in known:
                known[k] = (np.array(batch.column(3)[i].as_py(), float), batch.column(4)[i].values.cast(pa.large_string()), np.array(batch.column(5)[i].as_py(), float))
        for s in spans(batch.column(1), SPACE):
            docs, sizes = len(s.at) - 1, np.diff(s.at)
            counts, classes, good = _counts(s)
            own = keys[s.first : s.first + docs]
            words = span_texts(lower_az(s.data), s.inside, s.ends - s.starts)
            far = np.full((2, docs), np.nan)
            for k in set(own) - {None}:
                share, common, shares = known[k]
                mine = np.array([x == k for x in own])
                rows = np.flatnonzero(mine)
                far[0][rows] = distance(classes[rows].astype(float), share[None, :])
                token = np.repeat(mine, sizes)
                place = pc.index_in(words.filter(pa.array(token)), value_set=common).fill_null(len(common)).to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(docs), sizes)[token] * (len(common) + 1) + place
                found = np.bincount(at, minlength=docs * (len(common) + 1)).reshape(docs, -1)[rows]
                far[1][rows] = distance(found.astype(float), np.append(shares, max(0.0, 1.0 - shares.sum()))[None, :])
            # Too short to tell.
            far[0][classes.sum(axis=1) < LEAST_CHARS] = np.nan
            far[1][sizes < LEAST_JUDGED] = np.nan
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s.first, docs), *(pa.array(x.astype(np.int64)) for x in counts), pa.array(~good), *(pa.array(x, mask=np.isnan(x)) for x in far)], names=[x.split(" ")[0] for x in _JUDGED.split(", ")]
            )


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept), a row for each input row.

    Texts that fail the base rules go, and those whose class or word distance is above its limit. A distance is null, and decides
    nothing, where a text is too short, has no language or one without a reference. Null and empty texts have no
    words and fail. Whole texts count, of any length. Repeated rows are judged alike, each for itself; a distance at its limit is no reason to go.
    An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{lang_col}`"].alias("lang"), docs[f"`{text_col}`"].alias("text")).withColumn("mark", F.xxhash64("text"))
    measured = durable(rows.select("lang", "mark", "text").mapInArrow(_measure, _MEASURED), "measured")
    known = references(rows, measured).withColumnRenamed("lang", "r_lang")
    judged = rows.join(known, rows["lang"] == known["r_lang"], "left").select("doc_id", "text", "r_lang", "classes", "words", "shares").mapInArrow(_compare, _JUDGED)
    near = F.coalesce(F.col("class_distance") <= MOST_CLASS_DISTANCE, F.lit(True)) & F.coalesce(F.col("word_distance") <= MOST_WORD_DISTANCE + SAMPLING / F.sqrt("n_words"), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & near)

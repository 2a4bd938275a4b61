"""Language identification by interpolated Kneser-Ney character models.

Each language's model is fitted from a bounded sample of labelled rows, in one task a language, and kept
as sorted arrays of n-gram hashes with their discounted probabilities, and of context hashes with their
interpolation weights. A text gets the language of the lowest cross-entropy per character. Texts whose
cross-entropy is out of the range that the language's held-back rows show for texts of that length are
rejected. Models that together exceed what may be broadcast are applied block after block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.words import mix, slices
from scriptorium.llm.workers import forget
from scriptorium.session import durable

ORDER = 4
#: Distinct labelled texts that a language's model is fitted from at most, and their bytes (one text at least, whole);
#: every fifth of them calibrates the rejection.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 8 << 20
#: Bits of a mark by which the marks are counted before the least are taken.
LEAD_BITS = 10
#: Models that are broadcast at once.
MODEL_BYTES = 256 << 20
#: Letters that the unigram model reckons with.
ALPHABET = 4096
#: How sharply a difference in bits per character turns into a score.
SHARPNESS = 4.0
#: A text of n characters is rejected beyond the held-back rows' mean bits per character + SLACK_BITS + SPREADS q / sqrt(n),
#: q being their deviation times sqrt(n) that QUANTILE of them stay below.
SLACK_BITS, SPREADS, QUANTILE = 1.0, 3.0, 0.99
#: Bytes of text that are scored at once; a longer text is scored alone.
SCORED_BYTES = 1 << 20

_B = 0x9E3779B97F4A7C15 | 1
_WEIGHTS = np.array([pow(_B, j + 1, 1 << 64) for j in range(16)], np.uint64)


@functools.lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Each letter's lower case; 0 for whatever is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            table[c] = ord(x.lower()[0])
    return table


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, document of each): lower-case letters, with one 0 for each run of anything else and one before each text."""
    texts = [" " + (t or "") for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars, doc = _fold_table()[raw], np.repeat(np.arange(len(texts)), sizes)
    keep = chars != 0
    keep[1:] |= chars[:-1] != 0
    keep[np.cumsum(sizes) - sizes] = True
    return chars[keep], doc[keep]


def _places(doc: np.ndarray) -> np.ndarray:
    """Each character's place in its document."""
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    return np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))


def gram_hashes(chars: np.ndarray, place: np.ndarray, at: np.ndarray, order: int, skip: int = 0) -> np.ndarray:
    """Hashes of the `order` characters that end `skip` before each of `at`; before a text there are zeros."""
    total = np.zeros(len(at), np.uint64)
    for j in range(skip, skip + order):
        inside = place[at] >= j
        total += np.where(inside, chars[np.maximum(at - j, 0)], 0).astype(np.uint64) * _WEIGHTS[j - skip]
    return mix(total, order)


def fit(texts: list[str], order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order (n-gram hashes, discounted probabilities, context hashes, weights of the lower order), hashes sorted.

    The highest order counts occurrences, lower ones the distinct characters before an n-gram.
    """
    chars, doc = folded(texts)
    place = _places(doc)
    at = np.flatnonzero(place > 0)
    model = []
    for n in range(order, 0, -1):
        hashes = gram_hashes(chars, place, at, n)
        grams, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        # From here on one occurrence stands for each n-gram: the next lower order counts these.
        at = at[first]
        if n < order:
            counts = seen[np.searchsorted(lower, grams)]  # noqa: F821
        contexts = gram_hashes(chars, place, at, n - 1, 1)
        one, two = int((counts == 1).sum()), int((counts == 2).sum())
        discount = one / (one + 2 * two) if one else 0.5
        known, of = np.unique(contexts, return_inverse=True)
        total, kinds = np.bincount(of, weights=counts), np.bincount(of)
        model.append((grams, ((counts - discount) / total[of]).astype(np.float32), known, (discount * kinds / total).astype(np.float32)))
        if n > 1:
            lower, seen = np.unique(gram_hashes(chars, place, at, n - 1), return_counts=True)
    return model[::-1]


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, absent: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), absent)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], absent)


def cross_entropies(texts: list[str | None], models: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits per character of each text under each model, whether the text has letters, its number of characters)."""
    order = len(models[0])
    chars, doc = folded(texts)
    place = _places(doc)
    at = np.flatnonzero(place > 0)
    codes, _ = pd.factorize(gram_hashes(chars, place, at, order))
    if not len(codes):
        return np.zeros((len(texts), len(models))), np.zeros(len(texts), bool), np.zeros(len(texts), np.int64)
    first = at[np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))]
    grams = [gram_hashes(chars, place, first, n) for n in range(1, order + 1)]
    contexts = [gram_hashes(chars, place, first, n - 1, 1) for n in range(1, order + 1)]
    n = np.bincount(doc[at], minlength=len(texts))
    out = np.empty((len(texts), len(models)))
    for l, model in enumerate(models):
        p = np.full(len(first), 1 / ALPHABET)
        for (keys, own, known, weights), g, c in zip(model, grams, contexts):
            p = _look_up(keys, own, g, 0.0) + _look_up(known, weights, c, 1.0) * p
        out[:, l] = np.bincount(doc[at], weights=-np.log2(p)[codes], minlength=len(texts)) / np.maximum(n, 1)
    return out, np.bincount(doc[at], weights=chars[at] != 0, minlength=len(texts)) > 0, n


def _pack(model: list[tuple]) -> bytes:
    import pickle

    return pickle.dumps(model, protocol=5)


def _fit_language(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["mark", "text"])
    held = (pdf["mark"] % 5 == 0) if len(pdf) >= 20 else pd.Series(False, index=pdf.index)
    model = fit(pdf.loc[~held, "text"].tolist())
    own = pdf["text"] if not held.any() else pdf.loc[held, "text"]
    bits, letters, n = cross_entropies(own.tolist(), [model])
    bits, n = bits[letters, 0], n[letters]
    mean = float(np.average(bits, weights=n)) if len(n) else 0.0
    spread = float(np.quantile(np.maximum(0.0, (bits - mean) * np.sqrt(n)), QUANTILE)) if len(n) else 0.0
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "model": [_pack(model)], "mean": [mean], "spread": [spread]})


def _least_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, mark, bytes) to the SAMPLE_ROWS smallest distinct marks of each language in the task."""
    least: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs, marks, sizes = batch.column(0).to_pandas(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for lang, at in langs.groupby(langs).indices.items():
            x, n = least.get(lang, (np.zeros(0, np.int64),) * 2)
            x, first = np.unique(np.append(x, marks[at]), return_index=True)
            least[lang] = x[:SAMPLE_ROWS], np.append(n, sizes[at])[first[:SAMPLE_ROWS]]
    for lang, (x, n) in least.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(x, pa.int64()), pa.array(n, pa.int64())], names=["lang", "mark", "bytes"])


_STATE = [("best", "string"), ("least", "double"), ("weight", "double"), ("limit", "double"), ("letters", "boolean")]


def _applied(shared, last: bool):
    """Rows of (doc_id, text, state) through a block of models: the best language so far, its bits, all languages' weights
    relative to it, and its limit. The last block's rows come without the text, as results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        forget()
        names = np.array([x[0] for x in shared.value], object)
        models = [pickle.loads(x[1]) for x in shared.value]
        means, spreads = (np.array([x[i] for x in shared.value]) for i in (2, 3))
        for whole in batches:
            for i, j in slices(whole.column(1), SCORED_BYTES):
                batch, n = whole.slice(i, j - i), j - i
                best, least, weight, limit = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2, 6))
                bits, letters, size = cross_entropies(batch.column(1).to_pylist(), models)
                own = bits.argmin(axis=1)
                low = bits[np.arange(n), own]
                new = np.minimum(low, least)
                weight = weight * np.exp2(-SHARPNESS * np.minimum(least - new, 1e3)) + np.exp2(-SHARPNESS * (bits - new[:, None])).sum(axis=1)
                ahead = low < least
                best = np.where(ahead, names[own], best)
                limit = np.where(ahead, means[own] + SLACK_BITS + SPREADS * spreads[own] / np.sqrt(np.maximum(size, 1)), limit)
                if not last:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array(best, pa.string()), *(pa.array(x, pa.float64()) for x in (new, weight, limit)), pa.array(letters)],
                        names=["doc_id", "text", *(x for x, _ in _STATE)],
                    )
                    continue
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.where(letters, best, "und"), pa.string()), pa.array(np.where(letters, 1 / weight, 0.0)), pa.array(np.where(letters, new, 0.0)), pa.array(~letters | (new > limit))],
                    names=["doc_id", "lang_pred", "score", "bits", "rejected"],
                )

    return run


def identify(docs: DataFrame, train: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score, bits, rejected), a row for each row of docs.

    train gives labelled rows in the columns of the same names; those with a null text or language are
    left out, and each language's model is fitted from its distinct texts with the smallest hashes: SAMPLE_ROWS and
    SAMPLE_BYTES at most, or all if fewer; a first text of any length always counts.
    Texts that are null or without letters are `und` with score 0 and rejected, as is everything when
    there is nothing to learn from. bits is the cross-entropy per character. Of equal languages the
    first by name wins. Whole texts count; other columns are ignored. id_col may be any expression, as a
    struct of all columns to carry them along.
    """
    spark = docs.sparkSession
    labelled = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    marked = labelled.withColumn("mark", F.xxhash64("text").bitwiseAND(0x7FFFFFFFFFFFFFFF))
    # Texts that share a mark count as one; each task keeps the smallest marks it has, and the least of those are taken.
    marks = marked.select("lang", "mark", F.octet_length("text").cast("long").alias("bytes")).mapInArrow(_least_marks, "lang string, mark long, bytes long")
    marks = durable(marks.groupBy("lang", "mark").agg(F.max("bytes").alias("bytes")), "task-marks")
    # Counts of the marks' leading bits tell beyond which of them none can be among the least, so that a language's window stays small.
    lead = F.shiftright("mark", 63 - LEAD_BITS)
    counts = marks.groupBy("lang", lead.alias("lead")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("so_far", F.sum("n").over(Window.partitionBy("lang").orderBy("lead")))
    bounds = durable(counts.groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("so_far") >= SAMPLE_ROWS, F.col("lead"))), F.max("lead")).alias("last")), "mark-bounds")
    ordered = Window.partitionBy("lang").orderBy("mark")
    chosen = marks.join(bounds, "lang").where(lead <= F.col("last")).withColumns({"place": F.row_number().over(ordered), "so_far": F.sum("bytes").over(ordered)})
    chosen = durable(chosen.where((F.col("place") <= SAMPLE_ROWS) & ((F.col("so_far") <= SAMPLE_BYTES) | (F.col("place") == 1))).select("lang", "mark"), "sample-marks")
    # Written out, the marks are a plain table, which Spark broadcasts while it is small.
    sample = marked.join(chosen, ["lang", "mark"]).groupBy("lang", "mark").agg(F.min("text").alias("text"))
    fitted = durable(sample.groupBy("lang").applyInPandas(_fit_language, "lang string, model binary, mean double, spread double"), "language-models")
    blocks, size = [[]], 0
    for r in fitted.select("lang", F.octet_length("model").alias("bytes")).orderBy("lang").collect():  # a row for each language
        if blocks[-1] and size + r["bytes"] > MODEL_BYTES:
            blocks, size = [*blocks, []], 0
        blocks[-1].append(r["lang"])
        size += r["bytes"]
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    rows = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    found = T.StructType([rows.schema["doc_id"]]).add("lang_pred", "string").add("score", "double").add("bits", "double").add("rejected", "boolean")
    if not blocks[0]:
        return rows.select("doc_id", F.lit("und"), F.lit(0.0), F.lit(0.0), F.lit(True)).toDF(*found.names)
    rows = rows.select("doc_id", "text", F.lit(None).cast("string").alias("best"), F.lit(float("inf")).alias("least"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("limit"), F.lit(False).alias("letters"))
    for i, names in enumerate(blocks):
        block = sorted(fitted.where(F.col("lang").isin(names)).collect(), key=lambda r: r["lang"])
        shared = spark.sparkContext.broadcast([(r["lang"], bytes(r["model"]), r["mean"], r["spread"]) for r in block])
        last = i == len(blocks) - 1
        rows = rows.mapInArrow(_applied(shared, last), found if last else rows.schema)
    return rows


def keep_identified(docs: DataFrame, train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose texts aren't rejected; nulls and empty tables are handled as by identify, and columns may have any names."""
    return identify(docs, train, F.struct(*(docs[f"`{c}`"] for c in docs.columns)), text_col, lang_col).where("NOT rejected").select("doc_id.*")


def held_out(id_col: str = "doc_id"):
    """Whether a row belongs to the third that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))

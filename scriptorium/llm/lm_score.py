"""Cross-entropy difference: how much more likely a text is under a target model than under a background model.

Both models are bigram models with the same smoothing, over the words and bigrams that the corpus has,
told apart by 64-bit hashes, so that they grow with it. Texts are worked on in chunks. A chunk's distinct
words and bigrams are counted where it is read, and its counts dealt out by ranges of the
hashes; each range is summed up in one place, and every chunk gets back the sums of its own entries. A
text's score is its mean loss under the target model less that under the background model, in bits a
token: lower is nearer to the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.words import chunks, mix, words
from scriptorium.session import durable

#: Words that the unigram model counts for in each bigram context.
PRIOR = 32.0
#: Bytes of text in a chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES = 6 << 20
#: Bytes of text for each range that hashes are dealt into, about: there are as many ranges as the corpus needs.
RANGE_TEXT = 8 << 20

_COUNTS = "chunk long, part int, words long, learned long, tokens long, packed binary"


#: The key of a text's start as a context.
_START = mix(np.array([1], np.uint64), 22) & ~np.uint64(1)


def keys(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each word, of the word before it (or a text's start), and of both; those of words are odd, the others even."""
    word = mix(hashes, 21) | np.uint64(1)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[at[:-1][np.diff(at) > 0]] = _START
    return word, before, mix(before * np.uint64(3) + word, 23) & ~np.uint64(1)


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers, the first of them ascending, each as a frame of planes of bytes, after the frames' sizes."""
    frames = []
    for i, x in enumerate(columns):
        x = np.diff(x, prepend=np.zeros(1, np.uint64)) if i == 0 else x.astype(np.uint64)
        frames.append(zstandard.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), 1))
    return np.array([len(x) for x in frames], "<u4").tobytes() + b"".join(frames)


def _keys(packed: bytes, n: int) -> np.ndarray:
    """The first column alone."""
    size = int(np.frombuffer(packed, "<u4", 1)[0])
    planes = np.frombuffer(zstandard.decompress(packed[4 * n : 4 * n + size]), np.uint8)
    return np.cumsum(planes.reshape(8, -1).T.copy().view(np.uint64).reshape(-1))


def _unpack(packed: bytes, n: int) -> np.ndarray:
    columns, start = [], 4 * n
    for size in np.frombuffer(packed, "<u4", n).tolist():
        planes = np.frombuffer(zstandard.decompress(packed[start : start + size]), np.uint8)
        columns.append(planes.reshape(8, -1).T.copy().view(np.uint64).reshape(-1))
        start += size
    columns[0] = np.cumsum(columns[0])
    return np.stack(columns)


def _tally(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(hashes)
    hashes.clear()
    every.sort()
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
    return every[first], np.diff(first, append=len(every))


def _count(bits: int):
    """Chunks to the counts of their keys in each range: in the target and in all, then those of them that end a text.

    A word's count as a context is that of its occurrences less those that end a text. The upper bits of a key are its range.
    """
    return lambda batches: _counted(batches, bits)


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, text in zip(batch.column("chunk").to_pylist(), batch.column("packed")):
            found: list[list[np.ndarray]] = [[] for _ in range(4)]
            for rows in pa.ipc.open_stream(text.as_buffer()):
                target = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
                for w in words(rows.column(1)):
                    size = np.diff(w.at)
                    some = target[w.first : w.first + len(size)]
                    word, _, pair = keys(w.hashes, w.at)
                    mine, full = np.repeat(some, size), size > 0
                    ends = word[w.at[1:][full] - 1]
                    for to, x in zip(found, ((word[mine], pair[mine], np.repeat(_START, (full & some).sum())), (word, pair, np.repeat(_START, full.sum())), (ends[some[full]],), (ends,))):
                        to += x
            tallies = [_tally(x) for x in found]
            own = tallies[1][0]
            columns = [own]
            for x, n in tallies:
                columns.append(np.zeros(len(own), np.int64))
                columns[-1][np.searchsorted(own, x)] = n
            edges = np.append(np.searchsorted(own, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(own))
            packed = [_pack([x[a:b] for x in columns]) for a, b in zip(edges[:-1], edges[1:])]
            none = pa.nulls(len(packed), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(packed), chunk)), pa.array(range(len(packed)), pa.int32()), none, none, none, pa.array(packed, pa.binary())], names=["chunk", "part", "words", "learned", "tokens", "packed"]
            )


def _add(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's counts of all chunks to their sums, for each chunk at its own keys, with the range's distinct words and its tokens.

    Chunks' counts are held as they came, packed; only their keys are brought together, and counts added chunk by chunk.
    """
    held = [x for batch in tables for x in zip(batch.column("chunk").to_pylist(), batch.column("packed").to_pylist())]
    known = np.unique(np.concatenate([_keys(packed, 5) for _, packed in held]))
    sums = np.zeros((4, len(known)), np.int64)
    for _, packed in held:
        own = _unpack(packed, 5)
        sums[:, np.searchsorted(known, own[0])] += own[1:].astype(np.int64)  # a chunk has each key once
    word = (known & np.uint64(1)).astype(bool)
    learned, tokens = (int(x[word].sum()) for x in sums[:2])
    for chunk, packed in held:
        mine = np.searchsorted(known, _keys(packed, 5))
        # The zeros stand where keys would.
        packed = _pack([np.zeros(len(mine), np.uint64), *(x[mine] for x in sums)])
        one = [chunk, key[0].as_py(), int(word.sum()), learned, tokens, packed]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary()))], names=["chunk", "part", "words", "learned", "tokens", "packed"])


def own_counts(doc: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """How often each token's entry, by its place among size, occurs in its own document."""
    _, of, counts = np.unique(doc * size + place, return_inverse=True, return_counts=True)
    return counts[of]


def losses(counts: tuple[np.ndarray, ...], own: tuple[np.ndarray, ...], tokens: float, vocabulary: int) -> np.ndarray:
    """Bits of each token under a model: bigrams with a Dirichlet prior of the unigrams, those with one count added for each word.

    own, a document's counts of the same entries, are taken off, so that no text is judged by itself; the
    unigrams' total is left as it is.
    """
    word, before, pair = (x - y for x, y in zip(counts, own))
    single = (word + 1.0) / (tokens + vocabulary)
    return -np.log2((pair + PRIOR * single) / (before + PRIOR))


def _score(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's rows and its sums of each range to its documents' scores."""
    sums: dict[int, np.ndarray] = {}
    vocabulary, totals, text = 0, [0, 0], b""
    for batch in tables:
        for part, known, learned, tokens, packed in zip(*(batch.column(x).to_pylist() for x in ("part", "words", "learned", "tokens", "packed"))):
            if part is None:
                text = packed
            else:
                sums[part] = _unpack(packed, 5)[1:]
                vocabulary, totals = vocabulary + known, [totals[0] + learned, totals[1] + tokens]
    table = np.concatenate([sums.pop(i) for i in sorted(sums)], axis=1).astype(np.float64)
    contexts = table[:2] - table[2:]
    held, sizes, found = [], [], []
    for batch in pa.ipc.open_stream(text):
        for w in words(batch.column(1)):
            held.append(batch.slice(w.first, len(w.at) - 1))
            sizes.append(np.diff(w.at))
            found += keys(w.hashes, w.at)
    own, of = np.unique(np.concatenate(found), return_inverse=True)
    del found
    if len(own) != table.shape[1]:
        raise ValueError("a chunk's sums are not those of its keys")
    start = 0
    for batch, size in zip(held, sizes):
        n = int(size.sum())
        places = of[start : start + 3 * n].reshape(3, n)
        start += 3 * n
        doc = np.repeat(np.arange(len(size)), size)
        less = tuple(own_counts(doc, x, len(own)) for x in places)
        mine = np.repeat(batch.column(2).to_numpy(zero_copy_only=False).astype(bool), size)
        mean = []
        for m, off in enumerate((tuple(x * mine for x in less), less)):
            counts = (table[m, places[0]], contexts[m, places[1]], table[m, places[2]])
            bits = losses(counts, off, float(totals[m]), vocabulary)
            mean.append(np.bincount(doc, weights=bits, minlength=len(size)) / np.maximum(size, 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size.astype(np.int64)), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"]
        )


def score_documents(docs: DataFrame, in_target: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score), a row for each input row.

    in_target tells which rows the target model learns from; the background model learns from all. What a
    model learned from a document is left out when that document is scored. A null
    condition counts as false. Null texts and those without words have no tokens and score 0. Without any
    target rows the target model is uniform. Repeated rows count each time. Whole texts count; an empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(in_target, F.lit(False)).alias("target"))
    # Written out, so that counts and scores are those of one reading.
    held = durable(rows.mapInArrow(chunks(CHUNK_BYTES, 1), "chunk long, packed binary"), "scored-chunks")
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    bits = max(4, (size // RANGE_TEXT).bit_length())
    sums = held.mapInArrow(_count(bits), _COUNTS).groupBy("part").applyInArrow(_add, _COUNTS)
    none = F.lit(None)
    whole = held.select("chunk", none.cast("int").alias("part"), *(none.cast("long").alias(x) for x in ("words", "learned", "tokens")), "packed")
    return sums.union(whole).groupBy("chunk").applyInArrow(_score, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")

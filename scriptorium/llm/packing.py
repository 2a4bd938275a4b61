"""Packing of documents into training sequences by Karmarkar-Karp multiway differencing.

One pass without a shuffle: every task tokenises its documents, cuts the full sequences off each one,
and gathers what is left in bounded batches. In a batch, differencing merges partial partitions with
opposing imbalances until one near-equal partition into windows remains; where a window exceeds the
capacity, the batch is partitioned again into one window more. These windows are the sequences; what a
window is short of the capacity is left to padding, about 1 % of it with batches of this size.
"""

from __future__ import annotations

import heapq
import os
from bisect import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.words import byte_table, lower_az, numbered, slices, span_texts, spans
from scriptorium.llm.workers import remembered

#: ASCII white space, at which words end.
SPACE = byte_table(bytes([0x20, *range(0x09, 0x0E)]))

CAPACITY = 4096
END_ID = 2
#: Pieces partitioned at once; the state is one row of window sums for each.
BATCH_PIECES = 2048
#: Bytes of text that are encoded at once; a longer text is encoded alone.
ENCODED_BYTES = 2 << 20
#: Words whose ids a worker remembers, unless a caller says otherwise; beyond that it keeps those of its last batch.
MEMORY_WORDS = 1_500_000

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def _is_letters(word: bytes) -> bool:
    return word.isalpha() or not word.isascii() and word.decode("utf-8", "replace").isalpha()


class WordEncoder:
    """Token ids of texts, as bytes of little-endian unsigned 32-bit integers.

    Only for tokenizers that never join or look across ASCII white space, as those whose pre-tokenizer
    drops it: then a text's ids are those of its words, one after another.
    """

    def __init__(self, path: str, end_id: int | None = END_ID, memory_words: int = MEMORY_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()
        self.known: dict[bytes, bytes] = {}
        self.memory_words = memory_words
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.folds = ids("AbZ") == ids("abz")
        # Where the model marks the ends of words, many words can be encoded as one text and told apart again.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def _each(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        made = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return ((w, np.asarray(x.ids, "<u4").tobytes()) for w, x in zip(words, made))

    def _letters(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words of letters alone, each of which is one word to the pre-tokenizer."""
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.asarray(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part) or ends[-1] != 4 * len(ids):  # letters that this pre-tokenizer parts
                yield from self._each(part)
                continue
            raw = ids.tobytes()
            yield from zip(part, (raw[a:b] for a, b in zip([0, *ends], ends)))

    def _learn(self, new: set[bytes]) -> None:
        if self.ends is None:
            self.known.update(self._each(list(new)))
            return
        letters, ended, others = [], {}, []
        for w in new:
            if _is_letters(w):
                letters.append(w)
            elif (c := w.rstrip(b".,")) != w and c and _is_letters(c):
                ended[w] = c  # a word of letters with points or commas after it is the one and then the others
            else:
                others.append(w)
        known = self.known
        letters += {c for c in ended.values() if c not in known and c not in new}
        others += {t for w, c in ended.items() if (t := w[len(c) :]) not in known and t not in new}
        known.update(self._letters(letters))
        known.update(self._each(others))
        for w, c in ended.items():
            known[w] = known[c] + known[w[len(c) :]]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        found = []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            # Lower case is only folded early where that can't make a special token's name.
            found.append((raw.lower() if self.folds and b"<|" not in raw else raw).split())
        distinct = set().union(*found)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > self.memory_words:
            self.known = {w: self.known[w] for w in distinct if w in self.known}
        self._learn(new)
        known = self.known.__getitem__
        for words in found:
            yield b"".join(map(known, words)) + self.end


    def encode_column(self, column: pa.Array) -> Iterator[bytes]:
        """The same over a column of texts, where each distinct word of a stretch is looked up once and ids are gathered by its number."""
        for s in spans(column, SPACE, ENCODED_BYTES):
            if self.folds and b"<|" in s.data.tobytes():
                yield from self.encode(column.slice(s.first, len(s.at) - 1).to_pylist())
                continue
            numbers, words = numbered(span_texts(lower_az(s.data) if self.folds else s.data, s.inside, s.ends - s.starts))
            distinct = words.cast(pa.large_binary()).to_pylist()
            found = list(map(self.known.get, distinct))
            new = {w: i for i, (w, x) in enumerate(zip(distinct, found)) if x is None}
            if len(self.known) + len(new) > self.memory_words:
                self.known = {w: x for w, x in zip(distinct, found) if x is not None}
            self._learn(set(new))
            for w, i in new.items():
                found[i] = self.known[w]
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            first = np.cumsum(size) - size
            own = size[numbers]
            ends = np.concatenate([[0], np.cumsum(own)])
            ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(first[numbers] - ends[:-1], own) + np.arange(ends[-1])]
            edges = ends[s.at].tolist()
            for a, b in zip(edges[:-1], edges[1:]):
                yield ids[a:b].tobytes() + self.end


def encoder_of(path: str, end_id: int | None, memory_words: int = MEMORY_WORDS) -> WordEncoder:
    """One for each worker process, which keeps what it knows between tasks of packing."""
    return remembered(("packing", path, end_id, memory_words), lambda: WordEncoder(path, end_id, memory_words))


class Partition(NamedTuple):
    """A partial partition: the windows' sums, ascending, and what is in each; windows that are empty are left out."""

    sums: list[int]
    parts: list[tuple]


def _with_piece(a: Partition, size: int, part: tuple, windows: int) -> None:
    """Difference a partition with a single piece: it joins the smallest window."""
    if len(a.sums) == windows:
        size += a.sums.pop(0)
        part = (part, a.parts.pop(0))
    at = bisect(a.sums, size)
    a.sums.insert(at, size)
    a.parts.insert(at, part)


def _merged(a: Partition, b: Partition, windows: int) -> Partition:
    """Difference two partitions: the largest window of the one joins the smallest of the other, and so on."""
    joined = []
    for i in range(windows):
        # Window i of a from its smallest, window i of b from its largest; empty ones come before the smallest.
        x, y = i - (windows - len(a.sums)), len(b.sums) - 1 - i
        if x >= 0 and y >= 0:
            joined.append((a.sums[x] + b.sums[y], (a.parts[x], b.parts[y])))
        elif x >= 0:
            joined.append((a.sums[x], a.parts[x]))
        elif y >= 0:
            joined.append((b.sums[y], b.parts[y]))
    joined.sort(key=lambda j: j[0])
    return Partition([j[0] for j in joined], [j[1] for j in joined])


def difference(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each piece: Karmarkar-Karp differencing over `windows` sums.

    The two partial partitions whose windows differ most are merged until one is left. Most merges bring a single piece, which is put in place
    in a sorted list. Sums are kept whole: a partition's differences are those from its smallest window.
    """
    found = np.zeros(len(sizes), np.int64)
    if windows <= 1 or not sizes:
        return found
    heap = [(-int(size), i, Partition([int(size)], [(i,)])) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        if len(a.sums) < len(b.sums):
            a, b = b, a
        if len(b.sums) == 1:
            _with_piece(a, b.sums[0], b.parts[0], windows)
        else:
            a = _merged(a, b, windows)
        low = a.sums[0] if len(a.sums) == windows else 0
        heapq.heapreplace(heap, (low - a.sums[-1], serial, a))
        serial += 1
    for window, part in enumerate(heap[0][2].parts):
        stack = [part]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                found[x] = window
    return found


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Pieces (at most `capacity` each) dealt to windows within the capacity; one window more as long as any exceeds it."""
    if not sizes:
        return []
    windows = -(-sum(sizes) // capacity)
    while True:
        at = difference(sizes, windows)
        if np.bincount(at, weights=sizes, minlength=windows).max() <= capacity:
            break
        windows += 1
    out: list[list[int]] = [[] for _ in range(windows)]
    for i, w in enumerate(at):
        out[w].append(i)
    return [x for x in out if x]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", memory_words: int = MEMORY_WORDS) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Each token lies in exactly one piece; the pieces of a sequence follow each other from offset 0.
    Null text counts as empty: with an end id it gives one piece of one token, without one none.
    Texts of any length are cut as they come. Repeated rows are packed each for itself. An empty table
    gives no rows; other columns are ignored, whatever their names. tokenizer_path must be readable on
    the executors. memory_words bounds the words whose ids a worker remembers (about 0.2 kB each); it changes time, not results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, end_id, memory_words)
        serial = TaskContext.get().partitionId() << 40
        rest: list[tuple] = []

        def rows(sequences):
            nonlocal serial
            cols: list[list] = [[] for _ in _ARROW]
            for sequence in sequences:
                at = 0
                for doc, start, ids, total in sequence:
                    for col, x in zip(cols, (doc, start, len(ids) // 4, total, serial, at, ids)):
                        col.append(x)
                    at += len(ids) // 4
                serial += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _ARROW)], schema=_ARROW)

        def flush():
            return rows([rest[i] for i in w] for w in near_equal([len(p[2]) // 4 for p in rest], capacity))

        for batch in batches:
            for i, j in slices(batch.column(1), ENCODED_BYTES):
                part = batch.slice(i, j - i)
                full = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode_column(part.column(1))):
                    total, step = len(ids) // 4, 4 * capacity
                    for at in range(0, len(ids), step):
                        piece = (doc, at // 4, ids[at : at + step], total)
                        if len(piece[2]) == step:
                            full.append([piece])
                        else:
                            rest.append(piece)
                    if len(rest) >= BATCH_PIECES:
                        yield flush()
                        rest.clear()
                if full:
                    yield rows(full)
        if rest:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)

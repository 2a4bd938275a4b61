"""Words of whole texts as arrays of 64-bit hashes, computed over Arrow's buffers.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. Hashes are polynomial over a random byte
table, then mixed; they are the same in every process.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

_random = np.random.default_rng(20240607)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = _TABLE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _scale(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2^64, and those of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer (MurmurHash3's constants)."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words(NamedTuple):
    first: int  #: the first document's row in the batch
    hashes: np.ndarray  #: of all words, uint64
    at: np.ndarray  #: document i has the words at[i] to at[i + 1]
    data: np.ndarray  #: the texts' bytes
    starts: np.ndarray  #: each word's first byte
    ends: np.ndarray  #: and the one after its last


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, one after the last) of stretches of texts of `most` bytes in all; a longer text is alone."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def chunks(most: int, text: int) -> Callable:
    """Batches of rows to chunks of rows: (chunk, packed), at most about `most` bytes of the column at `text`, or one longer text."""

    def chunk(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in held:
                out.write_batch(batch)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for i, j in slices(batch.column(text), most):
                part = batch.slice(i, j - i)
                more = part.column(text).nbytes
                if held and size + more > most:
                    yield chunk(number, held)
                    number, size, held = number + 1, 0, []
                held.append(part)
                size += more
        if held:
            yield chunk(number, held)

    return run


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned numbers, as planes of bytes of their differences."""
    steps = np.diff(x, prepend=np.zeros(1, np.uint64))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_sorted(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.cumsum(planes.reshape(8, -1).T.copy().view(np.uint64).reshape(-1))


def words(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of a column of texts, some documents at a time; null has none."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    table, i = _LOWER if lower else _TABLE, 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        part, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        inside = ~_SPACE[part]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = edges[(edges > 0) & (edges < len(part))]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = _scale(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * up[:-1], out=sums[1:])
        yield Words(i, mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)), np.searchsorted(s, edges), part, s, e)
        i = j


def grams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of each k consecutive words: len(hashes) - k + 1 of them, those across documents included."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _scale(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes, salt) * up[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n], salt + k)


def byte_table(characters: bytes) -> np.ndarray:
    """Which bytes are among these."""
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_AS_LOWER = np.arange(256, dtype=np.uint8)
_AS_LOWER[ord("A") : ord("Z") + 1] += 32


def lower_az(data: np.ndarray) -> np.ndarray:
    return _AS_LOWER[data]


class Spans(NamedTuple):
    first: int  #: the first document's row in the batch
    at: np.ndarray  #: document i has the spans at[i] to at[i + 1]
    edges: np.ndarray  #: and the bytes edges[i] to edges[i + 1]
    data: np.ndarray  #: the texts' bytes
    inside: np.ndarray  #: which of them are in a span
    starts: np.ndarray  #: each span's first byte
    ends: np.ndarray  #: and the one after its last


def spans(column: pa.Array, separators: np.ndarray, most: int = SLICE_BYTES) -> Iterator[Spans]:
    """The runs of bytes that are no separators, within each text of a column, some documents at a time; null has none."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for i, j in slices(column, most):
        part, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        inside = ~separators[part]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = edges[(edges > 0) & (edges < len(part))]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        s = np.flatnonzero(begins)
        yield Spans(i, np.searchsorted(s, edges), edges, part, inside, s, np.flatnonzero(ends) + 1)


def span_texts(data: np.ndarray, inside: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The spans as texts, from their bytes and sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside])))


def numbered(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(each text's number, the distinct texts): equal texts have equal numbers."""
    coded = texts.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

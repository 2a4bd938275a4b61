"""Removal of long passages that an earlier document has too, by De Bruijn compaction over word k-mers.

The graph's nodes are 25-mers. Every window of 50 words passes the smallest of its 25-mers (the minimizer,
which only depends on the window's words), and the windows of a document that pass the same one follow each
other without a gap. Such a run is one row: the node, a hash of all its words, the document, the start, and
the node that the document passes next, which is the edge. Then, by joins:

- A node that only one document passes is dropped: no window through it repeats.
- A node through which all runs are equal doesn't branch. Where all its documents go on to one node, and that
  node is passed as often, so that none come from elsewhere, both lie on one nonbranching path. Paths are
  compacted in rounds of joins, each of which doubles how far a node sees back, until every node knows its
  path's first. One row for each document that passes the first node then stands for the whole path.
- The source of a path is its smallest document at its place there. Its words are read at those coordinates,
  and a copy's words are held against them by 128 bits of SHA-256 before any of them goes.
- Where different runs meet in a node, one run of each kind is opened into its windows, the smallest
  document of each window is found among them by a hash of its words, and goes back to all runs of the kind with the
  digest of the words there, against which a copy's words are held as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.words import Words, _scale, mix, slices, words
from scriptorium.session import durable

WINDOW = 50
_PLACE = np.uint64((1 << 24) - 1)
_PATHS = "doc_id long, mark long, node long, path long, start long, n int, next long"
_OPENED = "node long, path long, place int, window long, doc_id long, digest binary"


class _Prefix:
    """Hashes of any stretch of a slice's words."""

    def __init__(self, hashes: np.ndarray, salt: int):
        self.salt = salt
        up, self.down = _scale(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes, salt) * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64), self.salt)


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def paths_of(w: Words, window: int) -> tuple[np.ndarray, ...]:
    """(document, node, path, start, number of windows, next node) of each run of windows with one minimizer.

    Starts count from the slice's first word; after a document's last run the next node is 0.
    """
    n, k = len(w.hashes), window // 2
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.uint64))
    at = np.arange(n - k + 1)
    node = _Prefix(w.hashes, 11).of(at, at + k)
    least = _slide(node & ~_PLACE | at.astype(np.uint64) & _PLACE, window - k + 1)
    s = np.arange(n - window + 1)
    doc = np.repeat(np.arange(len(w.at) - 1), np.diff(w.at))[: len(s)]
    whole = s + window <= w.at[doc + 1]
    s, doc, least = s[whole], doc[whole], least[whole]
    p = s + (((least & _PLACE).astype(np.int64) - s) & int(_PLACE))
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    start, p, doc = s[first], p[first], doc[first]
    path = mix(_Prefix(w.hashes, 13).of(start, start + count - 1 + window) + (p - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    after = np.zeros(len(p), np.uint64)
    after[:-1] = np.where(doc[1:] == doc[:-1], node[p[1:]], np.uint64(0))
    return doc, node[p], path, start, count, after


def _all_paths(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for w in words(batch.column(2)):
                doc, node, path, start, count, after = paths_of(w, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[w.first + doc], marks[w.first + doc], node.view(np.int64), path.view(np.int64), start - w.at[doc], count.astype(np.int32), after.view(np.int64))],
                    names=["doc_id", "mark", "node", "path", "start", "n", "next"],
                )

    return run


def digest_of(found: list[bytes]) -> bytes:
    """128 bits of SHA-256: there is one for each window of a run that branches, and they are shuffled."""
    return hashlib.sha256(b" ".join(found)).digest()[:16]


def _open_paths(window: int):
    """(doc_id, text, wanted runs and whole paths) to the windows of those runs and, without a place, the whole paths, each with a digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for w in words(batch.column(1)):
                hashes = _Prefix(w.hashes, 17)
                for i, base in enumerate(w.at[:-1].tolist()):
                    found = (batch.column(1)[w.first + i].as_py() or "").encode("utf-8", "surrogatepass").split()
                    whole = [r for r in wanted[w.first + i] if r["path"] is None]
                    if whole:
                        digests = [digest_of(found[r["start"] : r["start"] + r["n"] + window - 1]) for r in whole]
                        none = pa.nulls(len(whole), pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["node"] for r in whole], pa.int64()), none, none.cast(pa.int32()), none, none, pa.array(digests, pa.binary())],
                            names=["node", "path", "place", "window", "doc_id", "digest"],
                        )
                    rows = [r for r in wanted[w.first + i] if r["path"] is not None]
                    if not rows:
                        continue
                    n = np.array([r["n"] for r in rows])
                    places = np.concatenate([np.arange(x) for x in n])
                    starts = np.repeat(np.array([r["start"] for r in rows], np.int64), n) + places
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(np.array([r["node"] for r in rows], np.int64), n)),
                            pa.array(np.repeat(np.array([r["path"] for r in rows], np.int64), n)),
                            pa.array(places.astype(np.int32)),
                            pa.array(hashes.of(base + starts, base + starts + window).view(np.int64)),
                            pa.array(np.full(len(places), ids[w.first + i], np.int64)),
                            pa.array([digest_of(found[x : x + window]) for x in starts.tolist()], pa.binary()),
                        ],
                        names=["node", "path", "place", "window", "doc_id", "digest"],
                    )

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans of start, words and digest) to what is left; a span only counts where its words have its digest, which is that of the words at its source."""
    for whole in batches:
        for i, j in slices(whole.column(1)):
            batch = whole.slice(i, j - i)
            total, removed, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = (text or "").encode("utf-8", "surrogatepass").split()
                total.append(len(found))
                spans = [x for x in spans or () if digest_of(found[x["start"] : x["start"] + x["words"]]) == x["digest"]]
                if spans:
                    start, words_ = (np.array([x[k] for x in spans], np.int64) for k in ("start", "words"))
                    edge = np.zeros(len(found) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + words_, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    found = [found[k] for k in np.flatnonzero(~covered)]
                removed.append(total[-1] - len(found))
                kept.append(b" ".join(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def compacted(kinds: DataFrame) -> DataFrame:
    """(node, total): the first node of each nonbranching path, and the path's windows.

    kinds has (node, next_low, next_high, passes, n) of nodes that don't branch. A path can't close, since a document's
    last run has no next node.
    """
    ahead = kinds.where("next_low = next_high").select(F.col("node").alias("a"), F.col("next_low").alias("node"), F.col("passes").alias("a_passes"), F.col("n").alias("a_n"))
    link = ahead.join(kinds.select("node", "passes", "n"), "node").where("passes = a_passes")
    # Of each node behind another: one before it on its path, the windows from that to itself, and its own.
    seen = durable(link.select("node", F.col("a").alias("back"), F.col("a_n").cast("long").alias("gap"), "n"), "path-links")
    heads = kinds.select("node", "n").join(seen.select("node"), "node", "left_anti")
    while True:
        far = seen.select(F.col("node").alias("back"), F.col("back").alias("far"), F.col("gap").alias("more"))
        step = durable(seen.join(far, "back", "left").select("node", F.coalesce("far", "back").alias("back"), (F.col("gap") + F.coalesce("more", F.lit(0))).alias("gap"), "n", F.col("far").isNull().alias("ended")), "path-steps")
        left = step.where("NOT ended").count()
        seen = step.drop("ended")
        if not left:
            break
    ends = seen.groupBy("back").agg(F.max(F.col("gap") + F.col("n")).alias("total"))
    return heads.join(ends, heads["node"] == ends["back"], "left").select("node", F.coalesce("total", F.col("n").cast("long")).alias("total"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, start, words, source, digest): stretches of words whose windows all start in a document with a smaller identifier.

    mark is xxhash64 of the text; it tells apart rows that share an identifier. digest is that of the words at the
    source's coordinates. Spans of a document may
    overlap. Null and short texts have none; a row without an identifier neither has nor is a source.
    """
    rows = _rows(docs, id_col, text_col)
    paths = durable(rows.where("doc_id IS NOT NULL").select("doc_id", "mark", "text").mapInArrow(_all_paths(window), _PATHS), "paths")
    nodes = paths.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("path").alias("low"), F.max("path").alias("high"))
    # Aggregates are written out before they are joined: Spark splits a very common node only between plain tables.
    nodes = durable(nodes.where("first < last").select("node", "first", (F.col("low") != F.col("high")).alias("branches")), "repeated-nodes")
    through = durable(paths.join(nodes, "node"), "repeated-paths")

    plain = through.where("NOT branches")
    kinds = plain.groupBy("node").agg(
        F.min("next").alias("next_low"), F.max("next").alias("next_high"), F.count(F.lit(1)).alias("passes"), F.first("n").alias("n"), F.min(F.struct("doc_id", "mark", "start")).alias("at")
    )
    kinds = durable(kinds, "plain-nodes")
    heads = durable(compacted(kinds).join(kinds.select("node", "at"), "node"), "path-heads")

    # One run of each kind that branches, the smallest document's, is opened; the words of each whole path are read at its source.
    branching = through.where("branches")
    opening = branching.groupBy("node", "path").agg(F.min(F.struct("doc_id", "mark", "start", "n")).alias("at")).select("at.doc_id", "at.mark", "at.start", F.col("at.n").cast("long").alias("n"), "node", "path")
    reading = heads.select("at.doc_id", "at.mark", "at.start", F.col("total").alias("n"), "node", F.lit(None).cast("long").alias("path"))
    wanted = opening.union(reading).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n", "node", "path")).alias("wanted"))
    texts = rows.join(wanted, ["doc_id", "mark"]).select("doc_id", "text", "wanted")
    opened = durable(texts.mapInArrow(_open_paths(window), _OPENED), "opened-windows")
    # Rows that share identifier and text are read twice, with one digest.
    digests = durable(opened.where("place IS NULL").groupBy("node").agg(F.first("digest").alias("digest")), "source-digests")
    lead = durable(heads.join(digests, "node").select("node", "total", "digest"), "path-sources")
    spans = plain.where("doc_id > first").join(lead, "node").select("doc_id", "mark", "start", (F.col("total") + window - 1).alias("words"), F.col("first").alias("source"), "digest")

    opened = opened.where("place IS NOT NULL").distinct()
    sources = durable(opened.groupBy("node", "window").agg(F.min(F.struct("doc_id", "digest")).alias("source")), "window-sources")
    by_kind = opened.select("node", "path", "place", "window").join(sources, ["node", "window"]).groupBy("node", "path").agg(F.sort_array(F.collect_list(F.struct("place", "source"))).alias("windows"))
    met = branching.select("doc_id", "mark", "node", "path", "start").join(durable(by_kind, "path-windows"), ["node", "path"])
    met = met.select("doc_id", "mark", "start", F.explode(F.filter("windows", lambda x: x["source"]["doc_id"] < F.col("doc_id"))).alias("x"))
    branched = met.select("doc_id", "mark", (F.col("start") + F.col("x.place")).alias("start"), F.lit(window).cast("long").alias("words"), F.col("x.source.doc_id").alias("source"), F.col("x.source.digest").alias("digest"))
    return spans.union(branched)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), a row for each input row.

    Each word covered by a window that also starts in a document with a smaller identifier goes; the
    words that stay are joined by one space. All windows are judged on the input. Null text has no
    words; texts of fewer words than a window stay whole, as do rows without an identifier. Rows that
    share an identifier are no sources for each other. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    rows = _rows(docs, id_col, text_col)
    spans = repeated_spans(docs, window, id_col, text_col)
    by_row = spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "words", "digest")).alias("spans"))
    joined = rows.join(by_row, ["doc_id", "mark"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_text string")

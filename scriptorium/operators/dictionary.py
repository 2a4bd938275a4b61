"""Translation by a bilingual dictionary: sentence memory, longest entries from left to right, a draft, and a model's polish (SCL-18)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import is_cjk, memory_key
from scriptorium.operators.library import segment_translate

#: Bytes of a dictionary's terms and values up to which it is broadcast; a larger one meets the texts' substrings in a join.
BROADCAST_BYTES = 256 << 20
#: The share of a text's Chinese characters from which a draft needs no polish.
COVERED = 0.99

_SEGMENTS = "array<struct<start:int,term:string,value:string>>"


class Matcher:
    """A dictionary that finds, at each place, the longest entry that begins there: entries by their text, and by two first characters the lengths to try."""

    def __init__(self, entries: dict[str, str]):
        self.entries = {t: v for t, v in entries.items() if t}
        lengths: dict[str, set[int]] = {}
        for t in self.entries:
            lengths.setdefault(t[:2], set()).add(len(t))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}

    def at(self, text: str, i: int) -> int:
        """The length of the longest entry at a place, 0 if there is none."""
        for n in self.lengths.get(text[i : i + 2], ()):
            if text[i : i + n] in self.entries:
                return n
        return 1 if text[i] in self.entries else 0

    def segments(self, text: str) -> Iterator[tuple[int, str, str]]:
        """(start, term, value) of the entries taken from left to right, each the longest at its place; what has none is passed over."""
        i = 0
        while i < len(text):
            n = self.at(text, i)
            if n:
                yield i, text[i : i + n], self.entries[text[i : i + n]]
            i += n or 1

    def draft(self, text: str) -> str:
        out, last = [], 0
        for i, term, value in self.segments(text):
            out += [text[last:i], value]
            last = i + len(term)
        return "".join([*out, text[last:]])

    def covered(self, text: str) -> float:
        """The share of the Chinese characters that entries cover; 1 without any."""
        inside = sum(sum("一" <= c <= "鿿" for c in term) for _, term, _ in self.segments(text))
        every = sum("一" <= c <= "鿿" for c in text)
        return inside / every if every else 1.0


def drafted(texts: DataFrame, dictionary: DataFrame, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """texts with `draft`, `covered` and `segments` (start, term, value), by a dictionary (term, value), of whose rows with one term the smallest value counts.

    The dictionary is measured first and broadcast while it is small; beyond that (no segments then, and covered null) its terms of up to 8 characters meet the texts'
    substrings in a join. A null text stays null; an empty dictionary leaves texts as they are.
    """
    spark = texts.sparkSession
    entries = dictionary.where("term <> ''").groupBy("term").agg(F.min("value").alias("value")).where("value IS NOT NULL")
    size = entries.agg(F.sum(F.octet_length("term") + F.octet_length("value")).alias("n")).first()["n"] or 0
    if size > broadcast_bytes:
        return segment_translate(texts, entries, text=text).withColumn("covered", F.lit(None).cast("double")).withColumn("segments", F.lit(None).cast(_SEGMENTS))
    shared = spark.sparkContext.broadcast(Matcher({r["term"]: r["value"] for r in entries.collect()}))  # bounded by broadcast_bytes

    @F.pandas_udf(f"struct<draft:string,covered:double,segments:{_SEGMENTS}>")
    def match(s: pd.Series) -> pd.DataFrame:
        m = shared.value
        rows = [(None, None, None) if x is None else (m.draft(x), m.covered(x), [dict(zip(("start", "term", "value"), y)) for y in m.segments(x)]) for x in s]
        return pd.DataFrame(rows, columns=["draft", "covered", "segments"])

    return texts.withColumn("m_", match(F.col(text))).select(*texts.columns, "m_.draft", "m_.covered", "m_.segments")


def translated(texts: DataFrame, dictionary: DataFrame, memory: DataFrame, target: str, polish: Callable | None = None, text: str = "text") -> DataFrame:
    """texts with `translation` and `way`: what the sentence memory (key, value) has, else a polished draft, else the draft.

    polish is a vectorised function of (text, draft, segments as JSON); it is asked where a draft covers less than COVERED, and what it gives counts if it is
    not blank and has no Chinese characters left.
    """
    remembered = memory.groupBy(F.col("key").alias("k_")).agg(F.min("value").alias("known_"))
    rows = drafted(texts.withColumn("k_", memory_key(F.lit(target), F.col(text))), dictionary, text).join(remembered, "k_", "left").drop("k_")
    if polish is None:
        asked = F.lit(None).cast("string")
    else:
        needed = F.col("known_").isNull() & (F.coalesce("covered", F.lit(0.0)) < COVERED)
        asked = F.when(needed, polish(F.when(needed, F.col(text)), F.when(needed, F.col("draft")), F.when(needed, F.to_json("segments"))))
    rows = rows.withColumn("asked_", asked).withColumn("asked_", F.when((F.trim("asked_") != "") & ~is_cjk(F.col("asked_")), F.col("asked_")))
    way = F.when(F.col("known_").isNotNull(), "memory").when(F.col("asked_").isNotNull(), "polished").when(F.col("draft").isNotNull(), "draft")
    return rows.withColumn("translation", F.coalesce("known_", "asked_", "draft")).withColumn("way", way).drop("known_", "asked_")


def learned(results: DataFrame, target: str, text: str = "text") -> DataFrame:
    """(key, value) to add to the memory: polished translations (a text's smallest one)."""
    return results.where("way = 'polished'").groupBy(memory_key(F.lit(target), F.col(text)).alias("key")).agg(F.min("translation").alias("value"))

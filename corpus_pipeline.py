"""The corpus pipeline: documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the
next stage's docs. All but the last keep the columns of documents, whatever their names, and further ones. An
empty table stays empty in every stage; texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.exact_dedup import drop_copies
from scriptorium.llm.jaccard_join import one_of_each
from scriptorium.llm.language_id import keep_identified
from scriptorium.llm.mixing import take_mix
from scriptorium.llm.packing import pack
from scriptorium.llm.queries import prepare
from scriptorium.session import durable, load

#: Words that packing's workers remember here, where executors hold the buffers of the stages before, too.
MEMORY_WORDS = 300_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null ones among them), or far from every language that the labelled rows teach, go. Repeated rows share their fate."""
    prepare(spark)
    return keep_identified(docs, docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays; null and empty texts are equal, repeated rows are copies, a null doc_id is the smallest."""
    prepare(spark)
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id stays; without words each doc_id stays, repeated rows once, a null doc_id only alone."""
    prepare(spark)
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; those not taken go. Texts without words stay once; null sources are one source; of repeated rows one stands for all."""
    prepare(spark)
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens; null texts are empty, repeated rows are packed each for itself."""
    prepare(spark)
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), memory_words=MEMORY_WORDS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The language models and the choice of the mix can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

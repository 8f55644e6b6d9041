"""Corpus pipeline: documents in, packed sequences out.

Documents the quality classifier rejects go; blocks of lines that an earlier document has, then near
copies but one, then long passages that an earlier document has; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimsift.llm import debruijn, minhash_join, packing, patience, quality_net
from dimsift.llm.tokenizer_file import TokenizerFile, default_path
from dimsift.storage import materialize

CARRIED = ["lang", "source", "n_chars"]
COLUMNS = ["doc_id", "text", *CARRIED]


def _emptied(before: str) -> Column:
    """A document that lost all it had."""
    return (F.col(before) > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")


def _with_new_text(docs: DataFrame) -> DataFrame:
    return docs.where(~_emptied("n_removed")).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those the classifier rejects; fitted on this input and the given labels."""
    docs = docs.select(COLUMNS)
    return quality_net.accepted(docs, quality_net.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines go from the later document; a document that loses all its words goes too."""
    return _with_new_text(patience.dedup(docs, carry=CARRIED))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies the document with the smallest id stays."""
    found = minhash_join.jaccard_join(docs)
    others = found.where(F.col("class_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.select(COLUMNS).join(others.hint("shuffle_hash"), "doc_id", "left_anti")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that a smaller document has go; a document that loses all its words goes too."""
    return _with_new_text(debruijn.dedup(docs, squeeze=False, carry=CARRIED))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, and their places in sequences."""
    return packing.pack(docs, TokenizerFile(spark, default_path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack),
]
# a fitted network, patience diff and packing have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves is stored before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs

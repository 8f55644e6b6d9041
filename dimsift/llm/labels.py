"""Labelled rows to fit a model on: a bounded sample that is the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5  # rows whose digest falls into fold 0 are held out everywhere


def fold(key: str = "doc_id") -> Column:
    """``crc32(key as text) mod 5``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def training_ids(labels: DataFrame, sample: int, label: str = "quality") -> DataFrame:
    """``doc_id, label``: at most ``sample`` labelled rows outside fold 0, chosen by digest.

    Null keys and labels are left out; of repeated keys with different labels, the larger label counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold() != 0))
    one = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def with_labels(docs: DataFrame, labels: DataFrame, sample: int, label: str = "quality") -> DataFrame:
    """Rows of ``docs`` (``doc_id, text``) in the sample, and their ``label``."""
    ids = training_ids(labels, sample, label)
    # at most `sample` rows of two numbers
    return docs.join(F.broadcast(ids), "doc_id")

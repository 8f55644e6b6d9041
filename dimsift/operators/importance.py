"""How much each dimension matters to each query.

An importance frame has one row per query: ``query_id, vec, importance``. Everything after the
feedback means is computed inside that row. A filter is any callable from a query frame
(``query_id, vec`` and, for answers, ``text``) to an importance frame, with a ``tag``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from .encode import ANSWER_BATCH, encode_text
from .vectors import mean_vectors


class Filter(Protocol):
    tag: str

    def __call__(self, queries: DataFrame) -> DataFrame: ...


def interaction(mean: Column | str) -> Column:
    """``q_d * mean_d`` per dimension; zero where a query has no mean."""
    return F.coalesce(arrays.times("vec", mean), F.transform("vec", lambda _: F.lit(0.0)))


def _with_means(queries: DataFrame, means: DataFrame) -> DataFrame:
    return queries.select("query_id", "vec").join(means, "query_id", "left")


def _of(queries: DataFrame, members: DataFrame) -> DataFrame:
    """Feedback of the given queries only."""
    return members.select("query_id", "doc_id").join(queries.select("query_id"), "query_id", "left_semi")


def top_feedback(run: DataFrame, k: int) -> DataFrame:
    return run.where(F.col("rank") < k).select("query_id", "doc_id")


def bottom_feedback(run: DataFrame, k: int) -> DataFrame:
    """The ``k`` lowest-placed documents of every query in the run, so its depth matters."""
    worst = Window.partitionBy("query_id").orderBy(F.col("rank").desc())
    return (
        run.withColumn("place", F.row_number().over(worst))
        .where(F.col("place") <= k)
        .select("query_id", "doc_id", "place")
    )


def _from_members(queries: DataFrame, members: DataFrame, vectors: DataFrame) -> DataFrame:
    means = mean_vectors(members, vectors, ["query_id"])
    return _with_means(queries, means).withColumn("importance", interaction("mean")).drop("mean")


@dataclass(frozen=True)
class PseudoRelevance:
    """The best ``k`` documents of a first run stand in for relevant ones."""

    run: DataFrame
    vectors: DataFrame
    k: int

    @property
    def tag(self) -> str:
        return f"prf-k{self.k}"

    def members(self, queries: DataFrame) -> DataFrame:
        return _of(queries, top_feedback(self.run, self.k))

    def __call__(self, queries: DataFrame) -> DataFrame:
        return _from_members(queries, self.members(queries), self.vectors)


@dataclass(frozen=True)
class Judged:
    """Documents judged relevant. The definition is ours: the upper bound is only announced elsewhere."""

    qrels: DataFrame
    vectors: DataFrame
    threshold: int = 1
    tag: str = "oracular"

    def members(self, queries: DataFrame) -> DataFrame:
        return _of(queries, self.qrels.where(F.col("relevance") >= self.threshold))

    def __call__(self, queries: DataFrame) -> DataFrame:
        return _from_members(queries, self.members(queries), self.vectors)


@dataclass(frozen=True)
class Answers:
    """A generated answer per query; a query without one falls back to its own text."""

    answers: DataFrame
    load_model: Callable[[], Callable]
    variant: str = "gpt"
    batch_size: int = ANSWER_BATCH

    @property
    def tag(self) -> str:
        return self.variant

    def __call__(self, queries: DataFrame) -> DataFrame:
        # a repeated id has one answer, the same on every run
        answers = self.answers.groupBy("query_id").agg(F.min("text").alias("answer"))
        texts = queries.join(answers, "query_id", "left").select(
            "query_id", "vec", F.coalesce("answer", "text").alias("text")
        )
        encoded = encode_text(texts, self.load_model, self.batch_size, into="mean")
        return encoded.withColumn("importance", arrays.times("vec", "mean")).drop("mean")


@dataclass(frozen=True)
class NegativeFeedback:
    """Any filter, less the interaction with the worst ``kneg`` documents of the run."""

    base: Filter
    run: DataFrame
    vectors: DataFrame
    kneg: int
    lambda_pos: float = 1.0
    lambda_neg: float = 0.5

    @property
    def tag(self) -> str:
        return f"{self.base.tag}-eclipse"

    def __call__(self, queries: DataFrame) -> DataFrame:
        worst = _of(queries, bottom_feedback(self.run, self.kneg))
        weights = F.lit(self.lambda_pos), F.lit(self.lambda_neg)
        if hasattr(self.base, "members") and self.base.vectors.sameSemantics(self.vectors):
            # both means from one pass over the vectors
            members = self.base.members(queries).withColumn("part", F.lit("positive")).unionByName(
                worst.withColumn("part", F.lit("negative"))
            )
            means = mean_vectors(members, self.vectors, ["query_id", "part"])
            means = means.groupBy("query_id").pivot("part", ["positive", "negative"]).agg(F.first("mean"))
            both = _with_means(queries, means)
            importance = combined(interaction("positive"), interaction("negative"), *weights)
        else:
            negative = mean_vectors(worst, self.vectors, ["query_id"]).withColumnRenamed("mean", "negative")
            both = self.base(queries).join(negative, "query_id", "left")
            importance = combined(F.col("importance"), interaction("negative"), *weights)
        return both.select("query_id", "vec", importance.alias("importance"))


def combined(positive, negative, lambda_pos, lambda_neg):
    return F.zip_with(positive, negative, lambda p, n: lambda_pos * p - lambda_neg * n)


def to_long(importance: DataFrame) -> DataFrame:
    """``query_id, dim, importance, drank`` with ``drank`` from 1."""
    zipped = F.arrays_zip(F.col("importance"), arrays.dim_ranks("importance").alias("drank"))
    return importance.select("query_id", F.posexplode(zipped).alias("dim", "cell")).select(
        "query_id", "dim", F.col("cell.importance").alias("importance"), F.col("cell.drank").alias("drank")
    )


def from_long(long: DataFrame, queries: DataFrame) -> DataFrame:
    """Back from ``query_id, dim, importance`` to one row per query."""
    in_order = F.sort_array(F.collect_list(F.struct("dim", "importance")))
    rows = long.groupBy("query_id").agg(F.transform(in_order, lambda s: s["importance"]).alias("importance"))
    return queries.select("query_id", "vec").join(rows, "query_id")


def subset(importance: DataFrame, query_ids: DataFrame) -> DataFrame:
    return importance.join(query_ids.select("query_id").distinct(), "query_id", "left_semi")


def row(importance: DataFrame, query_id: str) -> DataFrame:
    found = importance.where(F.col("query_id") == query_id)
    if found.isEmpty():
        raise KeyError(query_id)
    return found


def check_shape(importance: DataFrame) -> tuple[int, int]:
    """Queries and dimensions; raises when ids repeat or lengths differ."""
    size = importance.agg(
        F.count("*").alias("rows"),
        F.count_distinct("query_id").alias("ids"),
        F.min(F.size("importance")).alias("low"),
        F.max(F.size("importance")).alias("high"),
        F.min(F.size("vec")).alias("vec_low"),
        F.max(F.size("vec")).alias("vec_high"),
    ).first()
    if size["rows"] != size["ids"]:
        raise ValueError(f"{size['rows']} rows for {size['ids']} query ids")
    if len({size["low"], size["high"], size["vec_low"], size["vec_high"]}) > 1:
        raise ValueError("importance and query vectors differ in length")
    return size["rows"], size["low"]

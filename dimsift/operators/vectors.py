"""Operations on a table of vectors (``id column, vec``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays
from ..storage import broadcast_if_small, materialize

STRETCH = 32  # dimensions whose means are made side by side, in columns
PUSHED_IDS = 10_000  # more ids than that are joined instead of named; to the same rows


def missing_ids(vectors: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The distinct ids that have no vector."""
    return ids.select(key).distinct().join(vectors.select(key), key, "left_anti")


def require(vectors: DataFrame, ids: DataFrame, key: str = "doc_id") -> None:
    """Raise ``KeyError`` naming up to five ids without a vector, if there are any."""
    absent = [row[0] for row in missing_ids(vectors, ids, key).limit(5).collect()]
    if absent:
        raise KeyError(f"no vector for {absent}")


def among(key: str, ids: Sequence) -> Column:
    """Whether ``key`` is one of ``ids``, strings or whole numbers, as a literal list that a scan can use."""
    if not ids:
        return F.lit(False)
    # one expression: a column per id would be as many calls to the JVM; in hexadecimal, nothing needs quoting
    named = [f"CAST(X'{i.encode().hex()}' AS STRING)" if isinstance(i, str) else f"{i}L" for i in ids]
    return F.expr(f"`{key}` IN ({', '.join(named)})")


def _pushed(wanted: DataFrame, key: str) -> list | None:
    """The ids, if they are few enough to be named to the scan."""
    if not isinstance(wanted.schema[key].dataType, (T.StringType, T.LongType, T.IntegerType)):
        return None
    few = [r[0] for r in wanted.where(F.col(key).isNotNull()).limit(PUSHED_IDS + 1).collect()]
    return few if len(few) <= PUSHED_IDS else None


def lookup(vectors: DataFrame, ids: DataFrame, key: str = "doc_id", strict: bool = False) -> DataFrame:
    """The vector of every row of ``ids``; other columns of ``ids`` come along.

    The distinct ids are stored. A few thousand of them are named to the scan, which leaves out row groups
    that have none (tables of ``write_vectors`` are sorted and have Bloom filters); more are broadcast if
    their files are small, so the vector table is scanned but not moved. Only vectors that are wanted meet
    the other columns. ``strict`` raises ``KeyError`` for ids without a vector.
    """
    wanted = materialize(ids.select(key).distinct(), "wanted")
    few = _pushed(wanted, key)
    chosen = vectors.join(broadcast_if_small(wanted), key, "left_semi") if few is None else vectors.where(among(key, few))
    if strict:
        require(vectors if few is None else chosen, wanted, key)
    return chosen.join(ids, key)


def exploded(vectors: DataFrame, *keys: str, column: str = "vec") -> DataFrame:
    """One row per vector and dimension: ``keys, dim, value``."""
    return vectors.select(*keys, F.posexplode(column).alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


def centroid(vectors: DataFrame) -> DataFrame:
    """Mean of all vectors as ``dim, value``; every task sends one vector."""
    mean = vectors.where(F.col("vec").isNotNull()).agg(
        F.count("*").alias("n"), Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>"))).alias("mean")
    )
    return mean.where("n > 0").select(F.posexplode(vector_to_array("mean")).alias("dim", "value"))


def normalized(vectors: DataFrame, ids: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Vectors scaled to unit length, all of them or those of ``ids``."""
    if ids is not None:
        vectors = lookup(vectors, ids, key)
    return vectors.withColumn("vec", arrays.l2_normalize("vec"))


def mean_vectors(members: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, mean``: the mean vector of the documents listed per key; each has to have a vector.

    Sums per key form in the map tasks, a stretch of the dimensions to a row, so a key with very many members costs no
    more to shuffle than any other.
    """
    found = lookup(vectors.select("doc_id", "vec"), members.select(*keys, "doc_id"), strict=True)
    starts = F.sequence(F.lit(0), F.greatest(F.size("vec") - 1, F.lit(0)), F.lit(STRETCH))
    parts = found.select(*keys, "vec", F.explode(starts).alias("_start")).where(F.size("vec") > F.col("_start"))
    one = [F.get("vec", F.col("_start") + i).cast("double").alias(f"_{i}") for i in range(STRETCH)]
    sums = parts.select(*keys, "_start", (F.size("vec") - F.col("_start")).alias("_left"), *one).groupBy(*keys, "_start").agg(
        F.max("_left").alias("_left"), *[F.avg(f"_{i}").alias(f"_{i}") for i in range(STRETCH)]
    )
    mean = F.slice(F.array(*[f"_{i}" for i in range(STRETCH)]), F.lit(1), F.least("_left", F.lit(STRETCH)))
    in_order = F.sort_array(F.collect_list(F.struct("_start", mean.alias("mean"))))
    return sums.groupBy(*keys).agg(in_order.alias("_parts")).select(*keys, F.flatten("_parts.mean").alias("mean"))


def shape(vectors: DataFrame) -> DataFrame:
    """One row: number of vectors and the smallest and largest length."""
    return vectors.agg(
        F.count("*").alias("n_items"),
        F.min(F.size("vec")).alias("min_dims"),
        F.max(F.size("vec")).alias("max_dims"),
    )

"""Text to vectors, in batches, with any model the caller supplies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import VECTOR

# Rows per model call.
TEXT_BATCH = 2048
ANSWER_BATCH = 256
KNOWN_TOKENS = 100_000  # whose dimension a hash model remembers; a Python worker holds several models


def encode_text(
    df: DataFrame,
    load_model: Callable[[], Callable],
    batch_size: int = TEXT_BATCH,
    text: str = "text",
    into: str = "vec",
) -> DataFrame:
    """Replace the text column by ``array<float>`` vectors.

    ``load_model`` runs once per Python worker and returns a function from a batch of strings
    to a ``[batch, D]`` array. The work is map-only: no row leaves its partition.
    """
    predict = predict_batch_udf(load_model, return_type=VECTOR, batch_size=batch_size)
    return df.withColumn(into, predict(df[text])).drop(text)


def hash_vectors(df: DataFrame, key: str, dims: int = 64, salt: int = 0, text: str = "text") -> DataFrame:
    """``key, vec``: what ``hash_model`` gives, by native functions; every key is one text.

    Tokens are counted per dimension in the map tasks, so a row per text and dimension is shuffled.
    """
    token = F.explode_outer(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)))
    digits = F.substring(F.md5(F.col("_token").cast("binary")), 8 * salt + 1, 8)
    dim = (F.conv(digits, 16, 10).cast("long") % dims).cast("int")
    counts = df.select(key, token.alias("_token")).groupBy(key, dim.alias("_dim")).agg(F.count("_token").alias("_n"))
    found = F.collect_list(F.when(F.col("_dim").isNotNull(), F.struct("_dim", F.col("_n").cast("double"))))
    rows = counts.groupBy(key).agg(
        F.map_from_entries(found).alias("_found"), F.sqrt(F.sum(F.col("_n") * F.col("_n")).cast("double")).alias("_norm")
    )
    norm = F.when(F.col("_norm") == 0, 1.0).otherwise(F.col("_norm"))
    unit = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda d: (F.floor(F.coalesce(F.try_element_at("_found", d), F.lit(0.0)) / norm * 2.0**20 + 0.5) / 2.0**20).cast("float"),
    )
    return rows.select(key, unit.alias("vec"))


def hash_model(dims: int = 64, salt: int = 0) -> Callable[[], Callable]:
    """A model without weights: every ``[a-z]+`` token adds one to a hashed dimension, then unit length.

    ``salt`` picks eight of the 32 hex digits of the token's MD5, so two salts are two unrelated
    models. Components lie on a grid of 2^-20: they are exact in single precision, and sums of
    products are exact in double precision whatever their order.
    """

    def load():
        import numpy as np

        from ..functions.tokens import TokenDimensions

        known = TokenDimensions(dims, salt, KNOWN_TOKENS)

        def predict(texts):
            counts = known.counts(texts)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            unit = counts / np.where(norms == 0, 1.0, norms)
            return (np.floor(unit * 2.0**20 + 0.5) / 2.0**20).astype(np.float32)

        return predict

    return load

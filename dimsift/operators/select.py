"""From importance to weights on the query's dimensions.

A weight frame has one row per query and setting: ``query_id, alpha, alpha_value, vec, weights``.
``alpha`` is a label (``"0.1"`` .. ``"1.0"`` or ``"rdime"``), ``alpha_value`` its number or null.
Every step works on a row alone. A selector is any object with a ``tag`` and a method ``weights`` from
an importance frame (and the fractions asked for) to a weight frame; weights may be hard or soft.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, rows
from ..schemas import VECTOR

# The default grid of fractions.
DEFAULT_ALPHAS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)

WEIGHED_ROWS = 1000  # queries whose weights of all fractions are held at once


def alpha_label(alpha: float | str) -> str:
    return alpha if isinstance(alpha, str) else str(float(alpha))


def top_k_weights(importance: DataFrame, k: int) -> DataFrame:
    """The ``k`` most important dimensions; none for ``k <= 0``, all for ``k >= D``."""
    return importance.withColumn(
        "weights", arrays.top_k_weights(arrays.dim_ranks("importance"), F.lit(k))
    ).drop("importance")


@dataclass(frozen=True)
class TopAlpha:
    """A fixed fraction of the dimensions, for each of several fractions."""

    tag: str = "top-alpha"

    def weights(self, importance: DataFrame, alphas: Sequence[float] = DEFAULT_ALPHAS) -> DataFrame:
        # ranked once per query, before the settings multiply the rows
        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, WEIGHED_ROWS):
                    some = batch.slice(start, WEIGHED_ROWS)
                    at = pa.array(np.repeat(np.arange(some.num_rows), len(alphas)))
                    every = pa.array(np.tile(np.arange(len(alphas)), some.num_rows))
                    columns = [some["query_id"].take(at), pa.array(names, pa.string()).take(every), pa.array(shares, pa.float64()).take(every)]
                    columns += [some["vec"].take(at), rows.top_alpha_weights(some["importance"], shares)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "alpha", "alpha_value", "vec", "weights"])

        names, shares = [alpha_label(a) for a in alphas], [float(a) for a in alphas]
        schema = T.StructType([
            importance.schema["query_id"], T.StructField("alpha", T.StringType()), T.StructField("alpha_value", T.DoubleType()),
            importance.schema["vec"], T.StructField("weights", VECTOR),
        ])
        return importance.select("query_id", "vec", "importance").mapInArrow(weigh, schema)


@dataclass(frozen=True)
class NoiseThreshold:
    """Dimensions whose importance exceeds the query's own noise estimate; needs no fraction."""

    tag: str = "rdime"

    def weights(self, importance: DataFrame, alphas: Sequence[float] | None = None) -> DataFrame:
        return importance.select(
            "query_id",
            F.lit(self.tag).alias("alpha"),
            F.lit(None).cast("double").alias("alpha_value"),
            "vec",
            arrays.threshold_weights(F.col("vec"), F.col("importance")).alias("weights"),
        )


class Selector(Protocol):
    tag: str

    def weights(self, importance: DataFrame, alphas: Sequence[float] | None = None) -> DataFrame: ...


def selector(chosen: str | Selector) -> Selector:
    """The selector of that name, or the object itself."""
    if not isinstance(chosen, str):
        return chosen
    known = {s.tag: s for s in (TopAlpha(), NoiseThreshold())}
    if chosen not in known:
        raise ValueError(f"unknown selector {chosen!r}; known: {sorted(known)}")
    return known[chosen]


def labels(chosen: Selector, alphas: Sequence[float]) -> list[str] | None:
    """The settings a selector makes, where its kind tells; else they are in its weights."""
    if isinstance(chosen, TopAlpha):
        return [alpha_label(a) for a in sorted(alphas)]
    return [chosen.tag] if isinstance(chosen, NoiseThreshold) else None


def apply_weights(weighted: DataFrame) -> DataFrame:
    """Masked query vectors: ``vec * weights``, hard or soft."""
    kept = [f for f in weighted.schema.fields if f.name != "weights"]
    schema = T.StructType([T.StructField("vec", VECTOR) if f.name == "vec" else f for f in kept])

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {f.name: batch[f.name] for f in kept}
            columns["vec"] = rows.masked(batch["vec"], batch["weights"])
            yield pa.RecordBatch.from_pydict(columns)

    return weighted.mapInArrow(mask, schema)


def weights_long(weighted: DataFrame) -> DataFrame:
    return weighted.select("query_id", "alpha", F.posexplode("weights").alias("dim", "weight"))


def retained(weighted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of the dimensions kept, per query and setting."""
    return weighted.select(
        *by, "query_id", "alpha", (arrays.total(F.col("weights")) / F.size("weights")).alias("retained_frac")
    )


def mean_retained(fractions: DataFrame) -> DataFrame:
    return fractions.groupBy("alpha").agg(F.avg("retained_frac").alias("retained_frac"))

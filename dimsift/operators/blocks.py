"""Blocks of vectors that lie close together, and which of them a search has to read.

A block is known by the mean of its vectors, its centre, and by its radius, the largest distance of one of
them from it. No inner product of a query with a vector of the block exceeds ``q . centre + |q| radius``; a block
that no query can reach its floor in is left unread, and no row of the result changes.

Non-finite and null vectors have no place in a ranking; they are in block 0 and count for no centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import SCORE_BLOCK

BLOCK_TABLE = "block int, vectors bigint, centre array<double>, radius double"
SLACK = 1e-6  # of the largest product there can be, for sums in another order


def _finite(column: str):
    return F.col(column).isNotNull() & F.forall(column, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def with_blocks(vectors: DataFrame, key: str, blocks: int) -> DataFrame:
    """``vectors`` with the ``block`` each belongs to: the nearest of up to ``blocks`` of them, drawn by a hash of the key.

    ``blocks`` times the length of a vector is what the driver sees. Of equally near ones the first counts.
    """
    drawn = vectors.where(_finite("vec")).orderBy(F.xxhash64(key), key).limit(blocks)
    centres = np.array([r[0] for r in drawn.select("vec").collect()], np.float64)
    if not len(centres):
        return vectors.withColumn("block", F.lit(0))
    shared = vectors.sparkSession.sparkContext.broadcast((centres, (centres**2).sum(axis=1) / 2))
    marked = vectors.withColumn("_finite", _finite("vec"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, half = shared.value
        for batch in batches:
            chosen = batch["_finite"].to_numpy(zero_copy_only=False)
            found = np.zeros(batch.num_rows, np.int32)
            rows = np.flatnonzero(chosen)
            step = max(1, SCORE_BLOCK // len(centres))
            for part in (rows[i:i + step] for i in range(0, len(rows), step)):
                near = _matrix(batch["vec"].take(pa.array(part))) @ centres.T - half
                found[part] = near.argmax(axis=1)
            yield batch.drop_columns(["_finite"]).append_column("block", pa.array(found))

    inner = vectors.schema.simpleString()[len("struct<"):-1]
    return marked.mapInArrow(assign, f"{inner},block:int")


def block_table(vectors: DataFrame, block: str = "block") -> DataFrame:
    """``block, vectors, centre, radius`` of stored vectors with a block; one row per block with a finite vector."""
    finite = vectors.where(_finite("vec"))
    mean = Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>")))
    centres = finite.groupBy(F.col(block).alias("block")).agg(F.count("*").alias("vectors"), vector_to_array(mean).alias("centre"))
    # one row per block
    near = finite.select(F.col(block).alias("block"), "vec").join(F.broadcast(centres), "block")
    squares = F.aggregate(F.zip_with("vec", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    radius = near.select("block", squares.alias("square")).groupBy("block").agg(F.sqrt(F.max("square")).alias("radius"))
    return centres.join(radius, "block").select("block", "vectors", "centre", "radius")


def _over_blocks(blocks: DataFrame, shared, step, schema: str) -> DataFrame:
    """``step`` over stretches of the block table, against the shared queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value[0]
        size = max(1, SCORE_BLOCK // max(1, len(matrix)))
        for batch in batches:
            for part in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
                yield step(part["block"].to_numpy(), _matrix(part["centre"]), part["radius"].to_numpy(), *shared.value)

    return blocks.select("block", "centre", "radius").mapInArrow(run, schema)


def nearest_blocks(blocks: DataFrame, matrix: np.ndarray) -> list[int]:
    """For every query the block whose centre has the largest product with it; each block once."""
    shared = blocks.sparkSession.sparkContext.broadcast((matrix,))

    def step(numbers, centres, _, queries):
        products = queries @ centres.T
        best = products.argmax(axis=1)
        at = np.arange(len(queries))
        return pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(numbers[best]), pa.array(products[at, best])], ["at", "block", "product"]
        )

    found = _over_blocks(blocks, shared, step, "at int, block int, product double")
    best = found.groupBy("at").agg(F.max_by("block", F.struct("product", -F.col("block"))).alias("block"))
    numbers = sorted(r[0] for r in best.select("block").distinct().collect())
    shared.destroy()
    return numbers


def reached_blocks(blocks: DataFrame, matrix: np.ndarray, floor: np.ndarray) -> list[int]:
    """Blocks that may hold, for some query, a vector whose product reaches the query's floor."""
    shared = blocks.sparkSession.sparkContext.broadcast((matrix, floor.astype(np.float64)))

    def step(numbers, centres, radius, queries, floor):
        norm = np.linalg.norm(queries, axis=1)
        most = queries @ centres.T + norm[:, None] * radius
        most += SLACK * norm[:, None] * (np.linalg.norm(centres, axis=1) + radius)
        return pa.RecordBatch.from_arrays([pa.array(numbers[(most >= floor[:, None]).any(axis=0)])], ["block"])

    numbers = sorted(r[0] for r in _over_blocks(blocks, shared, step, "block int").collect())
    shared.destroy()
    return numbers

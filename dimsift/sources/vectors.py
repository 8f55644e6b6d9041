"""Stored vectors with a manifest that says what they are and that they are whole."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import BLOCK_TABLE, block_table, with_blocks
from ..operators.vectors import shape
from ..storage import materialize, spread
from .collections import MODEL_DIMS
from .files import load

MANIFEST = (
    "model string, dims int, dtype string, n_items bigint, min_dims int, max_dims int, "
    "seconds double, written_at string, status string"
)

ROW_GROUP_BYTES = 32 * 1024 * 1024


def corpus_path(root: str, model: str, corpus: str) -> str:
    """Collections over the same corpus share these vectors."""
    return f"{root}/vectors/{model}/corpus/{corpus}"


def query_path(root: str, model: str, collection: str, split: str = "queries") -> str:
    return f"{root}/vectors/{model}/queries/{collection}/{split}"


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest; raises unless the vectors were written to the end."""
    row = load(spark, f"{path}/manifest", "json", MANIFEST).first()
    if row is None or row["status"] != "complete":
        raise RuntimeError(f"vectors at {path} are incomplete")
    return row.asDict()


def is_complete(spark: SparkSession, path: str) -> bool:
    try:
        read_manifest(spark, path)
    except (FileNotFoundError, RuntimeError):
        return False
    return True


def _write_manifest(spark: SparkSession, path: str, **values) -> None:
    row = spark.createDataFrame([values], MANIFEST)
    row.write.mode("overwrite").json(f"{path}/manifest")


def write_vectors(df: DataFrame, path: str, model: str, overwrite: bool = False, blocks: int = 0) -> dict:
    """Write an id column and ``vec``; whole vectors already there are kept unless ``overwrite``.

    Rows are sorted by id, and every row group has a Bloom filter of its ids, so a lookup of some reads
    few of them. With ``blocks``, vectors that lie close together are stored together, in about so many
    folders, and a table of the blocks next to them tells a search which it has to read.
    """
    spark = df.sparkSession
    if not overwrite and is_complete(spark, path):
        return read_manifest(spark, path)
    started = time.time()
    _write_manifest(spark, path, model=model, status="writing")
    key = next(c for c in df.columns if c != "vec")
    df = df.withColumn("vec", F.col("vec").cast("array<float>"))
    order = ["block", key] if blocks else [key]
    parted = False
    if blocks:
        # stored, since the vectors are read to draw blocks, and to sort them by those
        df = with_blocks(materialize(df, "vectors"), key, blocks)
        parted = not df.isEmpty()  # folders of an empty table would not tell its columns
    writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").options(**{
        f"parquet.bloom.filter.enabled#{key}": "true", "parquet.bloom.filter.adaptive.enabled": "true",
        "parquet.block.size": str(ROW_GROUP_BYTES),
    })
    (writer.partitionBy("block") if parted else writer).parquet(f"{path}/data")
    if blocks:
        block_table(spark.read.parquet(f"{path}/data")).write.mode("overwrite").parquet(f"{path}/blocks")
    size = shape(spark.read.parquet(f"{path}/data")).first().asDict()
    expected = MODEL_DIMS.get(model)
    if expected and size["n_items"] and {size["min_dims"], size["max_dims"]} != {expected}:
        raise ValueError(f"{model} vectors have {expected} dimensions, got {size['min_dims']}..{size['max_dims']}")
    _write_manifest(
        spark, path, model=model, dims=size["max_dims"], dtype="float32", status="complete",
        seconds=time.time() - started,
        written_at=datetime.datetime.now(datetime.timezone.utc).isoformat(), **size,
    )
    return read_manifest(spark, path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors; refuses a missing or incomplete table, or one of mixed lengths."""
    manifest = read_manifest(spark, path)
    if manifest["min_dims"] != manifest["max_dims"]:
        raise RuntimeError(f"vectors at {path} differ in length")
    return spread(load(spark, f"{path}/data", "parquet"))


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vectors stored in blocks, with their ``block``, and the table of the blocks, as ``search`` takes them."""
    manifest = read_manifest(spark, path)
    if manifest["min_dims"] != manifest["max_dims"]:
        raise RuntimeError(f"vectors at {path} differ in length")
    return load(spark, f"{path}/data", "parquet"), load(spark, f"{path}/blocks", "parquet", BLOCK_TABLE)


def manifest_of(vectors: DataFrame, model: str) -> DataFrame:
    """The manifest columns that follow from the data."""
    return shape(vectors).withColumn("model", F.lit(model)).withColumn(
        "status", F.when(F.col("min_dims") == F.col("max_dims"), "complete").otherwise("incomplete")
    )

"""Reading delimited text with a fixed schema, and saying plainly when a path is missing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, path: str, format: str, schema=None, **options) -> DataFrame:
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from None
        raise


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job wrote ``path`` to its end."""
    try:
        load(spark, f"{path}/_SUCCESS", "binaryFile")
    except FileNotFoundError:
        return False
    return True

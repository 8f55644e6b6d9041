"""Per-query results, tuning studies and best configurations as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tune import PARAMETERS, best_trial
from ..schemas import RESULT_COLUMNS, RESULTS, SWEEP_RESULTS
from .files import load


def write_results(results: DataFrame, path: str, mode: str = "error") -> None:
    """``query_id, measure, value`` and, for sweeps, ``alpha`` and ``retained_frac``."""
    extra = [c for c in ("alpha", "retained_frac") if c in results.columns]
    results.select(*RESULT_COLUMNS, *extra).write.mode(mode).option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results with whichever of the known columns the file has, found by name."""
    header = load(spark, path, "csv", header=True).columns
    types = {f.name: f.dataType for f in SWEEP_RESULTS.fields}
    raw = load(spark, path, "csv", ", ".join(f"`{c}` string" for c in header), header=True)
    return raw.select(*[F.col(c).cast(types[c]).alias(c) for c in SWEEP_RESULTS.names if c in header])


def write_study(study: DataFrame, path: str, best_path: str, mode: str = "error") -> None:
    """The table of trials, and the best trial with all its parameters."""
    study.write.mode(mode).option("header", True).csv(path)
    read_study(study.sparkSession, path).transform(best_trial).write.mode(mode).json(best_path)


def read_study(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, "csv", PARAMETERS + ", value double", header=True)


def read_best(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, "json", PARAMETERS + ", value double")


__all__ = ["RESULTS", "read_best", "read_results", "read_study", "write_results", "write_study"]

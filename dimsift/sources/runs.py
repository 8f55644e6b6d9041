"""Ranked runs as tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RUN, RUN_COLUMNS, SWEEP_RUN, SWEEP_RUN_COLUMNS
from .files import load

TAB = {"sep": "\t"}


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Six columns, no header; ids stay strings. A missing path raises ``FileNotFoundError``."""
    return load(spark, path, "csv", RUN, **TAB)


def write_run(run: DataFrame, path: str, mode: str = "error") -> None:
    run.select(*RUN_COLUMNS).write.mode(mode).options(**TAB).csv(path)


def write_sweep(run: DataFrame, path: str, mode: str = "error") -> None:
    """All settings of a sweep with a header, one folder per ``alpha``."""
    columns = run.select(*SWEEP_RUN_COLUMNS)
    columns.write.mode(mode).options(header=True, **TAB).partitionBy("alpha").csv(path)


def read_sweep(spark: SparkSession, path: str, alpha: str | None = None) -> DataFrame:
    """A stored sweep; with ``alpha``, only that folder is read, and ``KeyError`` if it is not there."""
    run = load(spark, path, "csv", SWEEP_RUN, header=True, **TAB)
    if alpha is None:
        return run
    found = run.where(F.col("alpha") == alpha)
    if found.isEmpty():
        raise KeyError(alpha)
    return found


def alphas_of(run: DataFrame) -> list[str]:
    """The settings present, numbers in order before labels; a handful of values."""
    labels = [r[0] for r in run.select("alpha").distinct().collect()]

    def place(label: str):
        try:
            return (0, float(label), label)
        except ValueError:
            return (1, 0.0, label)

    return sorted(labels, key=place)

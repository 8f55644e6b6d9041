"""Generated answers, cross-encoder scores and tuning sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CE_SCORES, QRELS, QUERY_TEXT
from .files import load

QUOTED = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# characters that would end a line, and the escape itself, as two characters: a row is a line and files can be split
ESCAPES = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"))


def escaped(text: str) -> Column:
    out = F.col(text)
    for plain, safe in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescaped(text: str) -> Column:
    out = F.col(text)
    for plain, safe in reversed(ESCAPES):
        out = F.replace(out, F.lit(safe), F.lit(plain))
    return out


def first_per_query(answers: DataFrame, order: str) -> DataFrame:
    """The first text per ``query_id``; a hot id is reduced in the map tasks."""
    return answers.groupBy("query_id").agg(F.min_by("text", order).alias("text"))


def write_answers(answers: DataFrame, path: str, mode: str = "error") -> None:
    """One line per answer, which ``read_answers`` undoes."""
    answers.select("query_id", escaped("text").alias("text")).write.mode(mode).options(**QUOTED).csv(path)


def read_answers(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``query_id, text`` from CSV; where an id repeats, the first row of the file wins.

    Rows are lines with escaped line ends, as ``write_answers`` leaves them. ``multi_line`` is for
    files from elsewhere with line ends inside quotes; each of them is read by one task.
    """
    raw = load(spark, path, "csv", QUERY_TEXT, multiLine=multi_line, **QUOTED)
    if not multi_line:
        raw = raw.withColumn("text", unescaped("text"))
    at = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"))
    return first_per_query(raw.withColumn("at", at), "at")


def read_ce_scores(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, doc_id, ce_score`` from tab-separated text without header."""
    return load(spark, path, "csv", CE_SCORES, sep="\t").drop("na")


def write_eval_queries(queries: DataFrame, path: str, mode: str = "error") -> None:
    rows = queries.select("query_id", escaped("text").alias("text"))
    rows.write.mode(mode).options(sep="\t", **QUOTED).csv(path)


def read_eval_queries(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    rows = load(spark, path, "csv", QUERY_TEXT, sep="\t", multiLine=multi_line, **QUOTED)
    return rows if multi_line else rows.withColumn("text", unescaped("text"))


def write_eval_qrels(qrels: DataFrame, path: str, mode: str = "error") -> None:
    qrels.select(*QRELS.names).write.mode(mode).option("header", True).csv(path)


def read_eval_qrels(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, "csv", QRELS, header=True)

"""Named test collections: a corpus, queries and judgments, wherever their files lie."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize

# Embedding sizes per model, and which corpus a public collection searches.
MODEL_DIMS = {"tasb": 768, "contriever": 768, "cocondenser": 768, "ance": 768}
COLLECTION_CORPUS = {"dl19": "msmarco-passage", "dl20": "msmarco-passage", "dlhard": "msmarco-passage"}


@dataclass(frozen=True)
class Table:
    """A stored table: its format, path, read options, and which column is which."""

    path: str
    columns: Mapping[str, str]
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    schema: str | None = None

    def read(self, spark: SparkSession, types: Mapping[str, str]) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        if self.schema:
            reader = reader.schema(self.schema)
        df = reader.load(self.path)
        return df.select(*[
            F.col(self.columns.get(name, name)).cast(kind).alias(name) for name, kind in types.items()
        ])


@dataclass(frozen=True)
class Collection:
    """Collections that name the same ``corpus_name`` share its vectors."""

    name: str
    corpus_name: str
    corpus: Table
    queries: Table
    qrels: Table


def public_collection(name: str, corpus: Table, queries: Table, qrels: Table) -> Collection:
    """One of the collections whose corpus is known; ``KeyError`` for any other."""
    if name not in COLLECTION_CORPUS:
        raise KeyError(f"unknown collection {name!r}; known: {sorted(COLLECTION_CORPUS)}")
    return Collection(name, COLLECTION_CORPUS[name], corpus, queries, qrels)


class Catalog:
    """The collections a session knows; asking for another raises ``KeyError``."""

    def __init__(self, spark: SparkSession, *collections: Collection):
        self.spark = spark
        self.collections = {c.name: c for c in collections}

    def __getitem__(self, name: str) -> Collection:
        if name not in self.collections:
            raise KeyError(f"unknown collection {name!r}; known: {sorted(self.collections)}")
        return self.collections[name]

    def corpus(self, name: str, normalized: bool = True) -> DataFrame:
        """``doc_id, text``; texts are normalised unless told otherwise."""
        df = self[name].corpus.read(self.spark, {"doc_id": "string", "text": "string"})
        return df.withColumn("text", normalize("text")) if normalized else df

    def queries(self, name: str, normalized: bool = False) -> DataFrame:
        """``query_id, text``; texts stay raw unless told otherwise."""
        df = self[name].queries.read(self.spark, {"query_id": "string", "text": "string"})
        return df.withColumn("text", normalize("text")) if normalized else df

    def qrels(self, name: str) -> DataFrame:
        return self[name].qrels.read(
            self.spark, {"query_id": "string", "doc_id": "string", "relevance": "int"}
        )

    def all(self, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.corpus(name), self.queries(name), self.qrels(name)

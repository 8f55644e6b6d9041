"""The offline part: encode a collection, search it, keep what is already there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.encode import TEXT_BATCH, encode_text
from ..operators.search import DEFAULT_K, search
from ..sources import collections, runs, vectors
from ..sources.files import finished


def run_path(root: str, collection: str, model: str) -> str:
    return f"{root}/runs/{collection}/{model}"


def build(
    spark: SparkSession,
    catalog: collections.Catalog,
    collection: str,
    model: str,
    load_model: Callable[[], Callable],
    root: str,
    overwrite: bool = False,
    skip_corpus: bool = False,
    skip_queries: bool = False,
    batch_size: int = TEXT_BATCH,
) -> None:
    """Encode corpus and queries; a finished stage is not repeated unless ``overwrite``."""
    if not skip_corpus:
        path = vectors.corpus_path(root, model, catalog[collection].corpus_name)
        if overwrite or not vectors.is_complete(spark, path):
            encoded = encode_text(catalog.corpus(collection), load_model, batch_size)
            vectors.write_vectors(encoded, path, model, overwrite)
    if not skip_queries:
        path = vectors.query_path(root, model, collection)
        if overwrite or not vectors.is_complete(spark, path):
            encoded = encode_text(catalog.queries(collection), load_model, batch_size)
            vectors.write_vectors(encoded, path, model, overwrite)


def search_collection(
    spark: SparkSession,
    catalog: collections.Catalog,
    collection: str,
    model: str,
    root: str,
    k: int = DEFAULT_K,
    overwrite: bool = False,
) -> DataFrame:
    """The stored baseline run of a built collection, searched now if it is not there."""
    path = run_path(root, collection, model)
    if overwrite or not finished(spark, path):
        docs = vectors.read_vectors(
            spark, vectors.corpus_path(root, model, catalog[collection].corpus_name)
        )
        queries = vectors.read_vectors(spark, vectors.query_path(root, model, collection))
        runs.write_run(search(docs, queries, k, model), path, "overwrite")
    return runs.read_run(spark, path)


def build_eval_run(
    spark: SparkSession,
    eval_queries: DataFrame,
    docs: DataFrame,
    model: str,
    load_model: Callable[[], Callable],
    root: str,
    collection: str,
    split: str = "tune_queries",
    k: int = DEFAULT_K,
    overwrite: bool = False,
) -> DataFrame:
    """Encode tuning queries into a split of their own and search the corpus with them."""
    path = f"{root}/tune/runs/{model}"
    if overwrite or not finished(spark, path):
        queries = vectors.query_path(root, model, collection, split)
        vectors.write_vectors(encode_text(eval_queries, load_model), queries, model, overwrite)
        found = search(docs, vectors.read_vectors(spark, queries), k, model)
        runs.write_run(found, path, "overwrite")
    return runs.read_run(spark, path)

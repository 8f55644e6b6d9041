"""Registered queries: each runs one operator over the given tables, whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimsift.functions.text import normalize
from dimsift.operators import evaluate as ev
from dimsift.operators import importance as imp
from dimsift.operators import numbering, report, select, tune
from dimsift.operators import vectors as vec
from dimsift.operators.encode import encode_text, hash_model, hash_vectors
from dimsift.operators.search import Limits, search, top_document
from dimsift.plans import build, retrieve
from dimsift.sources import feedback, results as result_files, runs, vectors as vector_files
from dimsift.sources.collections import Catalog, Collection, Table
from dimsift.storage import shared_folder, spread

from .oracle import INJECTED, MEASURE_QUERIES, SAMPLE_SEED, SAMPLE_SIZE
from .tables import COLLECTIONS, DEPTH, FILTERS, MEASURES, MODEL, Tables

P, D = COLLECTIONS
TRIALS = tune.grid_trials(
    k=(2, 5), kneg=(2, 5), lambda_pos=(1.0,), lambda_neg=(0.1, 0.5), alpha=(0.2, 0.6, 1.0)
)
RANDOM_TRIALS = tune.random_trials(["k", "kneg", "lambda_pos", "lambda_neg", "alpha"], 10)
# Small enough that queries are searched in several blocks.
TIGHT = Limits(broadcast_bytes=16_000)

BLOCKS = 16  # folders that the given vectors are stored in

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[Tables], DataFrame]):
    QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
    return make


def _scores(run: DataFrame, *extra: str) -> DataFrame:
    return run.select("query_id", *extra, "doc_id", "rank", F.round("score", 6).alias("score"))


def _importance(frame: DataFrame) -> DataFrame:
    return imp.to_long(frame).select("query_id", "dim", F.round("importance", 9).alias("importance"))


def _weights(frame: DataFrame) -> DataFrame:
    return select.weights_long(frame).withColumn("weight", F.col("weight").cast("double"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _new_path(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _prf(t: Tables, collection: str = P) -> DataFrame:
    return t.prf(collection)(t.queries(collection))


# text and vectors


@query
def text_normalize(t):
    # the given texts hold none of the characters in question, so all are put in first
    dirty = "".join(f"a{chr(c)}b" for c in INJECTED)
    return t.doc_texts(P).select("doc_id", normalize(F.concat("text", F.lit(dirty), F.lit(" . . . "))).alias("text"))


def _catalog(t: Tables) -> Catalog:
    queries = Table(f"{t.sf_dir}/benchmark.parquet", {"query_id": "item_id"})
    documents = Table(f"{t.sf_dir}/documents.parquet", {})
    # the labels judge documents, not pairs, so every label stands as its own query here
    qrels = Table(f"{t.sf_dir}/labels.parquet", {"query_id": "doc_id", "relevance": "quality"})
    return Catalog(t.spark, Collection(P, "documents", documents, queries, qrels))


@query
def collection_corpus(t):
    return _catalog(t).corpus(P)


@query
def collection_queries(t):
    return _catalog(t).queries(P)


@query
def collection_qrels(t):
    return _catalog(t).qrels(P)


@query
def doc_offsets(t):
    return numbering.dense_offsets(t.doc_texts(P).select("doc_id"), ["doc_id"])


@query
def query_offsets(t):
    queries = t.query_texts(P).select("query_id")
    return numbering.dense_offsets(queries, [F.col("query_id").cast("long")])


@query
def hash_encode(t):
    return vec.exploded(hash_vectors(spread(t.doc_texts(P)), "doc_id"), "doc_id")


@query
def query_encode(t):
    return vec.exploded(encode_text(spread(t.query_texts(D)), hash_model()), "query_id")


def _wanted(t: Tables) -> DataFrame:
    return t.raw("labels").select(F.col("doc_id").cast("string"))


@query
def vector_lookup(t):
    return _rounded(vec.exploded(vec.lookup(t.embeddings(), _wanted(t)), "doc_id"), "value")


@query
def missing_ids(t):
    return vec.missing_ids(t.embeddings(), _wanted(t))


@query
def centroid(t):
    return _rounded(vec.centroid(t.embeddings()), "value")


@query
def l2_normalize(t):
    return _rounded(vec.exploded(vec.normalized(t.embeddings()), "doc_id"), "value")


@query
def l2_normalize_subset(t):
    return _rounded(vec.exploded(vec.normalized(t.embeddings(), _wanted(t)), "doc_id"), "value")


@query
def vector_manifest(t):
    return vector_files.manifest_of(t.embeddings(), "embeddings")


# search


@query
def baseline_topk(t):
    return _scores(search(t.docs(P), t.queries(P), DEPTH, MODEL))


@query
def baseline_topk_blocks(t):
    return _scores(search(t.docs(P), t.queries(P), DEPTH, MODEL, limits=TIGHT))


def _embeddings_topk(t: Tables, docs: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    # the given vectors, whose sums are not exact in any order: compared to five places
    queries = t.embeddings().join(_wanted(t).distinct(), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    return search(docs, queries, DEPTH, MODEL, blocks=blocks).select(
        "query_id", "doc_id", "rank", (F.round("score", 5) + 0.0).alias("score")
    )


@query
def embeddings_topk(t):
    return _embeddings_topk(t, t.embeddings())


@query
def dialogue_topk(t):
    return _scores(search(t.docs(D), t.queries(D), DEPTH, MODEL))


@query
def top1(t):
    return _rounded(top_document(t.docs(P), t.queries(P)), "score")


# importance and selection


@query
def prf_importance(t):
    return _importance(_prf(t))


@query
def eclipse_importance(t):
    return _importance(t.eclipse(P)(t.queries(P)))


@query
def oracular_importance(t):
    return _importance(t.oracular(P)(t.queries(P)))


@query
def answer_importance(t):
    return _importance(t.answer_filter()(t.texts_and_vectors(D)))


@query
def importance_ranked(t):
    return imp.to_long(_prf(t)).withColumn("importance", F.round("importance", 9))


@query
def importance_subset(t):
    return _importance(imp.subset(_prf(t), t.qrels(P).where("relevance = 3")))


@query
def top_alpha_mask(t):
    return _weights(select.TopAlpha().weights(_prf(t)))


@query
def top_k_mask(t):
    frame = select.top_k_weights(_prf(t), 10).withColumn("alpha", F.lit("k10"))
    return _weights(frame).drop("alpha")


@query
def rdime_mask(t):
    return _weights(select.NoiseThreshold().weights(_prf(t)))


@query
def retained_frac(t):
    return select.retained(select.NoiseThreshold().weights(_prf(t)))


@query
def mean_retained(t):
    return _rounded(select.mean_retained(retained_frac(t)), "retained_frac")


# masked search


@query
def masked_search(t):
    return _scores(t.sweep(P, alphas=[0.5]).run(0.5), "alpha")


@query
def alpha_sweep(t):
    return _scores(t.sweep(P).run_table, "alpha")


@query
def alpha_sweep_blocks(t):
    masked = select.apply_weights(select.TopAlpha().weights(_prf(t))).select("query_id", "alpha", "vec")
    found = search(t.docs(P), masked, DEPTH, MODEL, ["query_id", "alpha"], Limits(broadcast_bytes=64_000))
    return _scores(found, "alpha")


class SoftWeights:
    """Importance scaled to [0, 1] per query, on a grid of sixteenths."""

    tag = "soft"

    def weights(self, importance, alphas=None):
        low, high = F.array_min("importance"), F.array_max("importance")
        scaled = F.transform(
            "importance", lambda u: F.floor(F.when(high > low, (u - low) / (high - low)).otherwise(1.0) * 16) / 16
        )
        return importance.select(
            "query_id", F.lit(self.tag).alias("alpha"), F.lit(None).cast("double").alias("alpha_value"), "vec", scaled.alias("weights")
        )


@query
def soft_weight_search(t):
    return _scores(t.sweep(P, selector=SoftWeights()).run_table, "alpha")


@query
def rdime_search(t):
    return _scores(t.sweep(P, selector="rdime").run_table, "alpha")


@query
def eclipse_sweep(t):
    return _scores(t.sweep(P, "prf-k2-eclipse").run_table, "alpha")


@query
def dialogue_answer_sweep(t):
    found = retrieve.sweep(
        t.texts_and_vectors(D), t.docs(D), t.answer_filter(), k=DEPTH, model=MODEL
    )
    return _scores(found.run_table, "alpha")


# evaluation


def _evaluate_one(measure: str, name: str) -> None:
    def make(t):
        return _rounded(ev.evaluate(t.run(D), t.qrels(D), [measure], depth=DEPTH), "value")

    make.__name__ = name
    query(make)


for _measure, _name in MEASURE_QUERIES.items():
    _evaluate_one(_measure, _name)


@query
def eval_all(t):
    return _rounded(ev.evaluate(t.run(P), t.qrels(P), MEASURES, depth=DEPTH), "value")


@query
def eval_depth_levels(t):
    measures = ("AP(rel=3)", "R(rel=3)@20", "RR(rel=3)")
    return _rounded(ev.evaluate(t.run(P), t.qrels(P), measures), "value")


@query
def eval_summary(t):
    return _rounded(ev.summary(ev.evaluate(t.run(P), t.qrels(P), MEASURES, depth=DEPTH)), "mean")


@query
def sweep_eval(t):
    return _rounded(t.sweep(P).evaluate(t.qrels(P), MEASURES).metrics, "value")


@query
def sweep_summary(t):
    return _rounded(t.sweep(P).evaluate(t.qrels(P), MEASURES).summary(), "mean")


@query
def sweep_summary_table(t):
    table = t.sweep(P).evaluate(t.qrels(P), MEASURES).summary_table(MEASURES)
    return table.select("alpha", *[F.round(F.col(f"`{m}`"), 6).alias(m) for m in MEASURES])


@query
def results_with_retained(t):
    return _rounded(t.sweep(D, selector="rdime").evaluate(t.qrels(D), MEASURES).results(), "value")


@query
def eval_repeated_docs(t):
    # every document listed and judged a second time, lower
    run = t.run(P).select("query_id", "doc_id", "score")
    qrels = t.qrels(P)
    again = run.withColumn("score", F.col("score") - 0.125)
    judged = qrels.unionByName(qrels.withColumn("relevance", F.greatest(F.col("relevance") - 1, F.lit(0))))
    return _rounded(ev.evaluate(run.unionByName(again), judged, MEASURES), "value")


@query
def eval_deep_run(t):
    """The depth and the recall measure that are used unless told otherwise."""
    run = retrieve.baseline(t.docs(P), t.queries(P), model=MODEL)
    return _rounded(ev.evaluate(run, t.qrels(P), ["R@1000"]), "value")


@query
def sweep_per_query(t):
    return _rounded(t.sweep(P, alphas=[0.5]).evaluate(t.qrels(P), MEASURES).per_query(0.5), "value")


@query
def sweep_mean(t):
    measured = t.sweep(P, alphas=[0.5]).evaluate(t.qrels(P), MEASURES)
    rows = [(m, round(measured.mean(0.5, m), 6)) for m in MEASURES]
    return t.spark.createDataFrame(rows, "measure string, mean double")


def _sanity_input(t: Tables):
    masked = t.run(P).withColumn("model", F.lit(f"{MODEL}__prf-k2__rdime"))
    every = t.run(P).withColumn("model", F.lit(MODEL)).unionByName(masked)
    # only the best grade, so that some queries have no judgment
    judged = t.qrels(P).where("relevance = 3")
    return every.withColumn("collection", F.lit(P)), judged.withColumn("collection", F.lit(P))


@query
def run_sanity(t):
    return ev.run_sanity(*_sanity_input(t))


@query
def unjudged_queries(t):
    return ev.unjudged_queries(*_sanity_input(t))


# tuning


@query
def graded_qrels(t):
    return t.qrels(D)


@query
def eval_sample(t):
    return tune.sample_queries(t.ce_scores(D), SAMPLE_SIZE, SAMPLE_SEED)


@query
def eval_run(t):
    sample = tune.sample_queries(t.ce_scores(D), SAMPLE_SIZE, SAMPLE_SEED)
    queries = encode_text(tune.eval_queries(sample, t.query_texts(D)), hash_model())
    return _scores(search(t.docs(D), queries, DEPTH, MODEL))


def _study(t: Tables, trials=TRIALS) -> DataFrame:
    study = tune.run_trials(t.queries(P), trials, t.run(P), t.docs(P), t.qrels(P))
    return _rounded(study, "value")


@query
def trial_grid(t):
    return _study(t)


@query
def trial_random(t):
    return _study(t, RANDOM_TRIALS)


@query
def best_trial(t):
    return tune.best_trial(_study(t))


# reports


@query
def baseline_means(t):
    return _rounded(report.baseline_means(t.results(), COLLECTIONS, [MODEL], MEASURES), "mean")


@query
def sweep_means(t):
    return _rounded(report.sweep_means(t.results()), "mean")


@query
def retained_means(t):
    return _rounded(report.retained_means(t.results()), "retained_frac")


def _round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.round(F.col(f"`{c}`"), 6).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes
    ])


@query
def report_performance(t):
    return _round_doubles(
        report.performance(t.results(), [MODEL], COLLECTIONS, FILTERS, "top-alpha", 0.8, MEASURES)
    )


@query
def report_comparison(t):
    return _round_doubles(report.comparison(t.results(), [MODEL], COLLECTIONS, FILTERS))


@query
def report_sweep(t):
    return _round_doubles(report.sweep(t.results(), [MODEL], COLLECTIONS, FILTERS))


@query
def report_retained(t):
    return _round_doubles(report.retained(t.results(), [MODEL], COLLECTIONS, FILTERS))


@query
def delta_pct(t):
    base = report.baseline_means(t.results(), COLLECTIONS, [MODEL], MEASURES).withColumnRenamed("mean", "ref")
    joined = report.sweep_means(t.results()).join(base, ["collection", "model", "measure"])
    changed = joined.withColumn("delta_pct", report.delta_pct(F.col("mean"), F.col("ref")))
    # adding zero turns a rounded -0.0 into 0.0
    return _rounded(changed.drop("mean", "ref"), "delta_pct").withColumn("delta_pct", F.col("delta_pct") + 0.0)


# written and read back


@query
def build_and_search(t):
    """Encode, skip what is there, encode again on demand, search, and take the stored run the second time."""
    root = _new_path(t, "build")
    catalog = _catalog(t)
    for overwrite in (False, False, True):
        build.build(t.spark, catalog, P, MODEL, hash_model(), root, overwrite)
    build.search_collection(t.spark, catalog, P, MODEL, root, DEPTH)
    return _scores(build.search_collection(t.spark, catalog, P, MODEL, root, DEPTH))


@query
def run_file(t):
    path = _new_path(t, "run")
    runs.write_run(t.run(P), path)
    return _scores(runs.read_run(t.spark, path))


@query
def sweep_files(t):
    path = _new_path(t, "sweep")
    t.sweep(P).save(path)
    return _scores(retrieve.Sweep.load(t.spark, path).run_table, "alpha")


@query
def results_file(t):
    path = _new_path(t, "results")
    t.sweep(D, selector="rdime").evaluate(t.qrels(D), MEASURES).save_results(path)
    return _rounded(result_files.read_results(t.spark, path), "value")


@query
def vector_files_(t):
    path = _new_path(t, "vectors")
    vector_files.write_vectors(t.queries(D), path, MODEL)
    return vec.exploded(vector_files.read_vectors(t.spark, path), "query_id")


QUERIES["vector_files"] = QUERIES.pop("vector_files_")


def _stored_embeddings(t: Tables, **how) -> str:
    path = _new_path(t, "vectors")
    vector_files.write_vectors(t.embeddings(), path, "embeddings", **how)
    return path


@query
def stored_vector_lookup(t):
    # from files sorted by id, to whose scan the ids go
    found = vec.lookup(vector_files.read_vectors(t.spark, _stored_embeddings(t)), _wanted(t))
    return _rounded(vec.exploded(found, "doc_id"), "value")


@query
def embeddings_topk_in_blocks(t):
    docs, blocks = vector_files.read_blocks(t.spark, _stored_embeddings(t, blocks=BLOCKS))
    return _embeddings_topk(t, docs, blocks)


@query
def conversation_answers(t):
    turns = t.raw("conversations").where(F.col("role") == "assistant")
    return feedback.first_per_query(
        turns.select(F.col("conv_id").cast("string").alias("query_id"), "turn", "text"), "turn"
    )


@query
def answers_file(t):
    path = _new_path(t, "answers")
    turns = t.raw("conversations").where(F.col("role") == "assistant")
    rows = turns.orderBy("conv_id", "turn").select(F.col("conv_id").cast("string").alias("query_id"), "text")
    feedback.write_answers(rows, path)
    return feedback.read_answers(t.spark, path)


@query
def ce_scores_file(t):
    path = _new_path(t, "ce")
    rows = t.ce_scores(D).select("query_id", F.lit("0").alias("na"), "doc_id", "ce_score")
    rows.write.option("sep", "\t").csv(path)
    return _rounded(feedback.read_ce_scores(t.spark, path), "ce_score").withColumn(
        "ce_score", F.col("ce_score") + 0.0
    )


@query
def eval_set_files(t):
    queries, qrels = tune.eval_set(t.ce_scores(D), t.query_texts(D), SAMPLE_SIZE, SAMPLE_SEED)
    query_path, qrel_path = _new_path(t, "eval-queries"), _new_path(t, "eval-qrels")
    feedback.write_eval_queries(queries, query_path)
    feedback.write_eval_qrels(qrels, qrel_path)
    back = feedback.read_eval_qrels(t.spark, qrel_path)
    return back.join(feedback.read_eval_queries(t.spark, query_path).select("query_id"), "query_id", "left_semi")


@query
def study_files(t):
    path, best = _new_path(t, "study"), _new_path(t, "best")
    result_files.write_study(_study(t), path, best)
    return result_files.read_best(t.spark, best)

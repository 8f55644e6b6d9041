"""Hyperparameter search as a table of trials.

All trials of a study run in one plan: a trial is one more key column, the feedback means are
shared between trials that use the same depth, and the corpus is read once for the whole study.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..storage import materialize
from .evaluate import evaluate
from .importance import combined, interaction
from .search import search_distinct
from .select import Selector, TopAlpha, apply_weights, selector
from .vectors import mean_vectors

# Fixed values of a study.
SAMPLE_SIZE = 500
SEED = 42
MEASURE = "nDCG@100"
DEPTH = 100
N_TRIALS = 50
SPACE = {
    "k": (2, 20),
    "kneg": (2, 20),
    "lambda_pos": (0.5, 2.0),
    "lambda_neg": (0.1, 1.0),
    "alpha": (0.1, 1.0),
}
GRADE_BOUNDS = (0.0, 0.25, 0.75)

PARAMETERS = "trial_id int, k int, kneg int, lambda_pos double, lambda_neg double, alpha double"


def sample_queries(scores: DataFrame, n: int = SAMPLE_SIZE, seed: int = SEED) -> DataFrame:
    """``n`` distinct query ids in id order; the same ones for the same seed, however the table is split."""
    ids = scores.select("query_id").distinct()
    drawn = ids.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "query_id")), "query_id").limit(n)
    return drawn.orderBy("query_id")


def eval_queries(sample: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of the sampled queries; a sampled id without a text drops out here, not from the judgments."""
    return texts.select("query_id", "text").join(F.broadcast(sample), "query_id", "left_semi")


def graded_qrels(scores: DataFrame) -> DataFrame:
    """Four grades from real-valued scores; a bound belongs to the grade below it."""
    low, middle, high = GRADE_BOUNDS
    score = F.col("ce_score")
    grade = F.when(score <= low, 0).when(score <= middle, 1).when(score <= high, 2).otherwise(3)
    return scores.select("query_id", "doc_id", grade.cast("int").alias("relevance"))


def eval_set(scores: DataFrame, texts: DataFrame, n: int = SAMPLE_SIZE, seed: int = SEED):
    """Queries and judgments of a tuning study."""
    sample = sample_queries(scores, n, seed)
    # the sample has n rows, a parameter
    kept = scores.join(F.broadcast(sample), "query_id", "left_semi")
    return eval_queries(sample, texts), graded_qrels(kept)


def grid_trials(**values: Sequence[float]) -> list[dict]:
    """Every combination of the given parameter values, numbered from 0."""
    combos = product(*values.values())
    return [{"trial_id": i, **dict(zip(values, combo))} for i, combo in enumerate(combos)]


def random_trials(names: Sequence[str], n: int = N_TRIALS, seed: int = SEED) -> list[dict]:
    """``n`` independent draws; depths are integers, alpha a multiple of 0.1."""
    draw = random.Random(seed)
    trials = []
    for i in range(n):
        trial: dict = {"trial_id": i}
        for name in names:
            low, high = SPACE[name]
            if name == "alpha":
                trial[name] = draw.randint(round(low * 10), round(high * 10)) / 10
            elif isinstance(low, int):
                trial[name] = draw.randint(low, high)
            else:
                trial[name] = draw.uniform(low, high)
        trials.append(trial)
    return trials


def _settings(trials: Sequence[Mapping]):
    types = dict(field.split() for field in PARAMETERS.split(", "))
    return F.array(*[
        F.struct(*[F.lit(t.get(name)).cast(kind).alias(name) for name, kind in types.items()]) for t in trials
    ])


def _depths(trials: Sequence[Mapping], name: str) -> list[int]:
    return sorted({t[name] for t in trials if t.get(name) is not None})


def _feedback(places: DataFrame, place: str, depths: list[int], part: str) -> DataFrame:
    """``query_id, part, depth, doc_id``: the first documents of every query, for each depth."""
    wanted = F.filter(F.array(*map(F.lit, depths)), lambda depth: F.col(place) < depth)
    return places.where(F.col(place) < max(depths)).select(
        "query_id", F.lit(part).alias("part"), F.explode(wanted).alias("depth"), "doc_id"
    )


def _means(stored: DataFrame, part: str, depth: str) -> DataFrame:
    """The means of one part, ready to be joined on the trial's own depth."""
    return stored.where(F.col("part") == part).select(
        "query_id", F.col("depth").alias(depth), F.col("mean").alias(part)
    )


def trial_importance(
    queries: DataFrame,
    trials: Sequence[Mapping],
    run: DataFrame,
    vectors: DataFrame,
    base: DataFrame | None = None,
) -> DataFrame:
    """``trial_id, query_id, vec, importance`` and the trial's parameters.

    A trial takes the importance of ``base`` if given, else of the best ``k`` documents; with a
    ``kneg`` it subtracts negative feedback.
    """
    keyed = queries.select("query_id", "vec", F.inline(_settings(trials)))
    depths, worst_depths = _depths(trials, "k"), _depths(trials, "kneg")
    members = []
    if base is None:
        members.append(_feedback(run, "rank", depths, "positive"))
    if worst_depths:
        worst = Window.partitionBy("query_id").orderBy(F.col("rank").desc())
        bottom = run.withColumn("place", F.row_number().over(worst)).where(F.col("place") <= max(worst_depths))
        members.append(_feedback(bottom.withColumn("from_end", F.col("place") - 1), "from_end", worst_depths, "negative"))
    if members:
        # all depths of both kinds from one pass over the vectors; read once per kind below
        every = reduce(DataFrame.unionByName, members)
        means = materialize(mean_vectors(every, vectors, ["query_id", "part", "depth"]), "means")
    if base is None:
        keyed = keyed.join(_means(means, "positive", "k"), ["query_id", "k"], "left")
        keyed = keyed.withColumn("importance", interaction("positive")).drop("positive")
    else:
        keyed = keyed.join(base.select("query_id", "importance"), "query_id")
    if worst_depths:
        lambdas = F.coalesce("lambda_pos", F.lit(1.0)), F.coalesce("lambda_neg", F.lit(0.5))
        both = combined(F.col("importance"), interaction("negative"), *lambdas)
        keyed = keyed.join(_means(means, "negative", "kneg"), ["query_id", "kneg"], "left")
        keyed = keyed.withColumn(
            "importance", F.when(F.col("kneg").isNull(), F.col("importance")).otherwise(both)
        ).drop("negative")
    return keyed


def run_trials(
    queries: DataFrame,
    trials: Sequence[Mapping],
    run: DataFrame,
    vectors: DataFrame,
    qrels: DataFrame,
    chosen: str | Selector = "top-alpha",
    base: DataFrame | None = None,
    depth: int = DEPTH,
    measure: str = MEASURE,
) -> DataFrame:
    """``trial_id``, its parameters and ``value``, the mean of ``measure`` over the judged queries."""
    chosen = selector(chosen)
    keyed = trial_importance(queries, trials, run, vectors, base)
    if isinstance(chosen, TopAlpha):  # the fraction is the trial's own
        k = arrays.alpha_to_k(F.col("alpha"), F.size("importance"))
        weights = arrays.top_k_weights(arrays.dim_ranks("importance"), k)
        weighted = keyed.select("trial_id", "query_id", "vec", weights.alias("weights"))
    else:
        # a selector knows queries, not trials: to it, every pair of both is a query
        pair = F.to_json(F.struct("trial_id", "query_id"))
        parts = F.from_json("query_id", "trial_id int, query_id string")
        weighted = chosen.weights(keyed.select(pair.alias("query_id"), "vec", "importance"))
        weighted = weighted.withColumn("_pair", parts).select(
            F.col("_pair.trial_id").alias("trial_id"), F.col("_pair.query_id").alias("query_id"), "vec", "weights"
        )
    masked = apply_weights(weighted)
    keys = ["trial_id", "query_id"]
    found = search_distinct(vectors, masked, depth, "trial", keys)
    settings = [{"trial_id": t["trial_id"]} for t in trials]
    results = evaluate(found, qrels, [measure], ["trial_id"], settings, depth)
    means = results.groupBy("trial_id").agg(F.avg("value").alias("value"))
    spark = queries.sparkSession
    names = [field.split()[0] for field in PARAMETERS.split(", ")]
    table = spark.createDataFrame([tuple(t.get(n) for n in names) for t in trials], PARAMETERS)
    return table.join(means, "trial_id")


def best_trial(study: DataFrame) -> DataFrame:
    """The trial with the largest value, the earliest on ties, with all its parameters."""
    return study.orderBy(F.col("value").desc(), "trial_id").limit(1)

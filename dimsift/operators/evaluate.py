"""Effectiveness of runs against relevance judgments.

Every judged query counts, with 0 where the run has nothing for it. The ranking is taken from
``score`` (ties: larger ``doc_id`` first), not from the ``rank`` column; unjudged documents are
not relevant. A document listed or judged several times counts once, with its best score or grade, so
no measure exceeds 1. Several runs are measured in one job by naming their setting columns in ``by``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..storage import JOINED_BYTES, broadcast_if_small, materialize
from .numbering import places_in_group, running_sums
from .search import NUMBER, rows_of

# What is measured unless told otherwise.
DEFAULT_MEASURES = ("nDCG@10", "AP", "R@1000", "RR@10")

# A query with more run rows than this is numbered in parts, by range partitions; to the same numbers.
ONE_TASK_ROWS = 2_000_000
# Relevant documents of a query that go next to each list of what it found; with more, the lists are taken apart.
LISTED_JUDGMENTS = 1000


@dataclass(frozen=True)
class Measure:
    name: str
    kind: str
    cutoff: int | None
    relevance: int = 1

    @property
    def column(self) -> str:
        return f"m_{self.kind}_{self.relevance}_{self.cutoff or 'all'}"


def parse_measure(text: str) -> Measure:
    """Read ``nDCG@10``, ``AP``, ``AP(rel=2)``, ``R@1000`` or ``RR@10``."""
    found = re.fullmatch(r"(nDCG|AP|RR|R)(?:\(rel=(\d+)\))?(?:@(\d+))?", text)
    if not found or (found[1] == "R" and not found[3]):
        raise ValueError(f"unknown measure {text!r}")
    return Measure(text, found[1], int(found[3]) if found[3] else None, int(found[2] or 1))


def _within(place: str, cutoff: int | None) -> Column:
    return F.lit(True) if cutoff is None else F.col(place) <= cutoff


def _gain(place: str) -> Column:
    return F.col("relevance") / F.log2(F.col(place) + 1)


def _largest_group(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _placed(df: DataFrame, keys: list[str], order: list[Column], into: str, limit: int | None) -> DataFrame:
    """Number the rows of each key from 1, up to ``limit`` if there is one.

    With a limit, Spark drops the rest of a group before the shuffle. Without one, groups larger
    than ``ONE_TASK_ROWS`` are numbered in parts, by ranges.
    """
    if (_largest_group(df, keys) if limit is None else limit) > ONE_TASK_ROWS:
        placed = places_in_group(df, keys, order, into)
    else:
        placed = df.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed if limit is None else placed.where(F.col(into) <= limit)


def _deepest(measures: Sequence[Measure]) -> int | None:
    cutoffs = [m.cutoff for m in measures]
    return None if None in cutoffs else max(cutoffs)


def _ideal(qrels: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Per judged query: relevant documents per threshold, and the best possible gain per cutoff."""
    levels = sorted({m.relevance for m in measures})
    counts = qrels.groupBy("query_id").agg(*[
        F.sum(F.when(F.col("relevance") >= level, 1).otherwise(0)).alias(f"n_rel_{level}") for level in levels
    ])
    graded = [m for m in measures if m.kind == "nDCG"]
    if not graded:
        return counts
    relevant = qrels.where("relevance > 0").select("query_id", "relevance")
    ranked = _placed(relevant, ["query_id"], [F.col("relevance").desc()], "ideal", _deepest(graded))
    gains = ranked.groupBy("query_id").agg(*[
        F.sum(F.when(_within("ideal", c), _gain("ideal"))).alias(f"idcg_{c or 'all'}")
        for c in sorted({m.cutoff for m in graded}, key=str)
    ])
    return counts.join(gains, "query_id", "left")


def _listed(qrels: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """``_ideal``, and a map ``_judged`` of the relevant documents, from judgments that are few per query: one row each, stored."""
    relevant = F.col("relevance") > 0
    levels = sorted({m.relevance for m in measures})
    lists = qrels.groupBy("query_id").agg(
        *[F.sum(F.when(F.col("relevance") >= level, 1).otherwise(0)).alias(f"n_rel_{level}") for level in levels],
        F.map_from_entries(F.collect_list(F.when(relevant, F.struct("doc_id", "relevance")))).alias("_judged"),
    )
    best = F.sort_array(F.map_values("_judged"), asc=False)

    def ideal(cutoff: int | None) -> Column:
        first = best if cutoff is None else F.slice(best, 1, cutoff)
        gains = F.transform(first, lambda grade, at: grade / F.log2(at + 2))
        return F.when(F.size("_judged") > 0, F.aggregate(gains, F.lit(0.0), lambda total, gain: total + gain))

    cutoffs = sorted({m.cutoff for m in measures if m.kind == "nDCG"}, key=str)
    return materialize(lists.select("*", *[ideal(c).alias(f"idcg_{c or 'all'}") for c in cutoffs]), "judged")


def _hits(run: DataFrame, relevant: DataFrame, keys: list[str], levels: list[int], deepest: int | None, depth: int | None) -> DataFrame:
    """The relevant documents of the run: place, relevance, and how many of each level are at or above it."""
    order = [F.col("score").desc(), F.col("doc_id").desc()]
    found = {f"found_{level}": (F.col("relevance") >= level) for level in levels}
    if min(n for n in (deepest, depth) if n is not None) > ONE_TASK_ROWS:
        # a key's rows do not fit one task: places and counts are summed up in parts
        judged = run.join(relevant, ["query_id", "doc_id"], "left")
        counted = {n: F.coalesce(c, F.lit(False)).cast("int") for n, c in found.items()}
        hits = running_sums(judged, keys, order, {"place": F.lit(1), **counted}).where("relevance > 0")
        return hits if deepest is None else hits.where(F.col("place") <= deepest)
    placed = run.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    placed = placed if deepest is None else placed.where(F.col("place") <= deepest)
    hits = placed.join(relevant, ["query_id", "doc_id"])
    in_order = Window.partitionBy(*keys).orderBy("place")
    return hits.withColumns({n: F.sum(c.cast("int")).over(in_order) for n, c in found.items()})


def _hits_of_lists(
    lists: DataFrame, judged: DataFrame, keys: list[str], levels: list[int], deepest: int | None, pairs: DataFrame | None
) -> DataFrame:
    """``_hits`` of a run that is stored as a list per query, or vector: a list meets the query's judgments, and only hits become rows."""
    judged = judged.select("query_id", "_judged").where(F.size("_judged") > 0)
    # scores stay where they are
    lists = lists.select(*[c for c in keys if c in lists.columns], F.col("found.doc_id").alias("_ids"), F.col("found.place").alias("_places"))
    if pairs is None:
        met = lists.join(broadcast_if_small(judged, JOINED_BYTES), "query_id")
    else:
        # the judgments go to the vectors, since a vector's list is longer
        met = lists.join(pairs.join(broadcast_if_small(judged, JOINED_BYTES), "query_id"), NUMBER)
    ids, places = F.col("_ids"), F.col("_places")
    both = F.array_intersect(ids, F.map_keys("_judged"))

    def hit(ids: Column, places: Column, one: Column) -> Column:
        place = F.element_at(places, F.array_position(ids, one).cast("int"))
        return F.struct(place.alias("place"), F.element_at(F.col("_judged"), one).alias("relevance"))

    rows = bind(ids, lambda i: bind(places, lambda p: F.transform(both, lambda one: hit(i, p, one))))
    hits = met.select(*keys, F.inline(rows))
    hits = hits if deepest is None else hits.where(F.col("place") <= deepest)
    in_order = Window.partitionBy(*keys).orderBy("place")
    found = {f"found_{level}": F.sum((F.col("relevance") >= level).cast("int")).over(in_order) for level in levels}
    return hits.withColumns(found)


def _score(m: Measure) -> Column:
    """The measure's sum over the relevant documents found."""
    counted = (F.col("relevance") >= m.relevance) & _within("place", m.cutoff)
    if m.kind == "nDCG":
        return F.sum(F.when(_within("place", m.cutoff), _gain("place")))
    if m.kind == "AP":
        return F.sum(F.when(counted, F.col(f"found_{m.relevance}") / F.col("place")))
    if m.kind == "R":
        return F.sum(F.when(counted, 1.0))
    return 1.0 / F.min(F.when(counted, F.col("place")))


def _value(m: Measure) -> Column:
    score = F.col(m.column)
    if m.kind == "nDCG":
        score = score / F.col(f"idcg_{m.cutoff or 'all'}")
    elif m.kind in ("AP", "R"):
        relevant = F.col(f"n_rel_{m.relevance}")
        score = F.when(relevant > 0, score / relevant)
    return F.coalesce(score, F.lit(0.0)).alias(m.name)


def _settings_of(run: DataFrame, by: list[str]) -> list[dict]:
    """The settings a run has: one per search that was made, however many rows each found."""
    return [row.asDict() for row in run.select(*by).distinct().collect()]


def _with_settings(population: DataFrame, run: DataFrame, by: list[str], settings: Sequence[dict]) -> DataFrame:
    """Every judged query once per setting."""
    kinds = {c: run.schema[c].dataType for c in by}
    if not settings:
        return population.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in by]).where("false")
    rows = [F.struct(*[F.lit(s[c]).cast(kinds[c]).alias(c) for c in by]) for s in settings]
    return population.select("*", F.inline(F.array(*rows)))


def evaluate(
    run: DataFrame,
    qrels: DataFrame,
    measures: Sequence[str] = DEFAULT_MEASURES,
    by: Sequence[str] = (),
    settings: Sequence[dict] | None = None,
    depth: int | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """``by, query_id, measure, value`` for all measures in one pass.

    ``settings`` lists the values of the ``by`` columns (read off the run if not given), so that
    every setting reports every judged query. ``depth`` is the largest number of rows per query,
    if the caller knows it: the run is then dealt out once, by setting and query, for all steps. If a
    measure without cutoff needs it, it is counted here. ``run`` should be a stored table, whose size Spark
    knows. It may have one row per setting and query, with a list ``found`` of ``doc_id, score, place``, as
    ``search_lists`` leaves it: then no document found is dealt out. With ``members``, the run is by vector, as ``search_vectors``
    leaves both: settings of a query that search with one vector are measured once.
    """
    parsed = [parse_measure(m) for m in measures]
    by, keys = list(by), [*by, "query_id"]
    deepest = _deepest(parsed)
    if by and settings is None:
        settings = _settings_of(run if members is None else members, by)
    ranked = keys if members is None else [NUMBER, "query_id"]
    pairs = None if members is None else members.select(*ranked).distinct()
    # stored, because several steps read them
    qrels = materialize(qrels.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance")), "judgments")
    levels = sorted({m.relevance for m in parsed if m.kind == "AP"})
    relevant = qrels.where("relevance > 0")
    if "found" in run.columns and _largest_group(relevant, ["query_id"]) <= LISTED_JUDGMENTS:
        population = _listed(qrels, parsed)
        hits = _hits_of_lists(run, population, ranked, levels, deepest, pairs)
        population = population.drop("_judged")
    else:
        population = _ideal(qrels, parsed)
        run = rows_of(run)
        if pairs is not None:
            run = run.join(broadcast_if_small(pairs, JOINED_BYTES), NUMBER)
        if deepest is None and depth is None:
            depth = _largest_group(run, ranked)
        if depth is not None and depth <= ONE_TASK_ROWS:
            # rows of one document, too, are together then
            run = run.repartition(*ranked)
        run = run.groupBy(*ranked, "doc_id").agg(F.max("score").alias("score"))
        # few judgments leave the ranked rows where they are; many, which come with many queries, are joined in parts
        hits = _hits(run, broadcast_if_small(relevant, JOINED_BYTES), ranked, levels, deepest, depth)
    scores = hits.groupBy(*ranked).agg(*[_score(m).alias(m.column) for m in parsed])
    if members is not None:
        scores = members.join(scores, ranked).drop(NUMBER)

    if by:
        population = _with_settings(population, run if members is None else members, by, settings)
    wide = population.join(scores, keys, "left").select(*keys, *[_value(m) for m in parsed])
    return wide.unpivot(keys, [m.name for m in parsed], "measure", "value")


def summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean per measure, best first."""
    means = results.groupBy(*by, "measure").agg(F.avg("value").alias("mean"))
    return means.orderBy(F.col("mean").desc(), "measure")


def summary_table(results: DataFrame, measures: Sequence[str] = DEFAULT_MEASURES) -> DataFrame:
    """One row per alpha, one column per measure; numbers before labels."""
    wide = results.groupBy("alpha").pivot("measure", list(measures)).agg(F.avg("value"))
    number = F.expr("try_cast(alpha AS double)")
    return wide.orderBy(number.isNull(), number, "alpha")


def with_retained(results: DataFrame, fractions: DataFrame) -> DataFrame:
    """Per-query results with the share of dimensions kept, null where there is none."""
    return results.join(
        fractions.select("query_id", "alpha", "retained_frac"), ["query_id", "alpha"], "left"
    )


def run_sanity(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per collection and model: queries in run and judgments, and run queries never judged.

    ``runs`` needs ``collection, model, query_id``, ``qrels`` ``collection, query_id``. Masked
    runs, whose name holds ``__``, are left out.
    """
    run_ids = _baseline_queries(runs)
    judged = qrels.select("collection", "query_id").distinct().withColumn("judged", F.lit(1))
    counts = (
        run_ids.join(judged, ["collection", "query_id"], "left")
        .groupBy("collection", "model")
        .agg(F.count("*").alias("run_queries"), (F.count("*") - F.count("judged")).alias("missing"))
    )
    # the judged queries of a collection are one more row next to its models
    both = counts.unionByName(
        judged.groupBy("collection").agg(F.count("*").alias("judged_queries")), allowMissingColumns=True
    )
    of_collection = F.max("judged_queries").over(Window.partitionBy("collection"))
    return (
        both.withColumn("qrel_queries", F.coalesce(of_collection, F.lit(0)))
        .where(F.col("model").isNotNull())
        .withColumn("ok", F.col("missing") == 0)
        .select("collection", "model", "run_queries", "qrel_queries", "missing", "ok")
    )


def _baseline_queries(runs: DataFrame) -> DataFrame:
    unmasked = runs.where(~F.col("model").contains("__"))
    return unmasked.select("collection", "model", "query_id").distinct()


def unjudged_queries(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run queries without a judgment, one row each."""
    judged = qrels.select("collection", "query_id").distinct()
    return _baseline_queries(runs).join(judged, ["collection", "query_id"], "left_anti")

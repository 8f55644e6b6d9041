"""The flagship dataflow: importance, selection, masked search, measures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import DEFAULT_MEASURES, evaluate, summary, summary_table, with_retained
from ..operators.importance import Filter
from ..operators.search import DEFAULT_K, run_of, search, search_vectors, with_members
from ..operators.select import DEFAULT_ALPHAS, Selector, TopAlpha, alpha_label, apply_weights, labels, retained, selector
from ..schemas import RESULT_COLUMNS, SWEEP_RUN_COLUMNS
from ..sources import results as result_files
from ..sources import runs as run_files
from ..storage import materialize


@dataclass(frozen=True)
class Sweep:
    """Runs of one filter and selector for several settings, stored, and what was measured on them."""

    run_table: DataFrame
    alphas: tuple[str, ...]
    fractions: DataFrame | None = None
    metrics: DataFrame | None = None
    depth: int | None = None
    found: DataFrame | None = None  # the same runs, as they are stored: what each vector found
    members: DataFrame | None = None  # and the vector of every query and setting, if several have one

    def run(self, alpha: float | str) -> DataFrame:
        """The run of one setting; ``KeyError`` for a setting the sweep does not have."""
        return self.run_table.where(F.col("alpha") == self._known(alpha))

    def evaluate(self, qrels: DataFrame, measures: Sequence[str] = DEFAULT_MEASURES) -> Sweep:
        settings = [{"alpha": a} for a in self.alphas]
        stored = self.run_table if self.found is None else self.found
        measured = evaluate(stored, qrels, measures, ["alpha"], settings, self.depth, self.members)
        return replace(self, metrics=measured)

    def per_query(self, alpha: float | str) -> DataFrame:
        return self._measured().where(F.col("alpha") == self._known(alpha)).select(*RESULT_COLUMNS)

    def mean(self, alpha: float | str, measure: str) -> float:
        wanted = self.per_query(alpha).where(F.col("measure") == measure)
        value = wanted.agg(F.avg("value")).first()[0]
        if value is None:
            raise KeyError(measure)
        return value

    def summary(self) -> DataFrame:
        return summary(self._measured(), ["alpha"])

    def summary_table(self, measures: Sequence[str] = DEFAULT_MEASURES) -> DataFrame:
        return summary_table(self._measured(), measures)

    def results(self) -> DataFrame:
        """Per-query results, with the share of dimensions kept where it is known."""
        measured = self._measured()
        return measured if self.fractions is None else with_retained(measured, self.fractions)

    def save(self, path: str, mode: str = "error") -> None:
        run_files.write_sweep(self.run_table, path, mode)

    def save_results(self, path: str, mode: str = "error") -> None:
        result_files.write_results(self.results(), path, mode)

    @classmethod
    def load(cls, spark: SparkSession, path: str, results_path: str | None = None) -> Sweep:
        """A stored sweep and, if given, its stored results with the retained shares."""
        table = run_files.read_sweep(spark, path)
        loaded = cls(table, tuple(run_files.alphas_of(table)))
        if results_path is None:
            return loaded
        stored = result_files.read_results(spark, results_path)
        fractions = None
        if "retained_frac" in stored.columns:
            fractions = stored.select("query_id", "alpha", "retained_frac").where(
                F.col("retained_frac").isNotNull()
            ).distinct()
        return replace(loaded, metrics=stored.select("alpha", *RESULT_COLUMNS), fractions=fractions)

    def _known(self, alpha: float | str) -> str:
        label = alpha_label(alpha)
        if label not in self.alphas:
            raise KeyError(f"{label!r} is not in {self.alphas}")
        return label

    def _measured(self) -> DataFrame:
        if self.metrics is None:
            raise RuntimeError("call evaluate first")
        return self.metrics


def baseline(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, model: str = "run") -> DataFrame:
    """The unmasked run, stored: feedback filters read it several times."""
    return materialize(search(vectors, queries.select("query_id", "vec"), k, model), "run")


def _stored_weights(chosen: Selector, importance: DataFrame, alphas: Sequence[float]) -> tuple[DataFrame, list[str]]:
    """Weights of all settings, stored where they are read more than once, and the settings."""
    weighted, known = chosen.weights(importance, alphas), labels(chosen, alphas)
    if not isinstance(chosen, TopAlpha):
        weighted = materialize(weighted, "weights")
    if known is None:
        known = sorted(r[0] for r in weighted.select("alpha").distinct().collect())
    return weighted, known


def masked_search(
    importance: DataFrame,
    vectors: DataFrame,
    chosen: str | Selector = "top-alpha",
    alphas: Sequence[float] = DEFAULT_ALPHAS,
    k: int = DEFAULT_K,
    run: str = "run",
) -> Sweep:
    """Search with masked queries for every setting; the corpus is read once for all of them.

    ``chosen`` is a selector or the name of a built-in one. The runs are stored: measuring, saving
    and looking at them does not search again.
    """
    chosen = selector(chosen)
    weighted, known = _stored_weights(chosen, importance, alphas)
    masked = apply_weights(weighted).select("query_id", "alpha", "vec")
    found, members = search_vectors(vectors, masked, k, run, ["query_id", "alpha"])
    table = run_of(with_members(found, members), run).select(*SWEEP_RUN_COLUMNS)
    fractions = None if isinstance(chosen, TopAlpha) else retained(weighted)
    return Sweep(table, tuple(known), fractions, depth=k, found=found, members=members)


def sweep(
    queries: DataFrame,
    vectors: DataFrame,
    dim_filter: Filter,
    chosen: str | Selector = "top-alpha",
    alphas: Sequence[float] = DEFAULT_ALPHAS,
    k: int = DEFAULT_K,
    model: str = "run",
) -> Sweep:
    """From a filter to the runs of all its settings, tagged ``model__filter__selector``."""
    chosen = selector(chosen)
    tag = f"{model}__{dim_filter.tag}__{chosen.tag}"
    return masked_search(dim_filter(queries), vectors, chosen, alphas, k, tag)


@dataclass(frozen=True)
class Comparison:
    """Runs of several filters and selectors, told apart by ``filter``, ``selector`` and ``alpha``."""

    run_table: DataFrame
    settings: tuple[dict, ...]
    fractions: DataFrame
    depth: int
    found: DataFrame  # the same runs, as they are stored: what each vector found
    members: DataFrame | None  # and the vector of every query and setting, if several have one

    def results(self, qrels: DataFrame, measures: Sequence[str] = DEFAULT_MEASURES) -> DataFrame:
        """Per-query results of every setting, with the share of dimensions kept where it varies."""
        by = ["filter", "selector", "alpha"]
        measured = evaluate(self.found, qrels, measures, by, self.settings, self.depth, self.members)
        return measured.join(self.fractions, [*by, "query_id"], "left")


def compare(
    queries: DataFrame,
    vectors: DataFrame,
    filters: Sequence[Filter],
    selectors: Sequence[str | Selector] = ("top-alpha", "rdime"),
    alphas: Sequence[float] = DEFAULT_ALPHAS,
    k: int = DEFAULT_K,
    model: str = "run",
) -> Comparison:
    """All settings of all filters and selectors, with the corpus read once for the lot."""
    masks, shares, settings = [], [], []
    by = ["filter", "selector", "alpha"]
    for dim_filter in filters:
        # stored, because every selector reads it
        importance = materialize(dim_filter(queries), "importance")
        for chosen in map(selector, selectors):
            # stored where the shares read it, too; fixed fractions keep as much for every query
            weighted, known = _stored_weights(chosen, importance, alphas)
            named = {"filter": F.lit(dim_filter.tag), "selector": F.lit(chosen.tag)}
            masks.append(apply_weights(weighted).select("query_id", "alpha", "vec").withColumns(named))
            if not isinstance(chosen, TopAlpha):
                shares.append(retained(weighted.withColumns(named), ("filter", "selector")))
            settings += [{"filter": dim_filter.tag, "selector": chosen.tag, "alpha": a} for a in known]
    masked = reduce(DataFrame.unionByName, masks).select(*by, "query_id", "vec")
    found, members = search_vectors(vectors, masked, k, model, [*by, "query_id"])
    tagged = run_of(with_members(found, members), model).withColumn("run", F.concat_ws("__", F.lit(model), "filter", "selector"))
    none = masked.select("filter", "selector", "query_id", "alpha", F.lit(None).cast("double").alias("retained_frac")).where("false")
    fractions = reduce(DataFrame.unionByName, shares) if shares else none
    return Comparison(tagged, tuple(settings), fractions, k, found, members)

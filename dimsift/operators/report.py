"""Comparison tables over stored results.

Input is one long table ``collection, model, filter, selector, alpha, query_id, measure, value``
and ``retained_frac``; unmasked runs carry the filter ``baseline``. Means form in the map tasks,
so what is shuffled is one row per task and table cell. Each table is made of one pass over the results:
what tells its columns apart is a condition on the mean. Missing cells are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import DEFAULT_MEASURES
from .select import DEFAULT_ALPHAS, alpha_label

BASELINE = "baseline"
# Tolerance for "as good as the best", and the fractions compared by default.
TOLERANCE = 1e-9
COMPARED_ALPHAS = (0.4, 0.6, 0.8)


def delta_pct(new: Column, ref: Column) -> Column:
    """Relative change in percent; null when either side is missing or ``ref`` is 0."""
    return F.when(ref != 0, (new - ref) / ref * 100)


def _grid(df: DataFrame, **values: Sequence[str]) -> DataFrame:
    """All combinations of the requested labels."""
    out = df.sparkSession.range(1).select()
    for name, labels in values.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, labels))).alias(name))
    return out


def baseline_means(results: DataFrame, collections, models, measures=DEFAULT_MEASURES) -> DataFrame:
    """Mean per requested (collection, model, measure) of the unmasked runs."""
    means = (
        results.where(F.col("filter") == BASELINE)
        .groupBy("collection", "model", "measure")
        .agg(F.avg("value").alias("mean"))
    )
    grid = _grid(results, collection=collections, model=models, measure=measures)
    return grid.join(means, ["collection", "model", "measure"], "left")


def sweep_means(results: DataFrame) -> DataFrame:
    """Mean per (collection, model, filter, selector, measure, alpha) of the masked runs."""
    keys = ["collection", "model", "filter", "selector", "measure", "alpha"]
    return results.where(F.col("filter") != BASELINE).groupBy(*keys).agg(F.avg("value").alias("mean"))


def retained_means(results: DataFrame, selector: str = "rdime") -> DataFrame:
    """Mean share of dimensions kept, per (collection, model, filter)."""
    return (
        results.where(F.col("selector") == selector)
        .groupBy("collection", "model", "filter")
        .agg(F.avg("retained_frac").alias("retained_frac"))
    )


def _is_best(value: Column, best: Column) -> Column:
    return F.coalesce(F.abs(value - best) < TOLERANCE, F.lit(False))


def performance(
    results: DataFrame,
    models: Sequence[str],
    collections: Sequence[str],
    filters: Sequence[str],
    selector: str,
    alpha: float | str | None = None,
    measures: Sequence[str] = DEFAULT_MEASURES,
    include_baseline: bool = True,
) -> DataFrame:
    """One configuration per filter: rows (model, filter), a column per ``collection:measure``.

    ``...:best`` marks the best value of a column. ``alpha`` is not needed for ``rdime``.
    """
    label = "rdime" if selector == "rdime" else alpha_label(alpha)
    shown = list(filters) + ([BASELINE] if include_baseline else [])
    masked = (F.col("selector") == selector) & (F.col("alpha") == label)
    wanted = results.where((F.col("filter") == BASELINE) | masked)
    means = wanted.groupBy("collection", "model", "filter", "measure").agg(F.avg("value").alias("mean"))
    grid = _grid(results, model=models, filter=shown, collection=collections, measure=measures)
    cells = grid.join(means, ["model", "filter", "collection", "measure"], "left")
    best = F.max("mean").over(Window.partitionBy("collection", "measure"))
    cells = cells.withColumn("best", _is_best(F.col("mean"), best)).withColumn(
        "cell", F.concat_ws(":", "collection", "measure")
    )
    names = [f"{c}:{m}" for c in collections for m in measures]
    wide = cells.groupBy("model", "filter").pivot("cell", names).agg(
        F.first("mean").alias("mean"), F.first("best").alias("best")
    )
    columns = [
        c for n in names for c in (F.col(f"`{n}_mean`").alias(n), F.col(f"`{n}_best`").alias(f"{n}:best"))
    ]
    return wide.select("model", "filter", *columns)


def _tag(label: str) -> str:
    """An alpha label as part of a column name: without a dot, which would need quoting."""
    return label.replace(".", "_")


def _mean_where(condition: Column, value: str) -> Column:
    return F.avg(F.when(condition, F.col(value)))


def _best_of(labels: list[str]) -> tuple[list[Column], Column]:
    """A column per alpha and which of them is best in its row; and the best value."""
    value = {a: F.col(f"`{a}`") for a in labels}
    best = F.greatest(*value.values()) if len(labels) > 1 else value[labels[0]]
    columns = [
        c
        for a in labels
        for c in (value[a].alias(f"alpha_{_tag(a)}"), _is_best(value[a], best).alias(f"best_{_tag(a)}"))
    ]
    return columns, best


def comparison(
    results: DataFrame,
    models: Sequence[str],
    collections: Sequence[str],
    filters: Sequence[str],
    measure: str = "nDCG@10",
    alphas: Sequence[float] = COMPARED_ALPHAS,
    selector_sweep: str = "top-alpha",
    selector_rdime: str = "rdime",
    include_baseline: bool = True,
) -> DataFrame:
    """Fixed fractions against the noise threshold: rows (collection, model, filter).

    ``delta_pct`` compares ``rdime`` with the best fixed fraction shown. A baseline row holds the
    unmasked mean with all dimensions retained.
    """
    keys = ["collection", "model", "filter"]
    labels = [alpha_label(a) for a in alphas]
    measured, masked = F.col("measure") == measure, F.col("filter") != BASELINE
    fixed = measured & masked & (F.col("selector") == selector_sweep)
    adaptive = measured & masked & (F.col("selector") == selector_rdime) & (F.col("alpha") == "rdime")
    cells = results.groupBy(*keys).agg(
        *[_mean_where(fixed & (F.col("alpha") == a), "value").alias(a) for a in labels],
        _mean_where(adaptive, "value").alias("rdime"),
        _mean_where(F.col("selector") == selector_rdime, "retained_frac").alias("retained_frac"),
        _mean_where(measured & ~masked, "value").alias("_baseline"),
    )
    shown = [*filters, *([BASELINE] if include_baseline else [])]
    table = _grid(results, collection=collections, model=models, filter=shown).join(cells, keys, "left")
    unmasked = F.col("filter") == BASELINE
    flags, best = _best_of(labels)
    mean = F.when(unmasked, F.col("_baseline")).otherwise(F.col("rdime"))
    kept = F.when(unmasked, F.when(F.col("_baseline").isNotNull(), 1.0)).otherwise(F.col("retained_frac"))
    return table.select(
        *keys, *flags, mean.alias("rdime"), kept.alias("retained_frac"), delta_pct(F.col("rdime"), best).alias("delta_pct")
    )


def sweep(
    results: DataFrame,
    models: Sequence[str],
    collections: Sequence[str],
    filters: Sequence[str],
    selector: str = "top-alpha",
    alphas: Sequence[float] = DEFAULT_ALPHAS,
    measures: Sequence[str] = ("nDCG@10", "AP"),
    include_baseline: bool = True,
) -> DataFrame:
    """Every fraction as a column: rows (model, filter, collection, measure), plus the baseline mean."""
    keys = ["model", "filter", "collection", "measure"]
    labels = [alpha_label(a) for a in alphas]
    masked = (F.col("filter") != BASELINE) & (F.col("selector") == selector)
    cells = results.groupBy(*keys).agg(
        *[_mean_where(masked & (F.col("alpha") == a), "value").alias(a) for a in labels],
        _mean_where(F.col("filter") == BASELINE, "value").alias("_baseline"),
    )
    shown = [*filters, *([BASELINE] if include_baseline else [])]
    table = _grid(results, model=models, filter=shown, collection=collections, measure=measures).join(cells, keys, "left")
    flags, _ = _best_of(labels)
    if not include_baseline:
        return table.select(*keys, *flags)
    # the grid is as small as the table shown
    baseline = F.max("_baseline").over(Window.partitionBy("collection", "model", "measure")).alias("baseline")
    return table.select(*keys, *flags, baseline).where(F.col("filter") != BASELINE)


def retained(
    results: DataFrame,
    models: Sequence[str],
    collections: Sequence[str],
    filters: Sequence[str],
    selector: str = "rdime",
) -> DataFrame:
    """Mean share of dimensions kept: rows (model, filter), a column per collection."""
    grid = _grid(results, model=models, filter=filters, collection=collections)
    cells = grid.join(retained_means(results, selector), ["model", "filter", "collection"], "left")
    return cells.groupBy("model", "filter").pivot("collection", list(collections)).agg(F.first("retained_frac"))

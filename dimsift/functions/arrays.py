"""Column expressions over vector columns. All arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain reference inside a lambda would be computed again for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def times(left: Column | str, right: Column | str) -> Column:
    """Elementwise product."""
    return F.zip_with(_col(left), _col(right), lambda a, b: a.cast("double") * b.cast("double"))


def dot(left: Column | str, right: Column | str) -> Column:
    return total(times(left, right))


def l2_norm(vec: Column | str) -> Column:
    return F.sqrt(dot(vec, vec))


def l2_normalize(vec: Column | str) -> Column:
    """Unit length; an all-zero vector stays as it is."""
    vec = _col(vec)
    return bind(
        l2_norm(vec),
        lambda norm: F.transform(vec, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm)),
    )


def dim_ranks(importance: Column | str) -> Column:
    """1-based rank of every dimension by importance, largest first; ties go to the lower dimension.

    Two array sorts inside the row, so ranking needs no shuffle.
    """
    ordered = F.sort_array(
        F.transform(
            _col(importance),
            lambda u, i: F.named_struct(F.lit("key"), F.lit(0.0) - u, F.lit("dim"), i),
        )
    )
    placed = F.sort_array(
        F.transform(
            ordered, lambda s, pos: F.named_struct(F.lit("dim"), s["dim"], F.lit("rank"), pos + 1)
        )
    )
    return F.transform(placed, lambda s: s["rank"])


def alpha_to_k(alpha: Column, dims: Column) -> Column:
    """``max(1, round(alpha * D))``, halves to the even neighbour."""
    return F.greatest(F.lit(1), F.rint(alpha.cast("double") * dims).cast("int"))


def top_k_weights(ranks: Column, k: Column) -> Column:
    return bind(k, lambda most: F.transform(ranks, lambda r: (r <= most).cast("float")))


def noise_threshold(vec: Column, importance: Column) -> Column:
    """Mean over the dimensions of ``q_d^2 - u_d``."""
    excess = F.zip_with(vec, importance, lambda q, u: q.cast("double") * q.cast("double") - u)
    return total(excess) / F.size(importance)


def threshold_weights(vec: Column, importance: Column) -> Column:
    return bind(
        noise_threshold(vec, importance),
        lambda eps: F.transform(importance, lambda u: (u > eps).cast("float")),
    )

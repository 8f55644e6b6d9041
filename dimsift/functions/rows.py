"""Steps on the vectors of many rows at once: what ``arrays`` says per row, an Arrow batch at a time.

An expression on an array is evaluated element by element; here rows of one length make a matrix. Nulls,
and lists of several lengths, are as in ``arrays``: a product with a null is null, and nulls rank first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _matrices(*columns: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray | None]]]:
    """Rows without a null list that have the same lengths, their values, and which of those are null."""
    whole = np.ones(len(columns[0]), bool)
    for column in columns:
        whole &= column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(whole)
    lengths = np.stack([pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in columns])[:, rows]
    if not len(rows):
        return
    same = [np.arange(len(rows))]
    if (lengths != lengths[:, :1]).any():
        _, kind = np.unique(lengths, axis=1, return_inverse=True)
        same = [np.flatnonzero(kind == n) for n in range(kind.max() + 1)]
    for at in same:
        some = [c if len(at) == len(c) else c.take(pa.array(rows[at])) for c in columns]
        flat = [c.flatten() for c in some]
        nulls = [v.is_null().to_numpy(zero_copy_only=False).reshape(len(at), -1) if v.null_count else None for v in flat]
        values = [pc.fill_null(v.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for v in flat]
        yield rows[at], [v.reshape(len(at), lengths[i, at[0]]) for i, v in enumerate(values)], nulls


def _lists(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]], rows: int) -> pa.Array:
    """A list of single precision per row, from matrices of some rows each; null where there is none."""
    lengths, valid = np.zeros(rows, np.int64), np.zeros(rows, bool)
    for at, matrix, _ in parts:
        lengths[at], valid[at] = matrix.shape[1], True
    ends = np.append(0, np.cumsum(lengths))
    values, nulls = np.empty(ends[-1], np.float32), np.zeros(ends[-1], bool)
    for at, matrix, mask in parts:
        places = ends[at][:, None] + np.arange(matrix.shape[1])
        values[places] = matrix
        if mask is not None:
            nulls[places] = mask
    items = pa.array(values, mask=nulls if nulls.any() else None)
    # a null as the start of a list makes it null
    offsets = pa.array(ends.astype(np.int32), mask=np.append(~valid, False) if not valid.all() else None)
    return pa.ListArray.from_arrays(offsets, items)


def masked(left: pa.Array, right: pa.Array) -> pa.Array:
    """``arrays.times``, in single precision."""
    parts = []
    for at, (a, b), nulls in _matrices(left, right):
        short, most = min(a.shape[1], b.shape[1]), max(a.shape[1], b.shape[1])
        product, mask = np.zeros((len(at), most)), np.zeros((len(at), most), bool)
        product[:, :short], mask[:, short:] = a[:, :short] * b[:, :short], True
        for missing in nulls:
            if missing is not None:
                mask[:, :missing.shape[1]] |= missing
        with np.errstate(over="ignore"):
            parts.append((at, product.astype(np.float32), mask))
    return _lists(parts, len(left))


def top_alpha_weights(importance: pa.Array, alphas: Sequence[float]) -> pa.Array:
    """For every row, a list per fraction: the weights that ``arrays`` makes of ``dim_ranks`` and ``alpha_to_k``."""
    shares, parts = np.array([float(a) for a in alphas]), []
    for at, (u,), (missing,) in _matrices(importance):
        falling = 0.0 - u
        if missing is None:
            order = np.argsort(falling, axis=1, kind="stable")
        else:
            order = np.lexsort((np.where(missing, 0.0, falling), ~missing), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(1, u.shape[1] + 1)[None, :], 1)
        for n, k in enumerate(np.maximum(1, np.rint(shares * u.shape[1]))):
            parts.append((at * len(shares) + n, rank <= k, None))
    return _lists(parts, len(importance) * len(shares))

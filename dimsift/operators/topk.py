"""The best ``k`` documents per query of what one task has seen, in arrays of fixed size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCORE_BLOCK = 1_000_000  # scores held at once by a task
MERGE_ROWS = 250_000  # kept rows that are merged at a time
PENDING_SHARE = 4  # found rows that wait for a merge: one for so many kept ones
SPARE_IDS = 1_000_000  # ids of documents no longer kept that may be held
OUT_ROWS = 100_000
EXACT_CELLS = 100_000  # components multiplied at once where scores are taken in double precision
ROUGH_REACH = 1e15  # longest vectors whose products are first taken in single precision
LOOK_SHARE = 16  # of so many documents one is looked at for a first floor
LEAST_LOOK = 100  # documents; where fewer would be looked at, none are
FOUND_SHARE = 2  # rows that such a floor should let through, for one that is kept
LOWER = 4  # times as many are to reach a second guess
LEAST_SHARE = 16  # of so many documents at least, a guess should let through one
TILE_SCORES = 256_000  # rough products taken at once, as many as a core's own cache holds
GROUP = 16  # rows of them whose largest is compared first
GROUPS_A_PLACE = 32  # groups of the documents looked at, for a place among the best of them


def check_dimensions(documents: np.ndarray, queries: np.ndarray) -> None:
    if documents.shape[1] != queries.shape[1]:
        raise ValueError(f"documents have {documents.shape[1]} dimensions, queries {queries.shape[1]}")


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest score of every row."""
    place = scores.shape[1] - k
    return np.partition(scores, place, axis=1)[:, place]


def product_error(dims: int, queries: np.ndarray, longest: float) -> np.ndarray:
    """For vectors of the lengths ``queries`` and one no longer than ``longest``, at least what their product in single precision may be off.

    Each of its ``dims`` terms and sums, and both vectors, are rounded once (2^-24 of the value; the bound has twice
    that), and what is too small for single precision may become 0.
    """
    rounded = (dims + 8) * 2.0**-23 * queries * longest
    return rounded + dims * 2.5e-38 * (1 + queries + longest)


def best_first(query: np.ndarray, score: np.ndarray, kind: str | None = None) -> np.ndarray:
    """The order by query, then from the largest score, as one sort of whole numbers."""
    bits = score.view(np.uint32)
    falling = np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF))
    return np.argsort(query.astype(np.uint64) << np.uint64(32) | falling, kind=kind)


def exact_scores(matrix: np.ndarray, vectors: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Scores of pairs, summed in double precision, each on its own, and kept in single precision."""
    score = np.empty(len(row), np.float32)
    step = max(1, EXACT_CELLS // max(1, vectors.shape[1]))
    for a in range(0, len(row), step):
        some = slice(a, a + step)
        score[some] = np.einsum("ij,ij->i", matrix[query[some]], vectors[row[some]].astype(np.float64, copy=False))
    score += np.float32(0)  # a rounded -0.0 becomes 0.0
    return score


@dataclass(frozen=True)
class Look:
    """What is known of all documents before any query is met: their greatest length, and some rows of them for a first floor."""

    longest: float
    rows: np.ndarray


def look_at(vectors: np.ndarray) -> Look:
    step = max(1, SCORE_BLOCK // max(1, vectors.shape[1]))
    lengths = [np.linalg.norm(vectors[a:a + step].astype(np.float64), axis=1).max() for a in range(0, len(vectors), step)]
    rows = np.random.default_rng(0).choice(len(vectors), len(vectors) // LOOK_SHARE, replace=False)
    return Look(float(max(lengths, default=0.0)), np.sort(rows).astype(np.int32))


def reaching(products: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the products that reach the bound of their column; those of a column in order.

    Few do, so the largest of every ``GROUP`` rows is compared, and single rows only where that reaches it.
    """
    columns, whole = len(bound), len(products) // GROUP * GROUP
    grouped = products[:whole].reshape(-1, GROUP, columns)
    group, column = np.divmod(np.flatnonzero(grouped.max(axis=1) >= bound), columns)
    values = grouped[group, :, column]
    hit, place = np.divmod(np.flatnonzero(values >= bound[column, None]), GROUP)
    last_row, last_column = np.nonzero(products[whole:] >= bound)
    row = np.concatenate((group[hit] * GROUP + place, last_row + whole)).astype(np.int32)
    query = np.concatenate((column[hit], last_column)).astype(np.int32)
    return row, query, np.concatenate((values[hit, place], products[whole + last_row, last_column]))


def best_rows(
    matrix: np.ndarray, vectors: np.ndarray, k: int, look: Look | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of ``vectors`` for every query: how many there are, then their rows and scores, best first.

    ``vectors`` are in the order of their ids, so of equal scores the first rows stay. A look at some of them guesses
    a floor that about twice ``k`` reach. Where ``k`` did reach it, nothing below it has a place; the few queries
    whose guess was too high are searched again, with a lower one as long as that leaves most out. ``look`` is ``look_at(vectors)``, if that is at hand.
    """
    check_dimensions(vectors, matrix)
    matrix, k = matrix.astype(np.float64, copy=False), min(k, len(vectors))
    look = look or look_at(vectors)
    place = FOUND_SHARE * k * len(look.rows) // len(vectors) + 4
    if len(look.rows) < max(LEAST_LOOK, 2 * place):
        return _best_without_guess(matrix, vectors, k)
    return _best_guessing(matrix, vectors, k, look, place)


def _best_guessing(
    matrix: np.ndarray, vectors: np.ndarray, k: int, look: Look, place: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, with the ``place``-th best of the documents looked at as the floor, and a lower one for queries it is too high for."""
    counts, rows, scores = _best_above_guess(matrix, vectors, k, look, place)
    missed = np.flatnonzero(counts < k)
    if not len(missed):
        return counts, rows, scores
    if len(look.rows) < LEAST_SHARE * (lower := LOWER * place):
        _, again, better = _best_without_guess(matrix[missed], vectors, k)
    else:
        _, again, better = _best_guessing(matrix[missed], vectors, k, look, lower)
    found = np.repeat(counts == k, counts)
    every_row, every_score = np.empty((len(matrix), k), np.int32), np.empty((len(matrix), k), np.float32)
    reached = counts == k
    every_row[reached], every_score[reached] = rows[found].reshape(-1, k), scores[found].reshape(-1, k)
    every_row[missed], every_score[missed] = again.reshape(-1, k), better.reshape(-1, k)
    return np.full(len(matrix), k), every_row.ravel(), every_score.ravel()


def _best_without_guess(matrix: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = RunningTopK(matrix, k)
    best.add(pa.array(np.arange(len(vectors), dtype=np.int32)), vectors)
    found = pa.Table.from_batches(
        best.result(pa.table({"query": np.arange(len(matrix), dtype=np.int32)}), ranked=True),
        pa.schema([("query", pa.int32()), ("doc_id", pa.int32()), ("score", pa.float64()), ("rank", pa.int32())]),
    )
    counts = np.bincount(found["query"].to_numpy(), minlength=len(matrix))
    return counts, found["doc_id"].to_numpy(), found["score"].to_numpy().astype(np.float32)


def _guessed(near: np.ndarray, sample: np.ndarray, place: int) -> np.ndarray:
    """About the ``place``-th largest product of every query: that of the largest of groups, if there are many to a place."""
    group = max(1, len(sample) // (GROUPS_A_PLACE * place))
    sample = sample[: len(sample) // group * group]
    few = max(1, SCORE_BLOCK // len(sample))
    return np.concatenate([
        kth_best((near[a:a + few] @ sample.T).reshape(-1, group, len(sample) // group).max(axis=1), place)
        for a in range(0, len(near), few)
    ]).astype(np.float32)


def _best_above_guess(
    matrix: np.ndarray, vectors: np.ndarray, k: int, look: Look, place: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` at most of those that reach a guessed floor; all of them where there are fewer.

    Found pairs are told apart by their rough products as far as those go: only pairs that may be among the best are
    taken in double precision, once, at the end.
    """
    lengths = np.linalg.norm(matrix, axis=1)
    kind = np.float32 if max(look.longest, float(lengths.max())) <= ROUGH_REACH else np.float64
    near, error = matrix.astype(kind), product_error(vectors.shape[1], lengths, look.longest)
    guess = _guessed(near, vectors[look.rows].astype(kind), place)
    floor = guess.astype(np.float64)
    across = np.ascontiguousarray(near.T)
    step = max(GROUP, TILE_SCORES // len(matrix) // GROUP * GROUP)
    most = 2 * FOUND_SHARE * len(matrix) * k
    products = np.empty(step * len(matrix), kind)
    kept = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.float32)
    new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pending = 0

    def merged():
        """The pairs that may be among the best ``k`` by what their rough products may be off."""
        query, row, rough = (np.concatenate(parts) for parts in zip(kept, *new))
        order = best_first(query, rough)
        first = np.searchsorted(query[order], np.arange(len(matrix) + 1))
        full = np.flatnonzero(np.diff(first) >= k)
        last = np.full(len(matrix), -np.inf)
        last[full] = rough[order[first[full] + k - 1]]
        np.maximum(floor, last - error, out=floor)
        stay = rough >= (last - 2 * error)[query]
        return query[stay], row[stay], rough[stay]

    for a in range(0, len(vectors), step):
        block = vectors[a:a + step].astype(kind, copy=False)
        rough = products[: len(near) * len(block)].reshape(len(block), -1)
        np.matmul(block, across, out=rough)
        row, query, value = reaching(rough, (floor - error).astype(kind))
        new.append((query, row + np.int32(a), value.astype(np.float32, copy=False)))
        pending += len(row)
        if pending > most:
            kept, new, pending = merged(), [], 0
    query, row, _ = merged()
    score = exact_scores(matrix, vectors, query, row)
    stay = score >= guess[query]
    query, row, score = query[stay], row[stay], score[stay]
    # a query's rows come in order, so a stable sort leaves those of equal scores in theirs
    order = best_first(query, score, "stable")
    query, row, score = query[order], row[order], score[order]
    first = np.searchsorted(query, np.arange(len(matrix) + 1))
    best = np.arange(len(query)) - first[query] < k
    return np.bincount(query[best], minlength=len(matrix)), row[best], score[best]


class RunningTopK:
    """The best ``k`` documents seen so far for each row of a query matrix.

    A kept row is a score and the number of its document, 8 bytes in two arrays of fixed size; a found row
    waits in 12 bytes until it is merged in, a stretch of queries at a time. Ids are held once per document, as
    long as a row may name it, and put in only when the rows are handed out. Scores are compared first;
    ids only where equal scores compete for the last places.

    All products are taken in single precision first; those that may reach the floor, by a bound on what rounding does,
    are taken in double precision, each on its own, so a pair of vectors has one score in whatever block it is met.
    """

    def __init__(self, matrix: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.matrix, self.k = matrix.astype(np.float64, copy=False), k
        queries = len(matrix)
        self.near, self.lengths = self.matrix.astype(np.float32), np.linalg.norm(self.matrix, axis=1)
        self.floor = np.full(queries, -np.inf, dtype=np.float32) if floor is None else floor.copy()
        self.scores = np.full((queries, k), -np.inf, np.float32)
        self.rows = np.full((queries, k), -1, np.int32)
        self.step = max(1, SCORE_BLOCK // max(1, queries))
        self.most_pending = max(1, queries * k // PENDING_SHARE)
        self.products = np.empty(self.step * queries, np.float32)
        room = self.most_pending + self.step * queries
        self.found_query, self.found_row = np.empty(room, np.int32), np.empty(room, np.int32)
        self.found_score = np.empty(room, np.float32)
        self.pending = 0
        self.ids: pa.Array | None = None
        self.needed_ids = 0

    def add(self, ids: pa.Array, vectors: np.ndarray) -> None:
        check_dimensions(vectors, self.matrix)
        if self.ids is not None and len(self.ids) > 2 * self.needed_ids + SPARE_IDS:
            self._forget_ids()
        first = 0 if self.ids is None else len(self.ids)
        self.ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        for start in range(0, len(vectors), self.step):
            query, doc, score = self._reached(vectors[start:start + self.step])
            at = slice(self.pending, self.pending + len(doc))
            self.found_query[at], self.found_score[at] = query, score
            self.found_row[at] = doc + (first + start)
            self.pending += len(doc)
            if self.pending > self.most_pending:
                self._merge()

    def _reached(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place in the block and score of the pairs that reach the floor."""
        block = block.astype(np.float64)
        longest = float(np.linalg.norm(block, axis=1).max())
        small = max(longest, float(self.lengths.max(initial=0.0))) <= ROUGH_REACH
        if small:
            rough = self.products[: len(self.near) * len(block)].reshape(-1, len(block))
            np.matmul(self.near, block.astype(np.float32).T, out=rough)
        else:
            rough = self.matrix @ block.T
        error = product_error(block.shape[1], self.lengths, longest)
        floor = self.floor - error
        reached = rough >= floor.astype(rough.dtype)[:, None]
        if len(block) > self.k and np.count_nonzero(reached) > self.k * len(rough):
            # no document below the k-th best of this block alone can be among the best k
            floor = np.maximum(floor, kth_best(rough, self.k) - 2 * error)
            reached = rough >= floor.astype(rough.dtype)[:, None]
        query, doc = np.divmod(np.flatnonzero(reached).astype(np.int32), np.int32(len(block)))
        score = exact_scores(self.matrix, block, query, doc)
        stay = score >= self.floor[query]
        return query[stay], doc[stay], score[stay]

    def _merge(self) -> None:
        """Put the found rows among the kept ones; what has no place is forgotten."""
        order = np.argsort(self.found_query[: self.pending], kind="stable")
        query = self.found_query[: self.pending][order]
        step = max(1, MERGE_ROWS // self.k)
        for a in range(0, len(self.matrix), step):
            b = min(a + step, len(self.matrix))
            new = order[slice(*np.searchsorted(query, (a, b)))]
            if len(new):
                self._merge_queries(a, b, new)
        self.pending = 0

    def _merge_queries(self, a: int, b: int, new: np.ndarray) -> None:
        kept = self.rows[a:b] >= 0
        query = np.concatenate((np.nonzero(kept)[0], self.found_query[new] - a))
        score = np.concatenate((self.scores[a:b][kept], self.found_score[new]))
        row = np.concatenate((self.rows[a:b][kept], self.found_row[new]))
        order = best_first(query, score)
        query, score, row = query[order], score[order], row[order]
        first = np.searchsorted(query, np.arange(b - a + 1))
        place = np.arange(len(query)) - first[query]
        # where the last place and the next have one score, the smaller ids stay
        last = first[:-1] + self.k - 1
        full = np.flatnonzero(last + 1 < first[1:])
        tied = np.full(b - a, np.nan, np.float32)
        even = full[score[last[full]] == score[last[full] + 1]]
        tied[even] = score[last[even]]
        at = np.flatnonzero(score == tied[query])
        if len(at):
            rivals = pa.table({"query": pa.array(query[at]), "id": self.ids.take(pa.array(row[at]))})
            row[at] = row[at][pc.sort_indices(rivals, sort_keys=[("query", "ascending"), ("id", "ascending")]).to_numpy()]
        stay = place < self.k
        query, score, row, place = query[stay], score[stay], row[stay], place[stay]
        self.scores[a + query, place], self.rows[a + query, place] = score, row
        ends = place == self.k - 1
        self.floor[a + query[ends]] = np.maximum(self.floor[a + query[ends]], score[ends])

    def _forget_ids(self) -> None:
        """Keep the ids of documents that some row names."""
        self._merge()
        kept = self.rows >= 0
        used = np.zeros(len(self.ids), bool)
        used[self.rows[kept]] = True
        self.ids = self.ids.filter(pa.array(used))
        self.rows[kept] = (np.cumsum(used, dtype=np.int32) - 1)[self.rows[kept]]
        self.needed_ids = len(self.ids)

    def result(self, keys: pa.Table, ranked: bool = False) -> Iterator[pa.RecordBatch]:
        """``keys, doc_id, score`` of the kept rows, in batches; ``ranked`` puts them in order and numbers them from 0."""
        self._merge()
        step = max(1, OUT_ROWS // self.k)
        for a in range(0, len(self.matrix), step):
            query, place = np.nonzero(self.rows[a:a + step] >= 0)
            if not len(query):
                continue
            ids = self.ids.take(pa.array(self.rows[a + query, place]))
            score = pa.array(self.scores[a + query, place].astype(np.float64))
            if ranked:
                found = pa.table({"query": query, "score": score, "id": ids})
                order = pc.sort_indices(found, sort_keys=[("query", "ascending"), ("score", "descending"), ("id", "ascending")])
                ids, score = ids.take(order), score.take(order)
            out = keys.take(pa.array(a + query)).append_column("doc_id", ids).append_column("score", score)
            if ranked:
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                out = out.append_column("rank", pa.array(rank.astype(np.int32)))
            yield from out.combine_chunks().to_batches()

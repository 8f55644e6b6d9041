"""Nearest neighbours by a forest of hash prefixes.

Every tree gives each vector a long hash string: symbols of ``SYMBOL_BITS`` bits, each the number of the
largest coordinate (and its sign) after a random rotation, so that near vectors share long prefixes. A
tree is a sorted array of these strings. A query descends every tree to its longest-prefix matches, then
all trees ascend together, bit by bit, until enough different candidates share the prefix; those are
compared exactly. How many are enough depends on the vectors: every block asks a sample of its own rows, whose
neighbours it knows, and takes the number that finds the recall wanted.

The strings are computed once and stored with the vectors, which stay in blocks where they were written;
each block is a forest of its own. Queries are a stated set: they go to the blocks in parts of bounded
size, and only a few neighbours per query and block are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, new_folder

TREES = 48
SYMBOLS = 6
SEED = 5
BLOCK_ROWS = 50_000  # vectors of one forest
QUERY_ROWS = 20_000  # queries that are sent out at once
RECALL = 0.95  # of a block's nearest, that its own sample of queries has to reach
SAMPLE_ROWS = 64  # of a block, asked to find out how many candidates that takes
SHARES = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7, 1.0)  # of a block, tried as numbers of candidates


@dataclass(frozen=True)
class Hashes:
    """Rotations of all trees; the strings have ``bits`` bits."""

    dims: int
    trees: int = TREES
    symbols: int = SYMBOLS
    seed: int = SEED

    @property
    def symbol_bits(self) -> int:
        return max(1, int(2 * self.dims - 1).bit_length())

    @property
    def used_symbols(self) -> int:
        return min(self.symbols, 62 // self.symbol_bits)

    @property
    def bits(self) -> int:
        return self.symbol_bits * self.used_symbols

    def rotations(self) -> np.ndarray:
        draw = np.random.default_rng(self.seed)
        count = self.trees * self.used_symbols
        return np.linalg.qr(draw.standard_normal((count, self.dims, self.dims)))[0].astype(np.float32)

    def strings(self, vectors: np.ndarray, rotations: np.ndarray) -> np.ndarray:
        """``[rows, trees]`` hash strings as numbers, which sort as the strings do."""
        unit = (vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=1e-300)).astype(np.float32)
        rows = np.arange(len(unit))
        out = np.zeros((len(unit), self.trees), np.int64)
        for i, rotation in enumerate(rotations):
            turned = unit @ rotation
            largest = np.abs(turned).argmax(axis=1)
            symbol = 2 * largest + (turned[rows, largest] > 0)
            out[:, i // self.used_symbols] = out[:, i // self.used_symbols] << self.symbol_bits | symbol
        return out


class Forest:
    """Sorted arrays of the strings of one block; candidates as the recall of its own rows asks for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, strings: np.ndarray, bits: int, k: int, recall: float = RECALL):
        self.ids, self.bits = ids, bits
        self.unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        self.vectors = vectors
        self.order = np.argsort(strings, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(strings.T, self.order, axis=1)
        self.wanted = self.needed(strings, k, recall)

    def needed(self, strings: np.ndarray, k: int, recall: float) -> int:
        """The fewest candidates of the shares tried with which a sample of the rows finds its ``k`` nearest."""
        n = len(self.ids)
        rows = np.unique(np.linspace(0, n - 1, min(n, SAMPLE_ROWS)).astype(np.int64))
        close = self.unit[rows] @ self.unit.T
        close[self.ids[rows][:, None] == self.ids[None, :]] = -np.inf
        kth = np.partition(close, max(0, n - k), axis=1)[:, max(0, n - k)]
        nearest = (close >= kth[:, None]) & np.isfinite(close)
        for share in SHARES:
            self.wanted = min(n, max(k + 1, int(np.ceil(share * n))))
            found = sum(int(nearest[i, some].sum()) for i, some in enumerate(self.candidates(strings[rows])))
            if found >= recall * nearest.sum():
                return self.wanted
        return n

    def ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows that share ``depth`` bits with each query begin and end, ``[trees, queries]``."""
        low = strings >> (self.bits - depth) << (self.bits - depth)
        high = low + (1 << (self.bits - depth))
        begin = np.stack([np.searchsorted(s, q) for s, q in zip(self.sorted, low.T)])
        end = np.stack([np.searchsorted(s, q) for s, q in zip(self.sorted, high.T)])
        return begin, end

    def candidates(self, strings: np.ndarray) -> Iterator[np.ndarray]:
        """Rows to compare with each query: all that share the longest depth at which there are enough."""
        at_depth: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        # the trees ascend together; with copies among the trees, no fewer rows than this are needed
        depth = np.zeros(len(strings), np.int64)
        open_ = np.ones(len(strings), bool)
        for d in range(self.bits, 0, -1):
            at_depth[d] = self.ranges(strings, d)
            found = (at_depth[d][1] - at_depth[d][0]).sum(axis=0)
            now = open_ & (found >= self.wanted)
            depth[now] = d
            open_ &= ~now
            if not open_.any():
                break
        mark = np.zeros(len(self.ids), bool)
        for q in range(len(strings)):
            rows = np.arange(len(self.ids))
            for d in range(depth[q], 0, -1):
                if d not in at_depth:
                    at_depth[d] = self.ranges(strings, d)
                begin, end = at_depth[d][0][:, q], at_depth[d][1][:, q]
                mark[:] = False
                for t in range(len(begin)):
                    mark[self.order[t, begin[t] : end[t]]] = True
                some = np.flatnonzero(mark)
                if len(some) >= self.wanted:
                    rows = some
                    break
            yield rows

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, strings: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        out = []
        lengths = np.linalg.norm(queries, axis=1)
        for i, rows in enumerate(self.candidates(strings)):
            rows = rows[self.ids[rows] != query_ids[i]]
            if not len(rows):
                continue
            close = self.unit[rows] @ (queries[i] / lengths[i])
            if len(rows) > k:
                rows = rows[close >= np.partition(close, -k)[-k] - 1e-9]
            # once more, in an order of adding that does not depend on the place of a row
            near = self.vectors[rows]
            exact = (near * queries[i]).sum(axis=1) / (np.sqrt((near * near).sum(axis=1)) * np.sqrt((queries[i] * queries[i]).sum()))
            best: dict[int, float] = {}
            for row in np.lexsort((self.ids[rows], -exact)):
                best.setdefault(int(self.ids[rows[row]]), float(exact[row]))
                if len(best) == k:
                    break
            out += [(int(query_ids[i]), v, s) for v, s in best.items()]
        return out


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def by_length(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, pa.RecordBatch | pa.Table]]:
    """The rows of each length of vectors; only those can be compared."""
    lengths = pc.list_value_length(rows["vec"])
    for dims in sorted(pc.unique(lengths).to_pylist()):
        yield dims, rows.filter(pc.equal(lengths, dims))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, vec``: rows with an id and a vector that is not zero and has only finite components."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vec", lambda v: v != 0))


def build(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The stored index, ``vec_id, vec, strings``, of every usable vector; each length has rotations of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, rows in by_length(batch):
                hashes = Hashes(dims)
                if dims not in rotations:
                    rotations = {dims: hashes.rotations()}  # one at a time: they are large
                strings = hashes.strings(matrix(rows["vec"], dims), rotations[dims])
                lists = pa.ListArray.from_arrays(np.arange(0, strings.size + 1, hashes.trees, dtype=np.int32), strings.ravel())
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], ["vec_id", "vec", "strings"])

    return materialize(usable(df, key, vector).mapInArrow(run, "vec_id long, vec array<double>, strings array<long>"), "forest")


def search(index: DataFrame, queries: DataFrame, k: int = 5, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest by cosine of every row of ``queries`` (``vec_id, vec, strings``).

    The trees of a block ascend until there are as many candidates as a sample of its rows needs to find
    ``recall`` of their neighbours; above 1, that is all rows.

    Vectors are compared with those of their own length. Rows with the query's own id are no candidates; of
    rows that repeat an id the nearest counts, and a repeated query is asked once. Equal scores go by the smaller
    id. Without usable vectors there are no rows.
    """
    spark = index.sparkSession
    asked = queries.dropDuplicates(["vec_id"])
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    folder = new_folder(spark, "nearest")
    for i in range(parts):  # as many scans of the index as there are parts of bounded size
        table = asked.where(part == i).toArrow().combine_chunks()
        by_dims = {
            dims: (rows["vec_id"].to_numpy(), matrix(rows["vec"].combine_chunks(), dims), np.asarray(rows["strings"].combine_chunks().flatten()).reshape(len(rows), -1))
            for dims, rows in by_length(table)
        }
        sent = spark.sparkContext.broadcast(by_dims)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            def answers(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for dims, rows in by_length(pa.Table.from_batches(block).combine_chunks()):
                    if dims not in sent.value:
                        continue
                    own = np.asarray(rows["strings"].combine_chunks().flatten()).reshape(len(rows), -1)
                    forest = Forest(rows["vec_id"].to_numpy(), matrix(rows["vec"].combine_chunks(), dims), own, Hashes(dims).bits, k, recall)
                    found = forest.nearest(*sent.value[dims], k)
                    q, v, s = zip(*found) if found else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

            block, size = [], 0
            for batch in batches:
                if batch.num_rows:
                    block.append(batch)
                    size += batch.num_rows
                if size >= BLOCK_ROWS:
                    yield from answers(block)
                    block, size = [], 0
            if block:
                yield from answers(block)

        near = index.mapInArrow(run, "query_id long, vec_id long, score double")
        best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
        # neither the driver nor the executors hold more than one part
        sent.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score double").parquet(folder)

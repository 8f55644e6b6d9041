"""Texts of an Arrow batch as one byte array, and the words in it, without a Python loop per word.

A word is a longest run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return. Those are single bytes in UTF-8, so words are found on bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 20  # of text that one numpy step works on; a longer text is a step of its own
TEXT_KINDS = (pa.types.is_string, pa.types.is_binary, pa.types.is_large_string, pa.types.is_large_binary)
WORD_GAPS = (0x20, *range(0x09, 0x0E))
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))

_is_gap = np.zeros(256, bool)
_is_gap[list(WORD_GAPS)] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def map_batches(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, chunk_bytes: int | None = None
) -> DataFrame:
    """``step`` over every Arrow batch, cut so that one call sees about ``chunk_bytes`` of text (``CHUNK_BYTES`` if not given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, chunk_bytes):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out
        # a worker lives on after its task, and so would what Arrow keeps for the next batch
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def text_chunks(batch: pa.RecordBatch, chunk_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch by the bytes of its string columns; an empty batch gives none."""
    chunk_bytes = CHUNK_BYTES if chunk_bytes is None else chunk_bytes
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if any(is_kind(column.type) for is_kind in TEXT_KINDS):
            size += np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    at = 0
    total = np.cumsum(size)
    while at < batch.num_rows:
        done = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + chunk_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as bytes, and the ``n + 1`` places where they begin; null counts as empty."""
    if pa.types.is_large_string(column.type):  # if the session asks Arrow for 64-bit offsets
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(bounds), np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the longest runs of true values, which stop where a text does."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate(([False], inside[:-1]))
    before[bounds[:-1][bounds[:-1] < len(inside)]] = False
    after = np.concatenate((inside[1:], [False]))
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


class Words:
    """Words of the texts of one column: byte spans, the text each is in, and 64-bit hashes."""

    def __init__(self, column: pa.Array):
        self.data, self.bounds = text_bytes(column)
        self.starts, self.ends = runs(~_is_gap[self.data], self.bounds)
        self.first = np.searchsorted(self.starts, self.bounds)  # of each text, in the list of words
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(column)), self.counts)
        self._hashed: dict[int, np.ndarray] = {}

    def hashes(self, seed: int = 0) -> np.ndarray:
        if seed not in self._hashed:
            self._hashed[seed] = span_hashes(self.data, self.starts, self.ends, seed)
        return self._hashed[seed]

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each ``size`` consecutive words of one text, and the place of its first word."""
        n = len(self.starts)
        if n < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[size - 1 :] == self.text[: n - size + 1])
        return sequence_hashes(self.hashes(seed), at, at + size, seed), at

    def joined(self, text: int, keep: np.ndarray | None = None) -> bytes:
        """The (kept) words of one text with a space between."""
        lo, hi = self.first[text], self.first[text + 1]
        chosen = np.arange(lo, hi) if keep is None else lo + np.flatnonzero(keep[lo:hi])
        return join_spans(self.data, self.starts[chosen], self.ends[chosen])


def join_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, glue: int = 0x20) -> bytes:
    if not len(starts):
        return b""
    length = ends - starts + 1
    total = np.cumsum(length)
    source = np.arange(total[-1]) + np.repeat(starts - (total - length), length)
    out = data[np.minimum(source, len(data) - 1)]
    out[total - 1] = glue
    return out[:-1].tobytes()


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2^64."""
    have = _powers.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 18)
        m = MULTIPLIERS[seed]
        inverse = np.uint64(pow(int(m), -1, 1 << 64))
        have = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x)))) for x in (m, inverse))
        if size <= CHUNK_BYTES * 2:
            _powers[seed] = have
    return have


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for each span: a polynomial read off one running sum, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(seed, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the bytes of each span."""
    return sequence_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends, seed)


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return values.view(np.int64)


def text_only(df: DataFrame, key: str, text: str) -> DataFrame:
    """The two columns an operator works on, under names that cannot clash with others in ``df``."""
    return df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

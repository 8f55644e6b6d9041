"""Best-fit packing of documents into sequences, large items matched first.

Documents become token pieces; only documents longer than a sequence are cut. How many sequences of
which make-up are needed depends on the number of pieces of each length alone, so the plan is made
on that histogram: at most ``capacity`` counts, whatever the number of documents.

* Pieces above a third of the capacity fit at most twice into a sequence. From the longest down, each
  is paired with the longest other that still fits beside it.
* Smaller pieces, from the longest down, go where the least room is left that holds them; when no gap
  does, a new sequence is opened.

Every step places as many equal pieces at once as it can, so a plan has a few thousand kinds of
sequences. A piece finds its place by its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from . import arrow
from .tokenizer_file import TokenizerFile
from .word_bpe import word_coder

CAPACITY = 4096
END_ID = 1
GROUP_ROWS = 50_000  # pieces of one length that are numbered in one group, about

PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, file: TokenizerFile, capacity: int = CAPACITY, end_id: int = END_ID,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``; a null text is empty, and an empty one is its end id alone."""
    end = end_id.to_bytes(4, "little")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, number, crc, length = [], [], [], []
        for i, t in enumerate(batch["text"].to_pylist()):
            ids = word_coder(file).encode(t or "") + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                row.append(i)
                number.append(k)
                crc.append(zlib.crc32(part))
                length.append(len(part) // 4)
        number = np.array(number, np.int64)
        columns = [
            batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(number * capacity),
            pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = arrow.text_only(df, key, text)
    return arrow.map_batches(rows, step, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECES}")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences as ``(lengths in order, how many)``, for so many pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    kinds: dict[int, list[list]] = {}  # by room: [lengths, how many]
    done: list[tuple[tuple[int, ...], int]] = []
    rooms: list[int] = []  # rooms of kinds, ascending

    def put(lengths: tuple[int, ...], many: int) -> None:
        room = capacity - sum(lengths)
        if room <= 0:
            done.append((lengths, many))
            return
        if room not in kinds:
            kinds[room] = []
            insort(rooms, room)
        kinds[room].append([lengths, many])

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        if at < 0:
            put((n,), left[large.pop()])
            continue
        other = large[at]
        many = left[n] // 2 if other == n else min(left[n], left[other])
        if many == 0:  # one piece is left that fitted only beside its like
            if at == 0:
                put((n,), left[large.pop()])
                continue
            other = large[at - 1]
            many = 1
        put((n, other), many)
        for m in (n, other):
            left[m] -= many
        large = [m for m in large if left[m]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        many = left[n]
        while many:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = min(capacity // n, many)
                put((n,) * each, many // each)
                many %= each
                continue
            room = rooms[at]
            lengths, have = kinds[room].pop()
            if not kinds[room]:
                del kinds[room], rooms[at]
            # as many of this length as the gap holds, in as many sequences as there are pieces for
            each = min(room // n, many)
            used = min(have, many // each)
            if have > used:
                if room not in kinds:
                    kinds[room] = []
                    insort(rooms, room)
                kinds[room].append([lengths, have - used])
            put(lengths + (n,) * each, used)
            many -= used * each
    return done + [(tuple(lengths), many) for some in kinds.values() for lengths, many in some]


class Places:
    """The plan as arrays: which numbers of a length go to which run of sequences, and where in them."""

    def __init__(self, kinds: list[tuple[tuple[int, ...], int]]):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        seen: dict[int, int] = {}
        base = 0
        for lengths, many in kinds:
            at = 0
            for n in lengths:
                first = seen.get(n, 0)
                rows.setdefault(n, []).append((first, base, at))
                seen[n] = first + many
                at += n
            base += many
        self.sequences = base
        self.by_length = {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in rows.items()}

    def find(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else ():
            first, base, at = self.by_length[int(lengths[some[0]])]
            k = np.searchsorted(first, numbers[some], side="right") - 1
            sequence[some] = base[k] + numbers[some] - first[k]
            offset[some] = at[k]
        return sequence, offset


def pack(df: DataFrame, file: TokenizerFile, capacity: int = CAPACITY, end_id: int = END_ID,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece.

    Repeated rows are packed each; null keys are kept. An empty table gives an empty plan and no rows.
    """
    spark = df.sparkSession
    # stored, since the numbers below have to be those of the same rows as the counts
    stored = materialize(pieces(df, file, capacity, end_id, key, text), "pieces")
    total = stored.count()
    shares = max(1, -(-total // GROUP_ROWS))
    share = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares))
    stored = stored.withColumn("_share", share)
    sizes = stored.groupBy("length", "_share").agg(F.count("*").alias("_rows"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_rows").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_share", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    in_share = Window.partitionBy("length", "_share").orderBy("doc_id", "piece")
    numbered = (
        stored.withColumn("_number", F.row_number().over(in_share) - 1)
        .join(starts, ["length", "_share"])
        .withColumn("_number", F.col("_number") + F.col("_before"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "_number")
    )

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sequence, offset = places.value.find(batch["length"].to_numpy(), batch["_number"].to_numpy())
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"]
        )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(lambda batches: map(step, batches), f"doc_id {kind}, {PIECES}, sequence_id long, offset long")

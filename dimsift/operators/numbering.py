"""Consecutive numbers over a whole table, without passing it through one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

# monotonically_increasing_id keeps the partition above bit 33 and the row number below it.
ROW_BITS = 33


def dense_offsets(df: DataFrame, order: Sequence[Column | str], into: str = "offset") -> DataFrame:
    """Number the rows 0..N-1 in ``order``.

    The order has to be given: rows that are read from several files come in no order of their own.

    A range partitioning sorts the table in parallel. The rows are stored with their place in
    their partition, so that later stages see the same places; only the partition sizes, one row
    per partition, meet in one task.
    """
    if not order:
        raise ValueError("name the columns that give the order")
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(df.withColumn("_at", F.monotonically_increasing_id()), "offsets")
    placed = placed.withColumn("_part", F.shiftrightunsigned("_at", ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    local = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    # one row per partition of the table above: a count of tasks, not of data
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(into, F.col("_start") + local)
        .drop("_at", "_part", "_start")
    )


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with whole numbers summed up, per key, from its first row in ``order`` to the row itself.

    One key may hold any share of the rows. A range partitioning sorts the table in parallel, and every task sums
    up what it has of each key. Only the first key of a partition can go on from the one before, so a
    row per partition tells what to add to it. The table is sorted and stored once, whatever the number of sums.
    """
    names = list(sums)
    group = F.to_json(F.struct(*keys))  # tells null from empty, and keys of several columns apart
    df = df.withColumns({n: c.cast("long") for n, c in sums.items()})
    sorted_rows = df.repartitionByRange(*map(F.col, keys), *order).sortWithinPartitions(*map(F.col, keys), *order)
    numbered = sorted_rows.withColumns({"_at": F.monotonically_increasing_id(), "_group": group})

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, totals, in_first = None, np.zeros(len(names), np.int64), True
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch["_group"]
            new = np.ones(batch.num_rows, bool)
            new[0] = groups[0].as_py() != last
            new[1:] = pc.not_equal(groups.slice(1), groups.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            of = np.cumsum(new)  # 0 where the last batch's key goes on
            first = (of == (0 if last is not None else 1)) & in_first
            columns = []
            for i, name in enumerate(names):
                total = np.cumsum(batch[name].to_numpy())
                before = np.concatenate(([-totals[i]], total[starts] - batch[name].to_numpy()[starts]))
                columns.append(total - before[of])
                totals[i] = columns[-1][-1]
            in_first, last = bool(first[-1]), groups[-1].as_py()
            for name, values in zip(names, columns):
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(values))
            yield batch.append_column("_first", pa.array(first))

    inner = numbered.schema.simpleString()[len("struct<"):-1]
    local = materialize(numbered.mapInArrow(add_up, f"{inner},_first:boolean"), "running-sums")
    local = local.withColumn("_part", F.shiftrightunsigned("_at", ROW_BITS))
    edges = local.groupBy("_part").agg(
        F.min_by("_group", "_at").alias("_from"), F.max_by(F.struct("_group", *names), "_at").alias("_last")
    )
    # what a partition's last key has so far: one row per partition from here on
    so_far = Window.partitionBy("_last._group").orderBy("_part")
    ends = edges.select("_part", "_from", F.col("_last._group").alias("_to"), *[F.sum(f"_last.{n}").over(so_far).alias(n) for n in names])
    before = Window.orderBy("_part")
    goes_on = F.lag("_to").over(before) == F.col("_from")
    carried = ends.select("_part", *[F.when(goes_on, F.lag(n).over(before)).otherwise(0).alias(f"_carried_{n}") for n in names])
    return (
        local.join(F.broadcast(carried), "_part")
        .withColumns({n: F.col(n) + F.when(F.col("_first"), F.col(f"_carried_{n}")).otherwise(0) for n in names})
        .drop("_at", "_group", "_first", "_part", *[f"_carried_{n}" for n in names])
    )


def places_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], into: str) -> DataFrame:
    """1-based place of each row within its key; one key may hold any share of the rows."""
    return running_sums(df, keys, order, {into: F.lit(1)}).withColumn(into, F.col(into).cast("int"))

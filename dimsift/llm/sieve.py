"""Bits that tell, for a key, that it is not in a set; sent to tasks, with a bound on their number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24  # at least: 2 MB
MOST_BITS = 1 << 30  # 128 MB; beyond about a tenth as many keys, a sieve lets more rows through, and loses none
BITS_PER_KEY = 10


class Sieve:
    def __init__(self, keys: DataFrame):
        """``keys`` has a column ``key`` of longs that are already well mixed."""
        wanted = min(MOST_BITS, keys.count() * BITS_PER_KEY)
        bits = max(BITS, 1 << max(0, wanted - 1).bit_length())
        at = F.shiftright(F.pmod("key", F.lit(bits)), 6).cast("int").alias("at")
        bit = F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) % 64 AS int))").alias("bit")
        self.bits = np.zeros(bits // 64, np.uint64)
        for batch in keys.select(at, bit).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():
            self.bits[batch["at"].to_numpy()] = batch["bits"].to_numpy().view(np.uint64)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.int64) % (len(self.bits) * 64)
        return (self.bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

"""Arrow helpers that several operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.arrow import flat, rows_of, slices, strings

__all__ = ["bloom", "flat", "in_bloom", "rows_of", "slices", "strings"]

#: The largest Bloom filter, in bits (16 MB); sixteen bits a key at least.
MOST_BITS = 1 << 27


def bloom(df: DataFrame, hashed: Column) -> np.ndarray | None:
    """A Bloom filter over 64-bit hashes, sized by their count: 16 to 32 bits a key, two hashes (1.5 % pass wrongly at most).

    Null if the largest filter would be too small: the caller then has another
    way. What it lets through wrongly is removed by the join that follows it.
    """
    h = df.select(hashed.alias("h"))
    bits = 1 << 14
    n = h.count()
    while bits < 16 * n:
        bits *= 2
    if bits > MOST_BITS:
        return None
    pos = h.select(F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))).alias("p"))
    words = pos.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m")).toPandas()
    out = np.zeros(bits // 64, "i8")
    out[words["w"].to_numpy(dtype="i8")] = words["m"].to_numpy(dtype="i8")
    return out.view("u8")


def in_bloom(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash (u8) may be in the filter."""
    mask = np.uint64(64 * len(bits) - 1)
    hit = np.ones(len(h), bool)
    for p in (h & mask, (h >> np.uint64(32)) & mask):
        hit &= (bits[(p >> np.uint64(6)).astype("i8")] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return hit

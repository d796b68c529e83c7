"""A Bloom filter of bounded size over 64-bit keys, filled by Spark, broadcast to tasks as a bit map.

Its size is a parameter, not a function of the data: past its capacity it passes more keys, and whatever follows it
still decides exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2 ** 23 bits are a broadcast of 1 MB.
BITS = 23


def fill(keys: DataFrame, column: str, bits: int = BITS) -> bytes:
    """The bit map of the keys, with two bits a key. At most 2 ** bits / 64 words reach the driver."""
    key = F.col(column)
    spots = keys.where(key.isNotNull()).select(
        F.explode(F.array(key.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(key, 64 - bits))).alias("spot")
    )
    words = (
        spots.groupBy(F.shiftright("spot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(spot & 63))")).alias("mask"))
        .toPandas()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    return out.tobytes()


def holds(bitmap: bytes, keys: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit keys may be in the filter."""
    words = np.frombuffer(bitmap, np.uint64)
    bits = int(len(words) * 64).bit_length() - 1
    found = np.ones(len(keys), bool)
    for spot in (keys & np.uint64((1 << bits) - 1), keys >> np.uint64(64 - bits)):
        found &= (words[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def sift(df: DataFrame, column: str, bitmap: bytes) -> DataFrame:
    """The rows of df whose key may be in the filter."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(holds(bitmap, keys)))

    return df.mapInArrow(pick, df.schema)

"""A Bloom filter of 64-bit ids for broadcasting, sized by their number up to MOST_BITS.

It spares work and never decides: an id that passes by mistake drops out of the exact join
behind it. Beyond MOST_BITS / 16 ids it lets more and more pass, and spares less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sketch import CHUNK, chunks, merged, unpacked
from .words import mix

#: Powers of two: the fewest bits, and the most (2**27 bits, 16 MB).
LEAST_BITS, MOST_BITS = 20, 27
#: Ids up to which one in seventy of the others passes.
CAPACITY = 1 << (MOST_BITS - 4)


class Bloom:
    """Ids, two bits each, in 2**k bits."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.k = bits, int(len(bits) * 8).bit_length() - 1

    @staticmethod
    def empty(ids: int) -> Bloom:
        k = min(max((max(ids, 1) * 16 - 1).bit_length(), LEAST_BITS), MOST_BITS)
        return Bloom(np.zeros(1 << (k - 3), np.uint8))

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(ids.astype(np.int64).view(np.uint64), 7)
        return h >> np.uint64(64 - self.k), (h >> np.uint64(5)) & np.uint64((1 << self.k) - 1)

    def add(self, ids: np.ndarray) -> None:
        for p in self.places(ids):
            np.bitwise_or.at(self.bits, p >> np.uint64(3), (np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, ids: np.ndarray) -> np.ndarray:
        a, b = self.places(ids)
        return ((self.bits[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (self.bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def bloom_of(ids: DataFrame, n: int | None = None) -> Bloom:
    """A filter of the `n` ids of a stored one-column table: tasks send the parts of their bits that aren't zero."""
    n = ids.count() if n is None else n

    def run(batches):
        mine = Bloom.empty(n)
        for batch in batches:
            mine.add(batch.column(0).to_numpy(zero_copy_only=False))
        for k, blob in chunks(mine.bits, np.uint8):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "blob"])

    out = Bloom.empty(n)
    parts = ids.mapInArrow(run, "chunk int, blob binary").withColumn("source", F.spark_partition_id())
    for r in merged(parts, np.uint8, np.bitwise_or, ids.rdd.getNumPartitions()).collect():
        out.bits[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = unpacked(bytes(r["blob"]), np.uint8)
    return out

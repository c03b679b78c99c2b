"""Arrays that all tasks add to, merged in a tree, and a count sketch on top of them.

A task cuts its array into chunks and sends those that hold anything. Chunks of FAN tasks
are added up at a time, and the sums of FAN such groups again, so that the work of one
merging task doesn't grow with the number of tasks that send.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix

CHUNK, FAN = 1 << 16, 256
PART = "chunk int, source int, blob binary"


def packed(part: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(part.view(np.uint8).reshape(-1, part.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob, CHUNK * width, codec="zstd", asbytes=True), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def chunks(values: np.ndarray, kind) -> Iterator[tuple[int, bytes]]:
    """(chunk, blob) of the chunks that aren't zero."""
    for k in range(0, len(values), CHUNK):
        if (part := values[k : k + CHUNK]).any():
            yield k // CHUNK, packed(part.astype(kind))


def merged(parts: DataFrame, kind, add: Callable[[np.ndarray, np.ndarray], np.ndarray], sources: int) -> DataFrame:
    """One row a chunk, from (chunk, source, blob); sources are numbers of tasks, all below `sources`."""

    def run(batches):
        at, total = None, None
        for batch in batches:
            for k, s, blob in zip(batch.column("chunk").to_pylist(), batch.column("source").to_pylist(), batch.column("blob"), strict=True):
                part = unpacked(blob.as_buffer(), kind)
                if at == (k, s):
                    total = add(total, part)
                    continue
                if at is not None:
                    yield row(*at, total)
                at, total = (k, s), part
        if at is not None:
            yield row(*at, total)

    def row(k, s, total):
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s], pa.int32()), pa.array([packed(total)], pa.binary())], ["chunk", "source", "blob"])

    while True:
        sources = -(-sources // FAN)
        parts = parts.withColumn("source", F.floor(F.col("source") / FAN).cast("int"))
        parts = parts.repartition("chunk", "source").sortWithinPartitions("chunk", "source").mapInArrow(run, PART)
        if sources == 1:
            return parts.select("chunk", "blob")


def saturating(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a + b < a, np.uint32(2**32 - 1), a + b)


class Levels:
    """Value -> level of frequency (log2, rounded up), a byte for each counter of a sketch. Level 0 is exact: no other row has the value."""

    def __init__(self, levels: np.ndarray):
        self.levels, self.shift = levels, np.uint64(64 - (len(levels).bit_length() - 1))

    @staticmethod
    def of(parts: DataFrame, bits: int) -> Levels:
        """From a stored table of the tasks' uint32 counters; a byte for each counter comes to the driver."""

        def run(batches):
            for batch in batches:
                found = [np.ceil(np.log2(np.maximum(unpacked(x.as_buffer(), np.uint32), 1))).astype(np.uint8).tobytes() for x in batch.column("blob")]
                yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(found, pa.binary())], ["chunk", "levels"])

        levels = np.zeros(1 << bits, np.uint8)
        sources = (parts.agg(F.max("source")).first()[0] or 0) + 1
        for r in merged(parts, np.uint32, saturating, sources).mapInArrow(run, "chunk int, levels binary").collect():
            levels[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["levels"]), np.uint8)
        return Levels(levels)

    def key(self, h: np.ndarray, order: int) -> np.ndarray:
        """Rank of each value in one of the orders that put frequent values last."""
        level = self.levels[h >> self.shift].astype(np.uint64)
        return (level << np.uint64(58)) | (mix(h, order + 1) >> np.uint64(6))


def counted(counts: np.ndarray, h: np.ndarray) -> None:
    """Adds values to a task's counters."""
    bits = len(counts).bit_length() - 1
    np.add.at(counts, (h >> np.uint64(64 - bits)).astype(np.int64), counts.dtype.type(1))

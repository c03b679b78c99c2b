"""Exact top-k inner products with a vector-approximation file.

Vectors are made integers, floor(scale * x), and stored twice: exactly, by row number, and
as the approximation file, one byte a component. The byte is a cell of a fixed grid: 192
cells of one width around zero, that width a power of two taken from the typical size of
the components, and on either side cells four times as wide each, up to the largest
number; so one extreme vector widens no other's cells.

1.  The cells are scanned where they lie, and nothing else of the vectors; the queries go
    past them in bounded groups (asked.py). A cell's corners bound every score from both
    sides. A task keeps each query's k largest lower bounds so far, and passes on the
    vectors whose upper bound reaches the k-th of them.
2.  The k-th largest lower bound over all tasks is the floor of a query; vectors whose
    upper bound is below it go.
3.  Exact vectors are fetched by row number in the order of their upper bounds, best first,
    in rounds; a round ends when no vector is left whose bound reaches the k-th exact score.

The query set is stated by a predicate; every query meets every vector's cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asked import answers
from .shared import Shelf

#: Queries, and vectors, that one matrix product takes at a time.
STRIP, ROWS = 128, 8192
#: Cells of one width on either side of zero, and cells beyond them.
LINEAR, WIDE = 96, 32


def edges(step: int) -> np.ndarray:
    """The smallest integer of each of the 256 cells."""
    wide = [min(LINEAR * step * 4**k, 1 << 62) for k in range(WIDE)]
    low = [-(1 << 63), *[-x for x in reversed(wide[1:])]]
    return np.array([*low, *(step * np.arange(-LINEAR, LINEAR)), *wide], np.int64)


def bounds(step: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and half width of each cell."""
    low = edges(step).astype(float)
    high = np.append(low[1:], float(1 << 63)) - 1
    return (low + high) / 2, (high - low) / 2


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


class Scan:
    """Queries of one length, one grid, and the k largest lower bounds that each has met."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, step: int, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.centre, self.half = bounds(step)
        self.largest = np.abs(queries).max(initial=0)
        self.lowest = np.full((len(ids), k), -np.inf)

    def of(self, cells: np.ndarray, ids: np.ndarray):
        """(place of the query, place of the vector, upper bound, lower bound) of what cells can't rule out, strip by strip."""
        used, k = np.unique(cells), self.k
        most = float(np.abs(self.centre[used]).max(initial=0) + self.half[used].max(initial=0)) * float(self.largest) * max(cells.shape[1], 1)
        # Half integers are exact in these types up to here; beyond, bounds are widened by more than sums can be off.
        kind = np.float32 if most < 2**22 else np.float64
        middle, reach = self.centre.astype(kind)[cells].T, self.half.astype(kind)[cells].T if self.half[used].any() else None
        guard = most * 1e-12 if most >= 2**51 else 0.0
        for at in range(0, len(self.queries), STRIP):
            q, held = self.queries[at : at + STRIP].astype(kind), self.lowest[at : at + STRIP]
            score = (q @ middle).astype(float)
            slack = (np.abs(q) @ reach).astype(float) + guard if reach is not None else guard
            lower, upper = score - slack, score + slack
            own = self.ids[at : at + STRIP, None] == ids[None, :]
            lower[own] = upper[own] = -np.inf
            top = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k :] if len(ids) > k else lower
            both = np.concatenate([held, top], axis=1)
            held[:] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
            r, c = np.nonzero((upper >= held.min(axis=1)[:, None]) & ~own)
            if len(r):
                yield r + at, c, upper[r, c], lower[r, c]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best by integer inner product, ties to smaller ids.

    Rows without id or vector, and vectors with a null or non-finite component, take no
    part; only vectors of a query's own length are its candidates, empty ones (whose scores
    are all 0) those of an empty query; rows with the query's own id aren't. Rows with one
    id are separate candidates and one query each; a query that stands in the table several
    times is answered once for each different vector.
    An empty table gives an empty result; other columns play no part. Scores beyond 64
    bits are outside the exact range.
    """
    spark, shelf = vectors.sparkSession, Shelf(vectors.sparkSession, "topk")
    good = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    exact = shelf.put(rows.select(F.monotonically_increasing_id().alias("row"), "id", "asks", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(F.lit(scale) * x)).alias("v")), "exact")
    typical = F.avg(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.log2(1.0 + F.abs(x.cast("double")))) / F.greatest("dim", F.lit(1)))
    dims = exact.groupBy("dim").agg(F.count_if("asks").alias("asked"), typical.alias("size"))
    # 192 cells hold twelve times the typical component on either side.
    step = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2((F.pow(F.lit(2.0), "size") - 1) * 12 / LINEAR)), F.lit(0))).cast("long")
    dims = shelf.put(dims.where("asked > 0").select("dim", F.when(F.col("size") > 0, step).otherwise(F.lit(1)).alias("step")), "dims")

    def approximated(batches):
        for batch in batches:
            keys = np.stack([batch.column("dim").to_numpy(), batch.column("step").to_numpy()], axis=1)
            for dim, step in np.unique(keys, axis=0).tolist():
                some = batch.filter(pa.array((keys == [dim, step]).all(axis=1)))
                cells = (np.searchsorted(edges(step), _matrix(some.column("v"), dim), "right") - 1).astype(np.uint8)
                offsets = np.arange(len(cells) + 1, dtype=np.int32) * dim
                blobs = pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(offsets), pa.py_buffer(cells.tobytes())])
                yield pa.RecordBatch.from_arrays([some.column("row"), some.column("id"), some.column("dim"), blobs], ["row", "id", "dim", "cells"])

    cells = shelf.put(exact.join(dims, "dim").select("row", "id", "dim", "step", "v").mapInArrow(approximated, "row long, id long, dim int, cells binary"), "cells")
    queries = exact.where("asks").groupBy("id", "v", "dim").agg(F.min("row").alias("q"))
    queries = shelf.put(queries.join(dims, "dim"), "queries")

    def scanned(asked: pa.Table, batches):
        sides = {}
        for dim in set(asked.column("dim").to_pylist()):
            some = asked.filter(pa.array(asked.column("dim").to_numpy() == dim))
            sides[dim] = some.column("q").to_numpy(), Scan(some.column("id").to_numpy(), _matrix(some.column("v"), dim), some.column("step")[0].as_py(), k)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in sides:
                    continue
                own = batch.filter(pa.array(dims == dim))
                for at in range(0, own.num_rows, ROWS):
                    some = own.slice(at, ROWS)
                    rows, ids = some.column("row").to_numpy(), some.column("id").to_numpy()
                    grid = np.frombuffer(b"".join(some.column("cells").to_pylist()), np.uint8).reshape(len(ids), dim)
                    qs, scan = sides[dim]
                    for a, b, upper, lower in scan.of(grid, ids):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qs[a], rows[b], ids[b], upper, lower)], ["q", "row", "id", "upper", "lower"])

    found = answers(queries, cells, "q", "8 * dim + 64", scanned, "q long, row long, id long, upper double, lower double", shelf, "scanned")
    shelf.drop("cells")

    def kth(rows: DataFrame, by: str, name: str) -> DataFrame:
        """(q, name): the k-th largest value of each query that has so many."""
        order = Window.partitionBy("q").orderBy(F.col(by).desc())
        return rows.select("q", by, F.row_number().over(order).alias("_n")).where(F.col("_n") == k).select("q", F.col(by).alias(name))

    left = found.join(kth(found, "lower", "floor"), "q", "left").where("floor is null or upper >= floor")
    order = Window.partitionBy("q").orderBy(F.col("upper").desc(), "id", "row")
    left = shelf.put(left.select("q", "row", "id", "upper", F.row_number().over(order).alias("n")), "left")
    shelf.drop("scanned")
    asks = queries.select("q", F.col("id").alias("query_id"), F.col("v").alias("qv"))
    done, read, size = [], 0, k
    while True:
        # The next `size` of each query; after the first round only those whose bound reaches its k-th score so far.
        now = left.where((F.col("n") > read) & (F.col("n") <= read + size))
        now = now.join(exact.select("row", "v"), "row").join(asks, "q")
        score = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
        done.append(shelf.put(now.select("q", "query_id", F.col("id").alias("vec_id"), score.alias("score")), f"scored{len(done)}"))
        scored = done[0]
        for more in done[1:]:
            scored = scored.unionByName(more)
        rest = left.where(F.col("n") > read + size).join(kth(scored, "score", "reached"), "q", "left").where("reached is null or upper >= reached").drop("reached")
        read, size = read + size, size * 4
        left = shelf.put(rest, f"left{len(done)}")
        if left.isEmpty():
            break
    best = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

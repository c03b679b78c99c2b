"""K-means over integer vectors with a Walsh-Hadamard progressive search.

A Walsh-Hadamard transform of length d multiplies squared distances by d, exactly and in
integers. Its coefficients are ordered from coarse to fine, by the sign changes of their
rows. The search for a vector's nearest centroid adds up squared differences of
coefficients block by block. After each block the centroid that leads is finished, which
gives a distance that the nearest can't exceed; what is left of any distance is at least
the squared difference of the two remaining norms, so that a centroid whose least possible
distance is strictly above the leader's goes. The others finish all coefficients, which
gives the exact distance; ties go to the smaller number.

Vectors are stored once and stay where they lie: a round broadcasts the centroids (k rows),
and each task sends a sum and a count for each cluster, whatever the sizes of clusters are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shelf

#: The largest integer component: squared distances stay within 64 bits.
LARGEST = 1 << 27
#: Up to here doubles hold all sums of a search exactly; Python integers take over beyond.
DOUBLES = 1 << 17
#: Rows of a batch that are searched at a time.
STRIP = 4096


def walsh(dim: int) -> np.ndarray:
    """The Hadamard matrix of a power of two, rows ordered by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < dim:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def _ends(dim: int) -> list[int]:
    """Where blocks of coefficients end: each as long as all before it."""
    ends = [min(4, dim)]
    while ends[-1] < dim:
        ends.append(ends[-1] * 2)
    return ends


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of each vector, and how many pairs finished all coefficients."""
    dim = v.shape[1]
    kind = np.float64 if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= DOUBLES else object
    h = walsh(dim).astype(kind)
    a, b = v.astype(kind) @ h.T, c.astype(kind) @ h.T
    # Norms of what stands behind each coefficient, for bounds only; bounds are widened by more than rounding can take.
    left = [np.sqrt(np.cumsum((x.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]) for x in (a, b)]
    r, k = (x.ravel() for x in np.indices((len(v), len(c))))
    sums, begin, most = np.zeros(len(r), kind), 0, np.full(len(v), np.inf)
    for end in _ends(dim):
        if begin:
            sums = sums + ((a[r, begin:end] - b[k, begin:end]) ** 2).sum(axis=1)
        else:
            sums = ((a[:, :end] ** 2).sum(axis=1)[:, None] + (b[:, :end] ** 2).sum(axis=1)[None, :] - 2 * (a[:, :end] @ b[:, :end].T)).ravel()
        begin = end
        if end < dim and len(r):
            so_far = sums.astype(float)
            order = np.lexsort((so_far, r))
            lead = order[np.searchsorted(r[order], np.arange(len(v)))]
            finished = so_far[lead] + ((a[:, end:] - b[k[lead], end:]).astype(float) ** 2).sum(axis=1)
            most = np.minimum(most, finished * (1 + 1e-9) + 1)
            keep = (so_far + (left[0][r, end] - left[1][k, end]) ** 2) * (1 - 1e-9) - 1 <= most[r]
            r, k, sums = r[keep], k[keep], sums[keep]
    exact = np.array([int(x) // dim for x in sums], np.int64) if kind is object else sums.astype(np.int64) // dim
    order = np.lexsort((k, exact, r))
    first = order[np.searchsorted(r[order], np.arange(len(v)))]
    return k[first], exact[first], len(r)


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _assigned(batches, centroids: np.ndarray):
    """(batch, first row, clusters, distances, vectors), strip by strip."""
    for batch in batches:
        v = _vectors(batch, centroids.shape[1])
        for at in range(0, len(v), STRIP):
            some = v[at : at + STRIP]
            yield batch, at, *nearest(some, centroids)[:2], some


def _next(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; a cluster without vectors keeps its centroid."""
    sent, (k, dim) = vectors.sparkSession.sparkContext.broadcast(centroids), centroids.shape

    def run(batches):
        totals, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, _, cluster, _, v in _assigned(batches, sent.value):
            np.add.at(totals, cluster, v)
            counts += np.bincount(cluster, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(own))), pa.array(totals[own].ravel()), pa.array(np.repeat(counts[own], dim))], ["cluster", "place", "total", "n"])

    sums = vectors.select("v").mapInArrow(run, "cluster int, place int, total long, n long").groupBy("cluster", "place")
    out = centroids.copy()
    for r in sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    sent.unpersist()
    return out


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of `dim` components (a power of two).

    Components are floor(scale * x). Vectors that are null, of another length, or hold a
    null or non-finite component are left out. Centroids start as the k vectors with the
    smallest sha256 of "seed:id"; each round assigns every vector to its nearest centroid
    and moves the centroids to the floors of their means; at the end vectors are assigned
    once more. Fewer than k vectors make as many centroids. Rows with one id are separate
    vectors, and as starts stand in the order of their components; rows without an id are
    assigned but are no starts, and with no start the result is empty, as it is for an
    empty table. Equal vectors meet as ties of equal distance. Integers beyond 2**27 raise,
    as their distances leave 64 bits. Other columns play no part.
    """
    if dim & (dim - 1) or dim < 1:
        raise ValueError("the transform needs a power of two")
    spark, shelf = vectors.sparkSession, Shelf(vectors.sparkSession, "clusters")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("x"))
    finite = ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where((F.size("x") == dim) & finite).select("vec_id", F.transform("x", lambda x: F.floor(scale * x)).alias("v"))
    large = F.exists("v", lambda x: (x > LARGEST) | (x < -LARGEST))
    rows = shelf.put(rows.withColumn("v", F.when(large, F.raise_error(F.lit("a component is too large for distances of 64 bits"))).otherwise(F.col("v").cast("array<int>"))), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = rows.where("vec_id is not null").select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not starts:
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in starts], np.int64)
    for _ in range(rounds):
        centroids = _next(rows, centroids)
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch, at, cluster, distance, _ in _assigned(batches, sent.value):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(at, len(cluster)), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = shelf.put(rows.mapInArrow(assign, schema), "assigned")
    shelf.drop("vectors")
    total = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    every = sum(total.values())
    per = spark.createDataFrame([(c, t, every, digest[c]) for c, t in total.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # A row for each of the k clusters.
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

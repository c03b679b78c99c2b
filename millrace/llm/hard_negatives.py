"""Hard-negative mining with angular triangle filtering.

Each vector stores its norm and its angles to a few reference directions. By the triangle
inequality on the sphere, the angle between an anchor and a row is at least the largest
difference and at most the smallest sum of their angles to one reference; that interval's
cosines times both norms bound the score, widened by more than rounding can take. Only
pairs whose bounds overlap a window of scores that are still wanted get an integer score:

1.  Positives: rows of the anchor's label whose upper bound reaches the k-th best score
    seen by the task, or the k-th best lower bound of the batch.
2.  Negatives: rows of other labels whose bounds overlap a positive's window, above the
    best negatives that the task has already found for it.

Anchors meet the rows in bounded groups (asked.py); tasks pass on their few best for each
anchor or positive, and a window over those ranks them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asked import answers
from .shared import Shelf

#: Reference directions, and rows of the sample that they are chosen from.
REFERENCES, SAMPLE = 8, 1024
#: Anchors that meet a batch of rows at a time, and rows of that batch.
STRIP, ROWS = 128, 4096
#: Radians that stored angles can be off, and more.
SLACK = 1e-6


def references(sample: list[np.ndarray], dim: int) -> np.ndarray:
    """Unit vectors: sampled directions, each as far as can be from those before it; random ones where the sample has too few."""
    rows = [v / n for v in sample if len(v) == dim and (n := float(np.linalg.norm(v.astype(float)))) > 0]
    chosen: list[np.ndarray] = rows[:1]
    if rows:
        all_rows = np.array(rows)
        nearest = all_rows @ chosen[0]
        while len(chosen) < min(REFERENCES, len(rows)):
            chosen.append(all_rows[int(nearest.argmin())])
            nearest = np.maximum(nearest, all_rows @ chosen[-1])
    more = np.random.default_rng(dim).normal(size=(REFERENCES - len(chosen), dim)) if dim else np.zeros((REFERENCES - len(chosen), 0))
    chosen += [x / max(float(np.linalg.norm(x)), 1e-300) for x in more]
    return np.array(chosen).reshape(REFERENCES, dim)


def angles(v: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to each reference; vectors without a direction stand at right angles."""
    x = v.astype(float)
    norm = np.sqrt((x**2).sum(axis=1))
    cos = np.divide(x @ refs.T, norm[:, None], out=np.zeros((len(x), len(refs))), where=norm[:, None] > 0)
    return norm, np.arccos(np.clip(cos, -1, 1))


def bounds(norm_a: np.ndarray, angles_a: np.ndarray, norm_b: np.ndarray, angles_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that each pair can have."""
    low, high = np.zeros((len(norm_a), len(norm_b))), np.full((len(norm_a), len(norm_b)), np.pi)
    for r in range(angles_a.shape[1]):
        x, y = angles_a[:, r, None], angles_b[None, :, r]
        np.maximum(low, np.abs(x - y), out=low)
        both = x + y
        np.minimum(high, np.minimum(both, 2 * np.pi - both), out=high)
    size = norm_a[:, None] * norm_b[None, :]
    guard = size * 1e-9 + 1
    return size * np.cos(np.minimum(high + SLACK, np.pi)) - guard, size * np.cos(np.maximum(low - SLACK, 0)) + guard


def scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs of rows, exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 1 << 53 and len(i) * 8 > len(a) * len(b):
        return (a.astype(float) @ b.astype(float).T)[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        x, y = a[i[at : at + (1 << 16)]], b[j[at : at + (1 << 16)]]
        out[at : at + (1 << 16)] = (x * y).sum(axis=1) if most < 1 << 63 else (x.astype(object) * y.astype(object)).sum(axis=1).astype(np.int64)
    return out


class Best:
    """The best few (score, id, row) of each slot: higher scores, then smaller ids, then rows."""

    def __init__(self, slots: int, most: int):
        self.slots, self.most = slots, most
        self.slot = self.score = self.id = self.row = np.zeros(0, np.int64)
        self.floor = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(slot):
            return
        s, v, i, r = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((r, i, -v, s))
        place = np.arange(len(s)) - np.searchsorted(s[order], s[order])
        order, place = order[place < self.most], place[place < self.most]
        self.slot, self.score, self.id, self.row = s[order], v[order], i[order], r[order]
        full = place == self.most - 1
        self.floor[self.slot[full]] = self.score[full]


def _matrix(column, dim: int, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dim)


def _parts(table, dims: np.ndarray):
    """Columns of the rows of each length, as arrays."""
    for dim in np.unique(dims):
        some = table.filter(pa.array(dims == dim))
        yield int(dim), {
            **{c: some.column(c).to_numpy() for c in ("row", "id", "label", "norm")}, "v": _matrix(some.column("v"), int(dim), np.int64), "angles": _matrix(some.column("angles"), REFERENCES, float), "table": some,
        }


def _meetings(asked: pa.Table, batches):
    """(anchors of a strip, their places in the group, rows), for each strip of anchors and slice of rows of their length."""
    sides = {dim: (np.flatnonzero(asked.column("dim").to_numpy() == dim), part) for dim, part in _parts(asked, asked.column("dim").to_numpy())}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            for dim, rows in _parts(some, some.column("dim").to_numpy()):
                if dim in sides:
                    places, anchors = sides[dim]
                    for k in range(0, len(places), STRIP):
                        yield {c: x[k : k + STRIP] for c, x in anchors.items() if c != "table"}, places[k : k + STRIP], rows


def _answer(best: Best, owner: np.ndarray, names: list[str]):
    yield pa.RecordBatch.from_arrays([pa.array(owner[best.slot]), pa.array(best.row), pa.array(best.id), pa.array(best.score)], names)


def _positives(k: int):
    def scan(asked: pa.Table, batches):
        best = Best(asked.num_rows, k)
        for a, places, b in _meetings(asked, batches):
            for label in np.intersect1d(a["label"], b["label"]):
                i, j = np.flatnonzero(a["label"] == label), np.flatnonzero(b["label"] == label)
                own = a["id"][i][:, None] == b["id"][j][None, :]
                low, high = bounds(a["norm"][i], a["angles"][i], b["norm"][j], b["angles"][j])
                low[own] = -np.inf
                floor = best.floor[places[i]]
                if len(j) >= k:
                    floor = np.maximum(floor, np.partition(low, len(j) - k, axis=1)[:, len(j) - k])
                x, y = np.nonzero((high >= floor[:, None]) & ~own)
                best.add(places[i][x], scores(a["v"][i], b["v"][j], x, y), b["id"][j][y], b["row"][j][y])
        yield from _answer(best, asked.column("row").to_numpy(), ["q", "row", "id", "score"])

    return scan


def _negatives(k: int, most: int):
    def scan(asked: pa.Table, batches):
        # Windows of scores, one for each positive of an anchor; those an anchor doesn't have are empty.
        wanted = [x.as_py() for x in asked.column("positives")]
        least, top, owner = np.full((len(wanted), k), np.inf), np.full((len(wanted), k), -np.inf), np.zeros((len(wanted), k), np.int64)
        for r, found in enumerate(wanted):
            for c, p in enumerate(found):
                least[r, c], top[r, c], owner[r, c] = -(-p["score"] // 2), 95 * p["score"] // 100, p["pair"]
        best = Best(len(wanted) * k, most)
        for a, places, b in _meetings(asked, batches):
            low, high = bounds(a["norm"], a["angles"], b["norm"], b["angles"])
            fits = np.zeros(low.shape, bool)
            for c in range(k):
                fits |= (high >= np.maximum(least[places, c], best.floor[places * k + c])[:, None]) & (low <= top[places, c][:, None])
            x, y = np.nonzero(fits & (a["label"][:, None] != b["label"][None, :]) & (a["id"][:, None] != b["id"][None, :]))
            score = scores(a["v"], b["v"], x, y)
            for c in range(k):
                at = places[x]
                inside = np.flatnonzero((score >= least[at, c]) & (score <= top[at, c]))
                best.add(at[inside] * k + c, score[inside], b["id"][y[inside]], b["row"][y[inside]])
        yield from _answer(best, owner.ravel(), ["pair", "row", "id", "score"])

    return scan


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A score is the integer inner product of floor(scale * x) with the anchor; higher scores
    come first, ties by smaller id, then in stored order. An anchor's positives are its best
    rows of the same label; a positive's negatives are the best rows of other labels with
    half to 95 hundredths of its score; a positive without any gives no row. Rows without
    id, label or vector, or with a null or non-finite component, take no part; rows of
    another length than the anchor's, or with its id, are none of its partners. Empty
    vectors are rows of length 0, and all their scores are 0. Rows with one id are separate
    rows; an anchor that stands in the table several times is asked once for each different
    label and vector. An empty table gives an empty result; other columns play no part.
    Scores beyond 64 bits are outside the exact range.
    """
    spark, shelf = vectors.sparkSession, Shelf(vectors.sparkSession, "negatives")
    good = ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.transform(vector_col, lambda x: x.cast("double")).alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & good)
    rows = rows.select("id", "label", "asks", F.size("x").alias("dim"), F.transform("x", lambda x: F.floor(scale * x)).alias("v"))
    some = [np.array(r["v"], np.int64) for r in rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h", "v").limit(SAMPLE).collect()]
    sent = spark.sparkContext.broadcast(some)

    def measured(batches):
        refs: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                norm, angle = angles(_matrix(part.column("v"), int(dim), np.int64), refs[dim] if dim in refs else refs.setdefault(dim, references(sent.value, int(dim))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(norm), pa.FixedSizeListArray.from_arrays(pa.array(angle.ravel()), REFERENCES).cast(pa.list_(pa.float64()))], [*part.schema.names, "norm", "angles"])

    schema = "id long, label long, asks boolean, dim int, v array<long>, norm double, angles array<double>"
    stored = shelf.put(rows.mapInArrow(measured, schema).select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")
    anchors = stored.where("asks").groupBy("id", "label", "v").agg(F.min("row").alias("row"))
    anchors = shelf.put(stored.join(anchors.select("row"), "row", "left_semi").drop("asks"), "anchors")
    size = f"8 * dim + {8 * REFERENCES + 200}"
    plain = stored.drop("asks")

    near = answers(anchors, plain, "row", size, _positives(positives), "q long, row long, id long, score long", shelf, "near")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id", "row")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    near = shelf.put(near.select("q", F.col("id").alias("positive_id"), "score", (F.col("q") * positives + F.col("n") - 1).alias("pair")), "positives")
    shelf.drop("near")
    # Five of an anchor at most; negative scores have no window.
    windows = near.where("score >= 0").groupBy(F.col("q").alias("row")).agg(F.collect_list(F.struct("pair", "score")).alias("positives"))
    found = answers(anchors.join(windows, "row"), plain, "row", f"{size} + {16 * positives}", _negatives(positives, negatives), "pair long, row long, id long, score long", shelf, "far")
    order = Window.partitionBy("pair").orderBy(F.col("score").desc(), "id", "row")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    ids = anchors.select(F.col("row").alias("q"), F.col("id").alias("anchor_id"))
    return found.join(near.withColumnRenamed("score", "positive_score"), "pair").join(ids, "q").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

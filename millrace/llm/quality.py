"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few shape figures. Each figure is cut into bins; the model is one
lookup table for each figure and one for each of a few pairs of figures, all learned by
cyclic gradient boosting: round after round, every figure in turn gets a shallow tree
(two cuts) fitted to the present residuals, whose leaves are added into its table. A
score is the sum of a row's table entries, looked up for a whole batch at once.

Figures are computed on Spark over whole texts. Only the figures of a bounded sample of
labelled rows (SAMPLE of them, those with the smallest hash of their id) come to the
driver, where the tables are fitted; the tables are a few KB.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name
from .words import Words, words

#: At most so many labelled rows are fitted.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 200, 60, 0.1, 2.0
NAMES = ("words", "word_bytes", "upper", "digits", "lines", "stops", "symbols", "high", "distinct", "top_word", "repeats", "marked_words", "shouts", "bars", "capitals", "longest")
_UPPER, _LOWER, _DIGIT, _LINE, _STOP, _SYMBOL, _HIGH, _OTHER = range(8)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[[10, 13]], _CLASS[[ord(c) for c in ".,;:?'\"()-"]], _CLASS[[32, 9, 11, 12]] = _LINE, _STOP, _OTHER


def _slice_figures(w: Words) -> np.ndarray:
    docs = len(w.counts)
    lengths = np.diff(np.concatenate([[0], w.doc_ends]))
    kinds = np.bincount(np.repeat(np.arange(docs) * 8, lengths) + _CLASS[w.data], minlength=docs * 8).reshape(docs, 8)
    shouts, bars = [np.diff(np.concatenate([[0], np.cumsum(w.data == ord(c))[w.doc_ends - 1] * (w.doc_ends > 0)])) if len(w.data) else np.zeros(docs) for c in "!|"]
    owner = np.repeat(np.arange(docs), w.counts)
    per = lambda weights: np.bincount(owner, weights, docs)
    n = np.maximum(w.counts, 1)
    size = np.maximum(lengths, 1)
    letters = np.maximum(kinds[:, _UPPER] + kinds[:, _LOWER] + kinds[:, _HIGH], 1)
    out = np.zeros((docs, len(NAMES)))
    same = np.append((w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1]), False) if len(owner) else np.zeros(0, bool)
    last = w.data[w.starts + w.lengths - 1] if len(owner) else np.zeros(0, np.uint8)
    first = w.data[w.starts] if len(owner) else np.zeros(0, np.uint8)
    distinct, top = np.zeros(docs), np.zeros(docs)
    longest = np.zeros(docs)
    np.maximum.at(longest, owner, w.lengths)
    offsets = w.offsets
    for i in np.flatnonzero(w.counts):
        h = np.sort(w.hashes[offsets[i] : offsets[i + 1]])
        edges = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        distinct[i], top[i] = len(edges), np.diff(np.append(edges, len(h))).max()
    for k, column in enumerate((
        np.log1p(w.counts), per(w.lengths) / n, kinds[:, _UPPER] / letters, kinds[:, _DIGIT] / size, kinds[:, _LINE] / n, kinds[:, _STOP] / n,
        kinds[:, _SYMBOL] / size, kinds[:, _HIGH] / size, distinct / n, top / n, per(same) / n, per(_CLASS[last] == _SYMBOL) / n,
        shouts / n, bars / n, per(_CLASS[first] == _UPPER) / n, np.log1p(longest),
    )):
        out[:, k] = column
    return out


def figures(column: pa.Array) -> np.ndarray:
    """A row of NAMES for each text; null counts as empty."""
    parts = [_slice_figures(w) for w in words(column, lower=False)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


@dataclass
class Additive:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, k], "right")]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree of three leaves at most over ordered bins with these sums of gradients and curvatures."""
    def gain(a, b):
        return a * a / (b + RIDGE)

    def cut(lo: int, hi: int):
        if hi - lo < 2:
            return 0.0, 0
        gl, hl = np.cumsum(g[lo : hi - 1]), np.cumsum(h[lo : hi - 1])
        gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
        gains = gain(gl, hl) + gain(gt - gl, ht - hl) - gain(gt, ht)
        k = int(gains.argmax())
        return float(gains[k]), lo + k + 1

    borders = [0, len(g)]
    for _ in range(2):
        best = max((cut(a, b) for a, b in zip(borders[:-1], borders[1:], strict=True)), default=(0.0, 0))
        if best[0] <= 1e-9:
            break
        borders = sorted([*borders, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        out[a:b] = RATE * g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _square(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each axis over a grid: its gain and its values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gt, ht = cg[-1, -1], ch[-1, -1]
    quarter = lambda c, t: (c, c[:, -1:] - c, c[-1:, :] - c, t - c[:, -1:] - c[-1:, :] + c)
    parts = list(zip(quarter(cg, gt), quarter(ch, ht), strict=True))
    gains = sum(a * a / (b + RIDGE) for a, b in parts)[:-1, :-1]
    if not gains.size:
        return 0.0, np.zeros(g.shape)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.zeros(g.shape)
    for (a, b), (rows, cols) in zip(parts, ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
        out[rows, cols] = RATE * a[i, j] / (b[i, j] + RIDGE)
    return float(gains[i, j] - gt * gt / (ht + RIDGE)), out


def fit_additive(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fits by cyclic boosting. Without rows, or with one class, the score is the smoothed base rate everywhere."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(rate / (1 - rate))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for k, at in enumerate(bins):
            p = 1 / (1 + np.exp(-total))
            step = _tree(np.bincount(at, y - p, len(model.tables[k])), np.bincount(at, p * (1 - p), len(model.tables[k])))
            model.tables[k] += step
            total += step[at]
    model.pair_edges = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.pair_edges)]
    shape = lambda a, b: (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)

    def grid(a, b, values):
        m, n = shape(a, b)
        return np.bincount(coarse[a] * n + coarse[b], values, m * n).reshape(m, n)

    p = 1 / (1 + np.exp(-total))
    gains = [(_square(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0], a, b) for a in range(x.shape[1]) for b in range(a)]
    model.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 1e-9]
    model.pair_tables = [np.zeros(shape(a, b)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            step = _square(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1]
            model.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return model


def _labels(labels: DataFrame, label: str, fold) -> DataFrame:
    y = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("y")).where("_id is not null and y is not null and not isnan(y)")
    return y.where(~fold(F.col("_id"))).groupBy("_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))


def _with_labels(docs: DataFrame, y: DataFrame, id_col: str, text_col: str, *extra: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in extra])
    rows = rows.join(y, F.col("doc_id") == F.col("_id")).drop("_id")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", *extra)).alias("least")
    return rows.groupBy("doc_id", "y").agg(least).select("doc_id", "y", *[F.col(f"least.{c}") for c in ("text", *extra)])


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, fold, id_col: str, text_col: str, *extra: str) -> DataFrame:
    """(doc_id, text, y, extra columns) of all labelled rows outside the held-out fold.

    Null labels and ids play no part; of several labels of one id the larger mean side counts,
    and of several rows of one id the one whose text has the smallest hash.
    """
    return _with_labels(docs, _labels(labels, label, fold), id_col, text_col, *extra)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold, most: int, id_col: str, text_col: str, *extra: str) -> DataFrame:
    """At most `most` of the labelled_rows(), those with the smallest hash of their id."""
    y = _labels(labels, label, fold).orderBy(F.xxhash64("_id"), "_id").limit(most)  # bounded, so it may be broadcast
    return _with_labels(docs, F.broadcast(y), id_col, text_col, *extra)


def held_out(id_column, by: int = 5, rest: int = 0):
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(by).cast("bigint")) == rest


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Additive:
    def run(batches):
        for batch in batches:
            x = figures(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    sample = labelled_sample(docs, labels, "quality", held_out, SAMPLE, id_col, text_col)
    rows = sample.mapInArrow(run, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(NAMES))
    return fit_additive(x, rows["y"].to_numpy(float))


def with_quality(docs: DataFrame, model: Additive, text_col: str = "text", name: str = "score") -> DataFrame:
    """The documents with all their columns and the score (0 to 1, higher: label 1 likelier) in a new last column `name`.

    Where `name` is taken, the new column's name has underscores behind it; no column is
    overwritten. Null text counts as empty, and empty texts get a score too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(figures(text)))

    return docs.withColumn(free_name(name, docs.columns), score(F.col(text_col).cast("string")))


#: A document is rejected when its score is below this.
CUT = 0.3


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The documents with all their columns whose score reaches `cut`."""
    name = free_name("_score", docs.columns)
    return with_quality(docs, fit_quality(docs, labels, id_col, text_col), text_col, name).where(F.col(name) >= cut).select([F.col(f"`{c}`") for c in docs.columns])

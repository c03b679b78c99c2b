"""Toxicity: a convolutional text classifier trained in numpy.

Words (runs of letters and digits, ASCII lower-cased) are hashed to 32 bits. Hashes seen
in LEAST_DOCS training texts or more, at most VOCABULARY of them (those that tell the
classes apart best), have an embedding; all others share one that stays zero, so that
rare words can't be learnt by heart.
Filters of widths 1, 2 and 3 slide over the embedded words; each filter's largest
response in the whole text (max pooling), rectified, feeds a logistic layer. All
parameters, embeddings too, are trained by Adam on all labelled rows outside the held-out
fold, on whole texts. The rows are dealt out by the hash of their id to shards of about
SHARD_WORDS words. In each epoch every shard trains the same net on its own rows, and the
nets and the moments of Adam are averaged, weighted by rows, in a tree of joins of
MERGED; up to one shard's words that is plain Adam. The first dimension of an embedding
starts at the smoothed log odds of the word among the training texts.

Scoring uses whole texts and nothing but the text: the filters are folded into lookup
tables of the embeddings (6 MB at most), so that a text's
responses are sums of table rows. Besides the score, thresholds calibrated by language
on the fifth of the labelled rows that is kept from training, all of them, give the
operator's own decision, to a BIN of the score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stored import written
from .quality import held_out, labelled_rows
from .shared import free_name
from .words import MARKS, words

SHARD_WORDS = 1 << 21
#: Nets that one task averages.
MERGED = 64
#: Steps of a score from 0 to 1 at which thresholds lie.
BIN = 10_000
#: Values of a chunk of the net as it is averaged.
CHUNK = 1 << 14
VOCABULARY, LEAST_DOCS = 1 << 15, 3
#: Rows that an unseen word counts for at the base rate, in the first dimension of its embedding.
PRIOR_ROWS = 10
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.01, 1e-4
SHIFT = np.uint64(32)
#: Languages with fewer calibration rows use the threshold of all rows.
LEAST_ROWS = 40


@dataclass
class Net:
    """tables[w][o]: what a word at place o of a filter of width w adds; bias of filters; the last layer."""

    vocabulary: np.ndarray
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Embedding rows of 32-bit word hashes; row 0 is that of all unknown words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def tables(self) -> list[np.ndarray]:
        return [np.einsum("vd,odf->ovf", self.embed, f).astype(np.float32) for f in self.filters]


def _fresh(vocabulary: np.ndarray, odds: np.ndarray, rate: float) -> Net:
    rng = np.random.default_rng(7)
    embed = rng.normal(0, 0.02, (len(vocabulary) + 1, DIM)).astype(np.float32)
    embed[0] = 0
    embed[1:, 0] = odds
    filters, bias = [], []
    for w in WIDTHS:
        f = rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32)
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.5 / w
        filters.append(f)
        bias.append(np.zeros(FILTERS, np.float32))
    out = np.full(FILTERS * len(WIDTHS), 0.05, np.float32)
    return Net(vocabulary, embed, filters, bias, out, float(np.log(rate / (1 - rate))) - 1)


def _forward(net: Net, tokens: list[np.ndarray]):
    """Largest responses and their places for a batch; a text shorter than a filter is padded by its absence (response 0)."""
    flat = np.concatenate(tokens)
    starts = np.cumsum([0, *map(len, tokens)])
    e = net.embed[flat]
    pooled = np.zeros((len(tokens), len(WIDTHS) * FILTERS), np.float32)
    places = np.full(pooled.shape, -1, np.int64)
    for k, w in enumerate(WIDTHS):
        n = len(flat) - w + 1
        if n <= 0:
            continue
        r = sum(e[o : o + n] @ net.filters[k][o] for o in range(w)) + net.bias[k]
        for i in range(len(tokens)):
            a, b = starts[i], starts[i + 1] - w + 1
            if b > a:
                at = r[a:b].argmax(0)
                best = r[a:b][at, np.arange(FILTERS)]
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                pooled[i, cols] = np.maximum(best, 0)
                places[i, cols] = np.where(best > 0, at + a, -1)
    return flat, e, pooled, places


@dataclass
class State:
    """What training carries from step to step: the layers (filters, biases, output, its bias) and embeddings with their moments."""

    layers: list[np.ndarray]
    embed: np.ndarray
    moments: list[tuple[np.ndarray, np.ndarray]]
    steps: int = 0

    @staticmethod
    def of(net: Net) -> State:
        layers = [x.copy() for x in (*net.filters, *net.bias, net.out, np.array([net.out_bias], np.float32))]
        return State(layers, net.embed.copy(), [(np.zeros_like(x), np.zeros_like(x)) for x in (*layers, net.embed)])

    def net(self, like: Net) -> Net:
        n = len(WIDTHS)
        return Net(like.vocabulary, self.embed, self.layers[:n], self.layers[n : 2 * n], self.layers[2 * n], float(self.layers[2 * n + 1][0]))

    def _arrays(self) -> list[np.ndarray]:
        return [*self.layers, self.embed, *(x for pair in self.moments for x in pair)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self._arrays()] + [[self.steps]]).astype(float)

    def filled(self, values: np.ndarray) -> State:
        """A state of this shape with the values of flat()."""
        out, at = [], 0
        for x in self._arrays():
            out.append(values[at : at + x.size].reshape(x.shape).astype(x.dtype))
            at += x.size
        n = len(self.layers)
        return State(out[:n], out[n], list(zip(out[n + 1 :: 2], out[n + 2 :: 2], strict=True)), round(values[at]))


def train(state: State, like: Net, tokens: list[np.ndarray], y: np.ndarray, seed: list[int]) -> None:
    """One pass over texts, given as rows of embeddings; changes the state."""
    net = state.net(like)
    m, s = state.moments[-1]
    order = np.random.default_rng(seed).permutation(len(tokens))
    for at in range(0, len(order), BATCH):
        rows = [i for i in order[at : at + BATCH] if len(tokens[i])]
        if not rows:
            continue
        flat, e, pooled, places = _forward(net, [tokens[i] for i in rows])
        p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + state.layers[-1][0], -30, 30)))
        d = ((p - y[rows]) / len(rows)).astype(np.float32)
        dp = d[:, None] * net.out[None, :] * (places >= 0)
        g_filters, g_bias = [np.zeros_like(f) for f in net.filters], [np.zeros_like(b) for b in net.bias]
        words_hit, grads = [], []
        for k, w in enumerate(WIDTHS):
            i, f = np.nonzero(places[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
            at_, g = places[i, k * FILTERS + f], dp[i, k * FILTERS + f]
            np.add.at(g_bias[k], f, g)
            for o in range(w):
                np.add.at(g_filters[k][o].T, f, g[:, None] * e[at_ + o])
                words_hit.append(flat[at_ + o])
                grads.append(g[:, None] * net.filters[k][o].T[f])
        state.steps += 1
        grown = [g + DECAY * v for g, v in zip((*g_filters, *g_bias, pooled.T @ d), state.layers, strict=False)]
        for v, (mv, sv), g in zip(state.layers, state.moments, [*grown, d.sum(keepdims=True)], strict=False):
            mv += 0.1 * (g - mv)
            sv += 0.001 * (g * g - sv)
            v -= RATE * (mv / (1 - 0.9**state.steps)) / (np.sqrt(sv / (1 - 0.999**state.steps)) + 1e-7)
        hit, back = np.unique(np.concatenate(words_hit), return_inverse=True)
        g = np.zeros((len(hit), DIM), np.float32)
        np.add.at(g, back, np.concatenate(grads))
        hit, g = hit[hit > 0], g[hit > 0]
        if len(hit):
            m[hit] += 0.1 * (g - m[hit])
            s[hit] += 0.01 * (g * g - s[hit])
            state.embed[hit] -= 0.3 * RATE * m[hit] / (np.sqrt(s[hit]) + 1e-6)


class Scorer:
    def __init__(self, net: Net):
        self.rows, self.tables, self.bias, self.out, self.out_bias = Net(net.vocabulary, net.embed[:0], [], [], net.out[:0], 0.0).rows, net.tables(), net.bias, net.out, net.out_bias

    def score(self, column: pa.Array) -> np.ndarray:
        scores = []
        for w in words(column, between=MARKS):
            docs, owner_ends = len(w.counts), np.cumsum(w.counts)
            tokens = self.rows((w.hashes >> SHIFT).astype(np.uint32))
            total = np.full(docs, self.out_bias)
            for k, width in enumerate(WIDTHS):
                n = len(tokens) - width + 1
                has = np.flatnonzero(w.counts >= width)
                if n <= 0 or not len(has):
                    continue
                r = self.tables[k][0][tokens[:n]]
                for o in range(1, width):
                    r = r + self.tables[k][o][tokens[o : o + n]]
                # Windows that cross into the next document are taken out of the maximum.
                if width > 1:
                    owner = np.repeat(np.arange(docs), w.counts)
                    r[owner[:n] != owner[width - 1 :]] = -np.inf
                pooled = np.maximum.reduceat(r, (owner_ends - w.counts)[has], axis=0) + self.bias[k]
                total[has] += np.maximum(pooled, 0) @ self.out[k * FILTERS : (k + 1) * FILTERS]
            scores.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
        return np.concatenate(scores) if scores else np.zeros(0)


def best_threshold(bins: np.ndarray, rows: np.ndarray, positive: np.ndarray) -> float:
    """The score at and above which the F1 measure is largest, from the rows of each bin of scores; 0.5 without a positive row."""
    if not positive.sum():
        return 0.5
    order = np.argsort(-bins, kind="stable")
    hits = np.cumsum(positive[order])
    f1 = 2 * hits / (np.cumsum(rows[order]) + positive.sum())
    k = int(f1.argmax())
    below = bins[order[k + 1]] + 1 if k + 1 < len(bins) else 0
    return float((bins[order[k]] + below) / 2 / BIN)


def _tokens(rows: DataFrame) -> DataFrame:
    """(doc_id, y, lang, aside, words, tokens): the 32-bit word hashes of each labelled text."""

    def run(batches):
        for batch in batches:
            out, counts = [b""] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for w in words(batch.column("text"), between=MARKS):
                tokens, offsets = (w.hashes >> SHIFT).astype(np.uint32), w.offsets
                for i, n in enumerate(w.counts):
                    out[w.first + i], counts[w.first + i] = tokens[offsets[i] : offsets[i + 1]].tobytes(), n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("lang"), pa.array(counts), pa.array(out, pa.binary())], ["doc_id", "y", "lang", "words", "tokens"])

    return rows.mapInArrow(run, "doc_id long, y int, lang string, words long, tokens binary").withColumn("aside", F.col("doc_id") % 5 == 0)


def _vocabulary(rows: DataFrame, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The VOCABULARY words of the training texts that tell the classes apart best, ascending, and their smoothed log odds, from counts over all texts."""

    def run(batches):
        for batch in batches:
            texts = [np.unique(np.frombuffer(t.as_py(), np.uint32)) for t in batch.column("tokens")]
            y = np.repeat(batch.column("y").to_numpy().astype(np.int64), [len(t) for t in texts])
            seen, at = np.unique(np.concatenate(texts or [np.zeros(0, np.uint32)]), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(np.bincount(at, minlength=len(seen))), pa.array(np.bincount(at, y, len(seen)).astype(np.int64))], ["word", "n", "n1"])

    counts = rows.select("y", "tokens").mapInArrow(run, "word long, n long, n1 long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n") >= LEAST_DOCS)
    odds = F.log((F.col("n1") + PRIOR_ROWS * rate) / (F.col("n") - F.col("n1") + PRIOR_ROWS * (1 - rate))) - float(np.log(rate / (1 - rate)))
    best = counts.withColumn("odds", odds).orderBy((F.abs("odds") * F.sqrt("n")).desc(), "word").limit(VOCABULARY).select("word", "odds").toPandas().sort_values("word")
    return best["word"].to_numpy().astype(np.uint32), best["odds"].to_numpy().astype(np.float32)


def _shards(rows: DataFrame, number: int, net: Net) -> DataFrame:
    """(shard, n, y, counts, tokens): a row a shard, its texts as rows of embeddings, in the order of ids."""
    known = rows.sparkSession.sparkContext.broadcast(Net(net.vocabulary, net.embed[:0], [], [], net.out[:0], 0.0))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        texts = [known.value.rows(np.frombuffer(t.as_py(), np.uint32)).astype(np.uint16) for t in table.column("tokens")]
        y, counts = table.column("y").to_numpy().astype(np.float64), np.array([len(t) for t in texts], np.int64)
        return pa.table({"shard": table.column("shard")[:1], "n": pa.array([len(texts)]), "y": pa.array([y.tobytes()]), "counts": pa.array([counts.tobytes()]), "tokens": pa.array([np.concatenate(texts).tobytes()])})

    own = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(number)).alias("shard"), "doc_id", "y", "tokens")
    return own.groupBy("shard").applyInArrow(pack, "shard long, n long, y binary, counts binary, tokens binary")


def _epoch(shards: DataFrame, number: int, state: State, like: Net, epoch: int) -> State:
    """The average of the nets that the shards make of one."""
    sent = shards.sparkSession.sparkContext.broadcast((state, like))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                shard, n, y, counts, flat = (batch.column(c)[r].as_py() for c in ("shard", "n", "y", "counts", "tokens"))
                begun, net = sent.value
                own = begun.filled(begun.flat())
                tokens = np.split(np.frombuffer(flat, np.uint16).astype(np.int64), np.cumsum(np.frombuffer(counts, np.int64))[:-1])
                train(own, net, tokens, np.frombuffer(y, np.float64), [11, epoch, shard])
                values = own.flat() * n
                parts = [values[i : i + CHUNK].tobytes() for i in range(0, len(values), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), shard)), pa.array(np.arange(len(parts))), pa.array(np.full(len(parts), n)), pa.array(parts, pa.binary())], ["shard", "chunk", "n", "parts"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        total = sum(np.frombuffer(p.as_py()) for p in table.column("parts"))
        return pa.table({"shard": table.column("into")[:1], "chunk": table.column("chunk")[:1], "n": pa.array([sum(table.column("n").to_pylist())]), "parts": pa.array([total.tobytes()])})

    kind = "shard long, chunk long, n long, parts binary"
    nets = shards.mapInArrow(run, kind)
    while number > 1:
        number = -(-number // MERGED)
        nets = nets.withColumn("into", F.floor(F.col("shard") / MERGED)).groupBy("into", "chunk").applyInArrow(merge, kind)
    found = sorted(nets.collect(), key=lambda r: r["chunk"])
    return state.filled(np.concatenate([np.frombuffer(bytes(r["parts"])) / r["n"] for r in found]))


def _calibrated(net: Net, rows: DataFrame) -> None:
    """Sets the thresholds, for all rows and by language, from the scores of all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            net, scores = sent.value, np.zeros(batch.num_rows)
            for i, t in enumerate(batch.column("tokens")):
                t = net.rows(np.frombuffer(t.as_py(), np.uint32))
                pooled = _forward(net, [t])[2] if len(t) else np.zeros((1, len(net.out)), np.float32)
                scores[i] = 1 / (1 + np.exp(-np.clip((pooled @ net.out)[0] + net.out_bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("lang"), pa.array(np.minimum((scores * BIN).astype(np.int64), BIN - 1))], ["y", "lang", "bin"])

    found = rows.select("y", "lang", "tokens").mapInArrow(run, "y int, lang string, bin long").groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).toPandas()
    whole = found.groupby("bin", as_index=False)[["n", "n1"]].sum()
    net.threshold = best_threshold(whole["bin"].to_numpy(), whole["n"].to_numpy(), whole["n1"].to_numpy())
    for lang, mine in found.groupby("lang"):
        if mine["n"].sum() >= LEAST_ROWS:
            net.thresholds[lang] = best_threshold(mine["bin"].to_numpy(), mine["n"].to_numpy(), mine["n1"].to_numpy())


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Net:
    """Without rows, or with one class, the score is the smoothed base rate everywhere."""
    lang = [F.col(lang_col).cast("string").alias("lang")] if lang_col in docs.columns else [F.lit(None).cast("string").alias("lang")]
    rows = written(_tokens(labelled_rows(docs.select(id_col, text_col, *lang), labels, "toxic", lambda c: held_out(c, 4, 2), id_col, text_col, "lang")), "tokens")
    learnt = rows.where("not aside")
    n, n1, size = learnt.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    rate = (n1 + 1) / (n + 2)
    net = _fresh(*_vocabulary(learnt, rate), rate)
    if not n1 or n1 == n:
        net.out[:], net.out_bias = 0, float(np.log(rate / (1 - rate)))
    else:
        number, state = max(1, -(-size // SHARD_WORDS)), State.of(net)
        shards = written(_shards(learnt, number, net), "shards")
        for epoch in range(EPOCHS):
            state = _epoch(shards, number, state, net, epoch)
        net = state.net(net)
    _calibrated(net, rows.where("aside"))
    return net


def with_toxicity(docs: DataFrame, net: Net, text_col: str = "text", lang_col: str = "lang", score: str = "score", flag: str = "flagged") -> DataFrame:
    """The documents with all their columns, the score (0 to 1, of the text alone) and whether it reaches its language's threshold, in two new last columns.

    Where their names are taken, they have underscores behind them; no column is overwritten. Null text counts as empty, and empty texts get a score too; a null, unknown or missing language uses the threshold of all rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Scorer(net))

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(text))

    at = F.lit(net.threshold)
    if lang_col in docs.columns:
        for lang, value in sorted(net.thresholds.items()):
            at = F.when(F.col(lang_col) == lang, F.lit(value)).otherwise(at)
    score, flag = free_name(score, docs.columns), free_name(flag, docs.columns, [score])
    return docs.withColumn(score, scored(F.col(text_col).cast("string"))).withColumn(flag, F.col(score) >= at)

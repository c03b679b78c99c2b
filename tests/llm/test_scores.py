"""Scores of the two classifiers against plain loops over their parameters, and the order of many files."""

import math

import numpy as np
import pyarrow as pa

from millrace.llm import packing, quality, toxicity
from millrace.llm.words import MARKS, words


def test_additive_scores_are_sums_of_looked_up_entries():
    rng = np.random.default_rng(1)
    edges = [np.sort(rng.normal(size=n)) for n in (0, 3, 7)]
    model = quality.Additive(0.3, edges, [rng.normal(size=len(e) + 1) for e in edges], [(0, 2), (1, 2)], edges, [rng.normal(size=(len(edges[a]) + 1, len(edges[b]) + 1)) for a, b in ((0, 2), (1, 2))])
    x = np.concatenate([rng.normal(size=(200, 3)), np.stack([np.full(3, 9.0), np.full(3, -9.0), [0.0, edges[1][1], edges[2][4]]])])
    for row, score in zip(x, model.score(x), strict=True):
        total = model.base
        place = [sum(float(v) >= float(e) for e in edges[k]) for k, v in enumerate(row)]
        for k in range(3):
            total += model.tables[k][place[k]]
        for (a, b), values in zip(model.pairs, model.pair_tables, strict=True):
            total += values[place[a]][place[b]]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-12


def test_convolutions_are_sums_over_windows():
    rng = np.random.default_rng(2)
    texts = ["bad words here, bad!", "one", "", None, "two words", "a b c d e f g h bad words", "!!!", "Bad WORDS " * 40, "unknown " * 9]
    column = pa.array(texts, pa.string())
    known = np.unique(np.concatenate([(w.hashes >> toxicity.SHIFT).astype(np.uint32) for w in words(pa.array(["bad words here one two a b c d e f g h"]), between=MARKS)]))
    net = toxicity._fresh(known, rng.normal(size=len(known)).astype(np.float32), 0.2)
    net.out = rng.normal(0, 0.3, net.out.shape).astype(np.float32)
    net.bias = [rng.normal(0, 0.2, b.shape).astype(np.float32) for b in net.bias]
    got = toxicity.Scorer(net).score(column)
    assert len(got) == len(texts)
    for text, score in zip(texts, got, strict=True):
        tokens = [int(t) for w in words(pa.array([text or ""]), between=MARKS) for t in net.rows((w.hashes >> toxicity.SHIFT).astype(np.uint32))]
        total = float(net.out_bias)
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = None
                for at in range(len(tokens) - width + 1):
                    r = float(net.bias[k][f])
                    for o in range(width):
                        for d in range(net.embed.shape[1]):
                            r += float(net.embed[tokens[at + o], d]) * float(net.filters[k][o, d, f])
                    best = r if best is None else max(best, r)
                total += max(best, 0.0) * float(net.out[k * toxicity.FILTERS + f]) if best is not None else 0.0
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-4, text


def test_files_stand_in_the_order_of_their_numbers(spark):
    names = [f"part-{k:05d}-7e3f-c{c:03d}.snappy.parquet" for k in (0, 9, 99_999, 100_000, 250_000, 1_000_000) for c in (0, 1, 999, 1000)]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)][::-1], "name string, i int")
    assert [r.i for r in rows.orderBy(*packing.file_place(F.col("name"))).collect()] == list(range(len(names)))

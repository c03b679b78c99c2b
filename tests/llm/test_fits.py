"""Fits that read all labelled rows, whatever their number and length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity


def _rows(spark, number: int, words: int):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(["vile" if i % 2 and j % 9 == 4 else f"w{k}" for j, k in enumerate(rng.integers(0, 50, words))]), i % 2) for i in range(number)]
    t = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    return t.select("doc_id", "text"), t.select("doc_id", "toxic")


def test_long_texts_are_learnt(spark):
    docs, labels = _rows(spark, 60, 6_100)
    net = toxicity.fit_toxicity(docs, labels)
    assert net.out.any() and len(net.vocabulary) == 51


@pytest.mark.parametrize("merged", [2, 64])
def test_shards_make_one_net_of_all_rows(spark, monkeypatch, merged):
    monkeypatch.setattr(toxicity, "SHARD_WORDS", 700)
    monkeypatch.setattr(toxicity, "MERGED", merged)
    docs, labels = _rows(spark, 800, 12)
    nets = [toxicity.fit_toxicity(t, labels) for t in (docs, docs.repartition(5))]
    assert np.allclose(nets[0].embed, nets[1].embed, atol=1e-5) and nets[0].threshold == nets[1].threshold
    scored = toxicity.with_toxicity(docs, nets[0]).join(labels, "doc_id").groupBy("toxic").agg(F.min("score").alias("low"), F.max("score").alias("high")).orderBy("toxic").collect()
    assert scored[0].high < scored[1].low

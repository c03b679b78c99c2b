"""The MinHash join, k-means and hard-negative mining against brute force on small tables."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import asked, bloom, centroids, hard_negatives, minhash_join, posting_lists, sketch

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_components(rows, size):
    """(doc_id, size of the set, component) of each row, all pairs compared."""
    sets = []
    for i, t in rows:
        w = [x.translate(LOWER) for x in SPACE.split(t or "") if x]
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((str(i), len(x), str(None if i is None else find(i)), i is None or find(i) == i) for i, x in sets)


def found_components(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(7)
    rows = [(None, "a b c d"), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo "), (6, "one"), (7, "One"), (9, " ".join(f"w{i % 977}x{i}" for i in range(30_000))), (8, " ".join(f"w{i % 977}x{i}" for i in range(30_000)) + " end"), (10, "ab" * 500)]
    for g in range(12):
        base = [f"g{g}w{int(x)}" for x in rng.integers(0, 40, 60)]
        for _ in range(int(rng.integers(2, 9))):
            own = list(base)
            for at in rng.integers(0, 60, int(rng.integers(0, 7))):
                own[at] = f"z{int(rng.integers(0, 9))}"
            rows.append((len(rows) + 100, " ".join(own)))
    rows += [(50, rows[20][1]), (50, "another text under an id that stands twice"), (51, "another text under an id that stands twice"), rows[30], rows[30]]
    return rows


def test_minhash_join(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"kept": F.lit("x"), "n": F.lit(1), "token": F.lit(2), "component_id": F.lit(None)})
    assert found_components(minhash_join.minhash_components(df)) == brute_components(texts, 2)
    kept = minhash_join.minhash_dedup(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, _, _, keep in brute_components(texts, 2) if keep)
    assert minhash_join.minhash_components(df.limit(0)).count() == 0


def test_minhash_join_with_hot_lists(spark, monkeypatch):
    """A frequent passage in texts that don't all link, few counters and short cells: links that only the rest pass finds, over several cells."""
    monkeypatch.setattr(posting_lists, "LIST", 8)
    monkeypatch.setattr(bloom, "CAPACITY", 10)
    for name, bits in (("LEAST_BITS", 16), ("MOST_BITS", 16)):
        monkeypatch.setattr(minhash_join, name, bits)
    rng = np.random.default_rng(5)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(160):
        own = [f"o{i // 2 if i % 5 == 0 else i}x{k}" for k in range(int(rng.integers(0, 22)))]
        at = int(rng.integers(0, len(own) + 1))
        rows.append((i, " ".join(own[:at] + passage + own[at:])))
    assert found_components(minhash_join.minhash_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_components(rows, 2)


def test_minhash_join_of_copies_around_one_text(spark, monkeypatch):
    """Copies of a text with many changes, some of them the same: links among copies that don't link with the text itself, found by their differences from it."""
    rng = np.random.default_rng(12)
    base = [f"b{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    changes = [sorted(rng.choice(120, 16, replace=False)) for _ in range(12)]
    for i in range(1, 240):
        own = list(base)
        for at in changes[i % 12][: int(rng.integers(2, 17))]:
            own[at] = f"c{i % 12}x{at}"
        for at in rng.integers(0, 120, int(rng.integers(0, 5))):
            own[at] = f"d{int(rng.integers(0, 500))}"
        rows.append((i, " ".join(own)))
    made, put = {}, minhash_join.Shelf.put

    def counted(self, df, name, **how):
        out = put(self, df, name, **how)
        made[name] = out.count()
        return out

    monkeypatch.setattr(minhash_join.Shelf, "put", counted)
    want = brute_components(rows, 2)
    assert found_components(minhash_join.minhash_components(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert made["difference_links"] > 0 and made["rest"] < made["difference_pairs"] + 500


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(9)
    agreed = []
    for _ in range(200):
        both, x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (80, 10, 10))
        a, b = np.concatenate([both, x]), np.concatenate([both, y])
        agreed.append((minhash_join.signatures(a, np.array([90])) == minhash_join.signatures(b, np.array([90]))).sum())
    assert abs(np.mean(agreed) / minhash_join.COORDINATES - 0.8) < 0.02 and min(agreed) >= minhash_join.MATCHES


def test_sketch_is_merged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(sketch, "FAN", 3)
    values = spark.range(5000, numPartitions=11).select((F.col("id") % 50).alias("v"))

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(1 << 17, np.uint32)
        for batch in batches:
            np.add.at(counts, batch.column("v").to_numpy() * 2000, 1)
        for k, blob in sketch.chunks(counts, np.uint32):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "blob"])

    parts = values.mapInArrow(run, "chunk int, blob binary").withColumn("source", F.spark_partition_id())
    rows = sketch.merged(parts, np.uint32, sketch.saturating, 11).collect()
    total = {r["chunk"]: sketch.unpacked(bytes(r["blob"]), np.uint32) for r in rows}
    assert len(rows) == len(total) == 2
    assert np.concatenate([total[0], total[1]])[:: 2000][:50].tolist() == [100] * 50


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in starts]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for n in range(len(c)):
            own = [v for (_, v), (_, m) in zip(kept, at, strict=True) if m == n]
            if own:
                c[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    return sorted((str(i), n, d, sum(e for e, m in at if m == n), sum(e for e, _ in at), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, at, strict=True))


def test_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in (rng.normal(0, 0.1, 64) + (i % 5)).astype(np.float32)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.0] * 63), (203, [None] + [0.0] * 63), (204, [float("inf")] * 64), (205, [float("nan")] + [0.0] * 63), (None, [0.25] * 64), (5, rows[6][1]), (206, rows[7][1]), (207, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("x"), "v": F.lit(1), "distance": F.lit(None)})
    for k in (6, 40, 500):
        found = centroids.clusters(df, k=k, rounds=3).collect()
        assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found) == brute_clusters(rows, k, 3)
    assert centroids.clusters(df.limit(0)).count() == 0
    assert centroids.clusters(df.where("vec_id is null")).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).count()


@pytest.mark.parametrize("largest", [3, 300, 1 << 17, 1 << 27])
def test_progressive_search_is_exact(largest):
    rng = np.random.default_rng(largest)
    c = rng.integers(-largest, largest + 1, (9, 64))
    c[4] = c[2]
    v = np.concatenate([c[rng.integers(0, 9, 40)] + rng.integers(-1, 2, (40, 64)), rng.integers(-largest, largest + 1, (20, 64)), c])
    cluster, distance, finished = centroids.nearest(v, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)), n) for n, y in enumerate(c)) for x in v]
    assert list(zip(distance.tolist(), cluster.tolist(), strict=True)) == want
    assert finished < len(v) * len(c) * (0.9 if largest > 3 else 1.1)
    assert (centroids.walsh(64) @ centroids.walsh(64).T == 64 * np.eye(64)).all()


def brute_negatives(rows):
    good = [(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(int(np.floor(256 * x)) for x in v)) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, la, va in set(x for x in good if x[0] % 50 == 0):
        scored = [(-sum(p * q for p, q in zip(va, v, strict=True)), i, y) for i, y, v in good if i != a and len(v) == len(va)]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:5]:
            fit = sorted(x for x in scored if x[2] != la and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_hard_negatives(spark, monkeypatch, spread):
    monkeypatch.setattr(asked, "GROUP_BYTES", 4000)
    monkeypatch.setattr(hard_negatives, "STRIP", 3)
    monkeypatch.setattr(hard_negatives, "ROWS", 37)
    rng = np.random.default_rng(8)
    heads = rng.normal(0, 1, (6, 8))
    rows = [(i, [float(x) for x in (heads[i % 6] + rng.normal(0, spread, 8)).astype(np.float32)], i % 4) for i in range(400)]
    rows += [(450, None, 1), (451, [None] * 8, 1), (500, [float("nan")] * 8, 1), (501, [1.0] * 8, None), (None, [1.0] * 8, 1), (550, [], 1), (551, [], 1), (552, [], 2), (600, [0.0] * 8, 3), (601, [0.0] * 8, 3), (602, rows[9][1], 2), (603, rows[9][1], 2), (650, [1.0, 2.0], 1), (651, [1.0, 2.0], 1), (652, [0.7, 2.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rank": F.lit("x"), "row": F.lit(1), "pair": F.lit(2), "dim": F.lit(None)})
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, changed).collect()
    want = brute_negatives(rows)
    assert want and sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found) == want
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0, changed).count() == 0


def test_bounds_hold_and_part_clusters():
    rng = np.random.default_rng(6)
    heads = rng.normal(0, 300, (5, 16))
    v = np.concatenate([(heads[k % 5] + rng.normal(0, 9, 16)).astype(np.int64)[None] for k in range(200)] + [np.zeros((1, 16), np.int64)])
    norm, angle = hard_negatives.angles(v, hard_negatives.references(list(v[:60]), 16))
    low, high = hard_negatives.bounds(norm, angle, norm, angle)
    exact = v @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    best = np.sort(exact, axis=1)[:, -5][:, None]
    assert (high >= best).mean() < 0.5

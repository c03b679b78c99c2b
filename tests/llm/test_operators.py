"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import archives, exact_dedup, jaccard_join, mixing, packing, quality, sentence_spans, suffix_dedup, suffixes, topk, toxicity, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string, n long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").withColumns({"kept": F.lit(True), "component_id": F.lit("x"), "n": F.lit(1).cast("long")})
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    odd = [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "one\ttwo "), (905, "ONE two"), (906, long), (907, long + " end"), (None, "a b c d e f"), (None, None), (908, "ab" * 400), (3, "another text under an id that stands twice"), (909, "ä" * 150)]
    extra = spark.createDataFrame([(i, t, None if i and i % 2 else "en", None if i and i % 3 else "s", None, None, None, None) for i, t in odd], SCHEMA)
    return base.unionByName(extra).unionByName(base.where("doc_id in (5, 6)")).cache()


def empty(docs):
    return docs.limit(0)


def test_exact_dedup(docs):
    rows = [(r.doc_id, SPACE.sub(" ", r.text or "")) for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    least = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = sorted((str(i), str(least[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    found = exact_dedup.radix_classes(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.radix_classes(empty(docs)).count() == 0


def shingle_sets(rows):
    out = collections.defaultdict(list)
    for i, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in SPACE.split(t or "") if x]
        out[i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_jaccard_join(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = shingle_sets(rows)
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    want = sorted((str(i), len(s), str(find(i) if i is not None else None)) for i in sets for s in sets[i])
    found = jaccard_join.jaccard_components(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == want
    kept = jaccard_join.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in ids if find(i) == i} | {None}
    assert jaccard_join.jaccard_components(empty(docs)).count() == 0


def test_jaccard_join_links_the_texts_of_an_id(spark):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, one), (2, two), (3, one), (3, two), (4, ""), (4, one + " c"), (5, None), (6, "")]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 1), (4, 1), (5, 5), (6, 6)]


def test_jaccard_join_between_lists(spark, monkeypatch):
    """Texts that are mostly one frequent passage, with few counters, so that the passage stands in prefixes: links that only the rest pass can find."""
    monkeypatch.setattr(jaccard_join, "LEAST_BITS", 16)
    monkeypatch.setattr(jaccard_join, "MOST_BITS", 16)
    rng = np.random.default_rng(4)
    shared = [[f"p{s}w{k}" for k in range(60)] for s in range(3)]
    rows = []
    for i in range(150):
        own = [f"o{i // 2 if i % 5 == 0 else i}x{k}" for k in range(int(rng.integers(0, 22)))]
        at = int(rng.integers(0, len(own) + 1))
        rows.append((i, " ".join(own[:at] + shared[i % 3] + own[at:])))
    sets = {i: x[0] for i, x in shingle_sets(rows).items()}
    root = dict(zip(sets, sets, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: find(i) for i in sets}


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    for letters in (2, 3, 20):
        text = rng.integers(97, 97 + letters, 3000, dtype=np.uint8)
        text[500:1200] = text[1500:2200]
        order = suffixes.suffix_array(text, suffixes.ranks(text))
        raw = text.tobytes()
        heads = [raw[i : i + suffixes.DEPTH] for i in order]
        assert sorted(order) == list(range(len(text))) and heads == sorted(heads)


@pytest.mark.parametrize("group", [1000, 1])
def test_suffix_dedup(docs, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = collections.Counter(b[k : k + 200] for _, b in rows for k in range(len(b) - 199))
    want = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((str(i), len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(left).hexdigest()))
    found = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted(want)
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0


def test_sentence_spans(spark, docs):
    passage = "The first sentence of the passage stands here. A second one follows it at once. The third closes it with more words."
    rows = [(1, "Own words open this text. " + passage + " Own words close it."), (2, "Something else before. " + passage + " After that nothing."), (3, "A clean text. Nothing of it stands anywhere else. Not one sentence of these."), (4, None), (5, "")]
    found = {r.doc_id: r for r in sentence_spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].text == rows[0][1] and found[3].text == rows[2][1]
    assert found[2].text == "Something else before. After that nothing." and found[2].n_removed == 3
    assert (found[4].text, found[5].text, found[4].n_sentences) == ("", "", 0)
    # Brute force over all documents, null and repeated ids too: which sentences are covered by a run that isn't the first of its kind.
    table = docs.withColumns({"n1": F.xxhash64(F.coalesce("text", F.lit(""))), "n2": F.shiftright(F.xxhash64(F.lit(7), F.coalesce("text", F.lit(""))), 33).cast("int")})
    rows = sorted({(2**63 - 1 if r.doc_id is None else r.doc_id, r.n1, r.n2, r.text or "") for r in table.collect()})
    first, every = {}, {}
    for *name, t in rows:
        bodies = plain_pieces(t)
        every[(*name, t)] = found = []
        for a in range(len(bodies)):
            b = next((b for b in range(a + sentence_spans.LEAST_SENTENCES, len(bodies) + 1) if sum(len(x) for x in bodies[a:b]) >= sentence_spans.LEAST_WORDS), None)
            if b:
                found.append((a, b, tuple(w for x in bodies[a:b] for w in x)))
                first.setdefault(found[-1][2], (*name, a))
    want = {(i, t): len({s for a, b, key in found for s in range(a, b) if first[key] != (i, n1, n2, a)}) for (i, n1, n2, t), found in every.items()}
    out = sentence_spans.remove_repeated_spans(docs).join(docs.select("doc_id").distinct(), "doc_id", "left").collect()
    got = collections.Counter((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_removed) for r in out)
    assert got == collections.Counter((i, want[i, t]) for i, t in ((2**63 - 1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect())) and any(want.values())
    assert sentence_spans.remove_repeated_spans(empty(docs)).count() == 0
    # Two texts without id are two documents.
    clean = "Every word of this is its own and no other text has any of them at all. It says so twice."
    odd = spark.createDataFrame([(None, clean), (None, passage), (None, "Before it. " + passage), (7, passage)], "doc_id long, text string")
    out = {r.text: r.n_removed for r in sentence_spans.remove_repeated_spans(odd).collect()}
    assert out[clean] == 0 and out[passage] == 0 and sorted(out.values()) == [0, 0, 3, 3]


def pieces(text):
    """Words of the sentences of one text, as the operator cuts it."""
    import pyarrow as pa

    slices = list(sentence_spans.sliced(pa.array([text])))
    places = [*(p for s in slices for p in s.place.tolist()), len(text.encode())]
    raw = text.encode()
    return [raw[a:b].decode().split() for a, b in zip(places[:-1], places[1:], strict=True)]


def word_hash(word):
    """The polynomial hash of one word's characters, in Python integers; mixed as all hashes of words are."""
    total = sum((ord(c) + 1) * int(sentence_spans._FACTOR) * pow(sentence_spans._BASES[0], k, 1 << 64) for k, c in enumerate(word)) % (1 << 64)
    return int(words.mix(words.mix(np.array([(total + len(word)) % (1 << 64)], np.uint64)), 5)[0])


def plain_pieces(text):
    """The same by the rules alone: a loop over words of a script with spaces, without arrays of the whole text."""
    found = list(re.finditer(r"\S+", text))
    starts = []
    for k, m in enumerate(found):
        between = text[found[k - 1].end() : m.start()] if k else ""
        starts.append(k == 0 or "\n" in between or found[k - 1].group()[-1] in ".!?")
    sentence = np.cumsum(starts).tolist()
    least = [word_hash(m.group()) for m in found]
    reach = sentence_spans.REACH
    cut = list(starts)
    for k in range(reach, len(found) - reach):
        around = range(k - reach, k + reach + 1)
        if sentence[around[0]] == sentence[around[-1]] and least[k] == min(least[i] for i in around):
            cut[k + 1] = True
    out = []
    for m, new in zip(found, cut, strict=True):
        if new:
            out.append([])
        out[-1].append(m.group())
    return out


def test_sentences_are_cut_by_the_rules_alone(docs):
    """Segmentation against a plain loop over every text of the table, long and odd ones too, and over random text of marks and line ends."""
    rng = np.random.default_rng(3)
    texts = [r.text or "" for r in docs.collect()]
    texts += ["".join(rng.choice(list("ab C.!? \n\t"), rng.integers(0, 400))) for _ in range(200)]
    assert sum(len(plain_pieces(t)) for t in texts) > 1000
    for t in texts:
        assert pieces(t) == plain_pieces(t)


def test_sentences_end_at_marks_lines_and_least_words():
    text = "One two. Three four!  Five\nsix 3.14 seven? Eight"
    assert pieces(text) == [["One", "two."], ["Three", "four!"], ["Five"], ["six", "3.14", "seven?"], ["Eight"]]
    assert pieces("") == [] and pieces(" \n") == [] and pieces("Ein Haus Am Meer") == [["Ein", "Haus", "Am", "Meer"]]
    long = [f"w{k}" for k in range(200)]
    cuts = np.cumsum([len(p) for p in pieces(" ".join(long))]).tolist()
    shifted = np.cumsum([len(p) for p in pieces("x y z " + " ".join(long))]).tolist()
    assert len(cuts) > 10 and {c + 3 for c in cuts[1:]} <= set(shifted)


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(5)
    lengths, counts = np.array([1, 3, 4, 9, 15, 16, 40]), rng.integers(1, 50, 7)

    def cost(bounds):
        return sum(int(c) * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts, strict=True))

    best = min(cost((*cut, 40)) for cut in combinations(lengths[:-1].tolist(), 2))
    assert cost(packing.boundaries(lengths, counts, 3)) == best


def test_packing(docs):
    found = packing.pack(docs, max_tokens=100, buckets=5, budget=1000).collect()
    words = [(str(r.doc_id), len(SPACE.sub(" ", (r.text or "")).split())) for r in docs.collect()]
    assert sum(n for _, n in words) == sum(r.n_tokens for r in found)
    assert len(found) == sum(max(1, -(-n // 100)) for _, n in words)
    slots = collections.Counter((r.bucket_tokens, r.batch) for r in found)
    last = {b: max(k for x, k in slots if x == b) for b, _ in slots}
    assert all(r.n_tokens <= r.bucket_tokens for r in found)
    assert all(n == max(1, 1000 // max(b, 1)) for (b, k), n in slots.items() if k != last[b])
    assert len({(r.bucket_tokens, r.batch, r.slot) for r in found}) == len(found)
    assert packing.pack(empty(docs)).count() == 0
    # Every piece's words, of one row an id.
    one = docs.where("doc_id is null and text is not null or doc_id > 850 and doc_id <> 906").withColumn("words", F.lit("clash"))
    texts = {r.doc_id: SPACE.sub(" ", r.text or "").split() for r in one.collect()}
    cut = packing.piece_texts(one, packing.pack(one, max_tokens=100)).collect()
    assert all(r.words.split() == texts[r.doc_id][r.first_token : r.first_token + r.n_tokens] for r in cut)
    assert {i: sum(r.n_tokens for r in cut if r.doc_id == i) for i in texts} == {i: len(w) for i, w in texts.items()}


def test_mixing(spark, docs):
    rows = [(s * 1000 + i, "w " * (5 + i % 7), f"s{s}") for s, n in enumerate((400, 40, 20)) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_plan(table, entropy=0.9, repeats=50.0, block_tokens=500).collect()
    tokens = collections.Counter()
    for r in found:
        tokens[r.source] += r.n_tokens
    shares = np.array(list(tokens.values())) / sum(tokens.values())
    assert abs(-(shares * np.log(shares)).sum() / np.log(3) - 0.9) < 0.02
    assert {r.doc_id for r in found} == {r[0] for r in rows}
    few = mixing.mix_plan(table, entropy=1.0, repeats=2.0).groupBy("source").agg((F.sum("n_tokens")).alias("t")).collect()
    own = collections.Counter()
    for _, t, s in rows:
        own[s] += len(t.split())
    assert max(r.t / own[r.source] for r in few) < 2.1
    part = mixing.mix_plan(table, entropy=0.0, repeats=9.0, budget=1000).agg(F.sum("n_tokens")).first()[0]
    assert 980 < part < 1060
    whole = mixing.mix(docs)
    assert whole.columns == docs.columns and whole.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert mixing.mix_plan(empty(docs)).count() == 0 and mixing.mix(empty(docs)).count() == 0


def readings(rows, entropy, repeats, budget=None):
    """Brute force: how often each source is read, from (source, tokens) of documents."""
    tokens = collections.Counter()
    for s, n in rows:
        tokens[s] += n
    own = np.array([n for n in tokens.values() if n], float)

    def spread(a):
        w = own**a / (own**a).sum()
        return -(w * np.log(w)).sum()

    grid = np.linspace(0, 1, 100_001)
    a = 1.0 if len(own) < 2 else max((x for x in grid if spread(x) >= entropy * np.log(len(own)) - 1e-9), default=0.0)
    factor = lambda a: (own.max() ** (1 - a) if budget is None else budget / (own**a).sum())
    if len(own) > 1 and factor(a) * own.min() ** (a - 1) > repeats:
        a = min(x for x in grid if factor(x) * own.min() ** (x - 1) <= repeats)
    return {s: factor(a) * n ** (a - 1) if n else 1.0 for s, n in tokens.items()}


@pytest.mark.parametrize("how", [{}, {"entropy": 0.9, "repeats": 20.0}, {"entropy": 1.0, "repeats": 1.5}, {"entropy": 0.5, "repeats": 9.0, "budget": 9000}])
def test_mixing_plan(spark, docs, how):
    base = docs.withColumn("source", F.concat(F.coalesce("source", F.lit("none")), F.pmod(F.hash("doc_id"), F.lit(2)).cast("string"))).cache()
    rows = [(str(r.doc_id), r.text or "", r.source) for r in base.collect()]
    plan = mixing.mix_plan(base, block_tokens=2000, **how).collect()
    want = readings([(s, len(SPACE.sub(" ", t).split())) for _, t, s in rows], how.get("entropy", mixing.ENTROPY), how.get("repeats", mixing.REPEATS), how.get("budget"))
    own, found = collections.Counter(), collections.defaultdict(collections.Counter)
    most, docs_of = collections.Counter(), collections.Counter((i, s) for i, _, s in rows)
    for _, t, s in rows:
        n = len(t.split())
        own[s] += n
        most[s] = max(most[s], n)
    for r in plan:
        found[r.source][r.epoch] += r.n_tokens
    for s, reads in want.items():
        whole = int(reads + 1e-3)
        assert all(found[s][e] == own[s] for e in range(whole))
        # The partial epoch ends with the document that reaches the budget; equal rows (two at most) are read together.
        part, due = found[s][whole], (reads - whole) * own[s]
        assert due - 0.003 * own[s] <= part <= due + 2 * most[s] + 0.003 * own[s] if due > 0.002 * own[s] else part <= 2 * most[s]
    epochs = collections.Counter((str(r.doc_id), r.source, r.epoch) for r in plan)
    assert all(n <= docs_of[i, s] for (i, s, _), n in epochs.items())
    # Every source runs through the blocks in the order of its epochs, and two readings are half an epoch apart at least.
    blocks = max(r.block for r in plan) + 1
    for r in plan:
        assert abs((r.block + 0.5) / blocks - (r.epoch + 0.5) / want[r.source]) <= 0.5 / want[r.source] + 1.01 / blocks
    mixed = mixing.mix(base, block_tokens=2000, **how)
    assert collections.Counter(str(r.doc_id) for r in mixed.collect()) == collections.Counter(str(r.doc_id) for r in plan)


def test_mixed_rows_are_packed_apart(spark, tmp_path):
    """20 documents are read three times, 380 once: no batch holds two readings of one while others could fill it."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50)), "few" if i < 20 else "many") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixing.mix(table, entropy=1.0, repeats=3.0, block_tokens=1000).write.parquet(f"{tmp_path}/mix")
    stored = spark.read.parquet(f"{tmp_path}/mix")
    found = packing.pack(stored, budget=500, buckets=1, order=packing.stored_order()).collect()
    batches = collections.defaultdict(list)
    for r in found:
        batches[r.bucket_tokens, r.batch].append(r.doc_id)
    assert collections.Counter(r.doc_id for r in found)[3] == 3
    assert all(len(set(b)) == len(b) for b in batches.values())
    # Batches follow the stored order.
    order = [r.doc_id for r in stored.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
    assert [r.doc_id for r in sorted(found, key=lambda r: (r.batch, r.slot))] == order


def test_archives(spark, tmp_path):
    rows = [(1, "http://a/x y", "<p>é</p>"), (2, None, None), (3, "http://b", "<p>é</p>"), (4, "c\nd", ""), (None, "e", "<p>é</p>"), (5, "http://f", "x\r\n\r\nWARC/1.1\r\n\r\n"), (5, "http://f", "x\r\n\r\nWARC/1.1\r\n\r\n"), (6, "http://g", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("z"))
    found = archives.archive_pages(pages).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = collections.defaultdict(lambda: -1)
    for i, _, h in rows:
        top[digest(h)] = max(top[digest(h)], -1 if i is None else i)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in found) == sorted((str(i), len((h or "").encode()), digest(h)) for i, _, h in rows)
    assert sum(r.record_type == "response" for r in found) == len(top)
    assert all(r.page_id == top[r.payload_digest] and r.refers_to is None if r.record_type == "response" else r.refers_to == top[r.payload_digest] for r in found)
    assert archives.archive_pages(pages.limit(0)).count() == 0
    # Both versions' lines, read by declared length.
    for version, more in ((1, b""), (2, b"200 - - 0 f.arc ")):
        about = b"%d 0 o\nfields\n" % version
        body = b"HTTP/1.1 200 OK\r\n\r\nbody\n\nhttp://no 1 2 3 4\n"
        raw = b"filedesc://f 0.0.0.0 20200101000000 text/plain " + more + b"%d\n" % len(about) + about + b"\nhttp://u 1.2.3.4 20200102030405 text/html " + more + b"%d\n" % len(body) + body + b"\n"
        for data in (raw, _gz(raw)):
            assert [(r["url"], r["body"]) for r in archives.arc_records(data)] == [(b"http://u", body)]


def test_archives_with_damaged_and_other_records(spark, tmp_path, monkeypatch):
    about = b"1 0 o\nfields\n"
    start = b"filedesc://f 0.0.0.0 20200101000000 text/plain %d\n" % len(about) + about
    page = b"HTTP/1.1 200 OK\r\nX-Source-Id: 7\r\n\r\n<p>x</p>"
    line = b" 1.2.3.4 20200102030405 text/html %d\n"
    raw = start + b"\nhttp://a b/c" + line % len(page) + page
    raw += b"\nnot a header\nnor this\nhttp://u 1.2.3.4 20200102030405 text/html many\n"
    raw += b"\ndns:x.org 1.2.3.4 20200102 text/dns 3\nabc\nhttp://u 1.2.3.4 now text/html 3\nabc\n" + b"http://v" + line % len(page) + page + b"\nhttp://w" + line % 999 + b"short"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0").write_bytes(raw)
    (tmp_path / "arc" / "part-1").write_bytes(_gz(start)[:30] + b"xxxxxxxx" + _gz(start)[38:])
    (tmp_path / "arc" / "part-2").write_bytes(b"")
    arc = f"file://{tmp_path}/arc"
    reasons = [r.reason for r in archives.rejected(spark, arc).collect()]
    assert sorted(reasons) == ["a record declares 999 bytes, the file has 5 more", "damaged compression", "no date", "no header line"]
    shelf = archives.Shelf(spark, "test")
    archives.convert(spark, arc, shelf.path("warc"), shelf)
    found = {r.url: r for r in archives.read_warc(spark, shelf.path("warc")).collect()}
    assert {u: r.record_type for u, r in found.items() if u != "http://v"} == {"http://a%20b/c": found["http://a%20b/c"].record_type, "dns:x.org": "resource"}
    assert sorted(found[u].record_type for u in ("http://a%20b/c", "http://v")) == ["response", "revisit"] and all(r.reason is None for r in found.values())
    assert (found["dns:x.org"].payload_bytes, found["dns:x.org"].date) == (3, "2020-01-02T00:00:00Z")
    # Files of a few records each, every one with its version block.
    monkeypatch.setattr(archives, "FILE_BYTES", 512)
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"text {i % 7}") for i in range(50)], "page_id long, url string, html string").coalesce(2)
    archives.write_arc(pages, shelf.path("many"))
    sizes = [len(list(archives.arc_records(r.content))) for r in spark.read.format("binaryFile").load(shelf.path("many")).collect()]
    assert sum(sizes) == 50 and max(sizes) < 5
    assert archives.archive_pages(pages).where("record_type = 'response'").count() == 7
    damaged = [f for f, _ in archives.warc_records(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort")]
    assert [list(f) for f in damaged] == [["reason"]]


def test_archives_are_cut_by_running_bytes(spark, tmp_path, monkeypatch):
    """Resources only, and small responses before a stretch of large ones: no file is larger than its limit and one record."""
    monkeypatch.setattr(archives, "FILE_BYTES", 65_536)
    about = b"1 0 o\nfields\n"
    start = b"filedesc://f 0.0.0.0 20200101000000 text/plain %d\n" % len(about) + about
    (tmp_path / "arc").mkdir()
    body = b"x" * 50_000
    (tmp_path / "arc" / "part-0").write_bytes(start + b"".join(b"\nftp://u/%d 1.2.3.4 20200102030405 text/plain %d\n" % (k, len(body)) + body for k in range(20)))
    shelf = archives.Shelf(spark, "cut")
    archives.convert(spark, f"file://{tmp_path}/arc", shelf.path("warc"), shelf)
    pages = spark.createDataFrame([(i, f"http://x/{i}", ("y" if i < 300 else "z" * 30_000) + str(i)) for i in range(320)], "page_id long, url string, html string").coalesce(1)
    archives.write_arc(pages, shelf.path("pages"))
    for name, records, opening in (("warc", lambda x: archives.warc_records(x), 1), ("pages", lambda x: archives.arc_records(x), 0)):
        found = [list(records(r.content)) for r in spark.read.format("binaryFile").load(shelf.path(name)).collect()]
        assert len(found) >= 10 and all(1 <= len(x) - opening for x in found)
        assert max(sum(len(r[1] if opening else r["body"]) for r in x) for x in found) <= 65_536
    assert archives.read_warc(spark, shelf.path("warc")).count() == 20
    assert archives.archive_pages(pages).count() == 320


def _gz(raw):
    import gzip

    return gzip.compress(raw[:50]) + gzip.compress(raw[50:])


def test_topk(spark, monkeypatch):
    reads, put = collections.Counter(), topk.Shelf.put

    def counted(self, df, name, **how):
        out = put(self, df, name, **how)
        reads[name] = out.count()
        return out

    monkeypatch.setattr(topk.Shelf, "put", counted)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8).astype(np.float32)]) for i in range(300)]
    rows += [(400, None), (520, []), (521, []), (540, []), (420, [None] * 8), (440, [float("nan")] * 8), (460, [0.5, 0.25]), (480, [0.5, -0.5]), (None, [0.1] * 8), (20, [0.3] * 8), (500, rows[7][1]), (501, rows[7][1])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)), F.col("vec_id") % 20 == 0, k=10).collect()
    good = [(i, tuple(int(np.floor(64 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in {x for x in good if x[0] % 20 == 0}:
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)]
        want |= {(q, i, -s) for s, i in sorted(scored)[:10]} if q != 20 else set()
    assert {(r.query_id, r.vec_id, r.score) for r in found if r.query_id != 20} == want
    # Exact vectors are read for a part of the pairs only, and with wide cells in more than one round.
    pairs = 17 * 300
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found if r.query_id in (520, 540)} == {(520, 1, 521, 0), (520, 2, 540, 0), (540, 1, 520, 0), (540, 2, 521, 0)}
    assert sum(n for name, n in reads.items() if name.startswith("scored")) < pairs / 4
    reads.clear()
    wide = [(i, [float(x) * 10.0 ** (i % 5) for x in rng.normal(0, 1, 6)]) for i in range(200)] + [(1000, [1e9] * 6)]
    found = topk.top_k(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=7).collect()
    ints = {i: [int(np.floor(64 * x)) for x in v] for i, v in wide}
    for q in range(0, 200, 20):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:7]
        assert [(r.vec_id, -r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [(i, s) for s, i in scored]
    assert reads["scored1"] > 0 and sum(n for name, n in reads.items() if name.startswith("scored")) < 11 * 200
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0

    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_cells_bound_their_integers():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(-300, 300, 500), rng.integers(-(1 << 61), 1 << 61, 500), [0, -1, 1, -(1 << 62), (1 << 62) - 1]])
    for step in (1, 2, 64):
        low = topk.edges(step)
        cells = np.searchsorted(low, values, "right") - 1
        centre, half = topk.bounds(step)
        slack = np.abs(values) * 1e-12
        assert len(low) == 256 and (np.diff(low) >= 0).all() and (np.abs(values - centre[cells]) <= half[cells] + slack).all()
        assert (half[cells][np.abs(values) < topk.LINEAR * step] == (step - 1) / 2).all()


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_quality(docs, big):
    model = quality.fit_quality(*big)
    scored = quality.with_quality(big[0], model).join(big[1], "doc_id").where(quality.held_out(F.col("doc_id"))).select("score", "quality").toPandas()
    assert ((scored.score >= 0.3) == scored.quality).mean() > 0.97
    odd = quality.with_quality(docs, model, name="q")
    assert odd.columns == [*docs.columns, "q"] and odd.where("q is null or q < 0 or q > 1").count() == 0
    assert quality.quality_filter(docs, big[1].limit(0)).count() == docs.count()
    clash = quality.with_quality(docs.withColumn("score", F.lit("own")), model)
    assert clash.columns[-2:] == ["score", "score_"] and clash.where("score <> 'own'").count() == 0


def test_toxicity(docs, big):
    net = toxicity.fit_toxicity(*big)
    scored = toxicity.with_toxicity(big[0], net).join(big[1], "doc_id").where(quality.held_out(F.col("doc_id"), 4, 2)).select("score", "toxic").toPandas()
    assert ((scored.score >= 0.3) == scored.toxic).mean() > 0.95
    odd = toxicity.with_toxicity(docs, net, score="q")
    assert odd.where("q is null or q < 0 or q > 1 or flagged is null").count() == 0
    assert toxicity.fit_toxicity(docs, big[1].limit(0)).out.sum() == 0
    clash = toxicity.with_toxicity(docs.withColumns({"score": F.lit("own"), "flagged": F.lit("own")}), net)
    assert clash.columns[-4:] == ["score", "flagged", "score_", "flagged_"] and clash.where("score <> 'own' or flagged <> 'own'").count() == 0


def test_pipeline(spark, docs, tmp_path):
    """Every stage of a run against brute force on what the stage before kept, with nulls, empty and repeated rows."""
    import corpus_pipeline

    sf = f"{tmp_path}/sf"
    plain = docs.drop("kept", "component_id", "n")
    plain.write.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    at, tables = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or tables[name].columns == plain.columns
        at = tables[name]
    rows = {name: [(r.doc_id, r.text, r.source) for r in t.collect()] for name, t in tables.items() if name != "packing"}
    before = spark.read.parquet(f"{sf}/documents.parquet")
    scored = quality.with_quality(before, quality.fit_quality(before, labels), name="q").collect()
    assert collections.Counter(rows["quality"]) == collections.Counter((r.doc_id, r.text, r.source) for r in scored if r.q >= 0.3)
    # One of each class of texts, with the smallest id; ids last that are null.
    classes = collections.defaultdict(list)
    for i, t, _ in rows["quality"]:
        classes[SPACE.sub(" ", t or "")].append(i)
    assert collections.Counter(i for i, _, _ in rows["exact_dedup"]) == collections.Counter(min(g, key=lambda i: (i is None, i)) for g in classes.values())
    # One id of each component.
    sets = shingle_sets([(i, t) for i, t, _ in rows["exact_dedup"]])
    ids = [i for i in sets if i is not None]
    root = dict(zip(ids, ids, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert collections.Counter(rows["near_dedup"]) == collections.Counter(r for r in rows["exact_dedup"] if r[0] is None or find(r[0]) == r[0])
    # Readings of each source: all rows in whole epochs, and no row more than once in the last; of 2.9999 readings the third is not whole.
    want = readings([(s, len((t or "").split())) for _, t, s in rows["near_dedup"]], mixing.ENTROPY, mixing.REPEATS)
    own = collections.Counter(rows["near_dedup"])
    for r, n in collections.Counter(rows["mixing"]).items():
        assert int(want[r[2]] + 1e-6) * own[r] <= n <= (int(want[r[2]] - 1e-3) + 1) * own[r]
    assert set(rows["mixing"]) == set(rows["near_dedup"])
    # Every word is in one piece, and batches are full but for the last of a bucket.
    packed = tables["packing"].collect()
    words = collections.Counter()
    for i, t, _ in rows["mixing"]:
        words[i] += len(SPACE.sub(" ", t or "").split())
    found = collections.Counter()
    for r in packed:
        found[r.doc_id] += r.n_tokens
    assert found == words and len({(r.bucket_tokens, r.batch, r.slot) for r in packed}) == len(packed)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, packed))
    empty_sf = f"{tmp_path}/none"
    plain.limit(0).write.parquet(f"{empty_sf}/documents.parquet")
    labels.write.parquet(f"{empty_sf}/labels.parquet")
    assert corpus_pipeline.run(spark, empty_sf).count() == 0


@pytest.mark.parametrize("kind", ["mid_sentence", "unpunctuated", "changed_word", "chinese", "arabic", "hindi"])
def test_sentence_spans_wherever_a_passage_stands(spark, kind):
    rng = np.random.default_rng(7)
    letters = {"chinese": "春夏秋冬山川風雨花鳥", "arabic": "ابتثجحخدذر", "hindi": "कखगघचछजझटठ"}.get(kind, "abcdefghij")
    end = {"chinese": "。", "arabic": "؟", "hindi": "।"}.get(kind, ".")

    def words(n, marks):
        drawn = ["".join(rng.choice(list(letters), 6)) for _ in range(n)]
        return [w + end if marks and k % 15 == 14 else w for k, w in enumerate(drawn)]

    marked, between = kind not in ("unpunctuated", "changed_word"), "" if kind == "chinese" else " "
    rows, least = [], []
    for i in range(0, 40, 2):
        passage = words(110, marked)
        for k in (0, 1):
            other = passage[:55] + ["jjjjjjjj"] + passage[56:] if kind == "changed_word" and k else passage
            rows.append((i + k, between.join(words(31 + 8 * k + i % 7, marked) + other + words(23 + i % 5, marked))))
        least.append(rows[-1][0])
    found = {r.doc_id: r for r in sentence_spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    size = 6 if kind == "chinese" else 1
    shares = [found[i].removed_words / (110 * size) for i in least]
    assert min(shares) > 0.3 and np.mean(shares) > 0.6 and max(shares) <= 1.1
    assert all(found[i - 1].n_removed == 0 for i in least)


def test_labelled_sample_has_one_row_an_id(spark):
    rows = [(1, f"text {k}", "en") for k in range(300)] + [(i, None if i == 2 else f"other {i}", None) for i in range(2, 40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = [quality.labelled_sample(t, labels, "quality", quality.held_out, 10, "doc_id", "text", "lang").collect() for t in (table, table.repartition(5))]
    assert sorted(map(repr, found[0])) == sorted(map(repr, found[1])) and len(found[0]) == len({r.doc_id for r in found[0]}) == 10
    every = quality.labelled_sample(table, labels, "quality", lambda c: c < 0, 100, "doc_id", "text", "lang").collect()
    assert sorted(r.doc_id for r in every) == list(range(1, 40))

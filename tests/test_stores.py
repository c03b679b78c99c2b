import pytest
from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.operators import sinks as K
from millrace.plans import drivers as R
from millrace.plans import postings as P
from millrace.sources import landing as A
from millrace.sources.html import rendered
from millrace.stored import spread, table_at, written


def test_text_of_pages(spark):
    pages = [
        ("<figcaption>cap</figcaption>x", "cap\nx"), ("a<center>b</center>c", "abc"), ("a <div>b</div>c", "a b\nc"), ("x<body>in<p>side</p></body>out", "in\nside"), ("a</p>b", "ab"),
        ("a b\x0bc<!-- [if mso] --><br/>d", "a\nb\nc\nd"), ("<div><b>one<p>two</b>three</div>", "one\ntwo\nthree"), ("<ul><li>1<li>2</ul>3<hr>4", "1\n2\n3\n4"), ("<template><body>no</body></template>yes", "yes"),
    ]
    got = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "i int, h string").select("i", rendered(F.col("h"))["text"].alias("t")).collect()
    assert [r.t for r in sorted(got)] == [t for _, t in pages]


def test_landing_folder(spark, tmp_path):
    (tmp_path / "m").mkdir()
    lines = ['{"id": "a", "internalDate": "x"}', "{bad", '{"id": "b"}', "", '{"id": "b", "payload": {"parts": 3}}', '{"threadId": "c"}', "[1]", '{"id": "d", "payload": "x"}', '{"id": "e", "payload": {"body": {"data": "A"}}}', '{"id": "f", "internalDate": 5, "payload": {"headers": [{"name": "FROM", "value": "x@y"}, 7], "body": {"data": "_-8="}, "mimeType": "text/plain"}}']
    (tmp_path / "m" / "1.json").write_text("\n".join(lines))
    folder = f"file://{tmp_path}/m"
    got = {r.id: r for r in A.raw_messages(spark, folder).collect()}
    assert set(got) == {"b", "f"}
    bad = {r.line: r.reason for r in A.rejected_lines(spark, folder).collect()}
    assert bad == dict(zip([lines[k] for k in (0, 1, 5, 6, 7, 8)], ["date is no number", "no JSON object", "no id", "no JSON object", "payload is no object", "body is no base64"], strict=True))
    from millrace.sources.messages import normalized

    at = {r.message_id: (str(r.received_at), r.sender, r.plain_text) for r in normalized(A.raw_messages(spark, folder)).collect()}
    assert at == {"b": ("1970-01-01 00:00:00", "", ""), "f": ("1970-01-01 00:00:00.005000", "x@y", "\ufffd\ufffd")}
    target, rejected, now = f"file://{tmp_path}/t", f"file://{tmp_path}/r", F.lit("2024-01-01").cast("timestamp")
    counts = [tuple(R.synced_folder(spark, folder, target, rejected, n, now, [], F.lit(7))[0].first()) for n in (0, 0, 1)]
    assert counts == [(7, 9, 2, 1, 6), (7, 9, 2, 1, 6), (7, 9, 0, 3, 6)]
    assert table_at(spark, rejected).count() == 12 and table_at(spark, target).count() == 2
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "jobs-1.html").write_text("<p>x</p>")
    assert [(r.page_id, r.html) for r in A.saved_pages(spark, f"file://{tmp_path}/p").collect()] == [("jobs-1", "<p>x</p>")]
    assert A.lookback_query(5, ["a.com", "b.com"]) == "after:5 category:updates -from:a.com -from:b.com" and A.lookback_query(5, None, "") == "after:5"
    assert A.alive(spark).first().alive == 1


def test_parsers_are_registered_in_order():
    assert [s for s, _ in U.with_parser("x", "x.org")][-2:] == ["x", "generic"]
    assert [s for s, _ in U.with_parser("x", "x.org", before="indeed")][:3] == ["linkedin", "x", "indeed"]
    with pytest.raises(ValueError, match="nowhere"):
        U.with_parser("x", "x.org", before="nowhere")


def test_pending_follows_not_in(spark):
    emails = spark.createDataFrame([("a",), ("b",), (None,)], "message_id string")
    done = lambda *keys: spark.createDataFrame([(k,) for k in keys], "message_id string")
    ids = lambda *tables: sorted((r.message_id for r in R.pending(emails, *tables).collect()), key=str)
    assert ids(done("a"), done("c")) == ["b"] and ids(done("a"), done(None)) == [] and ids(done(), done()) == [None, "a", "b"] or ids(done(), done()) == ["a", "b", None]


def test_backfill_tells_failed_messages(spark):
    m = spark.createDataFrame([("a", "x@y", "2024-01-01"), ("b", "x@y", None), ("c", "x@bad.org", "2024-01-01")], "message_id string, sender string, at string").withColumn("received_at", F.col("at").cast("timestamp"))
    got = {r.message_id: r.status for r in R.backfill_events(m, m.limit(0), ["bad.org"]).collect()}
    assert got == {"a": "success", "b": "failed", "c": "skipped"}


def test_sinks_take_empty_and_null_batches(spark, tmp_path):
    schema = "account_id long, message_id string, seq long"
    target = f"file://{tmp_path}/m"
    assert table_at(spark, target) is None and K.read_postings(spark, target) is None
    K.store_new(spark.createDataFrame([], schema), target, ["account_id", "message_id"], 0)
    for number in (1, 1, 2):
        K.store_new(spark.createDataFrame([(1, None, 5), (1, None, 4), (None, "b", 2), (1, "a", number)], schema), target, ["account_id", "message_id"], number)
    got = sorted(((r.account_id, r.message_id, r.seq) for r in table_at(spark, target).select("account_id", "message_id", "seq").collect()), key=str)
    assert got == sorted([(1, None, 4), (None, "b", 2), (1, "a", 1)], key=str)


def test_counts_of_events_are_those_of_the_events(spark):
    rows = spark.createDataFrame([(1, "f", "accepted"), (2, "f", "accepted"), (3, "g", "accepted"), (4, "f", "stale"), (5, None, "rejected")], "seq long, fingerprint string, outcome string")
    each = {r.event_type: r["count"] for r in P.events(rows).groupBy("event_type").count().collect()}
    assert each == {r.event_type: r.n for r in P.event_counts(rows).collect()} == {"job_persisted": 2, "duplicate_detected": 1, "filtered_stale": 1, "normalization_rejected": 1}
    known = spark.createDataFrame([("g",)], "fingerprint string")
    assert {r.seq: r.event_type for r in P.events(rows, known).collect()}[3] == "duplicate_detected"


def test_written_tables_and_small_inputs(spark):
    few = spark.range(5).coalesce(1)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and written(few, "t").count() == 5


def test_unsafe_urls(spark):
    urls = [(None, "scheme is not http or https"), ("HTTP://8.8.8.8", None), ("http://user@localhost", "blocked host"), ("http://[::ffff:10.0.0.1]/", "internal or private address"), ("http://1.2.3", None), ("https://x.org", None)]
    got = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "i int, u string").select("i", U.unsafe_reason(F.col("u")).alias("r")).collect()
    assert [r.r for r in sorted(got)] == [w for _, w in urls]


def test_links_keep_the_first_sighting(spark, tmp_path):
    postings, links = f"file://{tmp_path}/p", f"file://{tmp_path}/l"
    schema = "fingerprint string, seq long, status string, categories array<string>, title string"
    batches = [[("a", 5, "RELEVANT", ["AI", "PHP"], "x"), ("b", 6, "IRRELEVANT", [], "y")], [("a", 1, "RELEVANT", ["Python"], "z"), ("a", 2, "RELEVANT", ["AI"], "z"), ("b", 9, "RELEVANT", ["AI"], "y"), ("c", 3, "RELEVANT", ["None"], "n")]]
    categories = spark.createDataFrame([(1, "AI"), (2, "PHP"), (3, "Python"), (4, "Python")], "id int, name string")
    for number in (0, 1, 0):
        rows = spark.createDataFrame(batches[number], schema)
        K.store_postings(rows, postings, number)
        K.store_links(rows, categories, links, number)
    assert sorted((r.fingerprint, r.category_id, r.matched_by) for r in K.read_links(spark, links, K.read_postings(spark, postings)).collect()) == [("a", 3, "rules"), ("a", 4, "rules")]


def test_events_say_what_happened(spark):
    rows = spark.createDataFrame(
        [(1, "f", "t", None, "fresh", "p", "u", "RELEVANT", "accepted"), (2, "f", "t", None, "fresh", "p", "u", "RELEVANT", "accepted"), (3, "g", None, "missing title", "fresh", "p", None, "IRRELEVANT", "rejected"), (4, "h", "o'x", None, "too_old", "p", "u", "IRRELEVANT", "stale")],
        "seq long, fingerprint string, title string, reason string, age string, platform string, job_url string, status string, outcome string",
    )
    got = {r.seq: r for r in P.described(P.events(rows), rows, F.lit("2024-01-01").cast("timestamp"), 24).collect()}
    assert {k: (r.event_type, r.status, r.fingerprint, r.message) for k, r in got.items()} == {
        1: ("job_persisted", "success", "f", "Persisted with status RELEVANT"), 2: ("duplicate_detected", "skipped", "f", "Fingerprint f already exists"),
        3: ("normalization_rejected", "skipped", None, "Candidate rejected during normalization: missing title"), 4: ("filtered_stale", "skipped", None, "Job 'o'x' older than 24h (reason: too_old)"),
    }
    assert got[3].metadata == '{"platform":"p"}' and list(got[1].asDict()) == P.EVENT
    m = spark.createDataFrame([("a", "x@y")], "message_id string, sender string")
    assert R.backfill_events(m, m.limit(0), []).columns == P.EVENT

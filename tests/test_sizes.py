"""Queries on tables whose keys and row counts are those of larger data."""

from pathlib import Path

import pytest
from oracle import duck, spark_rows
from pyspark.sql import functions as F

from millrace.functions.dates import posted_at
from millrace.functions.text import employment_type, remote_type, salary
from millrace.functions.urls import _trim, canonical_url, job_id, parser_of
from millrace.operators import rule_join as R
from millrace.operators.judge import _least, categories
from millrace.operators.scrape import resolved
from millrace.plans import postings as P
from millrace.plans import serving as V
from millrace.queries import QUERIES, SQL
from millrace.stored import spread

SF = "/root/testdata/sf0.001"


def tables(spark, folder: Path, **rows) -> str:
    """A folder of the tables of the smallest size, some of them replaced by frames."""
    for p in Path(SF).iterdir():
        if p.stem not in rows:
            (folder / p.name).symlink_to(p)
    for name, frame in rows.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same(spark, name: str, sf_dir: str) -> bool:
    """Whether a query and its SQL agree; a table that Spark wrote is a folder."""
    sql = SQL[name]
    for p in Path(sf_dir).iterdir():
        if p.is_dir():
            sql = sql.replace(f"FROM {p.stem}", f"FROM '{p}/*.parquet'")
    return spark_rows(QUERIES[name](spark, sf_dir)) == duck(SF, sql)


def test_addresses_of_users_beyond_four_figures(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    both = events.unionByName(events.selectExpr("event_id + 1000 as event_id", "ts", "user_id + 9990 as user_id", "event_type", "value", "props"))
    assert same(spark, "c15_resolved_addresses", tables(spark, tmp_path, events=both.coalesce(1)))


def test_rows_of_one_row_group_are_dealt_out(spark):
    """A file with more splits than cores, all rows of which are in one of them."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        table = spark.read.parquet(f"{SF}/events.parquet")
        assert table.rdd.getNumPartitions() >= 8 and max(len(p) for p in table.rdd.glom().collect()) == table.count()
        assert max(len(p) for p in spread(table).rdd.glom().collect()) <= table.count() // 8 + 1
        assert spread(table, 10).rdd.getNumPartitions() == -(-table.count() // 10)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _python_stages(frame) -> int:
    return frame._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_redirects_judge_urls_once(spark):
    """Starts are judged in the plan of the chase, hops aren't."""
    urls = spark.createDataFrame([("https://x.org/1",)], "url string")
    moves = spark.createDataFrame([("https://x.org/1", "https://x.org/2"), ("https://x.org/2", "http://10.0.0.1/")], "src string, dst string")
    found = resolved(urls, moves)
    assert _python_stages(found) == 1
    assert [tuple(r) for r in found.collect()] == [("https://x.org/1", "https://x.org/1", 2, True, "internal or private address")]


def test_texts_move_once_for_each_part_that_begins_in_them(spark):
    texts = spark.createDataFrame([(1, "https://www.LINKEDIN.com/jobs/view/1234567890/?trk=" + "e" * 300), (2, "link to none"), (3, None)], "k int, t string")
    parts = spark.createDataFrame([("a", "linkedin.com"), ("b", "Jobs/view"), ("c", "abc")], "slug string, d string")
    exploded = []
    real = R.F.explode
    with pytest.MonkeyPatch.context() as m:
        m.setattr(R.F, "explode", lambda c: exploded.append(c) or real(c))
        found = R.containing(texts, parts, "k", "t", "d")
    grams = texts.select(R.F.lower("t").alias("_text")).select(R.F.size(exploded[0]).alias("n")).where("n > 0")
    assert sorted(r["n"] for r in grams.collect()) == [1, 2]
    assert sorted((r["k"], r["slug"]) for r in found.collect()) == [(1, "a"), (1, "b")]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(R, "MOST_STARTS", 1)
        assert sorted((r["k"], r["slug"]) for r in R.containing(texts, parts, "k", "t", "d").collect()) == [(1, "a"), (1, "b")]


def test_published_parts_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "MOST_PARTS", 7, raising=False)
    rows = spark.range(1000).selectExpr("timestamp_seconds(id div 3) as received_at", "id as seq")
    V.publish(rows, f"{tmp_path}/v", 1, 10)
    found = V.served(spark, f"{tmp_path}/v", 1)
    assert found.index.count() <= 7 and found.count() == 1000
    assert [r["seq"] for r in found.page(30, 20).collect()] == list(range(419, 399, -1))
    last = found.page(1, 20).collect()[-1]
    assert [r["seq"] for r in found.after(last["received_at"], last["seq"], 20).collect()] == list(range(979, 959, -1))


@pytest.mark.parametrize("what, most", [("url", 16), ("date", 7), ("categories", 1)])
def test_a_rows_parts_are_computed_once(spark, what, most):
    """How often a plan names the patterns that take a row's time; a part named twice was computed twice, and parts of parts four times."""
    c = P.candidates(spark, SF)
    found = {
        "url": lambda: canonical_url(F.col("url"), parser_of(F.col("sender"))), "date": lambda: posted_at(F.col("posted_text"), F.col("received_at")),
        "categories": lambda: categories(F.regexp_replace("title", "a", "b"), F.lit(None).cast("string")),
    }
    plan = c.select(found[what]().alias("x"))._jdf.queryExecution().analyzed().toString().lower()
    assert 0 < plan.count("regexp_extract(") + plan.count("regexp_replace(") <= most


@pytest.mark.parametrize("name", ["j3_category_pivot", "j3_posting_store", "i4_j4_events", "i4_j3_compaction", "k3_k8_served"])
def test_postings_of_many_parts(spark, tmp_path, monkeypatch, name):
    """One row group with keys beyond those of the table, dealt out over 30 parts: no part has more rows than asked, and the rows are those of the SQL."""
    events, dealt = spark.read.parquet(f"{SF}/events.parquet"), []
    more = events.unionByName(events.withColumns({"event_id": F.col("event_id") + 100_000, "user_id": F.col("user_id") + 2_000}))
    sf_dir = tables(spark, tmp_path, events=more.coalesce(1))
    monkeypatch.setattr(P, "spread", lambda df: dealt.append(spread(df, 70)) or dealt[-1])
    assert same(spark, name, sf_dir)
    assert len(dealt) == 1 and max(len(p) for p in dealt[0].rdd.glom().collect()) <= 80


def _times(frame, name: str) -> int:
    return frame._jdf.queryExecution().optimizedPlan().toString().lower().count(f"{name}(")


@pytest.mark.parametrize("what, most", [("remote", 1), ("employment", 1), ("salary", 2), ("id", 5)])
def test_a_fields_pattern_is_searched_once(spark, what, most):
    """How often a plan searches for a field's patterns; a posting's id has five, of which each platform tries its own."""
    c = P.candidates(spark, SF)
    found = {"remote": lambda: remote_type(F.col("block")), "employment": lambda: employment_type(F.col("block")), "salary": lambda: salary(F.col("block")), "id": lambda: job_id(F.col("url"), F.col("sender"))}
    per_use = {"id": 2}.get(what, 1)  # by the name of the platform and by the domain in the URL
    plan = c.select("seq", found[what]().alias("x"))
    # An id that is the first of two patterns is compared with nothing and then taken.
    assert 0 < _times(plan, "regexp_extract") <= per_use * most + (2 if what == "id" else 0)


def test_words_of_fixed_rules_are_sets(spark):
    c = P.candidates(spark, SF)
    named, unnamed = (c.select(canonical_url(F.col("url"), p).alias("x")) for p in (parser_of(F.col("sender")), None))
    assert _times(named, "array_contains") == _times(unnamed, "array_contains") == 0
    # The platform is found once a row, however many rules ask for it.
    assert named._jdf.queryExecution().optimizedPlan().toString().lower().count("indeed.com)") <= 8


def test_urls_are_trimmed_of_all_unicode_blanks(spark):
    points = spark.createDataFrame([(i, f" {chr(i)}x{chr(i)}y{chr(i)}\n") for i in range(1, 0x3100)], "i int, t string")
    assert points.where(_trim(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    assert points.where(F.length(_trim(F.col("t"))) == 3).count() >= 20


def test_categories_are_searched_for_only_where_a_keyword_is(spark):
    texts = spark.createDataFrame([("Paid AI-Engineer",), ("said aid",), ("open cart, back-end",), ("phpx PHP",), (None,)], "t string")
    found = texts.select(categories(F.col("t"), F.lit(None).cast("string")).alias("c"))
    assert [r["c"] for r in found.collect()] == [["AI"], [], ["Backend", "OpenCart"], ["PHP"], []]
    # Before a text is searched for whole words it is asked for keywords that contain no other one.
    assert _least(["php developer", "PHP", "back-end", "end"]) == ["php", "end"]
    assert _times(found, "contains") > 0

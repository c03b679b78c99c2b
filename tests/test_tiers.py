"""Published pages, the two tiers of the posting table, detail pages of misses, and SQL functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import registered as G
from millrace.functions import urls as U
from millrace.operators import scrape as S
from millrace.operators import sinks as K
from millrace.plans import compaction as C
from millrace.plans import serving as V


def _postings(spark, n):
    at = F.when(F.col("id") % 11 != 0, F.timestamp_seconds(1_700_000_000 + F.col("id") % 97 * 60))
    return spark.range(n, numPartitions=5).select(F.col("id").alias("seq"), at.alias("received_at"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"))


def test_pages_are_those_of_offset_and_read_few_files(spark, tmp_path):
    rows, target = _postings(spark, 1000), f"file://{tmp_path}/served"
    V.publish(rows, target, 1, 50)
    V.publish(rows, target, 1, 50)
    found = V.served(spark, target, 1)
    want = [r.seq for r in sorted(rows.collect(), key=lambda r: (r.received_at or dt.datetime.min, r.seq), reverse=True)]
    assert found.count() == 1000 and found.index.count() == 20
    for number, size in ((1, 7), (40, 25), (3, 333), (143, 7), (50, 100)):
        page = found.page(number, size)
        assert [r.seq for r in page.collect()] == want[(number - 1) * size : number * size]
        assert len(page.inputFiles()) <= size // 40 + 2
    at, got = None, [r.seq for r in found.page(1, 30).select("seq").collect()]
    by_seq = {r.seq: r.received_at for r in rows.collect()}
    while len(got) < 1000:
        page = found.after(by_seq[got[-1]], got[-1], 130)
        assert len(page.inputFiles()) <= 6
        more = [r.seq for r in page.collect()]
        assert more, at
        got += more
    assert got == want and found.after(by_seq[want[-1]], want[-1], 5).count() == 0
    V.publish(rows.limit(0), target, 2)
    empty = V.served(spark, target, 2)
    assert (empty is None or empty.count() == 0) and V.served(spark, target, 3) is None
    V.retire(spark, target, 1)
    assert V.served(spark, target, 1) is None


def _sightings(spark, n):
    i = F.col("id")
    return spark.range(n).select(
        (i % 37).cast("string").alias("fingerprint"), i.alias("seq"), F.concat(F.lit("t"), i.cast("string")).alias("title"), F.when(i % 5 == 0, F.timestamp_seconds(i)).alias("job_posted_at"),
        F.when(i % 3 == 0, F.concat(F.lit("r"), i.cast("string"))).alias("remote_type"), F.lit(None).cast("string").alias("salary"), F.when(i % 7 == 1, F.lit("full")).alias("employment_type"),
    )


def test_compaction_keeps_rows_and_moves_no_base(spark, tmp_path):
    rows, plain = _sightings(spark, 400), f"file://{tmp_path}/plain"
    table = C.PostingTable(spark, f"file://{tmp_path}/tiers", 4)
    assert table.read() is None and table.covered() == 0
    table.compact(3)
    for number in range(8):
        batch = rows.where(F.col("seq") % 8 == (number * 5 + 3) % 8)
        table.add(batch, number)
        table.add(batch, number)
        K.store_postings(batch, plain, number)
        if number in (2, 5):
            table.compact(number + 1)
            assert table.covered() == number + 1
        names = sorted(table.read().columns)
        assert names == sorted(K.read_postings(spark, plain).columns)
        assert sorted(map(str, table.read().select(names).collect())) == sorted(map(str, K.read_postings(spark, plain).select(names).collect()))
    # The base is scanned in its buckets: only the batches are shuffled.
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Scan parquet" in line]
    at = next(k for k, line in enumerate(plan.splitlines()) if "Bucketed: true" in line)
    above = plan.splitlines()[:at]
    assert scans and not any("Exchange" in line for line in above), plan
    with pytest.raises(ValueError, match="in the base"):
        table.add(rows, 1)
    table.retire()
    assert sorted(map(str, table.read().select(names).collect())) == sorted(map(str, K.read_postings(spark, plain).select(names).collect()))
    again = C.PostingTable(spark, f"file://{tmp_path}/tiers", 4)
    spark.sql(f"DROP TABLE {again.name}_6")
    assert again.read().count() == 37


def test_only_pages_of_misses_are_read(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    cards = spark.createDataFrame([(i, "Python Developer" if i % 4 else "Clerk", f"u{i}") for i in range(40)], "pos int, title string, job_url string")

    def page(rows):
        for r in rows:
            yield r

    details = spark.createDataFrame([(f"u{i}", "<body>a python developer</body>") for i in range(100)], "url string, html string")
    details.write.parquet(f"{tmp_path}/details")
    found = S.relevant(cards, spark.read.parquet(f"{tmp_path}/details"), "Python developer")
    assert found.count() == 40 and seen.value == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The semi join stands below the aggregate that brings a page's copies together.
    assert plan.index("Aggregate [url") < plan.index("LeftSemi")


def test_sql_functions_are_the_columns(spark):
    G.register(spark)
    G.register(spark)
    urls = [
        "https://uk.linkedin.com/comm/jobs/view/12/?trk=x&position=2&b=1&a=%7Ez*", " https://www.indeed.com/viewjob?jk=AB1&from=x&vjk=2 ", "http://x.org/?u=glassdoor.com&src=1&q='", "http://u:p@LinkedIn.com:80//a//comm/b/", "", "x", None,
        "https://wellfound.com/job-listings/a-b?src=1&b=2#f", "https://www.glassdoor.com/job-listing/a-JV_JO77.htm?src=a",
    ]
    df = spark.createDataFrame([(u, p, a) for u in urls for p in (None, "indeed", "nope") for a in ("Apply now", "x", None)], "url string, platform string, anchor string")
    df.createOrReplaceTempView("sql_urls")
    found = spark.sql("SELECT canonical_url(url), canonical_url(url, platform), platform_job_id(url), platform_job_id(url, platform), is_job_url(url), link_score(url, anchor) FROM sql_urls").collect()
    url, platform = F.col("url"), F.col("platform")
    want = df.select(U.canonical_url(url), U.canonical_url(url, platform), U.job_id(url), U.job_id(url, platform), U.is_job_url(url), U.link_score(url, F.col("anchor"))).collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in want]


def test_scratch_deletes_what_was_written(spark):
    from millrace.stored import scratch, table_at, written

    with scratch(spark):
        one = written(spark.range(3), "one")
        with scratch(spark):
            two = written(spark.range(4), "two").inputFiles()[0]
        assert one.count() == 3 and table_at(spark, two.rsplit("/", 1)[0]) is None
        path = one.inputFiles()[0].rsplit("/", 1)[0]
    assert table_at(spark, path) is None and written(spark.range(2), "kept").count() == 2

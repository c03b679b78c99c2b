import pytest
from oracle import duck, spark_rows

from millrace.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck(SF, SQL[name])


def test_rendering_keeps_lines_and_first_links(spark):
    from pyspark.sql import functions as F

    from millrace.sources.html import rendered

    html = '<head><title>t</title></head><p>Hello <b>bold</b></p><script>x</script>next<br>line <a href="https://a/1">one</a><a href="https://a/1">two</a><a href="/rel">no</a>'
    row = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(rendered(F.col("html")).alias("r")).collect()
    assert row[0].r.text == "Hello bold\nnext\nline onetwono"
    assert [(x.url, x.anchor_text) for x in row[0].r.links] == [("https://a/1", "one")]
    assert row[1].r is None and row[2].r.text == ""


def test_messages_decode(spark):
    import base64

    from millrace.sources.messages import RAW_MESSAGE, normalized

    coded = base64.urlsafe_b64encode("Grüße?>".encode()).decode().rstrip("=")
    raw = [("m1", None, "1787912100000", [{"name": "FROM", "value": "a@b"}], [{"mime_type": "text/plain", "data": ""}, {"mime_type": "text/plain", "data": coded}])]
    r = normalized(spark.createDataFrame(raw, RAW_MESSAGE)).first()
    assert (r.sender, r.subject, r.plain_text, r.html) == ("a@b", "", "Grüße?>", None)
    assert str(r.received_at) == "2026-08-28 10:15:00"


def test_explicit_dates(spark):
    from pyspark.sql import functions as F

    from millrace.functions.dates import posted_at

    rows = [("Posted Aug 28, 2026",), ("posted on Sept. 2 2026",), ("Posted 2026-08-01",), ("1 month ago",), ("just now",), ("Posted 2027-01-01",), ("nothing",), (None,)]
    df = spark.createDataFrame(rows, "t string").withColumn("ref", F.lit("2026-10-31 10:00:00").cast("timestamp"))
    got = [str(r[0]) for r in df.select(posted_at(F.col("t"), F.col("ref"))).collect()]
    assert got == ["2026-08-28 00:00:00", "2026-09-02 00:00:00", "2026-08-01 00:00:00", "2026-09-30 10:00:00", "2026-10-31 10:00:00", "None", "None", "None"]


def test_stream_stores_each_message_once(spark, tmp_path):
    from millrace.streaming.ingest import store_messages

    schema = "account_id long, message_id string, seq long"
    for part, rows in enumerate(([(1, "a", 1), (1, "b", 2), (1, "a", 3)], [(1, "b", 4), (2, "b", 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        store_messages(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = sorted((r.account_id, r.message_id, r.seq) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "a", 1), (1, "b", 2), (2, "b", 5)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["c9_title_like_lines", "c5_nav_anchor_lines"])
def test_every_line_is_judged(spark, name):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert QUERIES[name](spark, SF).count() == sum(t.count("\n") + 1 for t in texts if t is not None) > len(texts)

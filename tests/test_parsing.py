import datetime as dt

from pyspark.sql import functions as F

from millrace.functions import lines as L
from millrace.plans import parsing

SCHEMA = "message_id string, sender string, subject string, received_at timestamp, plain_text string, html string"
NOW = dt.datetime(2024, 5, 1, 12)
VIEW = "https://www.linkedin.com/jobs/view/"


def _parsed(spark, *rows):
    df = spark.createDataFrame([(i, s, subject, NOW, text, html) for i, s, subject, text, html in rows], SCHEMA)
    return {(r.message_id, r.job_url): r for r in parsing.candidates(df).collect()}


def test_messages_without_links_or_rows_give_nothing(spark):
    assert _parsed(spark, ("a", None, None, None, None), ("b", "x@linkedin.com", "s", "", ""), ("c", "x@y", "s", "see https://example.org/", "<a href='https://www.linkedin.com/feed'>x</a>")) == {}
    assert parsing.candidates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plain_text_between_anchors_and_whole_text(spark):
    flat = f'<html><body><a href="{VIEW}1">Data Engineer</a> <a href="{VIEW}2">Site Manager</a> <a href="{VIEW}3">Go</a></body></html>'
    text = "Hello\nData Engineer\nAcme Works\nBerlin, Germany\nSite Manager\nOther Corp\n$50,000 a year\nFull time\n2 days ago"
    got = _parsed(spark, ("b", "jobs@indeed.com", "s", text, flat), ("d", "jobs@indeed.com", "s", f"Chief Designer\nRed House\n{VIEW}9", None))
    assert [(r.title, r.company, r.location) for r in (got["b", f"{VIEW}1"], got["b", f"{VIEW}2"])] == [("Data Engineer", "Acme Works", "Berlin, Germany"), ("Site Manager", "Other Corp", None)]
    two = got["b", f"{VIEW}2"]
    assert (two.salary, two.employment_type, two.posted_date, two.job_posted_at) == ("$50,000 a year", "full-time", "2 days ago", dt.datetime(2024, 4, 29, 12))
    assert ("b", f"{VIEW}3") not in got and got["d", f"{VIEW}9"].title == "Chief Designer"


def test_anchor_text_is_the_title_and_one_record_per_id(spark):
    card = f'<div><p>Acme Works</p><a href="{VIEW}7?trk=a">Machine Learning Lead</a><p>Lahore, Pakistan (Remote)</p></div>'
    again = f'<div><a href="{VIEW}7/other">Machine Learning Lead of all</a><p>promoted</p><p>$9,000 a month</p></div>'
    got = list(_parsed(spark, ("m", "x@linkedin.com", "s", None, f"<body>{card}{again}</body>")).values())
    assert len(got) == 1
    assert (got[0].title, got[0].company, got[0].location, got[0].remote_type, got[0].salary, got[0].is_promoted) == ("Machine Learning Lead", "Acme Works", "Lahore, Pakistan (Remote)", "remote", "$9,000 a month", True)


def test_company_before_the_anchor_and_generic_subject(spark):
    job = "https://www.glassdoor.com/job-listing/x-JV_JO5.htm"
    page = f'<body><div><p>Blue Corp</p><a href="{job}">Night Nurse</a><p>Rome, Italy</p>3 days ago<a href="{job}">Easy Apply</a><p>no</p></div></body>'
    other = "https://boards.greenhouse.io/jobs/44"
    got = _parsed(spark, ("g", "a@glassdoor.com", "s", None, page), ("o", "a@b.org", " Night Shift ", "hm", f'<a href="{other}">go</a>'))
    g = got["g", job]
    assert (g.title, g.company, g.location, g.posted_date, g.platform_job_id) == ("Night Nurse", "Blue Corp", "Rome, Italy", "3 days ago", "5")
    assert got["o", other].title == "Night Shift"


def test_title_like_lines(spark):
    good = ["Senior Engineer", "Backend", "Nurse (Night)"]
    bad = [None, "", "ab", "Apply now", "Promoted", "Remote", "On-site", "2 hours ago", "Berlin, Germany", "$50,000 a year", "ailable.", "ved", "still av", "ty Part", "---", "some tkt"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, t string")
    got = {r.i for r in df.where(L.is_title_like(F.col("t"))).collect()}
    assert got == set(range(len(good)))


def test_fields_are_cleaned(spark):
    from millrace.sources.anchors import unescaped

    rows = [("&lt;td&gt;A&amp;B &nbsp; x<!--y-->",), ("<p> </p>",), (None,), ("z" * 300,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(L.cleaned_field(unescaped(F.col("t")))).collect()]
    assert got == ["A&B x y", None, None, "z" * 255]


def test_card_cascades(spark):
    from millrace.sources.cards import parsed_cards

    html = (
        '<ul><li data-job-id=" 12 "><h3></h3><a href="https://www.linkedin.com/jobs/view/12/?trk=z">Pilot - Sky Air - Oslo</a><span class="job-card-container__company-name">3 days ago</span>'
        '<h4 class="base-search-card__subtitle">Sky  Air</h4><time datetime="2024-04-02T10:00:00Z"></time></li><li data-job-id="13"><p>none</p></li></ul><div class="base-search-card"><h3>not read</h3></div>'
    )
    pages = spark.createDataFrame([(1, html, NOW), (2, None, NOW), (3, "", NOW)], "page_id long, html string, scraped_at timestamp")
    rows = parsed_cards(pages).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.title, r.company, r.location, r.job_url, r.job_id, r.posted_text) == ("Pilot", "Sky Air", None, "https://www.linkedin.com/jobs/view/12", "12", "2024-04-02T10:00:00Z")
    assert r.posted_at == dt.datetime(2024, 4, 2, 10)


def test_best_link_when_no_block_has_text(spark):
    text = "Night Nurse\nRome, Italy\nhttps://boards.greenhouse.io/jobs/1\nhttps://boards.greenhouse.io/jobs/2"
    other = "https://www.linkedin.com/in/someone"
    got = _parsed(
        spark, ("a", "a@b.org", " ", text, None), ("b", "a@b.org", "Subject", text, None),
        ("c", "a@b.org", "", f"Night Shift\n{other}\nhttps://boards.greenhouse.io/jobs/1", None), ("d", "a@b.org", None, "no links", None),
    )
    assert [(k, r.title) for k, r in got.items() if k[0] == "a"] == [(("a", "https://boards.greenhouse.io/jobs/1"), "Night Nurse")]
    assert {r.title for k, r in got.items() if k[0] == "b"} == {"Subject"} and len([k for k in got if k[0] == "b"]) == 2
    assert [r.title for k, r in got.items() if k[0] == "c"] == ["Night Shift"] and not [k for k in got if k[0] == "d"]


def test_leaf_parts(spark):
    from millrace.sources.messages import leaf_parts

    deep = '{"parts": [' * 50 + '{"mimeType": "a/b", "body": {"data": "x"}}' + "]}" * 50
    rows = [('{"mimeType": "text/plain", "body": {"data": "eA"}}',), (deep,), ("{bad",), (None,), ("[1]",), ('{"parts": [], "mimeType": "q"}',)]
    got = [[tuple(x) for x in r[0]] for r in spark.createDataFrame(rows, "j string").select(leaf_parts(F.col("j"))).collect()]
    assert got == [[("text/plain", "eA")], [("a/b", "x")], [], [], [], [("q", None)]]


def test_scrape_outcomes(spark):
    from millrace.plans.drivers import scrape_counts, scraped

    old = NOW - dt.timedelta(days=9)
    rows = [
        (1, 0, "Python Developer", "Oslo", "u1", "1", NOW), (1, 1, "Python Developer", "Oslo", "u1b", "1", NOW), (1, 2, "Python Developer", None, "u3", "3", NOW), (1, 3, "Python Developer", "Oslo", "u4", "4", old),
        (1, 4, "Python Developer", "Oslo", "u5", None, None), (2, 0, "Python Developer", "Oslo", "u1", "1", NOW), (2, 1, "Cook", "Oslo", "u6", "6", NOW), (2, 2, "Python Developer", "Oslo", "u9", "9", NOW),
    ]
    cards = spark.createDataFrame([(*r, NOW) for r in rows], "page_id long, pos int, title string, location string, job_url string, job_id string, posted_at timestamp, scraped_at timestamp")
    details = spark.createDataFrame([], "url string, html string")
    stored = spark.createDataFrame([("9", None)], "job_id string, job_url string")
    out = scraped(cards, details, stored, "python developer", "Oslo", "7d")
    assert {(r.page_id, r.pos): r.outcome for r in out.collect()} == {(1, 0): "saved", (1, 3): "too_old", (1, 4): "saved", (2, 0): "duplicate", (2, 2): "duplicate"}
    assert {tuple(r) for r in scrape_counts(cards, out).collect()} == {(1, 5, 2, 0, 1), (2, 3, 0, 2, 0)}


def test_cleaned_before_judged_and_stored(spark):
    from pyspark.sql import functions as F

    from millrace.operators.judge import reject_reason
    from millrace.plans.postings import postings, processed

    titles = ["<!--[if gte mso 9]><tr><![endif]-->", "&lt;td&gt;&nbsp;&lt;/td&gt;", "  ", None, "", "<b>x</b>", "Python &amp; Go Developer &lt;td&gt;(Remote)", "Backend  Engineer"]
    rows = [(k, t, f"https://www.linkedin.com/jobs/view/{100 + k}", "jobs@linkedin.com", "Acme &lt;b&gt;Ltd&lt;/b&gt;", "now", "Full time", "2026-08-28 10:00:00") for k, t in enumerate(titles)]
    found = spark.createDataFrame(rows, "seq long, title string, url string, sender string, company string, posted_text string, block string, at string").withColumn("received_at", F.col("at").cast("timestamp"))
    invisible = "title without visible text"
    want = [invisible, invisible, invisible, "missing title", "missing title", "unreliable title", None, None]
    out = {r.seq: r for r in processed(found).collect()}
    assert [out[k].reason for k in range(8)] == want
    assert [out[k].title for k in (0, 6, 7)] == [None, "Python & Go Developer (Remote)", "Backend Engineer"] and out[6].company == "Acme Ltd"
    judged = found.select("seq", reject_reason(F.col("title"), F.col("url"), F.lit(None).cast("string"), F.col("received_at")).alias("reason")).collect()
    assert [r.reason for r in sorted(judged)] == want
    assert sorted(r.title for r in postings(processed(found)).collect()) == ["Backend Engineer", "Python & Go Developer (Remote)"]

"""Messages are read once: what the cheaper columns and helpers give is what the plain rules give."""

import random

from pyspark.sql import functions as F

from millrace.functions import lines as L
from millrace.functions import text as X
from millrace.functions import urls as U
from millrace.plans import parsing
from millrace.queries import QUERIES
from millrace.sources import anchors as A
from millrace.sources import dom, html

SF = "/root/testdata/sf0.001"
PIECES = [
    "<p>", "</p>", '<a href="https://x/?a=1&amp;b=2">', '<a href="https://y/">', "</a>", "a  & b", "&lt;", "<br>", "<br/>", "<script>a<b</script>", "<!-- c -->", "<title>x</title>", "<head>", "</head>", "<body>", "</body>",
    "<div>", "</div>", "<td>", "</td>", "<hr>", "\n", "\x85", " x ", "\xa0y\t", "<svg>", "</svg>", "<template>", "</template>", "word",
]


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_page_is_read_once_for_text_and_anchors():
    rng = random.Random(3)
    for _ in range(3_000):
        page = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14)))
        got = A._page(page, None)
        assert got["text"] == html._read(page, ())[0], page
        urls = [a.attrs.get("href", "").strip() for a in dom.elements(dom.tree(page)) if a.tag == "a"]
        assert [x["url"] for x in got["found"]] == urls
        assert [x["first"] for x in got["found"]] == [u not in urls[:k] for k, u in enumerate(urls)]
    assert A._page("<p>page</p>", "plain")["text"] == "plain"


def test_links_are_chosen_within_the_row_of_a_message(spark):
    """Reading, links and blocks move nothing; entries without an id aren't moved either, as none is merged with another."""
    m = spark.createDataFrame([("m", "x@linkedin.com", "s", None, None, "")], "message_id string, sender string, subject string, received_at timestamp, plain_text string, html string")
    plan = _plan(parsing.blocks(m))
    assert plan.count("read(") == 1 and "Exchange" not in plan and "Join" not in plan
    assert _plan(QUERIES["e4_anchor_positions"](spark, SF)).count("Exchange") <= 1


def test_links_of_a_message(spark):
    """Of a canonical URL the longest anchor text, the first of ties, in the place of its first anchor; around it the best anchor of its own URL, whatever that leads to."""
    view = "https://www.linkedin.com/jobs/view/"
    page = (
        f'<body><a href="{view}2">Go</a><a href="{view}1?trk=a">Data Engineer</a><a href="{view}1/">Some Engineer</a><a href="https://www.linkedin.com/feed">Feed</a><a href="{view}2?trk=b">Chief Baker</a>'
        f'<a href="{view}2">Sign in to see this long text</a><a href="{view}3">unsubscribe</a><a href="{view}3">Head Gardener of all</a></body>'
    )
    rows = spark.createDataFrame([("m", "x@linkedin.com", "s", None, page)], "message_id string, sender string, subject string, plain_text string, html string").withColumn("received_at", F.lit(None).cast("timestamp"))
    got = [(r.ord, r.url, r.anchor_text, r.best_text) for r in parsing.blocks(rows).orderBy("ord").collect()]
    assert [g[1:] for g in got] == [(f"{view}2?trk=b", "Chief Baker", "Sign in to see this long text"), (f"{view}1?trk=a", "Data Engineer", "Data Engineer")]


def _old_title_like(line):
    line = F.trim(line)
    words = F.split(line, r"(?U)\s+")
    several, last = F.size(words) >= 2, F.element_at(words, -1)
    whole = lambda p: line.rlike(f"{'(?i)' if p.startswith('(?i)') else ''}^(?:{p.removeprefix('(?i)')})$")
    no = (
        (F.length(line) < 3) | line.rlike(L.ACTION) | ~line.rlike(r"[\p{L}\p{N}]") | line.rlike(L.BADGE) | whole(X.REMOTE) | whole(X.POSTED) | line.rlike(L.PLACE) | whole(X.SALARY_CURRENCY) | whole(X.SALARY_PLAIN)
        | line.rlike(r"[.,;:]$") | (~F.contains(line, F.lit(" ")) & (F.length(line) < 6)) | (several & ((F.length(last) <= 2) | (F.length(words[0]) <= 2))) | (~last.rlike("(?i)[aeiou]") & (F.length(last) < 4))
    )
    return F.coalesce(~no, F.lit(False))


WORDS = [
    "Senior", "Engineer", "at", "Acme", "xyz", "ab", "é", "Ünal", "1", "12", "50,000", "$50,000", "a year", "USD 5k", "- 60,000", "Remote", "hybrid", "on-site", "Berlin,", "Germany", "Apply now", "save job", "Promoted", "posted", "3 days ago", "just now", "Ago", ".", ";", "—", "-", "\t",
    "\xa0", " ", " ", "\n", "\r\n", "\x85", "\x0b", " ", "\U0001f600", "full time", "Part-time", "contractor", "manage", "View all", "sponsored", "Rs. 5", "GBP9",
]


def test_columns_give_what_the_plain_patterns_give(spark):
    rng = random.Random(11)
    texts = [(" " * rng.randint(0, 1)).join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))) for _ in range(20_000)]
    t, none = F.col("t"), F.lit("")
    df = spark.createDataFrame([(x,) for x in texts] + [(None,)], "t string")
    found = lambda p, g=1: F.nullif(F.regexp_extract(t, p, g), none)
    money = F.coalesce(found(f"({X.SALARY_CURRENCY})"), found(f"({X.SALARY_PLAIN})"))
    pairs = {
        "title": (L.is_title_like(t), _old_title_like(t)), "lines": (L.lines_of(t), F.filter(F.transform(F.split(F.coalesce(t, none), r"\R"), lambda x: L.cleaned(x)), lambda x: x.isNotNull())),
        "posted": (X.posted_phrase(t), found(X.POSTED, 0)), "salary": (X.salary(t), F.trim(F.regexp_replace(money, r"\s+", " "))), "remote": (X.remote_type(t), F.replace(F.lower(found(X.REMOTE)), F.lit("on-site"), F.lit("onsite"))),
        "promoted": (X.is_promoted(t), t.rlike(X.PROMOTED)), "way": (L.is_remote_line(t), t.rlike(X.REMOTE)),
    }
    for name, (new, old) in pairs.items():
        wrong = df.select("t", new.alias("new"), old.alias("old")).where("not (new <=> old)").limit(3).collect()
        assert not wrong, (name, wrong)


def test_only_entries_with_an_id_are_merged(spark, monkeypatch):
    """Of five senders' digests those of one are read again by id; the entries of the others stay where they are."""
    merged, real = [], parsing.one_per_id
    monkeypatch.setattr(parsing, "one_per_id", lambda rows, *more: merged.append(rows) or real(rows, *more))
    found = QUERIES["e2_f2_g1_g6_html_digests"](spark, SF)
    sources = {r["source"]: r["count"] for r in found.groupBy("source").count().collect()}
    assert len(sources) == 5 and merged[0].count() == sources["linkedin"] < sum(sources.values()) / 3


def test_words_of_navigation_are_cleaned_once(spark):
    """A text is put in lower case and its blanks made even once a row, not once for each phrase."""
    df = spark.createDataFrame([("View  all",)], "t string")
    plan = df.select(U.is_nav_anchor(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
    assert df.where(U.is_nav_anchor(F.col("t"))).count() == 1

"""Messages and result pages that Spark derives from the event table, so that parsing has input that grows with it.

Twenty events make one message or page; a card is one event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .postings import candidates

CARDS = 20
COMPANY = "Acme Works"
#: Senders in turn with the URL of a posting before and after its number.
SENDERS = [
    ("Jobs <jobs@linkedin.com>", "https://uk.linkedin.com/comm/jobs/view/", "/?trk=e&utm_source=x"), ("alert@indeed.com", "https://www.indeed.com/viewjob?from=m&jk=j", "&tk=7"),
    ("noreply@glassdoor.com", "https://www.glassdoor.com/job-listing/acme-JV_JO", ".htm?src=a"), ("team@wellfound.com", "https://wellfound.com/job-listings/acme-", "?utm_source=z"),
    ("board@example.org", "https://boards.greenhouse.io/jobs/", "?ref=q"),
]


def _pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("message", F.floor(F.col("seq") / CARDS))
    link = F.concat(_pick([s[1] for s in SENDERS], F.col("message")), F.col("seq").cast("string"), _pick([s[2] for s in SENDERS], F.col("message")))
    pay = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("$"), (50 + F.col("seq") % 50).cast("string"), F.lit(",000 a year"))).otherwise("")
    return c.select("message", "seq", "received_at", "title", "place", "posted_text", link.alias("link"), pay.alias("pay"))


def _paged(cards: DataFrame, card: Column) -> DataFrame:
    """One row per message: its cards in order as one text, and its latest instant."""
    rows = cards.groupBy("message").agg(F.array_sort(F.collect_list(F.struct("seq", card.alias("card")))).alias("cards"), F.max("received_at").alias("at"))
    return rows.select("message", "at", F.array_join(F.transform("cards", lambda x: x["card"]), "\n").alias("cards"))


def _message(rows: DataFrame, html: Column, text: Column) -> DataFrame:
    sender = _pick([s[0] for s in SENDERS], F.col("message"))
    return rows.select(F.col("message").alias("message_id"), sender.alias("sender"), F.lit("Your job alert").alias("subject"), F.col("at").alias("received_at"), text.alias("plain_text"), html.alias("html"))


def html_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of cards; one sender's cards have the company before the title."""
    company, link = F.lit(f"<p>{COMPANY}</p>"), F.concat(F.lit('<a href="'), F.replace(F.col("link"), F.lit("&"), F.lit("&amp;")), F.lit('">'), "title", F.lit("</a>"))
    head = F.when(F.col("message") % len(SENDERS) == 2, F.concat(company, link)).otherwise(F.concat(link, company))
    card = F.concat(F.lit("<table><tr><td>"), head, *[x for c in ("place", "pay", "posted_text") for x in (F.lit("<p>"), F.col(c), F.lit("</p>"))], F.lit("</td></tr></table>"))
    rows = _paged(_cards(spark, sf_dir), card)
    page = F.concat(F.lit("<html><head><title>t</title></head><body><div>20 new jobs for you</div>"), "cards", F.lit('<p><a href="https://www.linkedin.com/psettings/">Manage alerts</a></p></body></html>'))
    return _message(rows, page, F.lit(None).cast("string"))


def text_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests in plain text: "title at company - place", then the link, once for each card."""
    card = F.concat(F.col("title"), F.lit(f" at {COMPANY}"), F.lit(" - Lahore\n"), "posted_text", F.lit("\n"), "link")
    return _message(_paged(_cards(spark, sf_dir).where("title <> 'x'"), card), F.lit(None).cast("string"), F.col("cards"))


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of search results; some cards have no title."""
    e = lambda tag, kind, c: F.concat(F.lit(f'<{tag} class="{kind}">'), c, F.lit(f"</{tag}>"))
    url = F.concat(F.lit('<a class="base-card__full-link" href="https://pk.linkedin.com/comm/jobs/view/'), F.col("seq").cast("string"), F.lit('?position=1"></a>'))
    title = e("h3", "base-search-card__title", F.when(F.col("title") != "x", F.col("title")).otherwise(""))
    posted = F.concat(F.lit('<time class="job-search-card__listdate" datetime="2023-12-31">'), "posted_text", F.lit("</time>"))
    meta = e("div", "base-search-card__metadata", F.concat(e("span", "job-search-card__location", F.col("place")), posted))
    card = e("div", "base-search-card", F.concat(url, title, e("h4", "base-search-card__subtitle", F.lit(COMPANY)), meta))
    rows = _paged(_cards(spark, sf_dir), card)
    return rows.select(F.col("message").alias("page_id"), F.concat(F.lit("<body>"), "cards", F.lit("</body>")).alias("html"), F.col("at").alias("scraped_at"))

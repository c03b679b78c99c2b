"""Search URLs, access walls, redirects, and relevance with detail pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import search_text
from ..functions.urls import any_in, unsafe_reason
from ..sources.anchors import page_words
from ..stored import written
from .judge import keyword_matches

# The search page and the tokens of its filters.
SEARCH = "https://www.linkedin.com/jobs/search/"
POSTED = {"past_24_hours": "r86400", "past_week": "r604800", "past_month": "r2592000"}
KIND = {"full_time": "F", "part_time": "P", "contract": "C", "temporary": "T", "internship": "I"}
WORKPLACE = {"remote": "2", "hybrid": "3", "onsite": "1"}
# Marks of a page that only asks to log in or to wait.
WALL_URLS, WALL_TEXTS = ["/authwall", "/m/login", "/login"], ["you've been temporarily blocked", "too many requests"]
HOPS = 5


def search_url(keyword: Column, place: Column, posted: Column, kind: Column, workplace: Column) -> Column:
    """The URL of a search; blank texts and unknown filters add nothing."""

    def text(name: str, c: Column) -> Column:
        c = F.nullif(F.trim(c), F.lit(""))
        return F.concat(F.lit(f"{name}="), F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")))

    def token(name: str, c: Column, tokens: dict[str, str]) -> Column:
        return F.concat(F.lit(f"{name}="), F.try_element_at(F.create_map(*[F.lit(x) for kv in tokens.items() for x in kv]), c))

    query = F.concat_ws("&", text("keywords", keyword), text("location", place), token("f_TPR", posted, POSTED), token("f_JT", kind, KIND), token("f_WT", workplace, WORKPLACE))
    return F.when(query == "", SEARCH).otherwise(F.concat(F.lit(f"{SEARCH}?"), query))


def is_walled(url: Column, html: Column) -> Column:
    return F.coalesce(any_in(url, WALL_URLS), F.lit(False)) | F.coalesce(any_in(F.lower(html), WALL_TEXTS), F.lit(False))


def resolved(urls: DataFrame, moves: DataFrame, hops: int = HOPS, reason=unsafe_reason) -> DataFrame:
    """url with final_url, hops, blocked and reason after following moves (src, dst) at most `hops` times: one equi-join a hop.

    Of several moves from one source the smallest counts. Every URL on the way is judged
    before it is followed; at the first that must not be, the chase stops, and final_url is
    the URL that it began with. A URL is judged where it is named, once for each move and once
    for each start, so that no hop needs Python; moves with their reasons are stored.
    """
    moves = moves.where("src is not null and dst is not null").groupBy("src").agg(F.min("dst").alias("dst"))
    moves = written(moves.select("src", "dst", reason(F.col("dst")).alias("why")), "moves")
    out = urls.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"), reason(F.col("url")).alias("reason"))
    for _ in range(hops):
        # Without a key a blocked chase finds no move.
        at = out.withColumn("at", F.when(F.col("reason").isNull(), F.col("final_url")))
        out = at.join(moves, at["at"] == moves["src"], "left").select("url", F.coalesce("dst", "final_url").alias("final_url"), (F.col("hops") + F.col("dst").isNotNull().cast("int")).alias("hops"), F.coalesce("reason", "why").alias("reason"))
    blocked = F.col("reason").isNotNull()
    return out.select("url", F.when(blocked, F.col("url")).otherwise(F.col("final_url")).alias("final_url"), "hops", blocked.alias("blocked"), "reason")


def relevant(cards: DataFrame, details: DataFrame, keyword: str) -> DataFrame:
    """Cards (title, job_url, ...) that fit a keyword by title, else with the text of their detail page (url, html).

    Only the pages of cards whose title doesn't fit are read: details are first cut down to
    their URLs, before any page is moved where these are few enough to broadcast. One that only mentions a
    technology in its description, without a role beside it, goes. Cards without a page that
    fit by title stay; blank keywords keep all cards.
    """
    if not keyword.strip():
        return cards
    fits = lambda text: keyword_matches(keyword, text, rules.ROLES, rules.ROLE_WORDS, rules.STACK_WORDS)
    by_title = fits(F.coalesce("title", F.lit("")))
    misses = cards.where(~by_title & F.col("job_url").isNotNull())
    wanted = misses.select(F.col("job_url").alias("_wanted")).distinct()
    pages = details.join(wanted, details["url"] == wanted["_wanted"], "left_semi").groupBy(F.col("url").alias("_url")).agg(F.min("html").alias("_html"))
    read = misses.join(pages, misses["job_url"] == pages["_url"]).withColumn("_words", page_words(F.col("_html")))
    tech = [w for w in re.sub("[^a-z0-9]+", " ", keyword.lower()).split() if w not in rules.ROLE_WORDS]
    passing = F.lit(False)
    if tech:
        words = F.array(*[F.lit(t) for t in tech])
        has = lambda c: F.arrays_overlap(F.split(search_text(c), " "), words)
        beside = any_in(search_text(F.col("_words")), [p for t in tech for r in rules.ROLES for p in (f"{t} {r}", f"{r} {t}")])
        passing = ~has(F.coalesce("title", F.lit(""))) & ~beside & has(F.col("_words"))
    found = read.where(fits(F.concat_ws(" ", "title", "_words")) & ~passing).select(*cards.columns)
    return cards.where(by_title).unionByName(found)

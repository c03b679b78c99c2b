"""Validation, freshness, classification and relevance: columns that tag rows with an outcome and a reason."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import is_reliable_title, search_text
from ..functions.urls import any_in, is_job_url, job_id, once
from ..sources.anchors import stored_field


def reject_reason(title: Column, url: Column, posting_id: Column, received_at: Column, platform: Column | None = None, visible: Column | None = None) -> Column:
    """Why a candidate is no posting; null where it is one.

    `title` is as found; `visible` is what cleaning leaves of it, for callers that have it already.
    """
    visible = stored_field(title) if visible is None else visible
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    known = ~blank(posting_id) | job_id(url, platform).isNotNull() | is_job_url(url)
    return (
        F.when(title.isNull() | (title == ""), "missing title").when(visible.isNull(), "title without visible text").when(~is_reliable_title(visible), "unreliable title")
        .when(blank(url) & blank(posting_id), "no url or id").when(~known, "unsupported url").when(received_at.isNull(), "missing received_at")
    )


def freshness(posted: Column, received: Column, hours: int = 24, unknown: str = "keep") -> Column:
    """fresh, too_old or unknown_date; the limit itself is fresh, and an unknown date is fresh unless `unknown` is reject."""
    age = F.unix_micros(received) - F.unix_micros(posted)
    return F.when(posted.isNull(), "unknown_date" if unknown == "reject" else "fresh").when(age <= hours * 3_600_000_000, "fresh").otherwise("too_old")


def in_age_window(posted: Column, scraped: Column, option: str) -> Column:
    hours = rules.AGE_HOURS.get(option)
    if hours is None:
        return F.lit(True)
    return posted.isNull() | (posted >= scraped - F.make_dt_interval(F.lit(0), F.lit(hours)))


def _pattern(keywords: list[str]) -> str:
    return r"\b(?:" + "|".join(re.escape(k.lower()) for k in keywords) + r")\b"


def _least(keywords: list[str]) -> list[str]:
    """The keywords in lower case that contain no other one: a text with any of them all has one of these."""
    low = dict.fromkeys(k.lower() for k in keywords)
    return [k for k in low if not any(other != k and other in k for other in low)]


def categories(title: Column, description: Column, wanted: dict[str, list[str]] | None = None, negative: dict[str, list[str]] | None = None, disabled: frozenset[str] = frozenset()) -> Column:
    """Names of matching categories in rule order: any keyword as whole words, none of the negative ones. Disabled categories play no part.

    The small rule table becomes one alternation for each category, so there is no join. A text
    is searched for whole words only where it contains a keyword.
    """
    wanted, negative = wanted or rules.CATEGORIES, negative or {}
    text = F.lower(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(description, F.lit(""))))
    wanted = {name: keywords for name, keywords in wanted.items() if name not in disabled}
    if not wanted:
        return F.array().cast("array<string>")

    def hit(name: str, text: Column) -> Column:
        found = any_in(text, _least(wanted[name])) & text.rlike(_pattern(wanted[name]))
        return found & ~text.rlike(_pattern(negative[name])) if negative.get(name) else found

    return once(text, lambda text: F.array_compact(F.array(*[F.when(hit(name, text), F.lit(name)) for name in wanted])))


def rule_tables(table: DataFrame) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """The wanted and the negative keywords of enabled categories, for categories(), from a rule table (id, name, enabled, keyword, negative).

    Rules are few, and every one becomes a part of an expression; they come to the driver in the order of ids.
    """
    wanted: dict[str, list[str]] = {}
    negative: dict[str, list[str]] = {}
    for r in table.where("enabled").orderBy("id", "keyword").select("name", "keyword", "negative").collect():
        (negative if r["negative"] else wanted).setdefault(r["name"], []).append(r["keyword"])
    return wanted, negative


def status(found: Column) -> Column:
    return F.when(F.size(found) > 0, "RELEVANT").otherwise("IRRELEVANT")


def keyword_matches(keyword: str, text: Column, roles: list[str], role_words: set[str], stack: set[str]) -> Column:
    """Whether a title fits a search keyword; the keyword is a literal, so its phrases are constants.

    Words of the keyword that name no role are technologies. A technology next to a role
    fits; a full-stack text with several stack words doesn't; one technology alone doesn't;
    several fit when all are there.
    """
    words = [w for w in re.sub("[^a-z0-9]+", " ", keyword.lower()).split() if w]
    if not keyword.strip():
        return F.lit(True)
    if not words:
        return F.lit(False)
    tech = [w for w in words if w not in role_words]
    text = search_text(text)
    tokens = F.split(text, " ")
    array = lambda values: F.array(*[F.lit(v) for v in values])
    if not tech:
        return F.arrays_overlap(tokens, array(words))
    near = any_in(text, [f"{t} {r}" for t in tech for r in roles] + [f"{r} {t}" for t in tech for r in roles])
    mixed = text.rlike(r"full ?stack") & (F.size(F.array_intersect(tokens, array(sorted(stack)))) > 1)
    every = F.size(F.array_intersect(tokens, array(sorted(set(tech))))) == len(set(tech))
    return near | (~mixed & (every if len(tech) > 1 else F.lit(False)))

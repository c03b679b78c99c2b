"""Result-page cards: texts and attributes by selector from the page's tree, then fields as columns."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import posted_at
from ..functions.lines import cleaned
from ..functions.urls import canonical_url, job_id
from .dom import Node, elements, joined, tree

# Selectors in order of priority.
CARDS = ["li[data-occludable-job-id]", "li[data-job-id]", "div.base-search-card", "div.job-card-container"]
LINK = ["a.base-card__full-link", "a.job-card-list__title--link", "a.job-card-container__link", 'a[href*="/jobs/view/"]']
TITLE = ["a.job-card-list__title--link span[aria-hidden='true']", "h3.base-search-card__title", "span.job-card-list__title", "a.job-card-container__link span", "h3"]
COMPANY = ["span.job-card-container__company-name", "span.job-card-container__primary-description", "h4.base-search-card__subtitle", "div.base-search-card__subtitle h4"]
LOCATION = [
    "div.job-card-container__metadata-sibling", "li.job-card-container__metadata-item", "span.job-card-container__metadata-item", "li.job-search-card__metadata-item",
    "div.base-search-card__metadata span.job-search-card__location", "span.job-search-card__location", "p.job-search-card__location",
]
POSTED = ["span.job-card-container__listed-time", "time.job-search-card__listdate--new", "time.job-search-card__listdate", "p.job-search-card__listdate", "time"]
AGE = r"(?i)\b(just now|\d+\s*(?:minute|hour|day|week|month|year)s?\s+ago)\b"


@cache
def _steps(selector: str) -> list[tuple[str, str, str, str, str]]:
    """(tag, class, attribute, operator, value) of each step of a descendant selector."""
    step = r"(\w+)(?:\.([\w-]+))?(?:\[([\w-]+)(?:(\*?=)[\"']([^\"']*)[\"'])?\])?"
    return [re.fullmatch(step, s).groups("") for s in selector.split()]


def _fits(node: Node, step: tuple[str, str, str, str, str]) -> bool:
    tag, klass, attr, op, value = step
    has = node.attrs.get(attr)
    return (
        node.tag == tag and (not klass or klass in node.attrs.get("class", "").split())
        and (not attr or (has is not None and (not op or (has == value if op == "=" else value in has))))
    )


def _below(node: Node, above: list[tuple[str, str, str, str, str]]) -> bool:
    """Whether ancestors fit the steps before the last, in their order."""
    want, up = list(above), node.parent
    while want and up is not None:
        if _fits(up, want[-1]):
            want.pop()
        up = up.parent
    return not want


@cache
def _by_tag(selectors: tuple[str, ...]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for s in selectors:
        found.setdefault(_steps(s)[-1][0], []).append(s)
    return found


def _found(node: Node, selectors: tuple[str, ...], every: bool = False) -> dict[str, list[Node]]:
    """The first node below one, or every node, that each selector fits, from one walk."""
    tags, out = _by_tag(selectors), {}
    for x in elements(node):
        for s in tags.get(x.tag, ()):
            if every or s not in out:
                *above, last = _steps(s)
                if _fits(x, last) and _below(x, above):
                    out.setdefault(s, []).append(x)
    return out


_FIELDS = {"link": LINK, "title": TITLE, "company": COMPANY, "location": LOCATION, "posted": POSTED}
_SELECTORS = tuple(dict.fromkeys(s for v in _FIELDS.values() for s in v))


def _read(html: str) -> list[dict]:
    found, out = _found(tree(html), tuple(CARDS), every=True), []
    for card in next((found[s] for s in CARDS if s in found), []):
        own = _found(card, _SELECTORS)
        first = {k: [own[s][0] for s in v if s in own] for k, v in _FIELDS.items()}
        view = own.get(LINK[-1])
        out.append(
            {"pos": len(out), "ids": [card.attrs.get("data-occludable-job-id", ""), card.attrs.get("data-job-id", "")], "links": [x.attrs.get("href", "") for x in first["link"]]}
            | {k: [joined(x, " ") for x in first[k]] for k in ("title", "company", "location", "posted")} | {"dates": [x.attrs.get("datetime", "") for x in first["posted"]], "view": joined(view[0], " ") if view else ""}
        )
    return out


_LISTS = ("ids", "links", "title", "company", "location", "posted", "dates")
_TYPE = pa.list_(pa.struct([("pos", pa.int32()), *((n, pa.list_(pa.string())) for n in _LISTS), ("view", pa.string())]))


def cards(html: Column) -> Column:
    """The cards of a page in order, with the texts of each field's selectors; null html has none."""

    @F.arrow_udf("array<struct<pos: int, " + ", ".join(f"{n}: array<string>" for n in _LISTS) + ", view: string>>")
    def read(column: pa.Array) -> pa.Array:
        return pa.array([_read(h) if h else [] for h in column.to_pylist()], _TYPE)

    return read(html)


def _first(values: Column, ok=lambda x: F.lit(True)) -> Column:
    return F.try_element_at(F.filter(F.transform(values, cleaned), lambda x: x.isNotNull() & ok(x)), F.lit(1))


def parsed_cards(pages: DataFrame) -> DataFrame:
    """One row per card with a title of pages (page_id, html, scraped_at): first non-blank text of each field, dates against scraped_at."""
    c = pages.select("page_id", "scraped_at", F.explode_outer(cards(F.col("html"))).alias("c")).where("c is not null").select("page_id", "scraped_at", "c.*")
    url = _first(F.col("links"))
    not_age = lambda x: ~x.rlike(AGE)
    sr = F.filter(F.split(F.col("view"), r"\s+-\s+"), lambda x: F.trim(x) != "")
    title = F.coalesce(_first(F.col("title")), F.when(url.isNotNull(), cleaned(F.try_element_at(sr, F.lit(1)))))
    both = F.filter(F.arrays_zip("posted", "dates"), lambda x: cleaned(x["posted"]).isNotNull() | cleaned(x["dates"]).isNotNull())
    shown, attr = cleaned(F.try_element_at(both, F.lit(1))["posted"]), cleaned(F.try_element_at(both, F.lit(1))["dates"])
    rows = c.select(
        "page_id", "pos", "scraped_at", title.alias("title"), _first(F.col("company"), not_age).alias("company"), _first(F.col("location"), not_age).alias("location"), url.alias("url"),
        _first(F.col("ids")).alias("own_id"), shown.alias("shown"), attr.alias("attr"),
    ).where("title is not null")
    linkedin = F.lit("linkedin")
    return rows.select(
        "page_id", "pos", "title", "company", "location", canonical_url(F.col("url"), linkedin).alias("job_url"), F.coalesce("own_id", job_id(F.col("url"), linkedin)).alias("job_id"),
        F.coalesce("shown", "attr").alias("posted_text"), "scraped_at", F.coalesce(posted_at(F.col("shown"), F.col("scraped_at")), F.try_to_timestamp("attr")).alias("posted_at"),
    )

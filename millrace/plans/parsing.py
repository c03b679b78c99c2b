"""From messages to candidates: links, one block of text for each link, fields, and one record per posting of a message.

A page gives the array of its anchors, and links are chosen among them in the row of their
message, as its plain text must be cut between them: nothing moves before the entries of one
posting are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import text as X
from ..functions import urls as U
from ..functions.dates import posted_at
from ..operators.identity import one_per_id
from ..sources.anchors import anchor_places, page, unescaped
from ..sources.messages import text_links
from ..stored import written

MARK = "\u0001"
# The fields that count as filled when entries of one posting compete, and the mark of a card's own link.
FILLED = ["company", "location", "remote_type", "salary", "employment_type", "posted_date"]
CARD_LINK = r"(?i)jobcard[-_]?body"


def _computed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once a row, whatever is asked of it later."""
    rest = [c for c in rows.columns if c != name]
    return rows.select(*rest, F.explode(F.array(value)).alias(name))


def _first_of_each(rows: Column, *order) -> Column:
    """Of an array of structs the first of each value of order[0], by the rest of the order; one for each value, sorted by it."""
    rows = F.array_sort(F.transform(rows, lambda x: F.struct(*[o(x).alias(f"k{i}") for i, o in enumerate(order)], x.alias("row"))))
    return U.once(rows, lambda rows: F.transform(F.filter(rows, lambda x, i: (i == 0) | (x["k0"] != rows[F.greatest(i - 1, F.lit(0))]["k0"])), lambda x: x["row"]))


def _judged(found: Column, slug: Column) -> Column:
    """The anchors of a message with what is asked of their URLs more than once: own and canonical URL, whether they lead to a posting, and whether they may."""

    def judge(x: Column) -> Column:
        url, text = x["url"], x["anchor_text"]
        ruled = U.ruled_by(url)
        own = U.canonical_url(url, slug)
        # The rules of the platform that sent the message are mostly those of its URLs too.
        same = F.coalesce(ruled, F.lit("")) == F.coalesce(U.ruled_by(url, slug), F.lit(""))
        may = x["first"] & ~U.is_other_url(url) & ~U.is_bare_domain(url) & ~U.is_nav_anchor(text)
        return U.once(own, lambda own: F.struct(
            *[x[c].alias(c) for c in ("pos", "url", "anchor_text", "holder", "above", "below")], own.alias("own"), F.when(same, own).otherwise(U.canonical_url(url)).alias("canonical"),
            may.alias("may"), U.is_job_url(url).alias("job"),
        ))

    return F.transform(found, judge)


def _links(found: Column) -> Column:
    """The postings' links of a message in order, once per canonical URL with the longest anchor text, and what surrounds the best anchor."""
    size = lambda x: -F.length(F.trim(x["anchor_text"]))
    canonical, own, pos = (lambda x: x["canonical"]), (lambda x: x["own"]), (lambda x: x["pos"])
    wanted = F.filter(found, lambda x: x["may"] & x["job"])
    best = _first_of_each(found, own, lambda x: -F.length(x["anchor_text"]), pos)

    def link(chosen: Column, first: Column, best: Column) -> Column:
        at = F.filter(best, lambda x: x["own"] == chosen["own"])[0]
        return U.once(at, lambda at: F.struct(first["pos"].alias("ord"), *[chosen[c].alias(c) for c in ("url", "anchor_text", "own")], at["holder"].alias("holder"), at["anchor_text"].alias("best_text"), at["above"].alias("above"), at["below"].alias("below")))

    # Both have one row for each canonical URL, in the same order.
    pairs = U.once(wanted, lambda x: F.arrays_zip(_first_of_each(x, canonical, size, pos).alias("chosen"), _first_of_each(x, canonical, pos).alias("first")))
    return U.once(best, lambda best: F.array_sort(F.transform(pairs, lambda x: link(x["chosen"], x["first"], best))))


def _best(found: Column) -> Column:
    """The best scored link of a message, the first of ties, if it leads to a posting itself."""
    scored = F.transform(F.filter(found, lambda x: x["may"]), lambda x: F.struct(U.link_score(x["url"], x["anchor_text"]).alias("score"), (-x["pos"]).alias("place"), x["url"].alias("url"), x["own"].alias("own"), x["job"].alias("job")))
    return U.once(F.array_max(scored), lambda x: F.when(x["job"], F.struct(x["url"].alias("url"), x["own"].alias("own"))))


def _is_title_anchor(text: Column) -> Column:
    return F.coalesce((F.length(text) >= 3) & ~text.rlike(L.ACTION), F.lit(False))


def blocks(messages: DataFrame) -> DataFrame:
    """One row per link of messages (message_id, sender, subject, received_at, plain_text, html), with the block of text that belongs to it.

    The block is the card around the link's anchor; without cards, the text from one "title
    at company" to the next if there are as many as links; else from the place of one anchor
    text to the next; else the whole text for a single link. A link without any has an empty
    block. Messages without links to postings give no rows; null bodies count as empty. A
    message of no known platform with a blank subject and only empty blocks has one row
    more, with `last`: its best link and the whole text.
    """
    m = messages.select("message_id", F.coalesce("subject", F.lit("")).alias("subject"), "received_at", page(F.col("html"), F.col("plain_text")).alias("page"), U.parser_of(F.coalesce("sender", F.lit(""))).alias("slug"))
    m = m.select("message_id", "subject", "received_at", "slug", "page.*")
    none = F.lit(None).cast("string")
    plain = F.transform(text_links(F.col("text")), lambda u, i: F.struct(i.alias("pos"), u.alias("url"), F.lit("").alias("anchor_text"), none.alias("holder"), none.alias("above"), F.lit("").alias("below"), F.lit(True).alias("first")))
    m = m.withColumn("found", F.when(F.size("found") > 0, F.col("found")).otherwise(plain))
    # Each step is a column of its own, and a generator between two of them keeps the next ones from computing it again.
    j = _computed(m, "found", _judged(F.col("found"), F.col("slug")))
    # Asked for only where the subject can't be a title.
    top = F.when((F.col("slug") == "generic") & (F.trim("subject") == ""), _best(F.col("found")))
    j = _computed(j, "x", F.struct(_links(F.col("found")).alias("links"), top.alias("top"))).select("message_id", "subject", "received_at", "slug", "text", "x.*").where("size(links) > 0")
    text = F.col("text")
    text = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, "")).otherwise(text)
    j = j.withColumn("in_cards", F.exists("links", lambda x: x["holder"].isNotNull()))
    pieces = F.split(F.regexp_replace(text, L.TITLE_AT, MARK + "$0"), MARK)
    j = j.withColumn("pieces", F.when(~F.col("in_cards") & (F.size("links") > 1) & text.rlike(L.AT), pieces))
    j = j.withColumn("inline", F.coalesce(F.size("pieces") == F.size("links") + 1, F.lit(False)))
    j = j.withColumn("places", anchor_places(F.when(~F.col("in_cards") & ~F.col("inline"), F.col("text")), F.transform("links", lambda x: x["anchor_text"])))
    located = F.exists("places", lambda p: p >= 0)

    def block(x: Column, i: Column) -> Column:
        at = F.element_at("places", i + 1)
        following = F.try_element_at(F.filter(F.slice("places", i + 2, F.size("places")), lambda p: p >= 0), F.lit(1))
        between = F.when(at >= 0, F.substr(F.col("text"), at + 1, F.greatest(F.coalesce(following, F.length("text")) - at, F.lit(0))))
        whole = F.when(F.size("links") == 1, F.col("text"))
        text = F.when(F.col("in_cards"), x["holder"]).when(F.col("inline"), F.element_at("pieces", i + 2)).when(located, between).otherwise(whole)
        # Anchors that weren't found come after those that were.
        late = F.when(~F.col("in_cards") & ~F.col("inline") & located & (at < 0), F.size("links")).otherwise(0)
        return F.struct((i + late).alias("ord"), x["url"].alias("url"), x["anchor_text"].alias("anchor_text"), x["own"].alias("own"), x["best_text"].alias("best_text"), x["above"].alias("above"), x["below"].alias("below"), F.coalesce(text, F.lit("")).alias("block"), F.lit(False).alias("last"))

    none, empty = F.lit(None).cast("string"), F.lit("")
    last = F.struct(F.lit(0).alias("ord"), F.col("top.url").alias("url"), empty.alias("anchor_text"), F.col("top.own").alias("own"), none.alias("best_text"), none.alias("above"), empty.alias("below"), F.col("text").alias("block"), F.lit(True).alias("last"))
    j = j.withColumn("blocks", F.transform("links", block))
    lost = F.col("top").isNotNull() & F.forall("blocks", lambda x: L.first_line(x["block"]).isNull())
    titled = (F.col("slug") == "glassdoor") & F.exists("links", lambda x: _is_title_anchor(x["best_text"]))
    # Outer, though no list is empty: the filter that Spark infers otherwise repeats the expressions.
    return j.select("message_id", "slug", "subject", "received_at", titled.alias("by_anchor"), F.explode_outer(F.when(lost, F.array_append("blocks", last)).otherwise(F.col("blocks"))).alias("x")).select("message_id", "slug", "subject", "received_at", "by_anchor", "x.*")


def _around_title(rows: DataFrame, name: str, asked: Column) -> DataFrame:
    """Adds the fields where the anchor's text is the title, if it can be one: company and place are read again from the other lines. Rows that aren't asked for keep theirs."""
    rows = rows.withColumn("_anchor", F.when(asked, L.cleaned(F.col("anchor_text")))).withColumn("_at", F.array_position(F.transform("lines", F.lower), F.lower("_anchor")))
    at, anchor, f, again, none = F.col("_at"), F.col("_anchor"), F.col("f"), F.col("_again"), F.lit(None).cast("string")
    rest = F.concat(F.slice("lines", F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), F.slice("lines", (at + 1).cast("int"), F.greatest(F.size("lines"), F.lit(1))))
    rows = L.with_fields(rows.withColumn("_rest", F.when(at > 0, rest)), "_rest", "_again").withColumn("_titled", L.is_title_like(anchor))
    rows = rows.withColumn("_company", F.coalesce(again["company"], again["title"]))
    company = F.when(L.is_title_like(F.col("_company")) & (F.lower("_company") != F.lower(anchor)), F.col("_company"))

    def fields(company, location, remote):
        return F.struct(anchor.alias("title"), company.alias("company"), location.alias("location"), remote.alias("remote")).cast(L.FIELDS)

    title = f["title"]
    out = (
        F.when(~F.col("_titled"), f).when(title.isNull(), fields(none, none, none)).when(F.contains(F.lower(anchor), F.lower(title)), f)
        .when(at == 0, fields(F.when(F.lower(f["company"]) != F.lower(title), f["company"]), f["location"], f["remote"]))
        .otherwise(fields(company, again["location"], F.coalesce(f["remote"], again["remote"])))
    )
    return rows.withColumn(name, out).drop("_anchor", "_at", "_rest", "_again", "_titled", "_company")


def candidates(messages: DataFrame) -> DataFrame:
    """Candidate postings of messages: one row per link with a title, for one platform's digests one per posting id.

    Columns: message_id, source, ord, title, company, location, job_url, platform_job_id,
    received_at, job_posted_at, posted_date, remote_type, salary, employment_type,
    is_promoted, first_seen. Empty tables give empty results.
    """
    by_anchor, slug = F.col("by_anchor"), F.col("slug")
    # Cards of a digest whose titles are its anchors are read by their anchors alone.
    b = blocks(messages).withColumn("lines", L.lines_of(unescaped(F.when(~by_anchor, F.col("block")))))
    b = _around_title(L.with_fields(b, "lines", "f"), "around", ~by_anchor & (slug == "linkedin"))
    named = F.struct(
        F.when(_is_title_anchor(F.col("best_text")), F.col("best_text")).alias("title"), F.col("above").alias("company"),
        F.try_element_at(F.filter(L.lines_of(F.col("below")), lambda x: x.rlike(L.PLACE)), F.lit(1)).alias("location"), F.lit(None).cast("string").alias("remote"),
    ).cast(L.FIELDS)
    f = F.when(by_anchor, named).when(slug == "linkedin", F.col("around")).otherwise(F.col("f"))
    source = F.when(by_anchor, F.col("below")).otherwise(F.col("block"))
    # The generator computes the fields once a row; the filter on the title would repeat them else.
    b = b.withColumn("read", F.explode(F.array(F.struct(f.alias("f"), source.alias("text"))))).select("*", "read.f.title", "read.f.company", "read.f.location", "read.f.remote", "read.text").drop("read", "f", "around", "lines")
    text, guess = F.col("text"), L.title_guess(F.col("subject"), F.col("block"))
    rows = b.select(
        "message_id", F.col("slug").alias("source"), "ord", "url", "anchor_text",
        F.when(F.col("last"), F.coalesce(guess, "title")).when(slug == "generic", F.coalesce("title", guess)).otherwise(F.col("title")).alias("title"), "company", "location",
        F.col("own").alias("job_url"), U.job_id(F.col("own"), slug).alias("platform_job_id"), "received_at", X.posted_phrase(text).alias("posted_date"),
        F.coalesce("remote", X.remote_type(text)).alias("remote_type"), X.salary(text).alias("salary"), X.employment_type(text).alias("employment_type"), X.is_promoted(text).alias("is_promoted"),
    ).where("title is not null")
    filled = sum((F.col(c).isNotNull().cast("int") for c in FILLED[1:]), F.col(FILLED[0]).isNotNull().cast("int"))
    rank = [F.col("url").rlike(CARD_LINK), filled, F.length(F.trim("anchor_text"))]
    # Stored, as rows without an id stand for themselves: only the others are moved and merged.
    rows = written(rows.withColumn("one", F.when(F.col("source") == "linkedin", F.col("platform_job_id"))), "entries")
    merged = one_per_id(rows.where("one is not null"), "message_id", "one", rank, "ord", FILLED)
    rows = merged.unionByName(rows.where("one is null").withColumn("first_seen", F.col("ord")).select(merged.columns))
    return rows.withColumn("job_posted_at", posted_at(F.col("posted_date"), F.col("received_at"))).drop("one", "url", "anchor_text")

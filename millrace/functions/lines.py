"""Fields read from the lines of one posting's block, as column expressions over arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .urls import once

# Patterns of lines.
TITLE_AT = r"([A-Za-z0-9 ./,&()+\-']{3,80}?)\s+at\s+([A-Za-z0-9 .,&()\-']{2,80})"
DIGEST_HEADER = r"(?i)(\d+\s+new\s+(?:jobs?|roles?|openings)|\bjobs?\b\s+(?:match|for)\b|match(?:es)?\s+your\s+alert|new\s+jobs?\s+for\s+you|job\s+alerts?)"
ACTION = r"(?i)^(apply\s+now?|apply\s+on\s+company\s+site|easy\s+apply|view\s+job|view\s+details?|see\s+job|see\s+more|show\s+more|save\s+job|not\s+interested|dismiss)$"
BADGE = r"(?i)^(?:promoted|sponsored)$"
PLACE = r"(?i)^([A-Za-z][A-Za-z .'-]*,\s*[A-Za-z][A-Za-z .'-]*|(?:remote|hybrid|on-site|onsite)\b.*)$"
PLACE_REMOTE = r"(?i)\(\s*(?:remote|hybrid|on-?site)\s*\)\s*$"
MARKUP = r"(?i)<!--|-->|\[if[^\]]*\]>?|<!\[endif\]?>?"

FIELDS = "struct<title: string, company: string, location: string, remote: string>"


def _part(pattern: str, whole: bool = False) -> str:
    """A pattern as one of several; `whole` patterns must cover a line."""
    flags, pattern = ("i", pattern.removeprefix("(?i)")) if pattern.startswith("(?i)") else ("", pattern)
    return f"(?{flags}:^(?:{pattern})$)" if whole else f"(?{flags}:{pattern})"


# Lines that are no title, as one pattern, so that a line is searched once. Behind labels, badges, places, dates and salaries: lines that end in
# the middle of a sentence, without letters and figures, with a first or last of several words of two characters at most, or with a short last word without vowel.
_STARTS = [
    _part(ACTION), _part(BADGE), _part(X.REMOTE, True), _part(X.POSTED, True), _part(PLACE), _part(X.SALARY_CURRENCY, True), _part(X.SALARY_PLAIN, True), r"[^\p{L}\p{N}]*\z", r"(?U:\S{0,2}\s|[^\saeiouAEIOU]{0,3}\z)",
]
NO_TITLE = rf"^(?:{'|'.join(_STARTS)})|$(?<=[.,;:])|(?U:\s(?:\S{{0,2}}|[^\saeiouAEIOU]{{0,3}})\z)"
# What all lines "title at company" have, and characters and blanks that make lines need more than their trimming.
AT = r"\sat\s"
UNEVEN = r"[^\x20-\x7E\n]|  "


def cleaned(text: Column) -> Column:
    """White space as single spaces, none at the ends; null for nothing."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def cleaned_field(text: Column, cut: int = 255) -> Column:
    """A field whose entities are decoded, without comments and tags, cut to its length."""
    return F.left(cleaned(F.regexp_replace(F.regexp_replace(text, MARKUP, " "), "<[^>]*>", " ")), F.lit(cut))


def lines_of(block: Column) -> Column:
    """Lines of a block, cleaned, those that aren't blank."""
    block = F.coalesce(block, F.lit(""))
    # One pass over the block instead of one over each line; a break of two characters leaves a blank line, which goes.
    even = F.regexp_replace(F.regexp_replace(block, r"[\x0B\f\r\x85\u2028\u2029]", "\n"), r"(?U)[\s&&[^\n]]+", " ")
    lines = F.split(F.when(block.rlike(UNEVEN), even).otherwise(block), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def first_line(text: Column) -> Column:
    return F.try_element_at(lines_of(text), F.lit(1))


def title_guess(subject: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(subject), F.lit("")), first_line(text))


def normal_remote(text: Column) -> Column:
    return once(F.lower(text), lambda low: F.when(F.contains(low, F.lit("remote")), "remote").when(F.contains(low, F.lit("hybrid")), "hybrid").when(low.rlike("on-?site"), "onsite"))


def is_title_like(line: Column) -> Column:
    """Whether a line can be a title: none of a label, badge, place, date, salary or cut-off fragment. Null is none."""
    return once(F.trim(line), lambda line: F.coalesce((F.length(line) >= 3) & (F.contains(line, F.lit(" ")) | (F.length(line) >= 6)) & ~line.rlike(NO_TITLE), F.lit(False)))


def is_remote_line(line: Column) -> Column:
    return line.rlike(X.begins("RrHhOo", X.REMOTE))


def following_place(lines: Column) -> Column:
    """The first of three lines that names a place or a way of working."""
    return F.try_element_at(F.filter(F.slice(lines, 1, 3), lambda x: is_remote_line(x) | x.rlike(PLACE)), F.lit(1))


def _from(values: Column, start: Column) -> Column:
    return F.slice(values, start.cast("int"), F.greatest(F.size(values), F.lit(1)))


def _inline(lines: Column, at: Column) -> Column:
    """One line "title at company - place"; without a place, that of the next lines."""
    line = F.element_at(lines, F.greatest(at, F.lit(1)).cast("int"))
    parts = F.split(F.regexp_extract(line, TITLE_AT, 2), " - ")
    place = lambda parts: F.coalesce(F.trim(F.try_element_at(parts, F.lit(2))), following_place(_from(lines, at + 1)))
    found = once(parts, lambda parts: F.struct(F.trim(parts[0]).alias("company"), place(parts).alias("location")))
    return once(found, lambda x: F.struct(F.trim(F.regexp_extract(line, TITLE_AT, 1)).alias("title"), x["company"].alias("company"), x["location"].alias("location"), normal_remote(x["location"]).alias("remote")))


def _one_per_line(lines: Column, at: Column) -> Column:
    """Title, then company and place on lines of their own, read until a line is neither."""
    title = F.element_at(lines, F.greatest(at, F.lit(1)).cast("int"))

    def step(s: Column, line: Column) -> Column:
        def state(company=None, location=None, done=False):
            return F.struct((s["company"] if company is None else company).alias("company"), (s["location"] if location is None else location).alias("location"), F.lit(done).alias("done"))

        split = X.company_and_place(line)
        plain = s["company"].isNull() & ~F.contains(line, F.lit(",")) & ~F.contains(line, F.lit("$")) & ~F.contains(line, F.lit("ago")) & ~line.rlike(ACTION)
        unsplit = (
            F.when(line.rlike(PLACE_REMOTE), state(location=line)).when(is_remote_line(line) & ~F.contains(line, F.lit(",")), state(location=line, done=True)).when(line.rlike(PLACE), state(location=line))
            .when(plain, state(company=line)).otherwise(state(done=True))
        )
        return F.when(s["done"], s).otherwise(once(split, lambda x: F.when(x.isNotNull(), state(F.trim(x["company"]), F.trim(x["location"]))).otherwise(unsplit)))

    none = F.lit(None).cast("string")
    read = F.aggregate(_from(lines, at + 1), F.struct(none.alias("company"), none.alias("location"), F.lit(False).alias("done")), step)
    return once(read, lambda x: F.struct(title.alias("title"), x["company"].alias("company"), x["location"].alias("location"), normal_remote(x["location"]).alias("remote")))


def _place(lines: Column, holds) -> Column:
    """The place of the first line for which a condition holds, from 1; 0 for none. Lines behind it aren't asked."""
    return F.greatest(F.aggregate(lines, F.lit(0), lambda s, x: F.when(s > 0, s).when(holds(x), F.lit(1) - s).otherwise(s - 1)), F.lit(0))


def with_fields(rows: DataFrame, lines: str, name: str) -> DataFrame:
    """Adds struct(title, company, location, remote) of a block's cleaned lines; null without a title.

    Digest headers, labels at the start and badges are no lines. Each step is a column of
    its own, as the next ones use it many times.
    """
    rows = rows.withColumn("_body", F.filter(lines, lambda x: ~x.rlike(X.begins("0-9JjMmNn", DIGEST_HEADER))))
    rows = rows.withColumn("_kept", _place(F.col("_body"), lambda x: ~x.rlike(ACTION)))
    rows = rows.withColumn("_body", F.filter(F.when(F.col("_kept") > 0, _from(F.col("_body"), F.greatest("_kept", F.lit(1)))), lambda x: ~x.rlike(BADGE)))
    rows = rows.withColumns({
        "_inline": _place(F.slice("_body", 1, 8), lambda x: x.rlike(AT) & x.rlike(TITLE_AT)),
        "_plain": _place(F.col("_body"), is_title_like),
    })
    body, inline, plain = F.col("_body"), F.col("_inline"), F.col("_plain")
    return rows.withColumn(name, F.when(inline > 0, _inline(body, inline)).when(plain > 0, _one_per_line(body, plain)).cast(FIELDS)).drop("_body", "_kept", "_inline", "_plain")

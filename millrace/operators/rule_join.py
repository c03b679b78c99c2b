"""Rules that are rows of a table: keywords met as runs of words, and parts of text met by their first characters.

Both are equi-joins whose cost grows with the text and with what is found, not with text
times rules; a small rule table is broadcast when Spark's size check allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules

#: Characters by which a part of text is looked up.
GRAM = 4
#: Beginnings of parts that are sought in each text by themselves.
MOST_STARTS = 500
#: More words than a text can have.
_ALL = 1 << 30


def _from(values: Column, start: int) -> Column:
    return values if start == 1 else F.slice(values, start, _ALL)


def _joined(left: Column, right: Column) -> Column:
    """Elements side by side put together; null where one side has ended."""
    return F.zip_with(left, right, lambda x, y: F.concat(x, y))


def _pieces(low: Column) -> dict[str, Column]:
    """Words, words with what follows them, and what stands between two words."""
    return {k: F.regexp_extract_all(low, F.lit(p), F.lit(0)) for k, p in (("_w", r"(?U)\w+"), ("_ws", r"(?U)\w+\W*"), ("_b", r"(?U)(?<=\w)\W+(?=\w)"))}


def _runs(shapes: list[tuple[int, bool, bool]]) -> Column:
    """The runs of a text (_w, _ws, _b) that have one of the shapes: so many words, and with them what stands before or after, up to the next word.

    A keyword found between two word boundaries is such a run, whatever signs are in it: the
    signs at its ends reach to a word, or there would be no boundary.
    """
    found = []
    for n in sorted({n for n, _, _ in shapes}):
        run = F.col("_w")
        for _ in range(n - 1):
            run = _joined(F.col("_ws"), _from(run, 2))
        for _, before, after in sorted(s for s in shapes if s[0] == n):
            one = F.col("_b") if n == 0 else _joined(F.col("_b"), _from(run, 2)) if before else run
            found.append(_joined(one, _from(F.col("_b"), n + 1 if before else n)) if n and after else one)
    return F.array_distinct(F.array_compact(F.concat(*found)))


def _met(texts: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(key, columns of wanted) for the rows of `wanted` whose `_low` stands in a text as whole words.

    Only shapes of keywords, a few numbers, come to the driver; each makes at most a run a
    word of the text, and runs meet keywords by equality, so texts move as their runs alone.
    """
    shape = F.struct(F.size(F.regexp_extract_all("_low", F.lit(r"(?U)\w+"), F.lit(0))).alias("n"), (~F.rlike("_low", F.lit(r"(?U)^\w"))).alias("before"), (~F.rlike("_low", F.lit(r"(?U)\w$"))).alias("after"))
    shapes = [(r["n"], r["before"], r["after"]) for r in wanted.select(shape.alias("s")).distinct().select("s.*").collect()]
    if not shapes:
        return texts.select(key, F.lit("").alias("_low")).join(wanted, "_low")  # of no keywords, none
    rows = texts.select(key, F.lower(text).alias("_text")).select(key, *[c.alias(k) for k, c in _pieces(F.col("_text")).items()])
    return rows.select(key, F.explode(_runs(shapes)).alias("_low")).join(wanted, "_low")


def matched(texts: DataFrame, wanted: DataFrame, key: str, text: str = "text", rule: str = "rule_id", keyword: str = "keyword") -> DataFrame:
    """(key, rule) of the keywords that stand in a text as whole words, whatever their case; keys and rules are unique, and blank keywords match nothing."""
    low = F.lower(F.trim(F.col(keyword)))
    return _met(texts, wanted.where(low != "").select(rule, low.alias("_low")), key, text).select(key, rule)


def category_table(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The categories (id, name, enabled) and keywords (category_id, keyword, match_type) of rules.CATEGORIES as rows."""
    named = list(enumerate(rules.CATEGORIES.items(), 1))
    categories = spark.createDataFrame([(i, name, True) for i, (name, _) in named], "id int, name string, enabled boolean")
    return categories, spark.createDataFrame([(i, w, "word_boundary") for i, (_, words) in named for w in words], "category_id int, keyword string, match_type string")


def category_names(texts: DataFrame, categories: DataFrame, keywords: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, categories) of the texts that fit any: names, in the order of ids, of the enabled categories (id, name, enabled) that have a keyword in the text and no negative one.

    `keywords` has category_id, keyword and match_type; all types but negative count alike. Keys are unique.
    """
    on = categories.where("enabled").select(F.col("id").alias("_id"), "name")
    wanted = keywords.select(F.col("category_id").alias("_id"), F.lower(F.trim("keyword")).alias("_low"), (F.col("match_type") == "negative").alias("_no"))
    found = _met(texts, wanted.where("_low <> ''").join(on.select("_id"), "_id", "left_semi").distinct(), key, text)
    # Numbers only until here, so that a text's many hits become one row a category before they move.
    kept = found.groupBy(key, "_id").agg(F.bool_or("_no").alias("no")).where("not no").join(on, "_id")
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_id", "name"))).alias("_hits")).select(key, F.transform("_hits", lambda h: h["name"]).alias("categories"))


def classified(rows: DataFrame, categories: DataFrame, keywords: DataFrame, key: str, title: str = "title", description: str | None = None) -> DataFrame:
    """Rows with `categories`, the category_names() of their title and description; empty where none fits."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in (title, description) if c]
    names = category_names(rows.select(key, F.concat_ws(" ", *parts).alias("_all")), categories, keywords, key, "_all")
    return rows.join(names, key, "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def containing(texts: DataFrame, parts: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(key, columns of parts) of the parts that a text contains anywhere, in lower case; parts have GRAM characters or more, shorter ones match nothing.

    A part is looked up by its first GRAM characters among those that begin in the text. Up to
    MOST_STARTS of these come to the driver, and a text moves once for each that it has; only
    more parts than that are looked up under all that begin in a text.
    """
    wanted = parts.where(F.length(part) >= GRAM).withColumn("_gram", F.lower(F.substring(part, 1, GRAM)))
    starts = [r["_gram"] for r in wanted.select("_gram").distinct().limit(MOST_STARTS + 1).collect()]
    grams = F.array_distinct(F.regexp_extract_all("_text", F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    if len(starts) <= MOST_STARTS:
        grams = F.filter(F.lit(sorted(starts)).cast("array<string>"), lambda g: F.contains("_text", g))
    rows = texts.select(key, F.lower(text).alias("_text")).select(key, "_text", F.explode(grams).alias("_gram"))
    return rows.join(wanted, "_gram").where(F.contains("_text", F.lower(part))).select(key, *parts.columns)

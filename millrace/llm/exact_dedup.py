"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive bytes of their normalised text, most significant
first. A digit is a run of bytes; each level's digit is four times as wide as the last,
so a text of n bytes takes about log4(n) levels. A group that has become a single
document, or whose texts have all ended, leaves the recursion. Two texts share a group
at the end only if every one of their bytes was equal: no digest decides.

Every level is one aggregate (partial sums before the shuffle, so a group with a third
of all rows moves as a few counters) and one join back to the rows that are still open,
which adaptive execution splits where a group is large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Shelf, free_name, text_or_empty

#: Bytes in the first digit, and the factor from level to level.
FIRST_DIGIT = 64
WIDEN = 4
#: Equals replacing each run of white space by one space, but leaves single spaces alone.
_CHANGING = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, _CHANGING, " ")


def _head(data: Column, width: int) -> Column:
    return F.substring(data, 1, width)


def _tail(data: Column, width: int) -> Column:
    return F.substring(data, width + 1, 2**31 - 1)


def _first(id_column: Column, row: Column) -> Column:
    return F.min(F.struct(id_column.isNull().alias("none"), id_column.alias("id"), row.alias("row")))


def _split(rows: DataFrame, shelf: Shelf, sha: bool) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, doc) of rows (doc_id, text, doc); level by level, a level's bytes go once the next is stored."""
    data = normalised(F.col("text")).cast("binary")
    counts = rows.groupBy(_head(data, FIRST_DIGIT).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    # Stored, so that the join deals out both sides anew and can split a digit that many texts share.
    counts = shelf.put(counts, "digits")
    opened = rows.withColumn("digit", _head(data, FIRST_DIGIT)).join(counts, "digit").withColumn("open", F.col("n") > 1)
    state = shelf.put(opened.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (F.sha2(data, 256) if sha else F.lit(None).cast("string")).alias("text_sha256"), "doc",
        F.when(F.col("open"), F.col("digit")).alias("path"), F.when(F.col("open"), _tail(data, FIRST_DIGIT)).alias("rest"), "open",
    ), "level0", by="open")
    out, name = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "doc"], "level0"
    single = state.where("not open").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}).select(out)
    active = state.where("open")
    width, level, closed = FIRST_DIGIT * WIDEN, 1, [single]
    while not active.isEmpty():
        here = active.select("row", "doc_id", "text_sha256", "doc", "path", "rest").withColumn("digit", _head(F.col("rest"), width)).withColumn("ended", F.octet_length("rest") <= width)
        groups = here.groupBy("path", "digit", "ended").agg(F.count(F.lit(1)).alias("n"), _first(F.col("doc_id"), F.col("row")).alias("first"))
        groups = shelf.put(groups, f"groups{level}")
        split = here.join(groups, ["path", "digit", "ended"]).withColumn("open", (F.col("n") > 1) & ~F.col("ended"))
        # From here on a group is named by the row number of its first document.
        split = shelf.put(split.select("row", "doc_id", "text_sha256", "doc", "n", "first", F.col("first.row").alias("path"), F.when(F.col("open"), _tail(F.col("rest"), width)).alias("rest"), "open"), f"level{level}", by="open")
        shelf.drop(f"{name}/open=true", f"groups{level}")
        closed.append(split.where("not open").select(
            "doc_id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "doc",
        ))
        active, name = split.where("open"), f"level{level}"
        width, level = width * WIDEN, level + 1
    return reduce(DataFrame.unionByName, closed)


def radix_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the smallest id stays; a null id comes after
    all others, and of rows with equal ids exactly one (whichever Spark numbers first) is kept.
    An empty table gives an empty result. Other columns, whatever their names, play no part.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), F.lit(None).cast("int").alias("doc"))
    return _split(rows, Shelf(docs.sparkSession, "radix"), True).drop("doc")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one of each class of equal normalised texts, as radix_classes keeps them.

    Only ids are carried through the levels, and the documents that go are told by them.
    Rows whose id is null or stands more than once are carried whole. What stays in the
    shared folder are the ids of the documents that go.
    """
    shelf, id_ = Shelf(docs.sparkSession, "dedup"), F.col(id_col)
    several = shelf.put(docs.where(id_.isNotNull()).groupBy(id_.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "several")
    whole = docs.select(id_.alias("doc_id"), text_or_empty(text_col).alias("text"), F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    odd = F.col("doc_id").isNull()
    if not several.isEmpty():
        whole = whole.join(several.withColumn("again", F.lit(True)), whole["doc_id"] == several["id"], "left")
        odd = odd | F.col("again").isNotNull()
    found = _split(whole.select("doc_id", "text", F.when(odd, F.col("doc")).alias("doc")), shelf, False)
    gone = shelf.put(found.where("not kept and doc is null").select(F.col("doc_id").alias("id")), "gone")
    again = shelf.put(found.where("kept and doc is not null").select("doc"), "again")
    shelf.keep("gone", "again", "several")
    name = free_name("_id", docs.columns)
    left = docs.where(id_.isNotNull()).join(gone.unionByName(several).withColumnRenamed("id", name), id_ == F.col(name), "left_anti")
    return left.unionByName(again.select([F.col("doc")[c].alias(c) for c in docs.columns]))

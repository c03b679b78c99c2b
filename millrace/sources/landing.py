"""Messages and result pages that other programs have put into a folder; nothing here speaks to a live service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import any_in
from .messages import is_broken, opened

#: A line of a landing folder; the payload stays as its JSON text until it is opened.
_LINE = "id string, threadId string, internalDate string, payload string, _bad string"


def read_lines(lines: DataFrame) -> DataFrame:
    """Lines of text files (value, and what else the reader gives) as messages: file, line, reason, id, threadId, internalDate, headers, parts.

    A message is an object with an id, an instant in epoch milliseconds (none: 0) and a
    payload of nested parts, headers at its root. What can't be read keeps its line and has
    a reason; what can be read has neither. Blank lines are no lines. Works on streams alike.
    """
    more = [c for c in lines.columns if c != "value"]
    rows = lines.where(F.trim("value") != "").select(*more, F.col("_metadata.file_path").alias("file"), "value", F.from_json("value", _LINE, {"columnNameOfCorruptRecord": "_bad"}).alias("m"))
    rows = rows.withColumn("p", opened(F.coalesce("m.payload", F.lit("{}"))))
    reason = (
        F.when(F.col("m").isNull() | F.col("m._bad").isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{")), "no JSON object").when(F.coalesce(F.trim("m.id"), F.lit("")) == "", "no id")
        .when(F.col("m.internalDate").isNotNull() & F.col("m.internalDate").try_cast("long").isNull(), "date is no number").when(F.col("p").isNull(), "payload is no object")
        .when(F.exists("p.parts", lambda x: is_broken(x["data"])), "body is no base64")
    )
    rows = rows.withColumn("reason", reason)
    return rows.select(*more, "file", F.when(F.col("reason").isNotNull(), F.col("value")).alias("line"), "reason", "m.id", "m.threadId", "m.internalDate", "p.headers", "p.parts")


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """read_lines of a folder of JSON lines, with the columns that its folders name (account_id=7/...)."""
    return read_lines(spark.read.text(folder))


def raw_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of a folder (RAW_MESSAGE), of several copies of an id one; what can't be read is in rejected_lines()."""
    rows = landed(spark, folder).where("reason is null").select("id", "threadId", "internalDate", "headers", "parts")
    return rows.groupBy("id").agg(F.min(F.struct(*[c for c in rows.columns if c != "id"])).alias("m")).select("id", "m.*")


def rejected_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line, reason) of the lines that give no message."""
    return landed(spark, folder).where("reason is not null").select("file", "line", "reason")


def lookback_query(after: int, excluded: list[str] | None = None, category: str = "updates") -> str:
    """A mailbox search for what came after an instant in epoch seconds: its category, if one is named, and no excluded sender."""
    return " ".join([f"after:{after}", *([f"category:{category}"] if category else []), *(f"-from:{d}" for d in excluded or [])])


def in_lookback(received: Column, sender: Column, now: Column, hours: int, excluded: list[str] | None = None, category: Column | None = None, wanted: str = "") -> Column:
    """The same as a predicate on columns, so that it reaches the scan: received in the last `hours`, in whole seconds, of the wanted category, from no excluded sender."""
    found = F.unix_seconds(received) >= F.floor(F.unix_micros(now) / 1_000_000 - hours * 3600)
    if wanted and category is not None:
        found = found & (category == wanted)
    return found & ~any_in(F.lower(F.coalesce(sender, F.lit(""))), [d.lower() for d in excluded]) if excluded else found


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, html, scraped_at) of saved result pages, one a file; the id is the file's name and the instant that of its last change."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(name.alias("page_id"), F.col("content").cast("string").alias("html"), F.col("modificationTime").alias("scraped_at"))


def alive(spark: SparkSession) -> DataFrame:
    """One row: the session answers."""
    return spark.range(1).select(F.lit(1).alias("alive"))

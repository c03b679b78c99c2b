"""Runs from end to end: result pages to stored cards with counts, and another pass over messages without an outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import location_matches
from ..functions.urls import any_in
from ..operators.identity import first_per_key, insert_if_absent
from ..operators.judge import in_age_window
from ..operators.scrape import relevant
from ..operators.sinks import store_messages, store_rejected
from ..sources.landing import landed
from ..sources.messages import normalized
from ..stored import table_at, written

#: Cards stored of one page at most, in the order of the page, after all filters.
MOST_CARDS = 25


def scraped(cards: DataFrame, details: DataFrame, stored: DataFrame, keyword: str, place: str, age: str, most: int = MOST_CARDS) -> DataFrame:
    """Cards of pages that one search keeps, with `outcome`: saved, duplicate (stored already, or twice here) or too_old.

    `cards` as parsed_cards gives them, `details` (url, html), `stored` (job_id, job_url).
    A card counts once a page by id, else by URL; then it must fit the keyword, the place and
    the age; of each page the first `most` are left. Pages without cards give no rows. Cards
    are used several times: they should come from a stored table.
    """
    own = F.coalesce(F.concat(F.lit("i:"), "job_id"), F.concat(F.lit("u:"), "job_url"), F.concat(F.lit("n:"), F.col("pos").cast("string")))
    once = first_per_key(cards, [F.col("page_id"), own], "pos")
    near = relevant(written(once, "cards"), details, keyword).where(location_matches(F.lit(place), F.coalesce("location", F.lit(""))))
    near = near.withColumn("fresh", in_age_window(F.col("posted_at"), F.col("scraped_at"), age))
    place_in_page = F.row_number().over(Window.partitionBy("page_id", "fresh").orderBy("pos"))
    near = near.withColumn("nth", place_in_page).where(~F.col("fresh") | (F.col("nth") <= most))
    near = written(near, "near")
    seq = F.struct("page_id", "pos")
    new = insert_if_absent(near.where("fresh").select("page_id", "pos", "job_id", "job_url", seq.alias("seq")), stored, "seq").select("page_id", "pos", F.lit("saved").alias("new"))
    out = near.join(new, ["page_id", "pos"], "left")
    return out.withColumn("outcome", F.when(~F.col("fresh"), "too_old").otherwise(F.coalesce("new", F.lit("duplicate")))).drop("fresh", "nth", "new")


def scrape_counts(cards: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per page: total_found, saved, duplicates and filtered_by_date."""
    rows = cards.select("page_id", F.lit("found").alias("outcome")).unionByName(outcomes.select("page_id", "outcome"))
    names = {"found": "total_found", "saved": "saved", "duplicate": "duplicates", "too_old": "filtered_by_date"}
    return rows.groupBy("page_id").agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in names.items()])


def pending(emails: DataFrame, *done: DataFrame, key: str = "message_id") -> DataFrame:
    """Stored messages that no table of outcomes has, by `key`. As with SQL's NOT IN, an outcome without a key leaves nothing pending, and a message without one only is where there are no outcomes.

    An anti join on the key; whether there is an outcome without one is asked once, so nothing has to be broadcast.
    """
    outcomes = reduce(DataFrame.unionByName, [d.select(key) for d in done])
    has = outcomes.agg(F.count(F.lit(1)).alias("rows"), F.count(key).alias("keys")).first()
    if has["rows"] > has["keys"]:
        return emails.limit(0)
    return emails.where(F.col(key).isNotNull() | F.lit(has["rows"] == 0)).join(outcomes.distinct(), key, "left_anti")


def backfill_events(messages: DataFrame, candidates: DataFrame, excluded: list[str]) -> DataFrame:
    """One backfill_attempted event (postings.EVENT) for each message (message_id, sender) that gives no posting: skipped for an excluded sender, else success.

    `candidates` are those of the same messages. Messages with a candidate have their posting
    as outcome; one that can't be read (received_at null, where the column is there) has failed.
    """
    skipped = any_in(F.lower(F.coalesce("sender", F.lit(""))), excluded) if excluded else F.lit(False)
    lost = F.col("received_at").isNull() if "received_at" in messages.columns else F.lit(False)
    tagged = messages.select("message_id", skipped.alias("skipped"), lost.alias("lost"))
    rows = tagged.join(candidates.select("message_id", F.lit(True).alias("found")).distinct(), "message_id", "left").where("skipped or lost or found is null")
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(None).cast("long").alias("seq"), "message_id", none.alias("fingerprint"), F.lit("backfill_attempted").alias("event_type"), F.when(F.col("lost"), "failed").when(F.col("skipped"), "skipped").otherwise("success").alias("status"),
        F.when(F.col("lost"), "Message can't be read").when(F.col("skipped"), "Sender is excluded").otherwise("No posting in this message").alias("message"),
        none.alias("metadata"), F.lit(None).cast("timestamp").alias("created_at"),
    )


def synced(messages: DataFrame, target: str, number: int, now: Column, excluded: list[str], lost: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One sync run: stores the new messages of a batch and gives (account counts, messages to parse).

    `messages` are normalised ones with account_id and seq; `lost` has a row (account_id) for
    each that couldn't be read at all. Per account: found, ingested, skipped_duplicate
    (stored by another batch, or a second copy here) and failed (lost, or without an instant,
    so not stored; another run finds them again). Excluded senders are stored and not parsed.
    """
    messages = written(messages, "sync")
    store_messages(messages.where("received_at is not null"), target, number, now)
    stored = table_at(messages.sparkSession, target)
    new = stored.where(F.col("batch") == number).select("account_id", "message_id", "seq")
    kinds = [messages.select("account_id", F.when(F.col("received_at").isNull(), "failed").otherwise("read").alias("kind")), new.select("account_id", F.lit("ingested").alias("kind"))]
    if lost is not None:
        kinds.append(lost.select("account_id", F.lit("failed").alias("kind")))
    counts = reduce(DataFrame.unionByName, kinds).groupBy("account_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("read", "ingested", "failed")])
    counts = counts.select("account_id", (F.col("read") + F.col("failed")).alias("found"), "ingested", (F.col("read") - F.col("ingested")).alias("skipped_duplicate"), "failed")
    out = any_in(F.lower(F.coalesce("sender", F.lit(""))), excluded) if excluded else F.lit(False)
    return counts, messages.join(new, ["account_id", "message_id", "seq"], "left_semi").where(~out)


def synced_folder(spark: SparkSession, folder: str, target: str, rejected: str, number: int, now: Column, excluded: list[str], account: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """A sync run over a landing folder: what can be read is stored, what can't goes to the table `rejected` (account_id, file, line, reason), and both are counted.

    The account is a folder of the landing folder (account_id=...), or given. Every line is
    in one of ingested, skipped_duplicate and failed.
    """
    rows = landed(spark, folder)
    rows = rows if account is None else rows.withColumn("account_id", account)
    rows = written(rows.withColumn("seq", F.monotonically_increasing_id()), "landed")
    store_rejected(rows.where("reason is not null").select("account_id", "file", "line", "reason"), rejected, number)
    lost = table_at(spark, rejected)
    lost = None if lost is None else lost.where(F.col("batch") == number)
    good = rows.where("reason is null")
    messages = normalized(good, "account_id", "seq")
    return synced(messages, target, number, now, excluded, lost)

"""Keyed Parquet sinks. A batch has a number and is written by overwriting its own folder, so that its repetition replaces it.

Tables lie in folders batch=<number>/bucket=<hash of the key>; a batch looks for its keys in
the buckets that it has rows for, and reads no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.urls import platform_of
from ..sources.messages import content_hash
from ..stored import table_at
from .identity import first_per_key, fold, insert_if_absent

BUCKETS = 16


def _bucketed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))


def _earlier(rows: DataFrame, target: str, number: int) -> DataFrame | None:
    """What other batches have stored in the buckets of these rows (`bucket`); at most BUCKETS numbers come to the driver."""
    found = table_at(rows.sparkSession, target)
    if found is None:
        return None
    buckets = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    return found.where((F.col("batch") != number) & F.col("bucket").isin(buckets))


def _write(rows: DataFrame, target: str, number: int) -> None:
    """A bucket's rows come together in few files; adaptive execution joins small buckets in a task and splits large ones."""
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={number}")


def store_new(rows: DataFrame, target: str, keys: list[str], number: int, seq: str = "seq") -> None:
    """Stores the rows whose key no other batch has, the first of each key by `seq`. Rows with a null in their key are stored all as one key."""
    rows = _bucketed(rows, keys)
    stored = _earlier(rows, target, number)
    if stored is not None:
        old = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = [rows[k].eqNullSafe(old[f"_{k}"]) for k in keys]
        rows = rows.join(old, same, "left_anti")
    _write(first_per_key(rows, [F.col(k) for k in keys], seq), target, number)


def message_rows(messages: DataFrame, now: Column) -> DataFrame:
    """Rows of the message table from normalised messages (account_id, message_id, thread_id, sender, subject, received_at, plain_text, seq).

    Bodies aren't stored. A message is PROCESSED when it is written, whatever its parsing gave.
    """
    return messages.select(
        "account_id", "message_id", "thread_id", platform_of(F.col("sender")).alias("source"), "sender", F.left(F.col("subject"), F.lit(rules.SUBJECT_CUT)).alias("subject"), "received_at",
        F.lit("PROCESSED").alias("status"), content_hash(F.col("message_id"), F.col("subject"), F.coalesce("plain_text", F.lit(""))).alias("raw_hash"), now.alias("processed_at"), "seq",
    )


def store_messages(messages: DataFrame, target: str, number: int, now: Column) -> None:
    store_new(message_rows(messages, now), target, ["account_id", "message_id"], number)


def store_rejected(rows: DataFrame, target: str, number: int) -> None:
    """Keeps lines that give no message (account_id, file, line, reason), for a person or a later program to look at."""
    rows.write.mode("overwrite").parquet(f"{target}/batch={number}")


def store_postings(sightings: DataFrame, target: str, number: int) -> None:
    """Adds a batch of accepted sightings (fingerprint, seq, ...), folded. Nothing stored is read or changed: read_postings folds the batches."""
    _write(_bucketed(fold(sightings, placed=True), ["fingerprint"]), target, number)


def store_links(sightings: DataFrame, categories: DataFrame, target: str, number: int) -> None:
    """Adds the category links of a batch's postings (status, categories, seq), each with the sighting that it is from; nothing stored is read.

    `categories` (id, name, enabled) is the category table. Postings that a later batch
    sees again bring links too; read_links() keeps those of the first sighting.
    """
    first = fold(sightings.select("fingerprint", "seq", "status", "categories"), placed=True)
    links = category_links(first, categories, ["fingerprint", "seq"]).select("fingerprint", "seq", "category_id", F.lit(None).cast("double").alias("confidence"), F.lit("rules").alias("matched_by"))
    _write(_bucketed(links, ["fingerprint"]), target, number)


def read_links(spark: SparkSession, target: str, postings: DataFrame) -> DataFrame | None:
    """(fingerprint, category_id, confidence, matched_by) of stored postings (fingerprint, seq): a posting keeps the categories of its first sighting."""
    found = table_at(spark, target)
    return None if found is None else found.join(postings.select("fingerprint", "seq"), ["fingerprint", "seq"]).select("fingerprint", "category_id", "confidence", "matched_by")


def read_postings(spark: SparkSession, target: str) -> DataFrame | None:
    """One row a fingerprint: first sighting of all batches, null fields filled from later ones, all sightings counted; None where nothing is stored."""
    found = table_at(spark, target)
    return None if found is None else fold(found.drop("batch", "bucket"), counted="sightings")


def known_postings(sightings: DataFrame, target: str, number: int) -> DataFrame | None:
    """(fingerprint) of the sightings' postings that other batches have stored."""
    found = _earlier(_bucketed(sightings, ["fingerprint"]), target, number)
    return None if found is None else found.select("fingerprint").distinct()


def category_links(postings: DataFrame, categories: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, category_id): postings and the rows of the category table (id, name, enabled) that have one of their `categories` as name; names may repeat there."""
    keys = keys or ["fingerprint"]
    names = postings.where("status = 'RELEVANT'").select(*keys, F.explode("categories").alias("name")).distinct()
    return names.join(categories.select(F.col("id").alias("category_id"), "name"), "name").select(*keys, "category_id")


def store_events(events: DataFrame, target: str, number: int) -> None:
    """Adds audit events (postings.EVENT). An event is never changed, so nothing stored is read."""
    _write(_bucketed(events, ["seq"]), target, number)


def store_cards(cards: DataFrame, target: str, number: int, seq: str = "pos") -> None:
    """Stores the cards whose id and URL no other batch has. Both are keys, so both columns of all buckets are read, and nothing else."""
    found = table_at(cards.sparkSession, target)
    stored = cards.select("job_id", "job_url").limit(0) if found is None else found.where(F.col("batch") != number).select("job_id", "job_url")
    _write(_bucketed(insert_if_absent(cards, stored, seq), ["job_id", "job_url"]), target, number)

"""Fingerprints, first-wins folds and keyed deduplication.

Order of arrival is a column (`seq`), never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a later sighting may fill where the first has null.
ENRICHED = ("job_posted_at", "remote_type", "salary", "employment_type")


def fingerprint(platform: Column, url: Column, job_id: Column, title: Column, company: Column) -> Column:
    """sha256 of platform and canonical URL, else of its id, else of title and company."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    by_url = F.when(F.coalesce(url, F.lit("")) != "", F.concat(platform, F.lit(":url:"), url))
    by_id = F.when(F.coalesce(job_id, F.lit("")) != "", F.concat(platform, F.lit(":id:"), low(job_id)))
    return F.sha2(F.coalesce(by_url, by_id, F.concat(platform, F.lit(":title:"), low(title), F.lit(":"), low(company))), 256)


def fold(candidates: DataFrame, key: str = "fingerprint", seq: str = "seq", enriched: tuple[str, ...] = ENRICHED, counted: str | None = None, placed: bool = False) -> DataFrame:
    """One row per key: the first sighting, with null columns of `enriched` filled from the next sighting that has them, and `sightings`.

    Folds can be folded: `counted` names a column that says for how many sightings a row
    stands; with `placed`, columns named <field>_at say which sighting a filled field is from,
    and where there are such columns, they decide which value comes first.

    An aggregate with partial results before the shuffle: a posting seen by a third of all
    messages moves as one row a task.
    """
    enriched = tuple(c for c in enriched if c in candidates.columns)
    rest = [c for c in candidates.columns if c not in (key, *enriched, *(f"{c}_at" for c in enriched), counted)]
    at = {c: F.when(F.col(c).isNotNull(), F.col(f"{c}_at" if f"{c}_at" in candidates.columns else seq)) for c in enriched}
    fill = [F.min_by(c, at[c]).alias(c) for c in enriched] + ([F.min(at[c]).alias(f"{c}_at") for c in enriched] if placed else [])
    one = candidates.groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("_first"), *fill, (F.sum(counted) if counted else F.count(F.lit(1))).alias("sightings"))
    return one.select(key, *[F.col("_first")[c].alias(c) for c in rest], *enriched, *([f"{c}_at" for c in enriched] if placed else []), "sightings")


def duplicates(candidates: DataFrame, key: str = "fingerprint", seq: str = "seq") -> DataFrame:
    """The sightings after the first of each key: rows of duplicate events."""
    first = candidates.groupBy(key).agg(F.min(seq).alias("_first"))
    return candidates.join(first, key).where(F.col(seq) > F.col("_first")).drop("_first")


def first_per_key(rows: DataFrame, keys: list[Column], seq: str) -> DataFrame:
    """The row with the smallest `seq` of each key."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    one = rows.withColumns(named).groupBy(*named).agg(F.min_by(F.struct(*rows.columns), seq).alias("_row"))
    return one.select("_row.*")


def new_messages(messages: DataFrame, stored: DataFrame, seq: str = "seq") -> DataFrame:
    """Messages whose (account, message id) isn't stored, the first of each."""
    fresh = messages.join(stored.select("account_id", "message_id").distinct(), ["account_id", "message_id"], "left_anti")
    return first_per_key(fresh, [F.col("account_id"), F.col("message_id")], seq)


def page_dedup(cards: DataFrame, seq: str = "pos") -> DataFrame:
    """Cards of a page once per id, those without id once per URL, those without either all."""
    key = F.coalesce(F.concat(F.lit("i:"), "job_id"), F.concat(F.lit("u:"), "job_url"), F.concat(F.lit("n:"), F.col(seq).cast("string")))
    return first_per_key(cards, [key], seq)


def insert_if_absent(rows: DataFrame, stored: DataFrame, seq: str = "pos") -> DataFrame:
    """Rows to add: neither id nor URL stored, and the first of their id and of their URL among the rows."""
    fresh = rows.join(stored.where("job_id is not null").select("job_id").distinct(), "job_id", "left_anti")
    fresh = fresh.join(stored.where("job_url is not null").select("job_url").distinct(), "job_url", "left_anti")
    by_id = F.when(F.col("job_id").isNull(), F.lit(1)).otherwise(F.row_number().over(Window.partitionBy("job_id", F.when(F.col("job_id").isNull(), F.col(seq))).orderBy(seq)))
    fresh = fresh.withColumn("_i", by_id).where("_i = 1").drop("_i")
    by_url = F.when(F.col("job_url").isNull(), F.lit(1)).otherwise(F.row_number().over(Window.partitionBy("job_url", F.when(F.col("job_url").isNull(), F.col(seq))).orderBy(seq)))
    return fresh.withColumn("_u", by_url).where("_u = 1").drop("_u").select(rows.columns)


def one_per_id(entries: DataFrame, message: str, job_id: str, rank: list[Column], seq: str, fields: list[str]) -> DataFrame:
    """One row per (message, id): the best ranked entry (the first of ties), its null fields filled from the other entries in order; entries without id stay."""
    key = F.coalesce(F.concat(F.lit("i"), F.col(job_id)), F.concat(F.lit("n"), F.col(seq).cast("string")))
    order = F.struct(*rank, (-F.col(seq)).alias("_s"))
    fill = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_f_{c}") for c in fields]
    one = entries.withColumn("_key", key).groupBy(message, "_key").agg(F.max_by(F.struct(*entries.columns), order).alias("_b"), *fill, F.bool_or("is_promoted").alias("_p"), F.min(seq).alias("first_seen"))
    keep = [c for c in entries.columns if c not in (*fields, "is_promoted", message)]
    return one.select(message, *[F.col("_b")[c].alias(c) for c in keep], *[F.coalesce(F.col("_b")[c], F.col(f"_f_{c}")).alias(c) for c in fields], F.col("_p").alias("is_promoted"), "first_seen")

"""From candidates to stored postings and events, and the serving queries on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import posted_at
from ..functions.text import employment_type, remote_type, salary
from ..functions.urls import canonical_url, job_id, parser_of, platform_of
from ..operators.identity import duplicates, fingerprint, fold
from ..operators.judge import categories, freshness, reject_reason, status
from ..operators.rule_join import category_names
from ..sources.anchors import stored_field
from ..stored import spread

#: Titles and places of candidates derived from the event table.
TITLES = ["Senior Python Developer", "PHP Laravel Developer", "Backend Engineer", "Machine Learning Engineer", "Account Manager", "LLM Engineer", "x"]
PLACES = ["Lahore, Pakistan (Remote)", "Berlin, Germany", "Hybrid - Paris, France", "On-site"]
#: Fields of a candidate that are cleaned before they are judged and stored; those read from the block have fixed values, but for the salary.
FIELDS = ["title", "company", "location", "place", "description"]
UNITS = ["minutes", "hours", "days", "weeks", "months"]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate postings, one for each event: tracked URLs, relative dates, and a block of text to read fields from."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("received_at")))
    n, job = F.col("event_id"), (F.col("user_id") * 7 + F.col("event_id") % 5)
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    linkedin = F.concat(F.lit("https://"), pick(["www", "pk", "UK"], n), F.lit(".linkedin.com/comm/jobs/view/"), (1_000_000 + job).cast("string"), F.lit("/?trk=e"), n.cast("string"), F.lit("&utm_source=x"))
    indeed = F.concat(F.lit("https://www.indeed.com/viewjob?from=m&jk=j"), job.cast("string"), F.lit("&tk="), n.cast("string"))
    return e.select(
        n.alias("seq"), "user_id", "received_at",
        F.when(n % 4 == 3, indeed).otherwise(linkedin).alias("url"),
        F.when(n % 4 == 3, "Alerts <alert@INDEED.com>").when(n % 13 == 0, "someone@example.org").otherwise("Jobs <jobs@linkedin.com>").alias("sender"),
        pick(TITLES, n).alias("title"), pick(PLACES, n).alias("place"),
        F.when(n % 11 == 0, F.lit("new")).when(n % 17 == 0, F.lit("Posted yesterday")).otherwise(F.concat(F.lit("Posted "), (n % 40).cast("string"), F.lit(" "), pick(UNITS, F.floor(n / 3)), F.lit(" ago"))).alias("posted_text"),
        F.concat(pick(["Full time", "contractor", "Part-time", "role"], F.floor(n / 2)), F.lit(" "), pick(PLACES, n), F.when(n % 4 == 0, F.concat(F.lit(" $"), (50 + n % 50).cast("string"), F.lit(",000 a year"))).otherwise("")).alias("block"),
    )


def processed(found: DataFrame, fresh_hours: int = 24 * 30, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Candidates with identity, fields, date, categories and an outcome: rejected, stale or accepted.

    `tables` are categories and keywords as rule_join.category_table() has them, for rules
    that change or are many; without them the fixed rules judge, as part of the expression.
    The tables meet titles by a join on seq, which is unique.
    """
    platform = parser_of(F.col("sender"))
    cleaned = {c: stored_field(F.col(c)) for c in FIELDS if c in found.columns}
    fitting = categories(cleaned["title"], F.lit(None).cast("string"))
    if tables is not None:
        titles = found.select("seq", F.coalesce(cleaned["title"], F.lit("")).alias("_title"))
        found = found.join(category_names(titles, *tables, "seq", "_title").withColumnRenamed("categories", "_fitting"), "seq", "left")
        fitting = F.coalesce("_fitting", F.array().cast("array<string>"))
    read = F.struct(
        F.col("title").alias("_raw_title"), *[v.alias(c) for c, v in cleaned.items()],
        platform.alias("platform"), canonical_url(F.col("url"), platform).alias("job_url"), posted_at(F.col("posted_text"), F.col("received_at")).alias("job_posted_at"),
        remote_type(F.col("block")).alias("remote_type"), employment_type(F.col("block")).alias("employment_type"), stored_field(salary(F.col("block"))).alias("salary"),
        fitting.alias("categories"),
    )
    # The generator computes each of these once a row; later filters on them would repeat the expressions else.
    rows = found.withColumn("_read", F.explode(F.array(read))).select(*[c for c in found.columns if c not in cleaned and c != "_fitting"], "_read.*")
    rows = rows.withColumn("platform_job_id", job_id(F.col("job_url"), F.col("platform")))
    rows = rows.withColumns({
        "reason": reject_reason(F.col("_raw_title"), F.col("job_url"), F.col("platform_job_id"), F.col("received_at"), F.col("platform"), F.col("title")),
        "age": freshness(F.col("job_posted_at"), F.col("received_at"), fresh_hours),
        "status": status(F.col("categories")),
        "fingerprint": fingerprint(F.col("platform"), F.col("job_url"), F.col("platform_job_id"), F.col("title"), F.lit(None).cast("string")),
    })
    return rows.withColumn("outcome", F.when(F.col("reason").isNotNull(), "rejected").when(F.col("age") != "fresh", "stale").otherwise("accepted")).drop("_raw_title")


def postings(rows: DataFrame) -> DataFrame:
    """Stored postings: accepted candidates folded by fingerprint, numbered by first sighting."""
    kept = rows.where("outcome = 'accepted'").select("fingerprint", "seq", "platform", "title", "job_url", "platform_job_id", "received_at", "status", "categories", "job_posted_at", "remote_type", "salary", "employment_type")
    return fold(kept)


#: What an event of each type says of the candidate.
STATUS = {"job_persisted": "success", "duplicate_detected": "skipped", "filtered_stale": "skipped", "normalization_rejected": "skipped"}


def event_counts(rows: DataFrame) -> DataFrame:
    """(event_type, n) in one pass: of each fingerprint's accepted candidates one is persisted, all others are duplicates."""
    each = rows.groupBy("outcome", F.when(F.col("outcome") == "accepted", F.col("fingerprint")).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    counts = each.select(F.explode(F.when(F.col("outcome") == "accepted", F.array(
        F.struct(F.lit("job_persisted").alias("event_type"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("duplicate_detected").alias("event_type"), (F.col("n") - 1).alias("n")),
    )).otherwise(F.array(F.struct(F.when(F.col("outcome") == "stale", "filtered_stale").otherwise("normalization_rejected").alias("event_type"), "n")))).alias("e")).select("e.*")
    return counts.where("n > 0").groupBy("event_type").agg(F.sum("n").alias("n"))


def events(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Audit events (seq, event_type): every candidate is in exactly one of persisted, duplicate, stale and rejected.

    `known` has the fingerprints of postings that are stored already. The rows are used
    several times: they should come from a stored table.
    """
    if known is not None:
        found = known.select("fingerprint", F.lit(True).alias("_known")).distinct()
        old = rows.where("outcome = 'accepted'").join(found, "fingerprint", "left_semi").select("seq", F.lit("duplicate_detected").alias("event_type"))
        rest = rows.where("outcome = 'accepted'").join(found, "fingerprint", "left_anti").select("seq", "fingerprint", "outcome")
        return old.unionByName(events(rest.unionByName(rows.where("outcome <> 'accepted'").select("seq", "fingerprint", "outcome"))))
    kept = rows.where("outcome = 'accepted'")
    twice = duplicates(kept.select("fingerprint", "seq")).select("seq", F.lit("duplicate_detected").alias("event_type"))
    once = kept.groupBy("fingerprint").agg(F.min("seq").alias("seq")).select("seq", F.lit("job_persisted").alias("event_type"))
    other = rows.where("outcome <> 'accepted'").select("seq", F.when(F.col("outcome") == "stale", "filtered_stale").otherwise("normalization_rejected").alias("event_type"))
    return once.unionByName(twice).unionByName(other)


#: The columns of an audit event, of postings and of backfill runs alike; what doesn't apply is null.
EVENT = ["seq", "message_id", "fingerprint", "event_type", "status", "message", "metadata", "created_at"]
# What an event says, and the fields that it names.
MESSAGES = {
    "job_persisted": ("Persisted with status %s", ["_status"]), "duplicate_detected": ("Fingerprint %s already exists", ["fingerprint"]),
    "filtered_stale": ("Job '%s' older than %sh (reason: %s)", ["title", "_hours", "age"]), "normalization_rejected": ("Candidate rejected during normalization: %s", ["reason"]),
}


def described(found: DataFrame, rows: DataFrame, created_at: Column, fresh_hours: int = 24 * 30) -> DataFrame:
    """Events (seq, event_type) of processed rows in full (EVENT), with a sentence on what happened and the fields it rests on as JSON."""
    message_id = F.col("message_id") if "message_id" in rows.columns else F.lit(None).cast("string")
    own = rows.select("seq", message_id.cast("string").alias("message_id"), "fingerprint", "title", "reason", "age", "platform", "job_url", F.col("status").alias("_status"), F.lit(str(fresh_hours)).alias("_hours"))
    e = found.select("seq", "event_type").join(own, "seq")
    kind, message = F.col("event_type"), F.lit(None).cast("string")
    for name, (form, columns) in MESSAGES.items():
        message = F.when(kind == name, F.format_string(form, *[F.col(c) for c in columns])).otherwise(message)
    outcome = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[kind]
    identified = F.when(kind.isin("job_persisted", "duplicate_detected"), F.col("fingerprint"))
    about = F.to_json(F.struct("platform", "job_url", "title"))
    return e.select("seq", "message_id", identified.alias("fingerprint"), "event_type", outcome.alias("status"), message.alias("message"), about.alias("metadata"), created_at.alias("created_at"))


def served(rows: DataFrame, platforms: DataFrame, links: DataFrame, categories: DataFrame) -> DataFrame:
    """Postings as they are served: the slug of their platform (table slug, name; null where it has none) and the sorted names of their categories, from category_links."""
    names = links.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id").groupBy("fingerprint").agg(F.array_sort(F.collect_set("name")).alias("categories"))
    slugs = platforms.select(F.col("slug").alias("source")).distinct()
    found = rows.drop("categories").join(slugs, rows["platform"] == slugs["source"], "left").join(names, "fingerprint", "left")
    columns = ["seq", "title", "source", "job_url", "categories", "job_posted_at", "received_at", "status", "remote_type", "salary", "employment_type"]
    return found.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>"))).select(columns)


def relevant(rows: DataFrame) -> DataFrame:
    """Postings that fit a category, whether or not they have been exported since."""
    return rows.where(F.col("status").isin("RELEVANT", "EXPORTED"))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page, newest first; ties by descending number of arrival."""
    return rows.orderBy(F.col("received_at").desc(), F.col("seq").desc()).offset((number - 1) * size).limit(size)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(processed(candidates(spark, sf_dir)))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("seq", platform_of(F.col("sender")).alias("tag"), parser_of(F.col("sender")).alias("parser"))

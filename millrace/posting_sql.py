"""SQL of the derived candidates and postings, shared by the query modules, and the columns that are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules
from .plans import postings as P
from .registry import picked

CANDIDATES = f"""
    c0 AS (SELECT event_id AS n, user_id, user_id * 7 + event_id % 5 AS job, ts FROM events),
    cand AS (SELECT n AS seq, user_id, ts AS received_at,
        CASE WHEN n % 4 = 3 THEN 'https://www.indeed.com/viewjob?from=m&jk=j' || job || '&tk=' || n
             ELSE 'https://' || {picked(["www", "pk", "UK"], "n")} || '.linkedin.com/comm/jobs/view/' || (1000000 + job) || '/?trk=e' || n || '&utm_source=x' END AS url,
        CASE WHEN n % 4 = 3 THEN 'https://www.indeed.com/viewjob?jk=j' || job ELSE 'https://www.linkedin.com/jobs/view/' || (1000000 + job) END AS clean,
        CASE WHEN n % 4 = 3 THEN 'Alerts <alert@INDEED.com>' WHEN n % 13 = 0 THEN 'someone@example.org' ELSE 'Jobs <jobs@linkedin.com>' END AS sender,
        {picked(P.TITLES, "n")} AS title, {picked(P.PLACES, "n")} AS place, {picked(P.UNITS, "n // 3")} AS unit,
        CASE WHEN n % 11 = 0 THEN 'new' WHEN n % 17 = 0 THEN 'Posted yesterday' ELSE 'Posted ' || (n % 40) || ' ' || {picked(P.UNITS, "n // 3")} || ' ago' END AS posted_text,
        {picked(["Full time", "contractor", "Part-time", "role"], "n // 2")} || ' ' || {picked(P.PLACES, "n")} || CASE WHEN n % 4 = 0 THEN ' $' || (50 + n % 50) || ',000 a year' ELSE '' END AS block,
        n, job FROM c0),
    dated AS (SELECT *, CASE WHEN n % 11 = 0 THEN NULL WHEN n % 17 = 0 THEN received_at - INTERVAL 1 DAY
        WHEN unit = 'minutes' THEN received_at - to_minutes(CAST(n % 40 AS BIGINT)) WHEN unit = 'hours' THEN received_at - to_hours(CAST(n % 40 AS BIGINT))
        WHEN unit = 'days' THEN received_at - to_days(CAST(n % 40 AS INT)) WHEN unit = 'weeks' THEN received_at - to_days(CAST(7 * (n % 40) AS INT))
        ELSE received_at - to_months(CAST(n % 40 AS INT)) END AS job_posted_at,
        CASE WHEN n % 4 = 3 THEN 'indeed' WHEN n % 13 = 0 THEN 'generic' ELSE 'linkedin' END AS platform FROM cand)"""


def category_sql(wanted: dict[str, list[str]], negative: dict[str, str] | None = None) -> str:
    """SQL: for each category its name where the text t has one of its keywords, and no negative one, else null."""
    hit = lambda k: f"regexp_matches(t, '(^|[^a-z0-9_])({k})($|[^a-z0-9_])')"
    return ", ".join(f"CASE WHEN {hit('|'.join(k))}{f' AND NOT {hit(negative[name])}' if negative and name in negative else ''} THEN '{name}' END" for name, k in wanted.items())


CATEGORY_SQL = category_sql(rules.CATEGORIES)
PROCESSED = f"""{CANDIDATES},
    cats AS (SELECT *, lower(title) AS t FROM dated),
    proc AS (SELECT *, array_to_string(list_filter([{CATEGORY_SQL}], lambda x: x IS NOT NULL), ',') AS cat,
        regexp_extract(block, '(?i)\\b(remote|hybrid|on-?site)\\b', 1) AS r0,
        CASE WHEN n % 4 = 0 THEN '$' || (50 + n % 50) || ',000 a year' END AS salary,
        [{", ".join(repr(x) for x in ("full-time", "contract", "part-time"))}, NULL][CAST((n // 2) % 4 + 1 AS INT)] AS employment_type,
        CASE WHEN length(title) < 3 THEN 'rejected' WHEN job_posted_at IS NOT NULL AND epoch_us(received_at) - epoch_us(job_posted_at) > 720 * 3600000000 THEN 'stale' ELSE 'accepted' END AS outcome,
        sha256(platform || ':url:' || clean) AS fingerprint FROM cats),
    acc AS (SELECT *, CASE WHEN r0 = '' THEN NULL WHEN lower(r0) IN ('on-site', 'onsite') THEN 'onsite' ELSE lower(r0) END AS remote_type FROM proc WHERE outcome = 'accepted'),
    fold AS (SELECT fingerprint, arg_min(platform, seq) AS platform, arg_min(title, seq) AS title, arg_min(clean, seq) AS job_url, min(seq) AS seq, arg_min(received_at, seq) AS received_at,
        arg_min(cat, seq) AS cat, arg_min(job_posted_at, seq) FILTER (job_posted_at IS NOT NULL) AS job_posted_at, arg_min(remote_type, seq) FILTER (remote_type IS NOT NULL) AS remote_type,
        arg_min(salary, seq) FILTER (salary IS NOT NULL) AS salary, arg_min(employment_type, seq) FILTER (employment_type IS NOT NULL) AS employment_type, count(*) AS sightings FROM acc GROUP BY fingerprint)"""

FOLD = "fingerprint, platform, title, job_url, seq, epoch_us(received_at) AS received_us, cat AS cats, CASE WHEN cat <> '' THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS status, epoch_us(job_posted_at) AS posted_us, remote_type, salary, employment_type, sightings"


def flat(rows: DataFrame) -> DataFrame:
    return rows.select("fingerprint", "platform", "title", "job_url", "seq", F.unix_micros("received_at").alias("received_us"), F.array_join("categories", ",").alias("cats"), "status", F.unix_micros("job_posted_at").alias("posted_us"), "remote_type", "salary", "employment_type", "sightings")

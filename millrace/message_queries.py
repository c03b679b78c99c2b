"""Registered queries on messages and result pages; the SQL gives the rows that went into their HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import lines as L
from .functions import text as X
from .operators import scrape as S
from .plans import digests as D
from .plans import drivers as R
from .plans import parsing
from .plans import postings as P
from .registry import LINES, document_lines, picked, query
from .sources import cards as C
from .sources import messages as M
from .stored import spread, written

_CARDS = f"""c0 AS (SELECT event_id AS n, event_id // {D.CARDS} AS message, ts FROM events),
    c AS (SELECT n, message, max(ts) OVER (PARTITION BY message) AS seen, {picked(P.TITLES, "n")} AS title, {picked(P.PLACES, "n")} AS place, {picked(P.UNITS, "n // 3")} AS unit,
        message % {len(D.SENDERS)} AS s, CASE WHEN n % 4 = 0 THEN '$' || (50 + n % 50) || ',000 a year' END AS salary,
        CASE WHEN n % 11 = 0 THEN 'new' WHEN n % 17 = 0 THEN 'Posted yesterday' ELSE 'Posted ' || (n % 40) || ' ' || {picked(P.UNITS, "n // 3")} || ' ago' END AS posted FROM c0),
    d AS (SELECT *, {picked([s for s in ("linkedin", "indeed", "glassdoor", "wellfound", "generic")], "message")} AS source,
        CASE s WHEN 0 THEN 'https://www.linkedin.com/jobs/view/' || n WHEN 1 THEN 'https://www.indeed.com/viewjob?jk=j' || n WHEN 2 THEN 'https://www.glassdoor.com/job-listing/acme-JV_JO' || n || '.htm'
            WHEN 3 THEN 'https://wellfound.com/job-listings/acme-' || n ELSE 'https://boards.greenhouse.io/jobs/' || n END AS job_url,
        CASE s WHEN 1 THEN 'j' || n WHEN 3 THEN 'acme-' || n WHEN 4 THEN NULL ELSE CAST(n AS VARCHAR) END AS job_id,
        CASE WHEN n % 11 <> 0 AND n % 17 <> 0 THEN posted END AS posted_date,
        CASE n % 4 WHEN 0 THEN 'remote' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'onsite' END AS remote_type,
        CASE WHEN n % 11 = 0 OR n % 17 = 0 THEN NULL WHEN unit = 'minutes' THEN seen - to_minutes(CAST(n % 40 AS BIGINT)) WHEN unit = 'hours' THEN seen - to_hours(CAST(n % 40 AS BIGINT))
            WHEN unit = 'days' THEN seen - to_days(CAST(n % 40 AS INT)) WHEN unit = 'weeks' THEN seen - to_days(CAST(7 * (n % 40) AS INT)) ELSE seen - to_months(CAST(n % 40 AS INT)) END AS posted_at FROM c)"""


@query(f"""WITH {_CARDS} SELECT message AS message_id, source, job_url, job_id, remote_type, salary, posted_date, epoch_us(posted_at) AS posted_us,
    CASE WHEN title <> 'x' THEN title ELSE '{D.COMPANY}' END AS title,
    CASE WHEN s = 2 THEN '{D.COMPANY}' WHEN n % 4 = 2 THEN 'Hybrid' WHEN title <> 'x' THEN '{D.COMPANY}' WHEN n % 4 = 1 AND posted_date IS NULL THEN posted END AS company,
    CASE n % 4 WHEN 2 THEN CASE s WHEN 2 THEN place ELSE 'Paris, France' END WHEN 0 THEN CASE s WHEN 2 THEN NULL ELSE place END ELSE place END AS location
    FROM d WHERE NOT (s = 2 AND title = 'x')""")
def e2_f2_g1_g6_html_digests(spark, sf_dir):
    c = parsing.candidates(D.html_messages(spark, sf_dir))
    return c.select("message_id", "source", "job_url", F.col("platform_job_id").alias("job_id"), "remote_type", "salary", "posted_date", F.unix_micros("job_posted_at").alias("posted_us"), "title", "company", "location")


@query(f"WITH {_CARDS} SELECT message AS message_id, source, title, '{D.COMPANY}' AS company, 'Lahore' AS location, job_url, posted_date FROM d WHERE title <> 'x'")
def e3_text_digests(spark, sf_dir):
    return parsing.candidates(D.text_messages(spark, sf_dir)).select("message_id", "source", "title", "company", "location", "job_url", "posted_date")


@query(f"""WITH {_CARDS} SELECT message AS page_id, title, '{D.COMPANY}' AS company, place AS location, 'https://www.linkedin.com/jobs/view/' || n AS job_url, CAST(n AS VARCHAR) AS job_id, posted AS posted_text,
    CASE WHEN n % 11 = 0 THEN epoch_us(TIMESTAMP '2023-12-31') WHEN n % 17 = 0 THEN epoch_us(seen - INTERVAL 1 DAY) ELSE epoch_us(posted_at) END AS posted_us FROM d WHERE title <> 'x'""")
def e7_e11_result_cards(spark, sf_dir):
    c = C.parsed_cards(D.result_pages(spark, sf_dir))
    return c.select("page_id", "title", "company", "location", "job_url", "job_id", "posted_text", F.unix_micros("posted_at").alias("posted_us"))


def _line(*patterns: str) -> str:
    """SQL: a line that one of the patterns covers as a whole."""
    whole = ["(?i)^(?:" + p.removeprefix("(?i)") + ")$" if p.startswith("(?i)") else f"^(?:{p})$" for p in patterns]
    return "(" + " OR ".join("regexp_matches(t, '" + p.replace("'", "''") + "')" for p in whole) + ")"


_TITLED = f"""coalesce(NOT (length(t) < 3 OR {_line(L.ACTION, L.BADGE, L.PLACE, X.REMOTE, X.POSTED, X.SALARY_CURRENCY, X.SALARY_PLAIN)} OR NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]') OR regexp_matches(t, '[.,;:]$')
    OR (NOT contains(t, ' ') AND length(t) < 6) OR (len(w) >= 2 AND (length(w[-1]) <= 2 OR length(w[1]) <= 2)) OR (NOT regexp_matches(w[-1], '(?i)[aeiou]') AND length(w[-1]) < 4)), false)"""
_WORDS = f"{LINES}, l AS (SELECT doc_id, line, trim(text, ' ') AS t FROM lines), w AS (SELECT doc_id, line, t, string_split_regex(t, '\\s+') AS w FROM l)"


@query(f"WITH {_WORDS} SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({_TITLED}) AS titled FROM w GROUP BY doc_id")
def c9_title_like(spark, sf_dir):
    """Lines of each document, and those that can be titles."""
    rows = document_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(L.is_title_like(F.col("text"))).alias("titled"))


@query(f"WITH {_WORDS} SELECT doc_id, line, {_TITLED} AS titled FROM w")
def c9_title_like_lines(spark, sf_dir):
    d = document_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "line", L.is_title_like(F.col("text")).alias("titled"))


@query("SELECT doc_id, CASE WHEN trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) <> '' THEN left(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g')), 255) END AS field FROM documents")
def f12_cleaned_field(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", L.cleaned_field(F.col("text")).alias("field"))


@query("""SELECT event_id, 'https://www.linkedin.com/jobs/search/?keywords=' || replace(event_type, ' ', '+') || CASE WHEN user_id % 2 = 0 THEN '&location=S%C3%A3o+Paulo%2C+BR' ELSE '' END
    || CASE event_id % 3 WHEN 0 THEN '&f_TPR=r86400' WHEN 1 THEN '&f_TPR=r604800' ELSE '' END || '&f_JT=F' || CASE WHEN event_id % 2 = 0 THEN '&f_WT=2' ELSE '' END AS url FROM events""")
def a8_search_url(spark, sf_dir):
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    place = F.when(F.col("user_id") % 2 == 0, " São Paulo, BR ").otherwise(" ")
    date = F.when(n % 3 == 0, "past_24_hours").when(n % 3 == 1, "past_week").otherwise("any")
    return e.select("event_id", S.search_url(F.col("event_type"), place, date, F.lit("full_time"), F.when(n % 2 == 0, "remote").otherwise("other")).alias("url"))


@query("SELECT page_id, contains(url, '/login') OR contains(url, '/authwall') OR contains(lower(html), 'too many requests') OR contains(lower(html), 'you''ve been temporarily blocked') AS walled FROM pages")
def a6_access_wall(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", S.is_walled(F.col("url"), F.col("html")).alias("walled"))


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey + 1 END AS dst FROM part),
    w AS (SELECT src, src AS place, 0 AS hops FROM r UNION ALL SELECT w.src, r.dst, w.hops + 1 FROM w JOIN r ON w.place = r.src WHERE r.dst IS NOT NULL AND w.hops < 5)
    SELECT 'https://x.org/' || src AS url, 'https://x.org/' || arg_max(place, hops) AS final_url, max(hops) AS hops FROM w GROUP BY src""")
def c16_redirects(spark, sf_dir):
    p, url = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")), lambda k: F.concat(F.lit("https://x.org/"), k.cast("string"))
    moves = p.where("p_partkey % 8 <> 0").select(url(F.col("p_partkey")).alias("src"), url(F.col("p_partkey") + 1).alias("dst"))
    return S.resolved(p.select(url(F.col("p_partkey")).alias("url")), moves).select("url", "final_url", "hops")


@query(f"WITH {_CARDS} SELECT n AS seq, CASE WHEN n % 7 = 0 THEN true WHEN n % 3 = 0 AND n % 10 <> 5 THEN true ELSE false END AS kept FROM d")
def g9_relevance_with_details(spark, sf_dir):
    c = P.candidates(spark, sf_dir).select("seq", "title", F.concat(F.lit("u"), F.col("seq").cast("string")).alias("job_url"))
    pages = c.select(F.col("job_url").alias("url"), F.when(F.col("seq") % 3 == 0, "<body><p>We seek a</p> <b>Python Developer</b></body>").otherwise("<body>Some python is fine</body>").alias("html")).where("url not like '%5'")
    return c.join(S.relevant(c, pages, "Python").select("seq", F.lit(True).alias("hit")), "seq", "left").select("seq", F.coalesce("hit", F.lit(False)).alias("kept"))


@query(f"""WITH {_CARDS}, k AS (SELECT *, coalesce(CASE WHEN n % 11 = 0 THEN TIMESTAMP '2023-12-31' WHEN n % 17 = 0 THEN seen - INTERVAL 1 DAY ELSE posted_at END >= seen - INTERVAL 168 HOUR, true) AS fresh,
        place <> 'On-site' AND contains(place, 'Lahore') AND (n % 7 = 0 OR (n % 3 = 0 AND n % 10 <> 5)) AS fits FROM d WHERE title <> 'x'),
    r AS (SELECT *, row_number() OVER (PARTITION BY message, fits, fresh ORDER BY n) AS nth FROM k)
    SELECT message AS page_id, count(*) AS total_found, count(*) FILTER (fits AND fresh AND nth <= 2 AND n % 8 <> 0) AS saved, count(*) FILTER (fits AND fresh AND nth <= 2 AND n % 8 = 0) AS duplicates,
    count(*) FILTER (fits AND NOT fresh) AS filtered_by_date FROM r GROUP BY 1""")
def i12_scrape_run(spark, sf_dir):
    """One search over all result pages, at most two cards of a page; a part of the cards is stored already."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    url = F.concat(F.lit("https://www.linkedin.com/jobs/view/"), F.col("event_id").cast("string"))
    pages = events.select(url.alias("url"), F.when(F.col("event_id") % 3 == 0, "<body><p>We seek a</p> <b>Python Developer</b></body>").otherwise("<body>Some python is fine</body>").alias("html")).where("url not like '%5'")
    stored = events.where("event_id % 8 = 0").select(F.col("event_id").cast("string").alias("job_id"), url.alias("job_url"))
    cards = written(C.parsed_cards(D.result_pages(spark, sf_dir)), "cards")
    return R.scrape_counts(cards, R.scraped(cards, pages, stored, "Python", "Lahore", "7d", 2))


@query(f"""WITH {_CARDS} SELECT message AS message_id, CASE WHEN s = 2 THEN 'skipped' ELSE 'success' END AS status FROM d WHERE message % 3 <> 1 AND message % 4 <> 2
    GROUP BY message, s HAVING s = 2 OR message % 7 = 3""")
def i10_backfill(spark, sf_dir):
    """Messages without posting and event are read again; a part of them has no links."""
    every = D.html_messages(spark, sf_dir).withColumn("html", F.when(F.col("message_id") % 7 == 3, "<body>Your account</body>").otherwise(F.col("html")))
    every = written(every, "messages")
    ids = every.select("message_id")
    again = R.pending(every, ids.where("message_id % 3 = 1"), ids.where("message_id % 4 = 2"))
    return R.backfill_events(again, parsing.candidates(again), ["glassdoor.com"]).select("message_id", "status")


@query("""WITH l AS (SELECT conv_id, turn, unnest([{'pos': 0, 'mime_type': 'text/plain', 'text': role}, {'pos': 1, 'mime_type': 'text/html', 'text': text}, {'pos': 2, 'mime_type': 'text/plain', 'text': role || text}]) AS x FROM conversations)
    SELECT conv_id, turn, x.pos AS pos, x.mime_type AS mime_type, x.text AS text FROM l""")
def b2_leaf_parts(spark, sf_dir):
    """Turns of conversations as nested messages, flattened and decoded."""
    def leaf(mime: str, text):
        data = F.regexp_replace(F.translate(F.base64(text.cast("binary")), "+/", "-_"), r"[=\s]", "")
        return F.struct(F.lit(mime).alias("mimeType"), F.struct(data.alias("data")).alias("body"))

    c, role, text = spark.read.parquet(f"{sf_dir}/conversations.parquet"), F.col("role"), F.col("text")
    inner = F.to_json(F.struct(F.lit("multipart/alternative").alias("mimeType"), F.array(leaf("text/plain", role), leaf("text/html", text)).alias("parts")))
    whole = F.concat(F.lit('{"mimeType": "multipart/mixed", "parts": ['), inner, F.lit(", "), F.to_json(leaf("text/plain", F.concat(role, text))), F.lit("]}"))
    rows = c.select("conv_id", "turn", F.posexplode(M.leaf_parts(whole)).alias("pos", "x"))
    return rows.select("conv_id", "turn", "pos", "x.mime_type", M.decoded(F.col("x.data")).alias("text"))

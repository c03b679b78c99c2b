"""Registered queries of the posting operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    message_queries,  # noqa: F401  (registers the queries on messages and result pages)
    rules,
    store_queries,  # noqa: F401  (registers the queries of sources, sinks and serving)
)
from .functions import text as X
from .functions import urls as U
from .operators import identity as I
from .operators import judge as J
from .plans import drivers as R
from .plans import postings as P
from .posting_sql import CANDIDATES, CATEGORY_SQL, FOLD, PROCESSED, flat
from .sources import messages as M
from .registry import LINES, QUERIES, SQL, document_lines, query
from .registry import listed as _list
from .registry import picked as _pick
from .sources.html import rendered

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PAGE_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS s, lower({_PAGE_HOST}) AS h, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
    k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND NOT list_contains({_list(rules.TRACKING_PARAMS)}, lower(split_part(x, '=', 1))))) AS kept FROM p)
    SELECT page_id, s || '://' || h || CASE WHEN length(path) > 1 THEN rtrim(path, '/') ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM k""")
def u1_canonical_url(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(f"""WITH {CANDIDATES} SELECT seq, CASE WHEN n % 6 = 5 THEN 'https://www.linkedin.com/feed/' || n ELSE clean END AS canonical, CASE WHEN n % 6 = 5 THEN NULL WHEN n % 4 = 3 THEN 'j' || job ELSE CAST(1000000 + job AS VARCHAR) END AS job_id, n % 6 <> 5 AS is_job FROM cand""")
def u4_job_id(spark, sf_dir):
    """URLs of candidates, every sixth of them no posting."""
    c = P.candidates(spark, sf_dir)
    c = c.withColumn("url", F.when(F.col("seq") % 6 == 5, F.concat(F.lit("https://uk.linkedin.com/comm/feed/"), F.col("seq").cast("string"), F.lit("/?trk=x#top"))).otherwise(F.col("url")))
    return c.select("seq", U.canonical_url(F.col("url")).alias("canonical"), U.job_id(F.col("url")).alias("job_id"), U.is_job_url(F.col("url")).alias("is_job"))


_NAV = "t <> '' AND (" + " OR ".join(f"contains(t, '{p}')" for p in rules.NAV_PHRASES) + f" OR regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(rules.NAV_WORDS)})($|[^\\p{{L}}\\p{{N}}_])'))"
_NAV_LINES = f"{LINES}, a AS (SELECT doc_id, line, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM lines)"


@query(f"WITH {_NAV_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({_NAV}) AS nav FROM a GROUP BY doc_id")
def c5_nav_anchor(spark, sf_dir):
    """Lines of each document, and those that are anchors of navigation."""
    rows = document_lines(_read(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(U.is_nav_anchor(F.col("text"))).alias("nav"))


@query(f"WITH {_NAV_LINES} SELECT doc_id, line, {_NAV} AS nav FROM a")
def c5_nav_anchor_lines(spark, sf_dir):
    return document_lines(_read(spark, sf_dir, "documents")).select("doc_id", "line", U.is_nav_anchor(F.col("text")).alias("nav"))


@query("SELECT page_id, regexp_matches(url, '(?i)^https?://[^/]+/?$') AS bare, " + " OR ".join(f"contains(lower(url), '{p}')" for p in rules.OTHER_URLS) + " AS other FROM pages")
def c6_c7_url_rejects(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", U.is_bare_domain(F.col("url")).alias("bare"), U.is_other_url(F.col("url")).alias("other"))


@query(f"WITH {CANDIDATES}, l AS (SELECT seq, user_id, url, {_pick(['Apply now', 'see it', 'View job'], 'n')} AS anchor FROM cand), s AS (SELECT user_id, seq, url, round(least(0.5 + CASE WHEN regexp_matches(lower(anchor), 'apply|view job') THEN 0.4 ELSE 0 END + 0.3 + 0.6, 0.99), 2) AS c FROM l) SELECT user_id, CAST(max(c) AS DOUBLE) AS confidence, arg_max(url, c * 1000000000 - seq) AS url FROM s GROUP BY user_id")
def u7_best_link(spark, sf_dir):
    c = P.candidates(spark, sf_dir).withColumn("anchor", F.element_at(F.array(*[F.lit(x) for x in ("Apply now", "see it", "View job")]), (F.col("seq") % 3 + 1).cast("int")))
    c = c.withColumn("c", U.link_score(F.col("url"), F.col("anchor")))
    return c.groupBy("user_id").agg(F.max("c").alias("confidence"), F.max_by("url", F.struct("c", -F.col("seq"))).alias("url"))


@query(f"WITH {CANDIDATES} SELECT user_id, clean AS canonical, min(seq) AS first_seen, CAST(count(*) AS BIGINT) AS links FROM cand GROUP BY ALL")
def u8_job_links(spark, sf_dir):
    c = P.candidates(spark, sf_dir).where(U.is_job_url(F.col("url")) & ~U.is_other_url(F.col("url")) & ~U.is_bare_domain(F.col("url")))
    return c.groupBy("user_id", U.canonical_url(F.col("url")).alias("canonical")).agg(F.min("seq").alias("first_seen"), F.count(F.lit(1)).alias("links"))


@query(f"WITH {CANDIDATES} SELECT seq, CASE WHEN n % 4 = 3 THEN 'indeed' WHEN n % 13 = 0 THEN NULL ELSE 'linkedin' END AS tag, CASE WHEN n % 4 = 3 THEN 'indeed' WHEN n % 13 = 0 THEN 'generic' ELSE 'linkedin' END AS parser FROM cand")
def c1_c3_platform_and_parser(spark, sf_dir):
    return P.tagged(spark, sf_dir)


@query("SELECT conv_id, turn, text FROM conversations")
def b1_base64url(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    coded = F.regexp_replace(F.translate(F.base64(F.col("text").cast("binary")), "+/", "-_"), r"[=\s]", "")
    return c.select("conv_id", "turn", M.decoded(coded).alias("text"))


@query("SELECT page_id, array_to_string([rtrim(url, ').,>\"''')], ' ') AS links FROM pages")
def b7_text_links(spark, sf_dir):
    text = F.concat(F.lit("see ("), "url", F.lit("), again: "), "url", F.lit("."))
    return _read(spark, sf_dir, "pages").select("page_id", F.array_join(M.text_links(text), " ").alias("links"))


@query("SELECT conv_id, turn, sha256(CAST(conv_id AS VARCHAR) || ':' || role || ':' || text) AS raw_hash FROM conversations")
def b11_content_hash(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", M.content_hash(F.col("conv_id").cast("string"), F.col("role"), F.col("text")).alias("raw_hash"))


@query()
def b4_b6_render_and_links(spark, sf_dir):
    r = _read(spark, sf_dir, "pages").select("page_id", rendered(F.col("html"), ("http://", "https://", "/")).alias("r"))
    return r.select("page_id", "r.text", F.size("r.links").alias("links"))


@query(f"WITH {PROCESSED} SELECT seq, CASE WHEN r0 = '' THEN NULL WHEN lower(r0) IN ('on-site', 'onsite') THEN 'onsite' ELSE lower(r0) END AS remote_type, employment_type, salary, CASE WHEN n % 11 <> 0 AND n % 17 <> 0 THEN posted_text END AS posted, user_id % 3 = 0 AS promoted FROM proc")
def f5_f9_fields(spark, sf_dir):
    """Fields of blocks, of which some have the badge and some a word like it."""
    c = P.candidates(spark, sf_dir)
    c = c.withColumn("block", F.concat("block", F.when(F.col("user_id") % 3 == 0, " Promoted").otherwise(" unpromoted")))
    return c.select("seq", X.remote_type(F.col("block")).alias("remote_type"), X.employment_type(F.col("block")).alias("employment_type"), X.salary(F.col("block")).alias("salary"), X.posted_phrase(F.col("posted_text")).alias("posted"), X.is_promoted(F.col("block")).alias("promoted"))


@query(f"WITH {CANDIDATES}, l AS (SELECT seq, place, 'Acme ' || (n % 9) || ' - ' || place AS line FROM cand) SELECT seq, CASE WHEN contains(place, ',') OR place = 'On-site' THEN NULLIF(regexp_extract(line, '^([A-Za-z][A-Za-z0-9 .,&()''/-]*?)\\s+[-–—]\\s+([A-Za-z][A-Za-z .,''()-]*)$', 1), '') END AS company FROM l")
def f3_company_split(spark, sf_dir):
    c = P.candidates(spark, sf_dir).withColumn("line", F.concat(F.lit("Acme "), (F.col("seq") % 9).cast("string"), F.lit(" - "), "place"))
    return c.select("seq", X.company_of(F.col("line")).alias("company"))


@query(f"WITH {CANDIDATES} SELECT seq, epoch_us(job_posted_at) AS posted_us FROM dated")
def f10_relative_date(spark, sf_dir):
    from .functions.dates import posted_at

    return P.candidates(spark, sf_dir).select("seq", F.unix_micros(posted_at(F.col("posted_text"), F.col("received_at"))).alias("posted_us"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents")
def f16_search_text(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", X.search_text(F.col("text")).alias("t"))


@query(f"WITH {CANDIDATES} SELECT seq, len(list_intersect(['paris', 'germany'], string_split(trim(regexp_replace(lower(place), '[^a-z0-9]+', ' ', 'g')), ' '))) > 0 AS near FROM cand")
def c14_location(spark, sf_dir):
    return P.candidates(spark, sf_dir).select("seq", X.location_matches(F.lit("Paris / Germany"), F.col("place")).alias("near"))


@query(f"WITH {CANDIDATES} SELECT seq, length(title) >= 3 AS reliable, CASE WHEN length(title) < 3 THEN 'unreliable title' END AS reason FROM cand")
def c10_c12_validity(spark, sf_dir):
    c = P.candidates(spark, sf_dir)
    return c.select("seq", X.is_reliable_title(F.col("title")).alias("reliable"), J.reject_reason(F.col("title"), F.col("url"), F.lit(None).cast("string"), F.col("received_at")).alias("reason"))


@query(f"WITH {CANDIDATES} SELECT CASE WHEN job_posted_at IS NOT NULL AND epoch_us(received_at) - epoch_us(job_posted_at) > 86400000000 THEN 'too_old' ELSE 'fresh' END AS age, count(*) AS n FROM dated GROUP BY 1")
def i2_freshness(spark, sf_dir):
    from .functions.dates import posted_at

    c = P.candidates(spark, sf_dir)
    return c.groupBy(J.freshness(posted_at(F.col("posted_text"), F.col("received_at")), F.col("received_at")).alias("age")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CANDIDATES} SELECT seq FROM dated WHERE job_posted_at IS NULL OR epoch_us(job_posted_at) >= epoch_us(received_at) - 168 * 3600000000")
def g11_age_window(spark, sf_dir):
    from .functions.dates import posted_at

    c = P.candidates(spark, sf_dir).withColumn("p", posted_at(F.col("posted_text"), F.col("received_at")))
    return c.where(J.in_age_window(F.col("p"), F.col("received_at"), "7d")).select("seq")


@query(f"WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), f AS (SELECT doc_id, array_to_string(list_filter([{CATEGORY_SQL.replace('[^a-z0-9_]', chr(92) + 'P{L}').replace(chr(92) + 'P{L}', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]')}], lambda x: x IS NOT NULL), ',') AS cats FROM d) SELECT doc_id, cats, CASE WHEN cats <> '' THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS status FROM f")
def h4_h6_categories(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").withColumn("c", J.categories(F.lit(None).cast("string"), F.col("text")))
    return d.select("doc_id", F.array_join("c", ",").alias("cats"), J.status(F.col("c")).alias("status"))


@query(f"WITH {CANDIDATES} SELECT seq, n % 7 IN (0) AS python, n % 7 = 1 AS php_laravel FROM cand")
def g8_relevance(spark, sf_dir):
    fits = lambda k: J.keyword_matches(k, F.col("title"), rules.ROLES, rules.ROLE_WORDS, rules.STACK_WORDS)
    return P.candidates(spark, sf_dir).select("seq", fits("Python").alias("python"), fits("php laravel").alias("php_laravel"))


@query(f"WITH {PROCESSED} SELECT seq, fingerprint FROM proc")
def i3_fingerprint(spark, sf_dir):
    return P.processed(P.candidates(spark, sf_dir)).select("seq", "fingerprint")


@query(f"WITH {PROCESSED} SELECT {FOLD} FROM fold")
def i4_fold(spark, sf_dir):
    return flat(P.stored(spark, sf_dir))


@query(f"WITH {PROCESSED}, e AS (SELECT CASE WHEN outcome = 'stale' THEN 'filtered_stale' WHEN outcome = 'rejected' THEN 'normalization_rejected' WHEN seq = min(seq) OVER (PARTITION BY fingerprint, outcome) THEN 'job_persisted' ELSE 'duplicate_detected' END AS event_type FROM proc) SELECT event_type, count(*) AS n FROM e GROUP BY 1")
def i4_j4_events(spark, sf_dir):
    return P.event_counts(P.processed(P.candidates(spark, sf_dir)))


@query(f"WITH {CANDIDATES} SELECT user_id AS account_id, clean AS message_id, min(seq) AS seq FROM cand WHERE seq % 3 <> 0 AND (user_id, clean) NOT IN (SELECT user_id, clean FROM cand WHERE seq % 3 = 0) GROUP BY 1, 2")
def i5_message_dedup(spark, sf_dir):
    m = P.candidates(spark, sf_dir).select(F.col("user_id").alias("account_id"), U.canonical_url(F.col("url")).alias("message_id"), "seq")
    return I.new_messages(m.where("seq % 3 <> 0"), m.where("seq % 3 = 0"))


@query(f"WITH {CANDIDATES}, k AS (SELECT seq, CASE WHEN n % 6 <> 0 THEN job END AS job_id, CASE WHEN n % 9 <> 0 THEN clean END AS job_url FROM cand) SELECT min(seq) AS pos FROM k GROUP BY coalesce('i:' || job_id, 'u:' || job_url, 'n:' || seq)")
def i6_page_dedup(spark, sf_dir):
    return I.page_dedup(_cards(spark, sf_dir)).select("pos")


def _cards(spark, sf_dir):
    n = F.col("seq")
    job = (F.col("user_id") * 7 + n % 5).cast("string")
    return P.candidates(spark, sf_dir).select(n.alias("pos"), F.when(n % 6 != 0, job).alias("job_id"), F.when(n % 9 != 0, U.canonical_url(F.col("url"))).alias("job_url"))


@query(f"""WITH {CANDIDATES}, k AS (SELECT seq AS pos, CASE WHEN n % 6 <> 0 THEN job END AS job_id, CASE WHEN n % 9 <> 0 THEN clean END AS job_url FROM cand),
    old AS (SELECT * FROM k WHERE pos % 10 = 0),
    f AS (SELECT * FROM k WHERE pos % 10 <> 0 AND (job_id IS NULL OR job_id NOT IN (SELECT job_id FROM old WHERE job_id IS NOT NULL)) AND (job_url IS NULL OR job_url NOT IN (SELECT job_url FROM old WHERE job_url IS NOT NULL))),
    a AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS r FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY pos) AS s FROM a WHERE job_id IS NULL OR r = 1)
    SELECT pos FROM b WHERE job_url IS NULL OR s = 1""")
def i7_insert_if_absent(spark, sf_dir):
    cards = _cards(spark, sf_dir)
    return I.insert_if_absent(cards.where("pos % 10 <> 0"), cards.where("pos % 10 = 0")).select("pos")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_orderstatus = 'O'")
def i9_backfill_not_in(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    done = _read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.pending(orders, done, key="o_orderkey")


@query(f"WITH {PROCESSED}, b AS (SELECT user_id, clean, arg_max(seq, (salary IS NOT NULL)::INT * 1000000000 - seq) AS best, arg_min(salary, seq) FILTER (salary IS NOT NULL) AS salary, min(seq) AS first_seen FROM proc GROUP BY 1, 2) SELECT user_id, best AS seq, salary, first_seen FROM b")
def g6_one_per_id(spark, sf_dir):
    rows = P.processed(P.candidates(spark, sf_dir)).select("user_id", "seq", F.col("job_url").alias("jid"), "salary", F.lit(False).alias("is_promoted"))
    return I.one_per_id(rows, "user_id", "jid", [F.col("salary").isNotNull()], "seq", ["salary"]).select("user_id", "seq", "salary", "first_seen")


@query(f"WITH {PROCESSED} SELECT {FOLD} FROM fold ORDER BY received_at DESC, seq DESC LIMIT 20 OFFSET 20")
def k1_page(spark, sf_dir):
    return flat(P.page(P.stored(spark, sf_dir), 2, 20))


@query(f"WITH {PROCESSED} SELECT count(*) AS total, CAST((count(*) + 19) // 20 AS BIGINT) AS total_pages FROM fold")
def k2_k6_counts(spark, sf_dir):
    return P.stored(spark, sf_dir).agg(F.count(F.lit(1)).alias("total")).select("total", F.floor((F.col("total") + 19) / 20).alias("total_pages"))


@query(f"WITH {PROCESSED} SELECT seq, epoch_us(received_at) AS received_us FROM fold WHERE cat <> '' ORDER BY received_at DESC, seq DESC LIMIT 50")
def k5_k7_recent_relevant(spark, sf_dir):
    return P.page(P.relevant(P.stored(spark, sf_dir)), 1, 50).select("seq", F.unix_micros("received_at").alias("received_us"))


@query(f"WITH {PROCESSED} SELECT user_id, count(*) AS found, CAST(sum(CASE WHEN outcome = 'accepted' THEN 1 ELSE 0 END) AS BIGINT) AS ingested, CAST(sum(CASE WHEN outcome = 'stale' THEN 1 ELSE 0 END) AS BIGINT) AS filtered_by_date, CAST(sum(CASE WHEN outcome = 'rejected' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM proc GROUP BY user_id")
def k10_k11_summary(spark, sf_dir):
    p = P.processed(P.candidates(spark, sf_dir))
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("found"), *[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("accepted", "ingested"), ("stale", "filtered_by_date"), ("rejected", "failed"))])

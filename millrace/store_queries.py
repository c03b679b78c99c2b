"""Registered queries of sources, sinks and serving: they write tables, write a batch again and read back; the SQL gives what must be stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import rules
from .functions import lines as L
from .functions import registered as G
from .functions import text as X
from .functions import urls as U
from .functions.dates import posted_at
from .operators import addresses as N
from .operators import judge as J
from .operators import platforms as T
from .operators import rule_join as H
from .operators import scrape as S
from .operators import sinks as K
from .plans import compaction as C
from .plans import drivers as R
from .plans import parsing
from .plans import postings as P
from .plans import serving as V
from .posting_sql import CANDIDATES, FOLD, PROCESSED, category_sql, flat
from .registry import listed, picked, query
from .sources import landing as A
from .sources import messages as M
from .sources.html import rendered
from .streaming import ingest as I
from .stored import fresh_path, spread, table_at, written

_LONG = "'Subject ' || repeat('ab', 600)"


def _leaf(mime: str, text):
    """A node of a payload without parts; its data is base64url, padding stripped."""
    data = F.regexp_replace(F.translate(F.base64(text.cast("binary")), "+/", "-_"), r"[=\s]", "")
    return F.to_json(F.struct(F.lit(mime).alias("mimeType"), F.struct(data.alias("data")).alias("body")))


def _conversation_lines(spark, sf_dir):
    """(conv_id, turn, account_id, value): turns of conversations as lines of a landing folder. By turns the payload nests plain text and html three deep, has html only, or is plain text itself."""
    c = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text <> ''"))
    conv, turn, role = F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role")
    html = F.concat(F.lit("<html><body><p>From <b>"), role, F.lit("</b></p><div>turn "), turn, F.lit('<br><a href="https://x.org/'), conv, F.lit('">see</a></div></body></html>'))
    heads = F.to_json(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("from", F.concat(role, F.lit("@x.org"))), ("Subject", F.concat(F.lit("Turn "), turn)))]))
    many = lambda kind, *parts: F.concat(F.lit(f'"mimeType": "multipart/{kind}", "parts": ['), F.concat_ws(", ", *parts), F.lit("]"))
    nested = many("mixed", F.concat(F.lit("{"), many("related", F.concat(F.lit("{"), many("alternative", _leaf("text/plain", F.col("text")), _leaf("text/html", html)), F.lit("}")), _leaf("image/png", role)), F.lit("}")), _leaf("application/pdf", role))
    only = many("alternative", _leaf("text/html", html))
    flat = F.regexp_replace(_leaf("text/plain", F.concat("text", F.lit(" (https://x.org/p"), conv, F.lit(")."))), r"^\{|\}$", "")
    payload = F.concat(F.lit('{"headers": '), heads, F.lit(", "), F.when(F.col("turn") % 3 == 0, nested).when(F.col("turn") % 3 == 1, only).otherwise(flat), F.lit("}"))
    line = F.concat(F.lit('{"id": "'), conv, F.lit(":"), turn, F.lit('", "threadId": "t", "internalDate": "'), (F.lit(1_700_000_000_000) + F.col("conv_id") * 1000).cast("string"), F.lit('", "payload": '), payload, F.lit("}"))
    return c.select("conv_id", "turn", (F.col("conv_id") % 3).alias("account_id"), line.alias("value"))


@query("""SELECT conv_id || ':' || turn AS message_id, role || '@x.org' AS sender, 'Turn ' || turn AS subject, (1700000000000 + conv_id * 1000) * 1000 AS received_us,
    CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN 'From ' || role || chr(10) || 'turn ' || turn || chr(10) || 'see' ELSE text || ' (https://x.org/p' || conv_id || ').' END AS plain_text,
    CASE turn % 3 WHEN 2 THEN 'https://x.org/p' || conv_id || ' ' ELSE 'https://x.org/' || conv_id || ' see' END AS links FROM conversations WHERE text <> ''""")
def a1_a2_message_scan(spark, sf_dir):
    """A landing folder of JSON messages with nested payloads, each twice, read back once."""
    folder, lines = fresh_path(spark, "landing"), _conversation_lines(spark, sf_dir).select("value")
    lines.unionByName(lines).write.text(folder)
    m = M.normalized(A.raw_messages(spark, folder))
    return m.select("message_id", "sender", "subject", F.unix_micros("received_at").alias("received_us"), "plain_text", F.array_join(F.transform("links", lambda x: F.concat(x["url"], F.lit(" "), x["anchor_text"])), "|").alias("links"))


#: What makes a line of the folder unreadable, by its number: each cuts or changes the line.
_SPOILT = [(11, "no JSON object"), (13, "no id"), (17, "date is no number"), (19, "payload is no object"), (23, "body is no base64")]
_REASON = "CASE " + " ".join(f"WHEN (conv_id * 31 + turn) % {k} = 0 THEN '{r}'" for k, r in _SPOILT) + " END"


def _spoilt_folder(spark, sf_dir):
    """The same lines with some spoilt, the first turn of each conversation twice, and blank lines between."""
    k, v = F.col("conv_id") * 31 + F.col("turn"), F.col("value")
    ways = [F.substring(v, 1, 40), F.regexp_replace(v, '"id": "[^"]*", ', ""), F.regexp_replace(v, '"internalDate": "[0-9]*"', '"internalDate": "soon"'), F.regexp_replace(v, '"payload": .*$', '"payload": "none"}'), F.regexp_replace(v, '"data": ?"[^"]*"', '"data": "A"')]
    spoilt = F.coalesce(*[F.when(k % n == 0, way) for (n, _), way in zip(_SPOILT, ways, strict=True)], v)
    folder, lines = fresh_path(spark, "landing"), _conversation_lines(spark, sf_dir).withColumn("value", spoilt)
    twice = lines.unionByName(lines.where("turn = 0")).select("account_id", F.explode(F.array("value", F.lit("  "))).alias("value"))
    twice.write.partitionBy("account_id").text(folder)
    return folder


@query(f"""WITH l AS (SELECT *, conv_id % 3 AS account_id, {_REASON} AS reason FROM conversations WHERE text <> ''), t AS (SELECT * FROM l UNION ALL SELECT * FROM l WHERE turn = 0),
    g AS (SELECT account_id, count(*) AS found, count(*) FILTER (reason IS NOT NULL) AS failed, count(DISTINCT CASE WHEN reason IS NULL THEN conv_id || ':' || turn END) AS fresh, count(DISTINCT CASE WHEN reason IS NULL AND conv_id % 4 = 0 THEN conv_id || ':' || turn END) AS old FROM t GROUP BY 1)
    SELECT account_id, found, fresh - old AS ingested, found - failed - fresh + old AS skipped_duplicate, failed FROM g""")
def i11_folder_sync(spark, sf_dir):
    """A sync run over a folder with broken lines, of which a part is stored already: every line is ingested, a duplicate or failed."""
    folder, target, rejected, now = _spoilt_folder(spark, sf_dir), fresh_path(spark, "synced"), fresh_path(spark, "rejected"), F.lit("2024-01-01").cast("timestamp")
    earlier = A.landed(spark, folder).where("reason is null and cast(split(id, ':')[0] as long) % 4 = 0")
    K.store_messages(M.normalized(earlier, "account_id").withColumn("seq", F.lit(0).cast("long")), target, 0, now)
    counts = R.synced_folder(spark, folder, target, rejected, 1, now, ["example.org"])[0]
    return counts.select(F.col("account_id").cast("long"), "found", "ingested", "skipped_duplicate", "failed")


@query("SELECT conv_id || ':' || turn AS message_id, conv_id % 3 AS account_id, role || '@x.org' AS sender, (1700000000000 + conv_id * 1000) * 1000 AS received_us FROM conversations WHERE text <> ''")
def i5_landing_stream(spark, sf_dir):
    """A stream over a landing folder that is stopped, gets more files, some lines of them again, and goes on from its checkpoint."""
    folder, target, checkpoint = (fresh_path(spark, n) for n in ("landing", "streamed", "checkpoint"))
    lines = written(_conversation_lines(spark, sf_dir), "lines")
    for part in (lines.where("turn % 2 = 0"), lines):
        part.select("account_id", "value").write.mode("append").partitionBy("account_id").text(folder)
        I.append(I.landing_messages(spark, folder, 24), target, checkpoint).awaitTermination()
    return table_at(spark, target).select("message_id", F.col("account_id").cast("long"), "sender", F.unix_micros("received_at").alias("received_us"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT *, {_REASON} AS reason FROM conversations WHERE text <> '' UNION ALL SELECT *, {_REASON} FROM conversations WHERE text <> '' AND turn = 0) WHERE reason IS NOT NULL GROUP BY 1")
def a1_rejected_lines(spark, sf_dir):
    """Lines that give no message, by reason; each keeps its file and text."""
    rows = A.rejected_lines(spark, _spoilt_folder(spark, sf_dir)).where("file is not null and line is not null")
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CANDIDATES} SELECT seq FROM cand WHERE floor(epoch_us(received_at) / 1000000) >= floor((SELECT max(epoch_us(received_at)) FROM cand) / 1000000 - 100 * 3600) AND NOT contains(lower(sender), 'example.org')")
def a3_lookback(spark, sf_dir):
    c = P.candidates(spark, sf_dir)
    now = F.lit(c.agg(F.max("received_at")).first()[0])
    return c.where(A.in_lookback(F.col("received_at"), F.col("sender"), now, 100, ["Example.org"])).select("seq")


@query("SELECT 'User ' || user_id || chr(10) || event_type || chr(10) || 'abc' || chr(10) || 'see again' || chr(10) || 'x y' || chr(10) || 'z' AS text, event_id, 'https://x.org/' || event_id || ' see' AS links FROM events")
def b4_b6_generated(spark, sf_dir):
    """Pages of events: a title, a caption, a tag that breaks no line, a block behind a space, and text after the body."""
    n, e = F.col("event_id").cast("string"), spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    link = lambda text: F.concat(F.lit('<a href=" https://x.org/'), n, F.lit(f'">{text}</a>'))
    html = F.concat(
        F.lit("<html><head><title>no</title></head>before<body><script>no</script>User <b>"), F.col("user_id").cast("string"), F.lit("</b><figcaption>"), "event_type",
        F.lit("</figcaption>a<center>b</center>c<!-- no --><br>"), link("see"), F.lit(" "), link("again"), F.lit('<a href="/no"></a><hr>x <div>y</div><span><p>z</span></body><p>after</p></html>'),
    )
    r = e.select("event_id", rendered(html).alias("r"))
    return r.select("event_id", "r.text", F.array_join(F.transform("r.links", lambda x: F.concat_ws(" ", x["url"], x["anchor_text"])), "|").alias("links"))


@query(f"WITH {CANDIDATES} SELECT seq, CASE WHEN n % 4 = 3 THEN 'indeed' WHEN n % 13 = 0 THEN 'board' ELSE 'linkedin' END AS parser FROM cand")
def c4_registered_parser(spark, sf_dir):
    parsers = U.with_parser("board", "example.org", before="wellfound")
    return P.candidates(spark, sf_dir).select("seq", U.parser_of(F.col("sender"), parsers).alias("parser"))


#: Ways to write a URL around a number, and why it must not be followed.
_HOSTS = [
    ("'https://example.org/' || {k} || '?b'", None), ("'ftp://example.org/' || {k}", "scheme is not http or https"), ("'http:///path' || {k}", "no host"), ("'http://LOCALHOST:' || {k} || '/'", "blocked host"),
    ("'https://u:p@127.0.0.' || ({k} % 256) || '/x'", "internal or private address"), ("'http://[::ffff:10.0.0.' || ({k} % 256) || ']:8080/'", "internal or private address"), ("'http://10.2.' || ({k} % 256) || '.4'", "internal or private address"),
    ("'http://8.8.' || ({k} % 256) || '.8/'", None), ("'http://169.254.' || ({k} % 256) || '.254/latest'", "internal or private address"), ("'https://[2606:4700::' || ({k} % 1000) || ']/'", None),
    ("'http://224.0.' || ({k} % 256) || '.1/'", "internal or private address"), ("'mailto:a' || {k} || '@b'", "scheme is not http or https"), ("'http://[fe80::' || ({k} % 1000) || ']/'", "internal or private address"),
]
_HOST_URL = "CASE {k} % " + str(len(_HOSTS)) + " " + " ".join(f"WHEN {i} THEN {u}" for i, (u, _) in enumerate(_HOSTS)) + " END"


@query(f"SELECT event_id, {_HOST_URL.format(k='event_id')} AS url, NULLIF({picked([r or '' for _, r in _HOSTS], 'event_id')}, '') AS reason FROM events")
def c15_safe_urls(spark, sf_dir):
    """URLs whose hosts and addresses vary with the event."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", F.expr(_HOST_URL.format(k="event_id")).alias("url"))
    return e.withColumn("reason", U.unsafe_reason(F.col("url")))


_ADDRESS = "CASE user_id % 6 WHEN 0 THEN '10.' || (user_id % 256) || '.0.1' WHEN 1 THEN '93.184.' || (user_id % 256) || '.34' WHEN 2 THEN '2606:2800::' || user_id WHEN 3 THEN 'fd00::' || user_id WHEN 4 THEN '172.' || (user_id % 64) || '.1.1' END"


@query(f"""WITH u AS (SELECT DISTINCT user_id FROM events), a AS (SELECT user_id, {_ADDRESS} AS address FROM u)
    SELECT 'https://User' || user_id || '.example.org:8443/x' AS url, CASE WHEN address IS NULL OR (user_id % 6 IN (2, 3) AND user_id > 9999) THEN 'host has no address' WHEN user_id % 6 IN (0, 3) OR (user_id % 6 = 4 AND user_id % 64 BETWEEN 16 AND 31) OR user_id % 12 = 1 THEN 'internal or private address' END AS reason FROM a""")
def c15_resolved_addresses(spark, sf_dir):
    """Hosts of users with the addresses they resolve to, some of them with a second one that is private. A group of an IPv6 address has four figures at most: one with more is no address, so its host has none."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    host = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(".example.org"))
    addresses = e.select("user_id", host.alias("host"), F.expr(_ADDRESS).alias("address")).where("address is not null")
    addresses = addresses.select("host", "address").unionByName(e.where("user_id % 12 = 1").select(host.alias("host"), F.lit("192.168.7.7").alias("address")))
    urls = e.select(F.concat(F.lit("https://User"), F.col("user_id").cast("string"), F.lit(".example.org:8443/x")).alias("url"))
    return N.resolved_reason(urls, addresses, N.networks(spark))


_URL = "CASE WHEN {k} % 16 = 6 THEN 'http://10.0.0.' || ({k} % 200) ELSE 'https://x.org/' || {k} END"


@query(f"""WITH RECURSIVE r AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey + 1 END AS dst FROM part),
    w AS (SELECT src, src AS place, 0 AS hops FROM r UNION ALL SELECT w.src, r.dst, w.hops + 1 FROM w JOIN r ON w.place = r.src WHERE r.dst IS NOT NULL AND w.hops < 5 AND w.place % 16 <> 6),
    e AS (SELECT src, arg_max(place, hops) AS place, max(hops) AS hops FROM w GROUP BY src)
    SELECT src, CASE WHEN place % 16 = 6 THEN {_URL.format(k='src')} ELSE {_URL.format(k='place')} END AS final_url, hops, place % 16 = 6 AS blocked FROM e""")
def c15_c16_redirects(spark, sf_dir):
    """Chases that stop at a private address."""
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"))
    url = lambda k: F.when(k % 16 == 6, F.concat(F.lit("http://10.0.0."), (k % 200).cast("string"))).otherwise(F.concat(F.lit("https://x.org/"), k.cast("string")))
    k = F.col("p_partkey")
    # Private addresses repeat; each chase starts from its own key, so they are joined back by it.
    rows = p.select(k.alias("src"), url(k).alias("url"))
    moves = p.where(k % 8 != 0).where(k % 16 != 6).select(url(k).alias("src"), url(k + 1).alias("dst"))
    found = S.resolved(rows.select("url").distinct(), moves)
    return rows.join(found, "url").select("src", "final_url", "hops", "blocked")


_NEGATIVE, _DISABLED = {"Python": ["senior"]}, frozenset({"Backend"})


@query(f"WITH {CANDIDATES}, t AS (SELECT seq, lower(title) AS t FROM cand) SELECT seq, array_to_string(list_filter([{category_sql({k: v for k, v in rules.CATEGORIES.items() if k not in _DISABLED}, {'Python': 'senior'})}], lambda x: x IS NOT NULL), ',') AS cats FROM t")
def h2_h5_categories(spark, sf_dir):
    found = J.categories(F.col("title"), F.lit(None).cast("string"), None, _NEGATIVE, _DISABLED)
    return P.candidates(spark, sf_dir).select("seq", F.array_join(found, ",").alias("cats"))


#: Ids of categories; one name stands twice.
_IDS = [(k + 1, name) for k, name in enumerate(rules.CATEGORIES)] + [(90, "Python")]


def _categories(spark):
    return spark.createDataFrame(_IDS, "id int, name string")


@query(f"WITH {PROCESSED}, l AS (SELECT fingerprint, unnest(string_split(cat, ',')) AS name FROM fold WHERE cat <> '') SELECT fingerprint, CAST(id AS INT) AS category_id FROM l JOIN (VALUES {', '.join(f'({i}, {chr(39)}{n}{chr(39)})' for i, n in _IDS)}) v(id, name) USING (name)")
def h7_category_links(spark, sf_dir):
    return K.category_links(P.stored(spark, sf_dir), _categories(spark))


@query(f"WITH {PROCESSED} SELECT seq, title, CASE WHEN platform <> 'generic' THEN platform END AS source, job_url, array_to_string(list_sort(string_split(cat, ',')), ',') AS cats, epoch_us(received_at) AS received_us, CASE WHEN cat <> '' THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS status, salary FROM fold ORDER BY received_at DESC, seq DESC LIMIT 200")
def k3_k8_served(spark, sf_dir):
    """The newest 200 postings as they are served."""
    rows = written(P.stored(spark, sf_dir), "postings")
    platforms = spark.createDataFrame([(p.slug, p.slug.title()) for p in rules.PLATFORMS], "slug string, name string")
    newest = P.page(rows, 1, 200)
    out = P.served(newest, platforms, K.category_links(newest, _categories(spark)), _categories(spark))
    return out.select("seq", "title", "source", "job_url", F.array_join("categories", ",").alias("cats"), F.unix_micros("received_at").alias("received_us"), "status", "salary")


@query(f"WITH {CANDIDATES} SELECT seq, epoch_us(received_at) AS received_us FROM cand ORDER BY received_at DESC, seq DESC LIMIT 50")
def k4_recent_messages(spark, sf_dir):
    return P.page(P.candidates(spark, sf_dir), 1, 50).select("seq", F.unix_micros("received_at").alias("received_us"))


@query(f"WITH {CANDIDATES}, d AS (SELECT unnest({listed(U.enabled_domains())}) AS domain, unnest(range(1, {len(U.enabled_domains()) + 1})) AS nth) SELECT domain, CAST(nth AS INT) AS nth, count(*) AS messages FROM cand JOIN d ON contains(lower(sender), domain) GROUP BY 1, 2")
def k9_enabled_domains(spark, sf_dir):
    """Messages of each enabled domain, with its place by priority."""
    sender, none = F.lower("sender"), F.lit(None).cast("string")
    hits = F.array(*[F.struct(F.when(F.contains(sender, F.lit(d)), d).otherwise(none).alias("domain"), F.lit(k + 1).alias("nth")) for k, d in enumerate(U.enabled_domains())])
    return P.candidates(spark, sf_dir).select(F.explode(hits).alias("h")).select("h.*").where("domain is not null").groupBy("domain", "nth").agg(F.count(F.lit(1)).alias("messages"))


def _messages(spark, sf_dir):
    c = P.candidates(spark, sf_dir)
    return c.select(F.col("user_id").alias("account_id"), U.canonical_url(F.col("url")).alias("message_id"), F.lit("t").alias("thread_id"), "sender", F.expr(_LONG).alias("subject"), "received_at", F.concat(F.lit("text "), F.col("seq").cast("string")).alias("plain_text"), "seq")


@query(f"""WITH {CANDIDATES}, m AS (SELECT user_id AS account_id, clean AS message_id, arg_min(seq, (seq % 3) * 1000000000 + seq) AS seq FROM cand GROUP BY ALL)
    SELECT m.account_id, m.message_id, m.seq, CASE WHEN n % 4 = 3 THEN 'indeed' WHEN n % 13 = 0 THEN NULL ELSE 'linkedin' END AS source, left({_LONG}, 998) AS subject, 'PROCESSED' AS status, sha256(m.message_id || ':' || {_LONG} || ':text ' || m.seq) AS raw_hash
    FROM m JOIN cand USING (seq)""")
def j1_j2_message_store(spark, sf_dir):
    """Three batches, the second of them twice."""
    target, m = fresh_path(spark, "messages"), written(_messages(spark, sf_dir), "batches")
    for number in (0, 1, 2, 1):
        K.store_messages(m.where(F.col("seq") % 3 == number) if number != 1 else m.where("seq % 3 = 1"), target, number, F.lit("2024-01-01").cast("timestamp"))
    return table_at(spark, target).select("account_id", "message_id", "seq", "source", "subject", "status", "raw_hash")


def _accepted(rows):
    return rows.where("outcome = 'accepted'").select("fingerprint", "seq", "platform", "title", "job_url", "platform_job_id", "received_at", "status", "categories", "job_posted_at", "remote_type", "salary", "employment_type")


@query(f"WITH {PROCESSED} SELECT {FOLD} FROM fold")
def j3_posting_store(spark, sf_dir):
    """Postings of three batches, the last of them first and one of them twice."""
    target, rows = fresh_path(spark, "postings"), written(P.processed(P.candidates(spark, sf_dir)), "processed")
    for number in (2, 0, 1, 2):
        K.store_postings(_accepted(rows).where(F.col("seq") % 3 == number), target, number)
    return flat(K.read_postings(spark, target))


_EVENTS = """e AS (SELECT *, CASE WHEN outcome = 'stale' THEN 'filtered_stale' WHEN outcome = 'rejected' THEN 'normalization_rejected' WHEN seq = min(seq) OVER (PARTITION BY fingerprint, outcome) THEN 'job_persisted' ELSE 'duplicate_detected' END AS event_type FROM proc)"""


@query(f"""WITH {PROCESSED}, {_EVENTS} SELECT seq, event_type, CASE WHEN event_type = 'job_persisted' THEN 'success' ELSE 'skipped' END AS status, CASE WHEN outcome = 'accepted' THEN fingerprint END AS fingerprint,
    CASE event_type WHEN 'job_persisted' THEN 'Persisted with status ' || CASE WHEN cat <> '' THEN 'RELEVANT' ELSE 'IRRELEVANT' END WHEN 'duplicate_detected' THEN 'Fingerprint ' || fingerprint || ' already exists'
        WHEN 'filtered_stale' THEN 'Job ' || chr(39) || title || chr(39) || ' older than 720h (reason: too_old)' ELSE 'Candidate rejected during normalization: unreliable title' END AS message,
    '{{"platform":"' || platform || '","job_url":"' || clean || '","title":"' || title || '"}}' AS metadata FROM e""")
def j4_event_store(spark, sf_dir):
    """Events of three batches in order of arrival, each against the postings stored before it; the last twice."""
    rows = written(P.processed(P.candidates(spark, sf_dir)), "processed")
    events, target, most = fresh_path(spark, "events"), fresh_path(spark, "postings"), rows.agg(F.max("seq")).first()[0] or 0
    for number in (0, 1, 2, 2):
        batch = rows.where(F.floor(F.col("seq") * 3 / (most + 1)) == number)
        found = P.events(batch, K.known_postings(_accepted(batch), target, number))
        K.store_events(P.described(found, batch, F.lit("2024-01-01").cast("timestamp")), events, number)
        K.store_postings(_accepted(batch), target, number)
    return table_at(spark, events).select("seq", "event_type", "status", "fingerprint", "message", "metadata")


@query(f"WITH {PROCESSED}, l AS (SELECT fingerprint, unnest(string_split(cat, ',')) AS name FROM fold WHERE cat <> '') SELECT fingerprint, CAST(id AS INT) AS category_id, 'rules' AS matched_by FROM l JOIN (VALUES {', '.join(f'({i}, {chr(39)}{n}{chr(39)})' for i, n in _IDS)}) v(id, name) USING (name)")
def j3_category_pivot(spark, sf_dir):
    """Category links written with the postings of three batches, one of them twice: those of each posting's first sighting."""
    target, links, rows = fresh_path(spark, "postings"), fresh_path(spark, "links"), written(P.processed(P.candidates(spark, sf_dir)), "processed")
    for number in (2, 0, 1, 2):
        batch = _accepted(rows).where(F.col("seq") % 3 == number)
        K.store_postings(batch, target, number)
        K.store_links(batch, _categories(spark), links, number)
    return K.read_links(spark, links, K.read_postings(spark, target)).select("fingerprint", "category_id", "matched_by")


def _first(rows: str) -> str:
    """SQL: rows of a table that are the first of their id, and of those the first of their URL."""
    return f"SELECT pos, job_id, job_url FROM (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY pos) AS s FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY pos) AS r FROM {rows}) WHERE job_id IS NULL OR r = 1) WHERE job_url IS NULL OR s = 1"


@query(f"""WITH {CANDIDATES}, k AS (SELECT seq AS pos, CASE WHEN n % 6 <> 0 THEN job END AS job_id, CASE WHEN n % 9 <> 0 THEN clean END AS job_url FROM cand), k0 AS (SELECT * FROM k WHERE pos % 4 = 0), a AS ({_first('k0')}),
    k1 AS (SELECT * FROM k WHERE pos % 4 <> 0 AND (job_id IS NULL OR job_id NOT IN (SELECT job_id FROM a WHERE job_id IS NOT NULL)) AND (job_url IS NULL OR job_url NOT IN (SELECT job_url FROM a WHERE job_url IS NOT NULL))), b AS ({_first('k1')})
    SELECT pos FROM a UNION ALL SELECT pos FROM b""")
def j5_card_store(spark, sf_dir):
    """Cards of two batches, the second twice."""
    n = F.col("seq")
    cards = P.candidates(spark, sf_dir).select(n.alias("pos"), F.when(n % 6 != 0, (F.col("user_id") * 7 + n % 5).cast("string")).alias("job_id"), F.when(n % 9 != 0, U.canonical_url(F.col("url"))).alias("job_url"))
    cards, target = written(cards, "cards"), fresh_path(spark, "cards")
    for number in (0, 1, 1):
        K.store_cards(cards.where((F.col("pos") % 4 != 0) == bool(number)), target, number)
    return table_at(spark, target).select("pos")


@query(f"""WITH {CANDIDATES}, m AS (SELECT user_id AS account_id, clean AS message_id, seq, seq % 17 = 0 AS lost FROM cand WHERE seq % 3 <> 0),
    new AS (SELECT account_id, count(DISTINCT message_id) AS ingested FROM m WHERE NOT lost AND (account_id, message_id) NOT IN (SELECT user_id, clean FROM cand WHERE seq % 3 = 0) GROUP BY 1)
    SELECT account_id, count(*) AS found, coalesce(any_value(ingested), 0) AS ingested, count(*) - coalesce(any_value(ingested), 0) - count(*) FILTER (lost) AS skipped_duplicate, count(*) FILTER (lost) AS failed FROM m LEFT JOIN new USING (account_id) GROUP BY 1""")
def i11_sync_run(spark, sf_dir):
    """A sync run over messages of which a part is stored and a part has no instant."""
    target, m, now = fresh_path(spark, "synced"), _messages(spark, sf_dir), F.lit("2024-01-01").cast("timestamp")
    K.store_messages(m.where("seq % 3 = 0"), target, 0, now)
    late = m.where("seq % 3 <> 0").withColumn("received_at", F.when(F.col("seq") % 17 != 0, F.col("received_at")))
    return R.synced(late, target, 1, now, ["example.org"])[0]


#: URLs around a number with what a domain and a posting count for, and anchor texts with whether they say "apply".
_LINK_URLS = [("https://www.linkedin.com/jobs/view/", "", "linkedin.com", True), ("https://www.indeed.com/jobs?q=", "&l=x", "indeed.com", False), ("https://x.org/", "/about", None, False), ("https://boards.greenhouse.io/jobs/", "", None, True), ("https://WELLFOUND.com/people/", "-a", "wellfound.com", False)]
_LINK_TEXTS = [("Apply now ", True), ("see role ", False), ("View Job ", True), ("more ", False)]


def _case(k: str, values: list[str]) -> str:
    """SQL: the value at place k, counted around."""
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_LINK = f"""l AS (SELECT event_id, {_case('user_id', [f"'{t}' || user_id" for t, _ in _LINK_TEXTS])} AS anchor, {_case('user_id', [str(x) for _, x in _LINK_TEXTS])} AS apply,
    {_case('event_id', [f"'{d}'" if d else 'NULL' for _, _, d, _ in _LINK_URLS])} AS domain, {_case('event_id', [str(j) for *_, j in _LINK_URLS])} AS direct FROM events)"""


@query(f"""WITH {_LINK} SELECT event_id, round(least(0.99, 0.5 + CASE WHEN apply THEN 0.4 ELSE 0 END + CASE WHEN domain IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN direct THEN 0.6 ELSE 0 END), 2)::DOUBLE AS confidence,
    coalesce(nullif(concat_ws(' + ', CASE WHEN apply THEN '"' || anchor || '" anchor' END, domain || ' URL', CASE WHEN direct THEN 'direct job-posting URL' END), ''), 'generic link, no strong signal') AS reason, direct FROM l""")
def u7_link_verdict(spark, sf_dir):
    """Links whose URL and anchor text vary with event and user."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    url = F.expr(_case("event_id", [f"concat('{a}', user_id, '{b}')" for a, b, *_ in _LINK_URLS]))
    anchor = F.expr(_case("user_id", [f"concat('{t}', user_id)" for t, _ in _LINK_TEXTS]))
    return e.select("event_id", U.link_verdict(url, anchor).alias("v")).select("event_id", "v.*")


_URLS = [("https://www.linkedin.com/jobs/view/", "?x", True), ("https://www.LINKEDIN.com/jobs/view/", "", False), ("https://jobs.LEVER.co/acme-", "/", True), ("https://www.linkedin.com/feed/", "", False), ("https://dice.com/detail/", "", True), ("https://x.org/jobs/view/", "", False)]
_BADGES = [("Role {} promoted", True), ("Role {} unpromoted", False), ("Sponsored {}", True), ("{} self-promotion", False), ("PROMOTED {}", True)]


@query(f"SELECT event_id, {_case('event_id', [str(j) for *_, j in _URLS])} AS is_job, {_case('user_id', [str(p) for _, p in _BADGES])} AS promoted FROM events")
def c8_f9_mixed(spark, sf_dir):
    """URLs that are postings and that aren't, and blocks with and without the badge, around ids of events and users."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    url = F.expr(_case("event_id", [f"concat('{a}', user_id, '{b}')" for a, b, _ in _URLS]))
    block = F.expr(_case("user_id", [f"replace('{t}', '{{}}', event_id)" for t, _ in _BADGES]))
    return e.select("event_id", U.is_job_url(url).alias("is_job"), X.is_promoted(block).alias("promoted"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Town ' || chr(97 + CAST(doc_id % 26 AS INT)) || ', Land' WHEN 1 THEN 'Remote ' || doc_id WHEN 2 THEN NULL ELSE 'On-site at ' || doc_id END AS place FROM documents")
def f4_following_place(spark, sf_dir):
    """Places on the first to fourth line after a company, which vary with the document."""
    d, n = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), F.col("doc_id")
    own, text = F.concat(F.lit("Acme "), n.cast("string")), lambda head: F.concat(F.lit(head), n.cast("string"))
    town = F.concat(F.lit("Town "), F.chr(F.lit(97) + n % 26), F.lit(", Land"))
    lines = F.when(n % 4 == 0, F.array(own, town, text("Remote "))).when(n % 4 == 1, F.array(own, text("Full time "), text("Remote "))).when(n % 4 == 2, F.array(own, text("a "), text("b "), town)).otherwise(F.array(text("On-site at "), town))
    return d.select("doc_id", L.following_place(lines).alias("place"))


@query("WITH e AS (SELECT event_id, ts, date_trunc('day', ts) + to_days(CAST(event_id % 5 - 2 AS INT)) AS d FROM events) SELECT event_id, CASE WHEN event_id % 3 = 2 THEN epoch_us(ts - INTERVAL 2 DAY) WHEN d <= ts THEN epoch_us(d) END AS posted_us FROM e")
def f11_future_dates(spark, sf_dir):
    """Explicit dates from two days before to two days after the reference: a later one is no date, and doesn't fall back to the relative phrase behind it."""
    e, n = spread(spark.read.parquet(f"{sf_dir}/events.parquet")), F.col("event_id")
    day = F.date_add(F.to_date("ts"), (n % 5 - 2).cast("int"))
    text = F.when(n % 3 == 0, F.concat(F.lit("Posted on "), F.date_format(day, "MMM d, yyyy"), F.lit(" 2 days ago"))).when(n % 3 == 1, F.concat(F.lit("posted "), F.date_format(day, "yyyy-MM-dd"), F.lit(", 2 days ago"))).otherwise("Posted 2 days ago")
    return e.select("event_id", F.unix_micros(posted_at(text, F.col("ts").cast("timestamp"))).alias("posted_us"))


@query(r"""WITH l AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\p{Z}]+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE l[1] END AS title FROM l""")
def f14_title_guess(spark, sf_dir):
    """The subject where there is one, else the first line of a document that isn't blank."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", L.title_guess(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "source", F.lit("  "))).otherwise("  "), F.col("text")).alias("title"))


@query("SELECT sha256(coalesce(html, '') || chr(10)) AS content, count(*) AS n FROM pages GROUP BY 1")
def a4_saved_pages(spark, sf_dir):
    """Pages saved one a file and read back."""
    folder = fresh_path(spark, "saved")
    spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.coalesce("html", F.lit("")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return A.saved_pages(spark, folder).groupBy(F.sha2("html", 256).alias("content")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id AS message_id, 'generic' AS source, CASE event_id % 3 WHEN 0 THEN 'Data ' || user_id || ' Engineer' WHEN 1 THEN 'Opening ' || user_id ELSE 'see below:' END AS title, 'https://boards.greenhouse.io/jobs/' || event_id AS job_url,
    event_id % 3 = 0 AS dated FROM events WHERE event_id % 4 <> 3""")
def e5_g7_generic_messages(spark, sf_dir):
    """Messages of no known platform with one link: the whole text is its block, and the title that of the block, else the subject, else the first line. A link that is no posting gives none."""
    e, n = spread(spark.read.parquet(f"{sf_dir}/events.parquet")), F.col("event_id")
    url = F.when(n % 4 != 3, F.concat(F.lit("https://boards.greenhouse.io/jobs/"), n.cast("string"))).otherwise(F.concat(F.lit("https://x.org/about/"), n.cast("string")))
    head = F.when(n % 3 == 0, F.concat(F.lit("Data "), F.col("user_id").cast("string"), F.lit(" Engineer<br>Posted 2 days ago"))).otherwise("see below:")
    subject = F.when(n % 3 == 1, F.concat(F.lit("Opening "), F.col("user_id").cast("string"))).otherwise(" ")
    html = F.concat(F.lit("<html><body>"), head, F.lit('<br><a href="'), url, F.lit('">Go</a></body></html>'))
    m = e.select(n.alias("message_id"), F.lit("board@example.org").alias("sender"), subject.alias("subject"), F.col("ts").cast("timestamp").alias("received_at"), F.lit(None).cast("string").alias("plain_text"), html.alias("html"))
    return parsing.candidates(m).select("message_id", "source", "title", "job_url", F.col("posted_date").isNotNull().alias("dated"))


@query("""WITH m AS (SELECT event_id, user_id, unnest([0, 1]) AS k FROM events) SELECT event_id AS message_id, CASE k WHEN 0 THEN 'Python ' || user_id || ' Developer' ELSE 'Warehouse ' || user_id || ' Clerk' END AS title, CASE k WHEN 0 THEN 'Acme Works' ELSE 'Beta Works' END AS company,
    CASE k WHEN 0 THEN 'Berlin, Germany' ELSE 'Paris, France' END AS location, 'https://boards.greenhouse.io/jobs/' || (2 * event_id + k) AS job_url FROM m""")
def e4_anchor_positions(spark, sf_dir):
    """Messages without cards whose text is cut from the place of one anchor's text to that of the next."""
    e, n, u = spread(spark.read.parquet(f"{sf_dir}/events.parquet")), F.col("event_id"), F.col("user_id").cast("string")

    def job(k: int, kind: str, role: str, company: str, place: str):
        return F.concat(F.lit('<a href="https://boards.greenhouse.io/jobs/'), (2 * n + k).cast("string"), F.lit(f'">{kind} '), u, F.lit(f" {role}</a><br>{company}<br>{place}<br>"))

    html = F.concat(F.lit("<html><body>New for you<br>"), job(0, "Python", "Developer", "Acme Works", "Berlin, Germany"), job(1, "Warehouse", "Clerk", "Beta Works", "Paris, France"), F.lit("</body></html>"))
    m = e.select(n.alias("message_id"), F.lit("board@example.org").alias("sender"), F.lit("Alert").alias("subject"), F.col("ts").cast("timestamp").alias("received_at"), F.lit(None).cast("string").alias("plain_text"), html.alias("html"))
    return parsing.candidates(m).select("message_id", "title", "company", "location", "job_url")


@query(f"WITH {CANDIDATES}, t AS (SELECT seq, lower(title) AS t FROM cand) SELECT seq, array_to_string(list_filter([{category_sql({k: rules.CATEGORIES[k] for k in ('PHP', 'Backend', 'Python')}, {'Python': 'senior'})}], lambda x: x IS NOT NULL), ',') AS cats FROM t")
def a9_rule_table(spark, sf_dir):
    """Categories whose rules are rows of a table, one category of it switched off."""
    rows = [(k, name, name != "AI", w, False) for k, name in enumerate(("PHP", "AI", "Backend", "Python")) for w in rules.CATEGORIES[name]] + [(3, "Python", True, "senior", True)]
    wanted, negative = J.rule_tables(written(spark.createDataFrame(rows, "id int, name string, enabled boolean, keyword string, negative boolean"), "rules"))
    return P.candidates(spark, sf_dir).select("seq", F.array_join(J.categories(F.col("title"), F.lit(None).cast("string"), wanted, negative), ",").alias("cats"))


_BOARD = ("board", "Greenhouse.io", 5, ["board_id"], ["gh_src"], "/embed/", ["/jobs/([0-9]+)", "board_id=([0-9]+)"], "boards.greenhouse.io", True)


@query(f"""WITH {CANDIDATES}, k AS (SELECT seq, n, n % 5 = 0 AS board, clean, job FROM cand)
    SELECT seq, CASE WHEN board THEN 'board' WHEN n % 4 = 3 THEN 'indeed' ELSE 'linkedin' END AS slug, CASE WHEN board THEN 'https://boards.greenhouse.io/acme/jobs/' || n || '?b=2' ELSE clean END AS job_url,
        CASE WHEN board THEN CAST(n AS VARCHAR) WHEN n % 4 = 3 THEN 'j' || job ELSE CAST(1000000 + CAST(job AS BIGINT) AS VARCHAR) END AS job_id FROM k""")
def u1_u5_platform_table(spark, sf_dir):
    """Platforms as rows, a fifth among them: canonical URLs and ids by the rules that are joined to each URL."""
    n = F.col("seq")
    board = F.concat(F.lit("HTTPS://x.greenhouse.io:443/embed/acme//jobs/"), n.cast("string"), F.lit("/?gh_src=1&utm_source=z&b=2"))
    c = P.candidates(spark, sf_dir).select("seq", F.when(n % 5 == 0, board).otherwise(F.col("url")).alias("url"))
    platforms = T.platform_table(spark).unionByName(spark.createDataFrame([_BOARD], T.SCHEMA))
    rows = T.with_platform(c, platforms, "seq", "url")
    rows = rows.withColumn("job_url", U.canonical_url(F.col("url"), rule=F.col("platform")))
    return rows.select("seq", "platform.slug", "job_url", U.job_id(F.col("job_url"), rule=F.col("platform")).alias("job_id"))


_KEYWORDS = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents),
    r AS (SELECT doc_id, doc_id % 50 AS category_id, w[1] AS keyword, CASE WHEN doc_id % 70 = 0 THEN 'negative' ELSE 'exact' END AS match_type FROM w WHERE len(w) >= 3
        UNION ALL SELECT doc_id, doc_id % 50, w[2] || ' ' || w[3], CASE WHEN doc_id % 35 = 0 THEN 'negative' ELSE 'word_boundary' END FROM w WHERE len(w) >= 3)"""


@query(rf"""WITH {_KEYWORDS}, d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_ ]', '|', 'g') || ' ' AS t FROM documents),
    t AS (SELECT doc_id, t, unnest(list_distinct(string_split_regex(t, '[ |]+'))) AS token FROM d),
    h AS (SELECT DISTINCT t.doc_id, r.category_id, r.match_type FROM t JOIN r ON t.token = split_part(r.keyword, ' ', 1) WHERE r.category_id % 10 <> 3
        AND (contains(t.t, ' ' || r.keyword || ' ') OR contains(t.t, ' ' || r.keyword || '|') OR contains(t.t, '|' || r.keyword || ' ') OR contains(t.t, '|' || r.keyword || '|'))),
    k AS (SELECT doc_id, category_id FROM h GROUP BY ALL HAVING count(*) FILTER (match_type = 'negative') = 0),
    g AS (SELECT doc_id, string_agg('c' || category_id, ',' ORDER BY category_id) AS cats FROM k GROUP BY 1)
    SELECT doc_id, coalesce(cats, '') AS cats FROM documents LEFT JOIN g USING (doc_id)""")
def h1_h3_rule_join(spark, sf_dir):
    """Two keywords from each document, fifty categories of which some are switched off: all documents against all of them."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    words = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("w")).where("size(w) >= 3")
    kinds = [("w[0]", 70, "exact"), ("concat(w[1], ' ', w[2])", 35, "word_boundary")]
    keywords = [words.select((F.col("doc_id") % 50).alias("category_id"), F.expr(k).alias("keyword"), F.when(F.col("doc_id") % n == 0, "negative").otherwise(kind).alias("match_type")) for k, n, kind in kinds]
    keywords = written(keywords[0].unionByName(keywords[1]).distinct(), "keywords")
    categories = keywords.select(F.col("category_id").alias("id")).distinct().select("id", F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"), (F.col("id") % 10 != 3).alias("enabled"))
    return H.classified(docs, categories, keywords, "doc_id", "text").select("doc_id", F.array_join("categories", ",").alias("cats"))


@query(f"WITH {CANDIDATES} SELECT seq, clean AS job_url, CASE WHEN n % 4 = 3 THEN 'j' || job ELSE CAST(1000000 + job AS VARCHAR) END AS job_id, true AS is_job, 0.99::DOUBLE AS score FROM cand")
def u6_sql_functions(spark, sf_dir):
    """URL functions called by name."""
    G.register(spark)
    P.candidates(spark, sf_dir).createOrReplaceTempView("u6_candidates")
    return spark.sql("SELECT seq, canonical_url(url) AS job_url, platform_job_id(canonical_url(url)) AS job_id, is_job_url(url) AS is_job, link_score(url, 'see it') AS score FROM u6_candidates")


@query(f"WITH {PROCESSED} SELECT seq, fingerprint, epoch_us(received_at) AS received_us FROM fold ORDER BY received_at DESC, seq DESC LIMIT 40 OFFSET 80")
def k1_keyset_page(spark, sf_dir):
    """The third and fourth page of twenty from published files: one by its number, the next by the place where that ended."""
    target = fresh_path(spark, "served")
    V.publish(P.stored(spark, sf_dir), target, 1, 100)
    found = V.served(spark, target, 1)
    page = written(found.page(5, 20), "page")
    last = page.agg(F.min(F.struct("received_at", "seq")).alias("p")).first()["p"]
    rows = page if last is None else page.unionByName(found.after(last["received_at"], last["seq"], 20))
    return rows.select("seq", "fingerprint", F.unix_micros("received_at").alias("received_us"))


@query(f"WITH {PROCESSED} SELECT {FOLD} FROM fold")
def h1_i4_table_rules(spark, sf_dir):
    """Postings judged by category rules that are rows of tables, among them a category that is switched off and one whose keyword is denied."""
    categories, keywords = H.category_table(spark)
    categories = categories.unionByName(spark.createDataFrame([(80, "Off", False), (81, "Denied", True)], categories.schema))
    keywords = keywords.unionByName(spark.createDataFrame([(80, "developer", "exact"), (81, "engineer", "exact"), (81, "engineer", "negative")], keywords.schema))
    return flat(P.postings(P.processed(P.candidates(spark, sf_dir), tables=(categories, keywords))))


@query(f"WITH {PROCESSED} SELECT {FOLD} FROM fold")
def i4_j3_compaction(spark, sf_dir):
    """Postings of five batches, out of order; two compactions between them, and what they took in deleted."""
    table, rows = C.PostingTable(spark, fresh_path(spark, "tiers"), 8), _accepted(written(P.processed(P.candidates(spark, sf_dir)), "processed"))
    for number in range(5):
        table.add(rows.where(F.col("seq") % 5 == (3 * number + 2) % 5), number)
        if number in (1, 3):
            table.compact(number + 1)
    table.retire()
    return flat(table.read())

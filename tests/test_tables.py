"""Rules, platforms and addresses as tables, and messages as a stream with keyed state, on small fixtures."""

import ipaddress
import random

from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.operators import addresses as N
from millrace.operators import judge as J
from millrace.operators import platforms as T
from millrace.operators import rule_join as H
from millrace.plans import postings as P
from millrace.stored import table_at
from millrace.streaming import ingest as I


def test_keywords_are_whole_words(spark):
    texts = {1: "I said AI is fine", 2: "maintain c++ code; server-side", 3: None, 4: "", 5: "Über-Café au lait", 6: "a.b server side", 7: "x++y and a.b.c", 8: "naïve c+ +"}
    words = ["ai", "AI ", "c++", "server-side", "café", "uber", "a.b", "++", "", None, "is fine", "lait", "server side"]
    rows = spark.createDataFrame(list(texts.items()), "id int, text string")
    rules = spark.createDataFrame(list(enumerate(words)), "rule_id int, keyword string")
    import re

    want = {(i, k) for i, t in texts.items() for k, w in enumerate(words) if t and w and re.search(r"\b" + re.escape(w.strip().lower()) + r"\b", t.lower())}
    assert {tuple(r) for r in H.matched(rows, rules, "id").collect()} == want and (2, 2) not in want and (7, 7) in want
    assert H.matched(rows, rules.limit(0), "id").count() == 0 and H.matched(rows.limit(0), rules, "id").count() == 0


def test_keywords_of_any_signs_agree_with_patterns(spark):
    import re

    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("ab+. -é_") for _ in range(rng.randrange(n)))
    texts, words = {i: some(30) for i in range(120)}, sorted({some(7) for _ in range(150)})
    rows, rules = spark.createDataFrame(list(texts.items()), "id int, text string"), spark.createDataFrame(list(enumerate(words)), "rule_id int, keyword string")
    want = {(i, k) for i, t in texts.items() for k, w in enumerate(words) if w.strip() and re.search(r"\b" + re.escape(w.strip()) + r"\b", t)}
    assert {tuple(r) for r in H.matched(rows, rules, "id").distinct().collect()} == want and len(want) > 300
    parts = spark.createDataFrame([("ab+.",), ("B-A ",), ("a.ab",), ("aa",)], "part string")
    held = {(i, p) for i, t in texts.items() for p in ("ab+.", "B-A ", "a.ab") if p.lower() in t}
    assert {tuple(r) for r in H.containing(rows, parts, "id", "text", "part").collect()} == held


def test_rule_tables_judge_as_expressions_do(spark):
    jobs = [(1, "AI Engineer", None), (2, "He said maintain", ""), (3, "Senior Python Developer", "php"), (4, None, None), (5, "", "Machine learning and python"), (6, "Junior php", "x")]
    categories = [(1, "PHP", True), (2, "AI", True), (3, "Python", True), (4, "Off", False), (5, "Empty", True)]
    words = [(1, "php", "exact"), (1, "junior", "negative"), (2, "ai", "word_boundary"), (2, "machine learning", "synonym"), (3, "python", "exact"), (4, "senior", "exact"), (5, "x", "negative"), (9, "python", "exact"), (1, "php", "exact")]
    rows = spark.createDataFrame(jobs, "id int, title string, about string")
    out = H.classified(rows, spark.createDataFrame(categories, "id int, name string, enabled boolean"), spark.createDataFrame(words, "category_id int, keyword string, match_type string"), "id", "title", "about")
    names = {i: n for i, n, on in categories if on}
    wanted = {n: [w for c, w, m in words if c == i and m != "negative"] for i, n in names.items()}
    wanted = {n: w for n, w in wanted.items() if w}
    no = {n: [w for c, w, m in words if c == i and m == "negative"] for i, n in names.items()}
    plain = {r.id: list(r.c) for r in rows.select("id", J.categories(F.col("title"), F.col("about"), wanted, no).alias("c")).collect()}
    got = {r.id: list(r.categories) for r in out.collect()}
    assert got == plain and got[3] == ["PHP", "Python"] and got[6] == [] and got[1] == ["AI"] and got[5] == ["AI", "Python"]


def test_candidates_are_judged_by_tables_as_by_constants(spark):
    titles = ["Senior Python Developer", None, "", "<b>AI</b> Engineer", "Said nothing", "back-end &amp; Machine Learning", "<!-- x -->", "LLM Engineer"]
    url = "https://www.linkedin.com/jobs/view/"
    rows = spark.createDataFrame([(i, t, f"{url}{1000 + i % 5}", "a@linkedin.com", "Full time $50,000 a year", "2 days ago", i) for i, t in enumerate(titles)], "seq long, title string, url string, sender string, block string, posted_text string, _fit int")
    rows = rows.withColumn("received_at", F.lit("2024-01-05").cast("timestamp"))
    shown = lambda out: sorted(map(str, out.select("seq", "title", "categories", "status", "outcome", "fingerprint", "_fit").collect()))
    assert shown(P.processed(rows, tables=H.category_table(spark))) == shown(P.processed(rows))
    empty = tuple(t.limit(0) for t in H.category_table(spark))
    assert {r.status for r in P.processed(rows, tables=empty).collect()} == {"IRRELEVANT"}


def test_platforms_by_table_and_by_constants(spark):
    urls = [
        "https://uk.linkedin.com/comm/jobs/view/12/?trk=x&position=2", "https://www.indeed.com/viewjob?jk=AB1&from=x&vjk=2", "http://x.org/?u=glassdoor.com&src=1", "https://notlinkedin.com/comm/a?src=2", "https://wellfound.com/job-listings/a-b?src=1&b=2", "", "x", None,
        "https://www.glassdoor.com/job-listing/a-JV_JO77.htm?src=a",
    ]
    rows = spark.createDataFrame([(i, u, "indeed" if i == 2 else "nowhere" if i == 3 else None) for i, u in enumerate(urls)], "id int, url string, slug string")
    table = T.platform_table(spark)
    out = T.with_platform(rows, table, "id", "url", named="slug")
    same = out.select("id", U.canonical_url(F.col("url"), F.col("slug")).alias("a"), U.canonical_url(F.col("url"), rule=F.col("platform")).alias("b"), U.job_id(F.col("url"), F.col("slug")).alias("c"), U.job_id(F.col("url"), rule=F.col("platform")).alias("d")).collect()
    assert len(same) == len(urls) and all((r.a, r.c) == (r.b, r.d) for r in same), same
    mail = spark.createDataFrame([(1, "Jobs <a@LinkedIn.com>"), (2, "x@indeed.com linkedin.com"), (3, None), (4, "abc")], "id int, sender string")
    off = table.withColumn("enabled", F.col("slug") != "linkedin")
    got = {r.id: r.slug for r in T.with_platform(mail, off, "id", "sender", enabled=True).select("id", "platform.slug").collect()}
    assert got == {1: None, 2: "indeed", 3: None, 4: None}


def test_networks_agree_with_the_library(spark):
    rng = random.Random(4)
    found = [ipaddress.ip_address(rng.getrandbits(32)) for _ in range(300)] + [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(300)]
    for n in N.INNER + N.OPEN:
        net = ipaddress.ip_network(n)
        found += [net.network_address, net.broadcast_address]
        found += [type(net.network_address)(v) for v in (int(net.network_address) - 1, int(net.broadcast_address) + 1) if 0 <= v < 1 << net.max_prefixlen]
    found = [a for a in set(found) if not getattr(a, "ipv4_mapped", None)]
    rows = spark.createDataFrame([(str(a),) for a in found] + [("nowhere",), (None,), ("::ffff:10.1.1.1",), ("::ffff:8.8.8.8",)], "address string")
    got = {r.address: r.inner for r in N.judged(rows, N.networks(spark)).collect()}
    want = {str(a): a.is_loopback or a.is_private or a.is_link_local or a.is_reserved or a.is_multicast for a in found}
    assert got == want | {"nowhere": None, None: None, "::ffff:10.1.1.1": True, "::ffff:8.8.8.8": False}
    urls = spark.createDataFrame([("http://A.org/x",), ("http://b.org",), ("http://c.org",), ("http://10.0.0.1",), ("http://8.8.8.8",), (None,)], "url string")
    hosts = spark.createDataFrame([("a.org", "8.8.8.8"), ("A.ORG", "fd00::1"), ("b.org", "8.8.4.4"), ("c.org", "none")], "host string, address string")
    reasons = {r.url: r.reason for r in N.resolved_reason(urls, hosts, N.networks(spark)).collect()}
    assert reasons == {"http://A.org/x": "internal or private address", "http://b.org": None, "http://c.org": "host has no address", "http://10.0.0.1": "internal or private address", "http://8.8.8.8": None, None: "scheme is not http or https"}


def _line(key: str, hours: float) -> str:
    return f'{{"id": "{key}", "internalDate": "{int(1_700_000_000_000 + hours * 3_600_000)}", "payload": {{"mimeType": "text/plain", "body": {{"data": "eA"}}}}}}'


def test_landing_stream_restarts_and_forgets(spark, tmp_path):
    folder, target, checkpoint = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    folder.mkdir()

    def run():
        query = I.append(I.landing_messages(spark, f"file://{folder}", 24, 1, F.lit(1)), target, checkpoint)
        query.awaitTermination()
        return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]

    def stored():
        return sorted(r.message_id for r in table_at(spark, target).collect())

    (folder / "1").write_text("\n".join([*(_line(f"a{k}", k / 100) for k in range(50)), _line("a0", 0), "{broken"]))
    run()
    (folder / "2").write_text("\n".join([_line("a1", 0.01), _line("b", 5), _line("a49", 0.49)]))
    run()
    assert stored() == sorted([f"a{k}" for k in range(50)] + ["b"])
    # Two days later the keys of the first day leave the state, and what is older than the lookback is late.
    for k in range(3):
        (folder / f"3{k}").write_text(_line(f"c{k}", 60 + k))
        state = run()
    (folder / "4").write_text("\n".join([_line("late", 1), _line("c2", 62), _line("d", 63)]))
    state = run()
    assert stored() == sorted([f"a{k}" for k in range(50)] + ["b", "c0", "c1", "c2", "d"])
    assert state and state[-1] <= 4
    rejects = I.append(I.landing_rejects(spark, f"file://{folder}", account=F.lit(1)), f"{target}-bad", f"{checkpoint}-bad")
    rejects.awaitTermination()
    assert [(r.line, r.reason) for r in table_at(spark, f"{target}-bad").collect()] == [("{broken", "no JSON object")]

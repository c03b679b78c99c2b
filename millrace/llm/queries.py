"""The subpackage's registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import archive_pages
from .centroids import clusters
from .exact_dedup import radix_classes
from .hard_negatives import hard_negatives
from .jaccard_join import jaccard_components
from .minhash_join import minhash_components
from .mixing import mix_plan
from .packing import pack
from .quality import CUT, fit_quality, held_out, with_quality
from .sentence_spans import remove_repeated_spans
from .shared import table
from .suffix_dedup import remove_repeats
from .topk import top_k
from .toxicity import fit_toxicity, with_toxicity


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_classes(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


def op5_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = with_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "flagged")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, changed)


QUERIES = {f.__name__: f for f in (op1_sentence_spans, op2_exact_dedup, op3_packing, op4_mixing, op5_archives, op6_jaccard_join, op7_quality, op8_topk, op9_suffix_dedup, op10_toxicity, op11_minhash, op12_centroids, op13_hard_negatives)}



def _component_sql(size: int, kept: str = "") -> str:
    """Components of documents whose sets of `size`-word shingles reach a Jaccard similarity of 0.8."""
    return rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
                  ELSE list_distinct(list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i:i + {size - 1}], ' '))) END AS ss FROM w),
        n AS (SELECT doc_id, CAST(len(ss) AS BIGINT) AS n FROM s),
        t AS (SELECT doc_id, unnest(ss) AS sh FROM s),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach)
        SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id{kept} FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n"""


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """K-means of whole numbers, a few common table expressions a round."""
    text = f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INT) AS c, e FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k}))"""
    for n in range(rounds + 1):
        text += f""",
        a{n} AS (SELECT vec_id, v.e, min((CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), c.c)) AS best FROM (SELECT *, row_number() OVER () AS r FROM v) v, c{n} c GROUP BY r, vec_id, v.e)"""
        if n < rounds:
            text += f""",
        s{n} AS (SELECT best[2] AS c, p, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT best, unnest(e) AS x, unnest(range(1, 65)) AS p FROM a{n}) GROUP BY 1, 2),
        m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS e FROM s{n} GROUP BY c),
        c{n + 1} AS (SELECT c{n}.c, coalesce(m{n}.e, c{n}.e) AS e FROM c{n} LEFT JOIN m{n} USING (c))"""
    return text + f"""
        SELECT vec_id, best[2] AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} c ON c.c = best[2]"""


SQL = {
    "op12_centroids": _centroid_sql(),
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op5_archives": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
        b AS (SELECT page_id, payload_bytes, x, max(page_id) OVER (PARTITION BY x) AS top,
                     list_reduce(list_transform(range(0, 8), lambda g: list_reduce(list_transform([15, 10, 5, 0], lambda s:
                         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST(g AS INT) * 5 + 1, 5) AS BIGINT) >> s) & 31) + 1 AS INT), 1)),
                         lambda a, c: a || c)), lambda a, c: a || c) AS payload_digest FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM b""",
    "op6_jaccard_join": _component_sql(5),
    "op11_minhash": _component_sql(2, ", n.doc_id = min(r.reach) AS kept"),
    "op8_topk": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        n AS (SELECT doc_id, x, CAST(len(x) // 2 AS BIGINT) AS n FROM d),
        w AS (SELECT doc_id, i, md5_number(substr(x, CAST(2 * i + 1 AS BIGINT), 400)) AS m FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM n WHERE n >= 200)),
        h AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
        g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER o <= 200 THEN 0 ELSE 1 END AS fresh FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g),
        r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY doc_id, run),
        q AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM r),
        p AS (SELECT q.doc_id, string_agg(substr(x, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT)), '' ORDER BY a) || substr(any_value(x), CAST(2 * max(b) + 1 AS BIGINT)) AS kept,
                     CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM q JOIN n USING (doc_id) GROUP BY q.doc_id)
        SELECT n.doc_id, n.n AS n_bytes, coalesce(p.n_removed, 0) AS n_removed, coalesce(p.n_spans, 0) AS n_spans, sha256(unhex(coalesce(p.kept, n.x))) AS kept_sha256
        FROM n LEFT JOIN p USING (doc_id)""",
}

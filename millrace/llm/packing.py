"""Packing into optimal length buckets.

A global histogram of sequence lengths (at most `max_tokens` + 1 rows) goes to the
driver, where dynamic programming picks the bucket boundaries that minimise padding.
Inside a bucket, sequences get a global rank: rows are sorted by bucket and order across
range partitions and stored; a row's rank is its place in its partition, shifted by the
rows of its bucket in the partitions before. So batches are filled to their token budget
across the whole bucket, however many rows a bucket holds, and no task sees a bucket
whole. All of it is DataFrame operations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Shelf, text_or_empty

MAX_TOKENS, BUCKETS, BUDGET = 4096, 16, 65_536


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total of bound x rows; lengths ascending."""
    n = len(lengths)
    if not n:
        return []
    before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        nxt, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            total = best[:j] + float(lengths[j - 1]) * (before[j] - before[:j])
            cut[j] = total.argmin()
            nxt[j] = total[cut[j]]
        cuts.append(cut)
        if nxt[n] >= best[n]:
            cuts.pop()
            break
        best = nxt
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return sorted(set(bounds))


def _by_bucket(bucket: Column, values: dict[int, int]) -> Column:
    out = F.lit(None).cast("long")
    for k, v in values.items():
        out = F.when(bucket == k, F.lit(v).cast("long")).otherwise(out)
    return out


def file_place(name: Column) -> list[Column]:
    """Where a file of Spark's writers stands among its table's: by the number of its task, which has more than five figures from 100,000 on, then by that of the task's file."""
    return [F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), F.regexp_extract(name, r"-c(\d+)", 1).try_cast("long"), name]


def stored_order() -> list[Column]:
    """The order of a table's rows as its Parquet files hold them: by file, then by row; for tables as read, before anything else."""
    return [*file_place(F.col("_metadata.file_name")), F.col("_metadata.row_index")]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 1, order: list[Column] | None = None) -> DataFrame:
    """One row per sequence: doc_id, piece, first_token, n_tokens, bucket_tokens, batch, slot.

    A token is a word. A document of more than `max_tokens` is cut into pieces of that
    length, the last one shorter, so every word is in exactly one piece; null and empty
    texts are one sequence of no tokens in the shortest bucket. `batch` counts within a
    bucket; a batch has `slot` 0, 1, ... and budget // bucket_tokens rows (one at least),
    the last of a bucket perhaps fewer. Batches are filled in the order of `order`, columns
    of `docs`; without it, in that of a hash of id, piece and text. Repeated rows are
    sequences of their own; a null id is carried through; an empty table gives an empty
    result; other columns play no part.
    """
    shelf = Shelf(docs.sparkSession, "packing")
    order = order or [F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text_or_empty(text_col))]
    whole = docs.select(F.col(id_col).alias("doc_id"), count_words(text_or_empty(text_col)).alias("words"), *[c.alias(f"o{k}") for k, c in enumerate(order)])
    by = [f"o{k}" for k in range(len(order))]
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.lit(max_tokens))))))
    first = (F.col("piece") * max_tokens).alias("first_token")
    pieces = pieces.select("doc_id", "piece", first, F.least(F.col("words") - F.col("piece") * max_tokens, F.lit(max_tokens)).cast("long").alias("n_tokens"), *by)
    pieces = shelf.put(pieces, "pieces")
    histogram = sorted((r["n_tokens"], r["n"]) for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    lengths, counts = np.array([x for x, _ in histogram], np.int64), np.array([x for _, x in histogram], np.int64)
    bounds = boundaries(lengths, counts, buckets)
    bucket = F.lit(None).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    keys = ["bucket_tokens", *by, "doc_id", "piece"]
    dealt = pieces.withColumn("bucket_tokens", bucket).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The number of a row is its partition's number and its place there; both are stored with it.
    dealt = shelf.put(dealt.select("doc_id", "piece", "first_token", "n_tokens", "bucket_tokens", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "dealt")
    shelf.drop("pieces")
    parts = dealt.groupBy("bucket_tokens", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    shift = F.sum("n").over(Window.partitionBy("bucket_tokens").orderBy("part")) - F.col("n") - F.col("first")
    parts = shelf.put(parts.select("bucket_tokens", "part", shift.alias("shift")), "parts")
    rank = F.col("row") + F.col("shift")
    fit = _by_bucket(F.col("bucket_tokens"), {b: max(1, budget // max(b, 1)) for b in bounds})
    return dealt.join(parts, ["bucket_tokens", "part"]).select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket_tokens",
        F.floor(rank / fit).alias("batch"), (rank % fit).alias("slot"),
    )


def piece_texts(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences with their words, joined by single spaces; for tables with one row per id (a null id is an id)."""
    cut = F.array_join(F.slice(F.regexp_extract_all(text_or_empty("_text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), (F.col("first_token") + 1).cast("int"), F.greatest(F.col("n_tokens"), F.lit(0)).cast("int")), " ")
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return packed.join(own, F.col("doc_id").eqNullSafe(F.col("_id"))).select(*packed.columns, cut.alias("words"))

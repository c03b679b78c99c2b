"""Mixing sources to target weights by a temperature.

With T_s tokens in source s, the weight of a source is T_s ** a, normalised. The
exponent a in [0, 1] is bisected: the largest a whose weights reach the target entropy
(a share of the largest, that of equal weights), raised as far as the repetition limit
asks. The weights are then realised under a token budget: source s is read r_s times,
whole epochs first, each in a random order of its own, then the part of one more epoch
that its budget still pays for. The stream of the mix is cut into blocks of about
`block_tokens`; every source runs evenly through all blocks, and a block's rows stand in
random order.

A document's order value in an epoch is a hash of epoch, id and text, so its block follows
from its own row and a few numbers of its source: readings are laid out without a shuffle.
The half of the epoch that it falls into is the same in all epochs; two readings of it are
half an epoch apart at least. What needs order over a whole source is only where the last,
partial epoch stops: token totals by shards of the order values, then the running total
inside the shard where the budget ends. So a source with a third of all rows is no group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import count_words
from .shared import Shelf, text_or_empty

ENTROPY, REPEATS, BLOCK_TOKENS = 0.95, 3.0, 1_000_000
_STEPS_A_JOB, _JOBS = 5, 6
#: Rows of a shard of order values, and the most shards of a source.
SHARD_ROWS, MOST_SHARDS = 400, 20_000
#: Rows of a table of sources that is broadcast (some 60 bytes each).
MOST_SENT = 100_000


def _sums(sources: DataFrame, exponents: list[float], top: float) -> list[tuple[float, float]]:
    """For each exponent: sum of (T/top)**a, and of the same times ln(T/top)."""
    share = F.col("tokens") / F.lit(top)
    row = sources.agg(*[f for k, a in enumerate(exponents) for f in (F.sum(F.pow(share, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"l{k}"))]).first()
    return [(row[f"z{k}"] or 0.0, row[f"l{k}"] or 0.0) for k in range(len(exponents))]


def _bisect(sources: DataFrame, top: float, holds_high) -> float:
    """The border in [0, 1] above which `holds_high(a, z, l)` is true; each job answers five halvings ahead."""
    lo, hi = 0.0, 1.0
    for _ in range(_JOBS):
        parts = 1 << _STEPS_A_JOB
        grid = [lo + (hi - lo) * k / parts for k in range(1, parts)]
        held = [holds_high(a, z, ell) for a, (z, ell) in zip(grid, _sums(sources, grid, top), strict=True)]
        left, right = 0, parts
        while right - left > 1:
            middle = (left + right) // 2
            left, right = (left, middle) if held[middle - 1] else (middle, right)
        lo, hi = lo + (hi - lo) * left / parts, lo + (hi - lo) * right / parts
    return hi


def temperature(sources: DataFrame, entropy: float, repeats: float, budget: int | None) -> tuple[float, float, float]:
    """(exponent, factor, all tokens of the mix): source s is read factor * tokens ** (exponent - 1) times.

    `sources` has positive `tokens`. Without a budget, the budget is the smallest at which
    no source is read less than once: the largest source once.
    """
    row = sources.agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("top"), F.min("tokens").alias("low")).first()
    n, top = row["n"], float(row["top"] or 1)
    low = float(row["low"] or 1)
    if n < 2:
        a = 1.0
    else:
        # Entropy falls as the exponent rises; at 1 the weights are the sources' own shares.
        spread = lambda a, z, ell: math.log(z) - a * ell / z
        (z, ell), = _sums(sources, [1.0], top)
        a = 1.0 if spread(1.0, z, ell) >= entropy * math.log(n) else _bisect(sources, top, lambda a, z, ell: spread(a, z, ell) < entropy * math.log(n))
        most = (lambda a, z: (low / top) ** (a - 1)) if budget is None else (lambda a, z: (low / top) ** (a - 1) * budget / (z * top))
        (z, _), = _sums(sources, [a], top)
        if most(a, z) > repeats:
            a = _bisect(sources, top, lambda a, z, ell: most(a, z) <= repeats)
    a = round(a, 9)
    (z, _), = _sums(sources, [a], top)
    factor = top ** (1 - a) if budget is None or not z else budget / (z * top) * top ** (1 - a)
    return a, factor, factor * z * top**a


def _key(c: Column) -> Column:
    """The source as a key; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))


def _value(seed: int, epoch: Column, name: Column) -> Column:
    """Order value in [0, 2**62) of a document in an epoch: the half is the document's, the rest the epoch's."""
    half = F.pmod(F.xxhash64(F.lit(seed + 2), name), F.lit(2))
    return half * (1 << 61) + F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("long"), name), 3)


def _sources(thin: DataFrame, shelf: Shelf, entropy: float, repeats: float, budget: int | None, block_tokens: int, seed: int) -> tuple[DataFrame, int]:
    """(k, tokens, reads, whole, stop) of sources, and the number of blocks; `stop` is the last order value read in the partial epoch."""
    sources = shelf.put(thin.groupBy("k").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    a, factor, total = temperature(sources.where("tokens > 0"), entropy, repeats, budget)
    reads = F.when(F.col("tokens") > 0, F.round(F.lit(factor) * F.pow(F.col("tokens").cast("double"), F.lit(a - 1)), 9)).otherwise(F.lit(1.0))
    plan = sources.withColumn("reads", reads).withColumn("whole", F.floor("reads"))
    plan = plan.withColumns({"due": (F.col("reads") - F.col("whole")) * F.col("tokens"), "shards": F.least(F.lit(MOST_SHARDS), F.ceil(F.col("docs") / SHARD_ROWS)).cast("long")})
    plan = shelf.put(plan, "plan")
    part = thin.where("n_tokens > 0").join(plan.where("due > 0").select("k", "whole", "due", "shards"), "k").withColumn("v", _value(seed, F.col("whole"), F.col("name")))
    # Order values in shards of about equal width; division is monotone, so shards follow one another in order.
    width = F.lit(float(1 << 62)) / F.col("shards")
    part = shelf.put(part.select("k", "v", "n_tokens", "due", F.floor(F.col("v") / width).alias("shard")), "part")
    totals = part.groupBy("k", "shard", "due").agg(F.sum("n_tokens").alias("here"))
    totals = totals.withColumn("before", F.sum("here").over(Window.partitionBy("k").orderBy("shard")) - F.col("here"))
    last = shelf.put(totals.where("before < due").groupBy("k").agg(F.max("shard").alias("shard"), F.max("before").alias("before")), "last")
    inside = part.join(last, ["k", "shard"]).groupBy("k", "due", "before", "v").agg(F.sum("n_tokens").alias("n"))
    inside = inside.withColumn("start", F.col("before") + F.sum("n").over(Window.partitionBy("k").orderBy("v")) - F.col("n"))
    stop = inside.where("start < due").groupBy("k").agg(F.max("v").alias("stop"))
    plan = shelf.put(plan.join(stop, "k", "left").select("k", "tokens", "reads", "whole", "stop"), "stops")
    shelf.drop("sources", "plan", "part", "last")
    return plan, max(1, math.ceil(total / block_tokens))


def _read(rows: DataFrame, plan: DataFrame, blocks: int, seed: int) -> DataFrame:
    """Rows with `k` and `name`, once for each reading, with epoch, block and place."""
    # A table of sources is broadcast if it is small, which is checked; else it is joined.
    rows = rows.join(F.broadcast(plan) if plan.count() <= MOST_SENT else plan, "k")
    whole = F.col("whole")
    again = F.coalesce(_value(seed, whole, F.col("name")) <= F.col("stop"), F.lit(False))
    rows = rows.withColumn("last", whole - 1 + again.cast("long")).where("last >= 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    at = (F.col("epoch") + _value(seed, F.col("epoch"), F.col("name")) / float(1 << 62)) / F.col("reads")
    return rows.withColumns({"block": F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("long"), "place": F.xxhash64(F.lit(seed + 1), "epoch", "name")})


def _thin(docs: DataFrame, shelf: Shelf, id_col: str, text_col: str, source_col: str) -> DataFrame:
    name = F.xxhash64(F.col(id_col).cast("string"), text_or_empty(text_col))
    return shelf.put(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _key(F.col(source_col)).alias("k"), name.alias("name"), count_words(text_or_empty(text_col)).alias("n_tokens")), "thin")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 1) -> DataFrame:
    """One row per reading of a document: doc_id, source, n_tokens, epoch, block, place (sort by it within a block).

    A token is a word. Every row is a document; rows equal in id and text stand together in
    the order and are read alike. A null source is a source, a null id an id. The partial
    epoch stops with the document that reaches the budget, or with all that are equal to it.
    Documents without words are read with their source's whole epochs and, where their
    order value says so, its partial one. With the default budget every document is read
    at least once. An empty table gives an empty result; other columns play no part.
    """
    shelf = Shelf(docs.sparkSession, "mixing")
    thin = _thin(docs, shelf, id_col, text_col, source_col)
    plan, blocks = _sources(thin, shelf, entropy, repeats, budget, block_tokens, seed)
    return _read(thin, plan, blocks, seed).select("doc_id", "source", "n_tokens", "epoch", "block", "place")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 1) -> DataFrame:
    """The mix itself: each document with all its columns, once for each reading of mix_plan, in the order of blocks and places.

    The rows are dealt out by range of (block, place) and sorted, so that a table written
    from the result holds the mix in order, file by file and row by row. What stays in the
    shared folder is the small table of sources.
    """
    shelf = Shelf(docs.sparkSession, "mix")
    plan, blocks = _sources(_thin(docs, shelf, id_col, text_col, source_col), shelf, entropy, repeats, budget, block_tokens, seed)
    shelf.keep("stops")
    name = F.xxhash64(F.col(id_col).cast("string"), text_or_empty(text_col))
    rows = docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _key(F.col(source_col)).alias("k"), name.alias("name"))
    rows = _read(rows, plan, blocks, seed).select("doc", "block", "place", "epoch").repartitionByRange("block", "place", "epoch").sortWithinPartitions("block", "place", "epoch")
    return rows.select([F.col("doc")[c].alias(c) for c in docs.columns])

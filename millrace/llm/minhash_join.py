"""MinHash near-dedup by an inverted join of signature coordinates.

A signature has COORDINATES values: under each of as many hash functions, the smallest hash
of the document's distinct word shingles. Two documents agree in a coordinate with the
probability of their Jaccard similarity, so documents that reach 0.8 agree in 102 of 128 on
average and in fewer than MATCHES = 77 with a probability of 8 in a hundred million.

1.  Documents with equal sets are one class, by a 128-bit signature of the whole set; its
    smallest id carries the signature on.
2.  A pair (coordinate, value) is a token. One count sketch over all tokens gives a global
    order, frequent tokens last. A document is posted under the first PREFIX =
    COORDINATES - MATCHES + 1 of its tokens: two that agree in MATCHES coordinates share one
    of them. Tokens that the sketch has seen once are in no second document: they take
    their place in the order and aren't posted, and a document with more than
    COORDINATES - MATCHES of them isn't posted at all.
3.  Posting lists are merged (posting_lists.py): common tokens of a pair are counted, and
    the rest of both signatures is skipped for pairs that can't reach MATCHES with it.
4.  Pairs that are left are counted over their whole signatures; those with MATCHES
    agreements or more are confirmed on their full sets.
5.  Copies of one text that have been changed too much to link with it, or with each other,
    would be compared all with all. But the star pass has measured them against a common
    hub h, and of x and y it knows the differences from h, D(x) and D(y). As
    |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, two that link must share differences, the
    more the farther they are from h. So documents with one hub are joined by what they have
    in common against it, with prefixes that follow from this bound, exactly; the posting
    lists pair only documents with different hubs.

The posting order decides only how much work is done. State that grows with the corpus
stays in tables; broadcast are the sketch's levels (2**25 bytes at most) and a Bloom filter
(2**24 bytes at most) that spares a join and decides nothing.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .posting_lists import POSTING, Rules, classes_of, hot_level, linked, repeated, texts_of
from .shared import Shelf
from .sketch import Levels, chunks, counted
from .words import blobs, mix, run_sums, sets, shared

COORDINATES, MATCHES = 128, 77
PREFIX = COORDINATES - MATCHES + 1
#: Tokens to a counter of the sketch, and powers of two: the fewest and the most counters.
LOAD, LEAST_BITS, MOST_BITS = 2, 18, 25
_RNG = np.random.Generator(np.random.PCG64(11))
_TIMES = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def signatures(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Coordinates (32 bits each) of sets that stand one after another, none of them empty."""
    begins = np.cumsum(counts) - counts
    out = np.empty((len(counts), COORDINATES), np.uint32)
    for c in range(COORDINATES):
        out[:, c] = mix(np.minimum.reduceat((h ^ _FLIP[c]) * _TIMES[c], begins)) >> np.uint64(32)
    return out


def tokens(signature: np.ndarray) -> np.ndarray:
    """A 64-bit name for each (coordinate, value)."""
    return mix(signature.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)), 3)


def _signed(docs: DataFrame, size: int, shelf: Shelf) -> DataFrame:
    """(doc_id, n, sig_a, sig_b, signature) of all documents, stored; no signature without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("signature", pa.binary())])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, h, counts in sets(batch.column("text"), size):
                full = np.flatnonzero(counts)
                own = signatures(h, counts[full]) if len(full) else np.zeros((0, COORDINATES), np.uint32)
                many = np.where(counts > 0, COORDINATES, 0)
                both = [pa.array(run_sums(mix(h, seed), counts).view(np.int64)) for seed in (101, 202)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(counts)), pa.array(counts.astype(np.int64)), *both, blobs(own.ravel(), many)], schema=schema)

    return shelf.put(docs.mapInArrow(run, "doc_id long, n long, sig_a long, sig_b long, signature binary"), "signed")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _levels(reps: DataFrame, shelf: Shelf) -> Levels:
    bits = min(max((reps.count() * COORDINATES // LOAD).bit_length(), LEAST_BITS), MOST_BITS)

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            counted(counts, tokens(_matrix(batch.column("signature"))).ravel())
        for k, blob in chunks(counts, np.uint32):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "blob"])

    parts = reps.select("signature").mapInArrow(run, "chunk int, blob binary").withColumn("source", F.spark_partition_id())
    found = Levels.of(shelf.put(parts, "sketch"), bits)
    shelf.drop("sketch")
    return found


def _posted(reps: DataFrame, levels) -> DataFrame:
    """(token, doc_id, n, pos) of the prefixes, without tokens that are surely in one document only."""

    def run(batches):
        rank = levels.value
        for batch in batches:
            ids, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            keys = np.sort(rank.key(tokens(_matrix(batch.column("signature"))), 0), axis=1)
            alone = (keys >> np.uint64(58)) == 0
            post = ~alone & (np.arange(COORDINATES) < PREFIX) & (alone.sum(axis=1) <= COORDINATES - MATCHES)[:, None]
            r, pos = np.nonzero(post)
            yield pa.RecordBatch.from_arrays([pa.array(keys[r, pos].view(np.int64)), pa.array(ids[r]), pa.array(n[r].astype(np.int32)), pa.array(pos.astype(np.int32))], ["token", "doc_id", "n", "pos"])

    return reps.select("doc_id", "n", "signature").mapInArrow(run, POSTING)


def _rules(t: Fraction) -> Rules:
    def close(a, b):
        return F.least(a, b).cast("long") * t.denominator >= F.greatest(a, b).cast("long") * t.numerator

    def between(rows: DataFrame) -> tuple:
        n = F.col("n").cast("long")
        return F.floor((n * t.numerator + t.denominator - 0.5) / t.denominator).cast("int"), F.floor((n * t.denominator + 0.5) / t.numerator).cast("int")

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs whose common posted tokens, with what can follow the last of them, can still reach MATCHES."""
        one = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.greatest(F.max("px"), F.max("py")).alias("p"))
        return one.where(F.col("c") + (COORDINATES - 1) - F.col("p") >= MATCHES).select("x", "y")

    return Rules(close, between, plausible)


def _beside(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (x, y) with columns of both documents."""
    for side in ("x", "y"):
        pairs = pairs.join(rows.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs


def _measured(pairs: DataFrame, reps: DataFrame, texts: DataFrame, size: int, t: Fraction, shelf: Shelf, label: str) -> DataFrame:
    """(x, y, nx, ny, linked, added, removed) of the pairs with MATCHES agreements: whether their full sets link, and what x has more and less than y."""

    def agreeing(batches):
        for batch in batches:
            same = (_matrix(batch.column("x_signature")) == _matrix(batch.column("y_signature"))).sum(axis=1)
            yield batch.select(["x", "y"]).filter(pa.array(same >= MATCHES))

    def gather(batches):
        for batch in batches:
            for first, h, counts in sets(batch.column("text"), size):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(counts)), blobs(h, counts)], ["doc_id", "whole"])

    def confirmed(batches):
        for batch in batches:
            rows = []
            for a, b in zip(batch.column("x_whole"), batch.column("y_whole"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                added, removed = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                linked = (len(x) - len(added)) * t.denominator >= t.numerator * (len(y) + len(added))
                rows.append((len(x), len(y), linked, added.tobytes(), removed.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["x", "y", "nx", "ny", "linked", "added", "removed"])

    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    left = shelf.put(_beside(pairs, reps, ["signature"]).mapInArrow(agreeing, "x long, y long"), f"{label}_left")
    whole = shelf.put(texts_of(texts, left, shelf, label).mapInArrow(gather, "doc_id long, whole binary"), f"{label}_sets")
    found = _beside(left, whole, ["whole"]).mapInArrow(confirmed, "x long, y long, nx int, ny int, linked boolean, added binary, removed binary")
    found = shelf.put(found, f"{label}_measured")
    shelf.drop(f"{label}_left", f"{label}_sets", f"{label}_ids", label)
    return found


def _hubs(measured: DataFrame, shelf: Shelf) -> DataFrame:
    """(doc_id, hub) of the measured documents and of those they were measured against: of a document's hubs, itself among them if it is one, the one that most were measured against."""
    weight = shelf.put(measured.groupBy(F.col("y").alias("hub")).agg(F.count(F.lit(1)).alias("weight")), "weights")
    every = measured.select(F.col("x").alias("doc_id"), F.col("y").alias("hub")).unionByName(weight.select(F.col("hub").alias("doc_id"), "hub"))
    best = every.join(weight, "hub").groupBy("doc_id").agg(F.min(F.struct((-F.col("weight")).alias("w"), "hub")).alias("best"))
    return shelf.put(best.select("doc_id", "best.hub"), "hubs")


def _by_difference(measured: DataFrame, hubs: DataFrame, joined: DataFrame, t: Fraction, shelf: Shelf) -> DataFrame:
    """Links (x, y) between documents of one hub that are in different components: at least one of them doesn't link with the hub.

    Differences are ordered with those that the hub lacks first, which few documents share.
    """
    up, down = t.denominator + t.numerator, t.denominator - t.numerator
    component = joined.withColumnRenamed("node", "doc_id")
    placed = hubs.join(component, "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
    torn = placed.groupBy("hub").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("hub")
    torn = shelf.put(torn, "torn")
    own = measured.select(F.col("x").alias("doc_id"), F.col("y").alias("hub"), "nx", "ny", "linked", "added", "removed").join(placed, ["doc_id", "hub"]).join(torn, "hub")
    own = shelf.put(own, "differences")

    def posted(batches):
        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("hub", "doc_id", "nx", "ny", "linked", "c")}
            found = [np.frombuffer(a.as_py() + r.as_py(), np.int64) for a, r in zip(batch.column("added"), batch.column("removed"), strict=True)]
            a = np.array([len(e) for e in found], np.int64)
            # The fewest common differences with any partner: one, or what follows for a document that links with the hub from a partner that doesn't.
            bound = -(-(down * c["ny"].astype(np.int64) + 1 + a * up - down * c["nx"].astype(np.int64)) // (2 * up))
            many = np.maximum(a - np.where(c["linked"], np.maximum(bound, 1), 1) + 1, 0)
            at = np.repeat(np.arange(len(a)), many)
            place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            e = np.concatenate([f[:k] for f, k in zip(found, many, strict=True)]) if len(at) else np.zeros(0, np.int64)
            columns = [c["hub"][at], e, c["doc_id"][at], c["nx"][at].astype(np.int32), a[at].astype(np.int32), place.astype(np.int32), c["linked"][at].astype(bool), c["c"][at]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["hub", "e", "doc_id", "n", "a", "pos", "linked", "c"])

    rows = shelf.put(own.mapInArrow(posted, "hub long, e long, doc_id long, n int, a int, pos int, linked boolean, c long"), "difference_lists")
    names = ("doc_id", "n", "a", "pos", "c")
    x = rows.where("not linked").select("hub", "e", *[F.col(k).alias(f"x_{k}") for k in names])
    y = rows.select("hub", "e", "linked", *[F.col(k).alias(f"y_{k}") for k in names])
    # At least so many common differences; the first of them stands early enough in both.
    least = F.greatest(F.lit(1), F.ceil(((F.col("x_a") + F.col("y_a")) * up - (F.col("x_n") + F.col("y_n")) * down) / (2 * up)))
    early = (F.col("x_pos") <= F.col("x_a") - least) & (F.col("y_pos") <= F.col("y_a") - least)
    pairs = x.join(y, ["hub", "e"]).where((F.col("x_c") != F.col("y_c")) & (F.col("linked") | (F.col("x_doc_id") < F.col("y_doc_id"))) & early)
    pairs = shelf.put(pairs.select("hub", F.col("x_doc_id").alias("x"), F.col("y_doc_id").alias("y")).distinct(), "difference_pairs")

    def settled(batches):
        for batch in batches:
            keep = []
            for a, b, p, q, n, m in zip(*(batch.column(k) for k in ("x_added", "y_added", "x_removed", "y_removed", "x_nx", "y_nx")), strict=True):
                a, b, p, q = (v.as_buffer() for v in (a, b, p, q))
                apart = (len(a) + len(b) + len(p) + len(q)) // 8 - 2 * (shared(a, b) + shared(p, q))
                keep.append(apart * up <= down * (n.as_py() + m.as_py()))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    for side in ("x", "y"):
        pairs = pairs.join(own.select("hub", F.col("doc_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("added", "removed", "nx")]), ["hub", side])
    found = shelf.put(pairs.mapInArrow(settled, "x long, y long").distinct(), "difference_links")
    shelf.drop("torn", "differences", "difference_lists", "difference_pairs")
    return found


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, threshold: float = 0.8, shelf: Shelf | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id, kept (component_id is its id).

    The parameters MATCHES and PREFIX are made for thresholds from 0.8 on; links are exact,
    as they are confirmed on full sets of 64-bit shingle hashes, and one is missed where two
    signatures agree in fewer than MATCHES coordinates by chance. Ids are integers (cast to
    long). Words are lower-cased (A-Z) and split at white space; a set holds the distinct
    runs of `size` words, of a shorter text the whole sequence; texts that are null, empty
    or without words have an empty set and link with nothing. The component is the smallest
    id reachable by links, the document's own included. Rows with one id are one document
    that links where any of its texts does; rows without an id link with nothing, have
    component null and are kept. An empty table gives an empty result; other columns play
    no part.
    """
    if threshold < 0.8:
        raise ValueError("signatures are sized for thresholds of 0.8 or more")
    spark, shelf = docs.sparkSession, shelf or Shelf(docs.sparkSession, "minhash")
    t = Fraction(threshold).limit_denominator(1000)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = _signed(every, size, shelf)
    plain = signed.drop("signature")
    classes = classes_of(signed, shelf)
    # Of a class's rows with the smallest id any will do: their sets are equal, and so are their signatures.
    reps = signed.join(classes.select(F.col("rep").alias("doc_id"), "sig_a", "sig_b", "n"), ["doc_id", "sig_a", "sig_b", "n"], "left_semi").select("doc_id", "n", "signature")
    reps = shelf.put(reps, "reps")
    levels = spark.sparkContext.broadcast(_levels(reps, shelf))
    postings = shelf.put(repeated(_posted(reps, levels), hot_level(reps.count())), "postings")
    texts = every.where("doc_id is not null")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        return _measured(pairs, reps, texts, size, t, shelf, label).where("linked").select("x", "y").distinct()

    def settled(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
        measured = spark.read.schema("x long, y long, nx int, ny int, linked boolean, added binary, removed binary").parquet(shelf.path("star_measured"))
        # An id that stands with several texts has no one difference from its hub; such ids stay with the posting lists.
        several = shelf.put(reps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id"), "several_texts")
        for side in ("x", "y"):
            measured = measured.join(several.withColumnRenamed("doc_id", side), side, "left_anti")
        hubs = _hubs(measured, shelf)
        return _by_difference(measured, hubs, joined, t, shelf), hubs

    found = linked(plain, classes, postings, _rules(t), verified, shelf, settled)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, threshold: float = 0.8) -> DataFrame:
    """The documents with all their columns, one id of each component (the smallest); documents without an id stay."""
    shelf = Shelf(docs.sparkSession, "minhash")
    gone = minhash_components(docs, id_col, text_col, size, threshold, shelf).where("not kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    gone = shelf.put(gone, "gone")
    shelf.keep("gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone_id"], "left_anti")

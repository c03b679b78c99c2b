"""N-gram Jaccard self-join with prefix filters under several global token orders.

Two documents link when the Jaccard similarity of their sets of word shingles reaches
the threshold t. If all shingles are ordered in one global way, and each document takes
its first |x| - ceil(t |x|) + 1 shingles (the prefix), linked documents share a prefix
shingle; and that holds for every order. Candidates must therefore meet the filter of
each of several orders, and only what is left in the intersection is verified.

Orders. Every order puts frequent shingles last, by the level (log2) of an estimate from
one count sketch over the whole corpus, and differs in the pseudo-random order within a
level. The sketch has a counter for every LOAD shingles, 2**25 at most, which some 1.6 GB
of text reach; beyond that counters hold more shingles each, and only shingles that are
more frequent than a counter's load still go last. An estimate only decides the order, and
any order gives the same links: with more text prefixes hold more frequent shingles, and
the exact passes below have more pairs to filter.

Steps, all on Spark:
1.  Each document gives its set's size and a 128-bit signature; each task adds its sketch.
    Documents with equal sets are one class, carried on by their smallest id.
2.  Prefix shingles of class representatives under the first order are dealt out by
    shingle; those that occur once go, the rest is a small table of postings.
3.  Star pass and rest pass over the posting lists (posting_lists.py). Where a shingle
    stands in a document's prefix bounds the length of its partners, from below and above.
    Pairs are filtered by what two documents can still share behind their last common
    prefix shingle, by the second and third order, then verified.

State that grows with the corpus stays in tables. Broadcast are the sketch's levels (2**25
bytes at most) and a Bloom filter of ids (bloom.py, 2**24 bytes at most); the Bloom filter
only spares work, and ids that it lets through by mistake drop out of the joins.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .posting_lists import POSTING, Rules, classes_of, hot_level, linked, repeated, texts_of
from .shared import Shelf, free_name
from .sketch import Levels, chunks, counted
from .words import blobs, mix, run_sums, sets, shared

#: Shingles to a counter of the sketch, and powers of two: the fewest and the most counters.
LOAD, LEAST_BITS, MOST_BITS = 8, 18, 25
#: Bytes of text to a shingle, for the size of the sketch only.
SHINGLE_BYTES = 6
#: Documents after which a task sends its counters, before 16 bits can overflow.
FLUSH_DOCS = 30_000
ORDERS = 3


def _signed(docs: DataFrame, size: int, shelf: Shelf) -> tuple[DataFrame, Levels]:
    """(doc_id, n, sig_a, sig_b) of all documents, stored, and the levels."""
    shingled = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHINGLE_BYTES
    bits = min(max((shingled // LOAD).bit_length(), LEAST_BITS), MOST_BITS)

    def run(batches):
        counts, seen = np.zeros(1 << bits, np.uint16), 0
        for batch in batches:
            ids = batch.column("doc_id")
            for first, h, many in sets(batch.column("text"), size):
                counted(counts, h)
                rows = len(many)
                sums = [pa.array(run_sums(mix(h, seed), many).view(np.int64)) for seed in (101, 202)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, rows), pa.array(many.astype(np.int64)), *sums, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()), pa.array(np.zeros(rows, bool))], names)
                seen += rows
                if seen > FLUSH_DOCS:
                    yield from sketched(counts)
                    counts, seen = np.zeros(1 << bits, np.uint16), 0
        yield from sketched(counts)

    def sketched(counts):
        for k, blob in chunks(counts, np.uint32):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.array([k], pa.int32()), pa.array([blob], pa.binary()), pa.array([True])], names)

    names = ["doc_id", "n", "sig_a", "sig_b", "chunk", "blob", "sketch"]
    signed = docs.mapInArrow(run, "doc_id long, n long, sig_a long, sig_b long, chunk int, blob binary, sketch boolean")
    signed = shelf.put(signed.withColumn("source", F.spark_partition_id()), "signed", by="sketch")
    levels = Levels.of(signed.where("sketch").select("chunk", "source", "blob"), bits)
    shelf.drop("signed/sketch=true")
    return signed.where("not sketch").select("doc_id", "n", "sig_a", "sig_b"), levels


def _prefix(keys: np.ndarray, counts: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of sets, whose keys stand one after another: their keys in order, and how many each has."""
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        keys[a:b].sort()
    most = np.where(counts > 0, counts - -(-counts * t.numerator // t.denominator) + 1, 0)
    place = np.arange(len(keys)) - np.repeat(ends - counts, counts)
    return keys[place < np.repeat(most, counts)], most


def _prefixes(docs: DataFrame, size: int, t: Fraction, levels, order: int) -> DataFrame:
    """(token, doc_id, n, pos) of the prefix shingles under one order."""

    def run(batches):
        rank = levels.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, h, counts in sets(batch.column("text"), size):
                keys, most = _prefix(rank.key(h, order), counts, t)
                if len(keys):
                    place = np.arange(len(keys)) - np.repeat(np.cumsum(most) - most, most)
                    own = ids[first : first + len(most)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(own, most)), pa.array(np.repeat(counts, most).astype(np.int32)), pa.array(place.astype(np.int32))], ["token", "doc_id", "n", "pos"])

    return docs.mapInArrow(run, POSTING)


def _bound(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> int:
    """The most shingles that two documents can share, from their sorted prefixes under one order; 0 without a common one."""
    i = np.searchsorted(x, y)
    i[i == len(x)] = 0
    common = np.flatnonzero(x[i] == y) if len(x) else np.zeros(0, np.int64)
    if not len(common):
        return 0
    j = int(common[-1])
    return len(common) + min(nx - 1 - int(i[j]), ny - 1 - j)


def _overlap(nx: int, ny: int, t: Fraction) -> int:
    """The least intersection with |x & y| >= t |x | y|."""
    return -(-(nx + ny) * t.numerator // (t.numerator + t.denominator))


def _verified(pairs: DataFrame, docs: DataFrame, size: int, t: Fraction, levels, shelf: Shelf, label: str) -> DataFrame:
    """The pairs (x, y) that link: prefix filters of the other orders, intersected, then the whole sets."""
    def gather(batches):
        rank = levels.value
        for batch in batches:
            ids = batch.column("doc_id")
            for first, h, counts in sets(batch.column("text"), size):
                full = np.flatnonzero(counts)
                if len(full):
                    cut = [_prefix(rank.key(h, k), counts, t) for k in range(1, ORDERS)]
                    columns = [blobs(keys, most[full]) for keys, most in cut]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(first + full)), pa.array(counts[full].astype(np.int32)), *columns, blobs(h, counts[full])], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), *((f"p{k}", pa.binary()) for k in range(1, ORDERS)), ("whole", pa.binary())])
    gathered = shelf.put(texts_of(docs, pairs, shelf, label).mapInArrow(gather, f"doc_id long, n int, {', '.join(f'p{k} binary' for k in range(1, ORDERS))}, whole binary"), f"{label}_sets")

    def side(s: str, *cols: str) -> DataFrame:
        return gathered.select(F.col("doc_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cols])

    def filtered(batches):
        for batch in batches:
            c = {k: batch.column(k) for k in batch.schema.names}
            keep = []
            for r in range(batch.num_rows):
                nx, ny = c["x_n"][r].as_py(), c["y_n"][r].as_py()
                least = _overlap(nx, ny, t)
                keep.append(all(_bound(np.frombuffer(c[f"x_p{k}"][r].as_buffer(), np.uint64), nx, np.frombuffer(c[f"y_p{k}"][r].as_buffer(), np.uint64), ny) >= least for k in range(1, ORDERS)))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    def checked(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("x_whole"), batch.column("y_whole"), strict=True):
                a, b = a.as_buffer(), b.as_buffer()
                both = shared(a, b)
                keep.append(both * t.denominator >= t.numerator * (len(a) // 8 + len(b) // 8 - both))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    cols = ["n", *(f"p{k}" for k in range(1, ORDERS))]
    left = shelf.put(pairs.join(side("x", *cols), "x").join(side("y", *cols), "y").mapInArrow(filtered, "x long, y long").distinct(), f"{label}_left")
    found = left.join(side("x", "whole"), "x").join(side("y", "whole"), "y").mapInArrow(checked, "x long, y long").distinct()
    found = shelf.put(found, f"{label}_links")
    shelf.drop(f"{label}_sets", f"{label}_left", f"{label}_ids", label)
    return found


def _plausible(pairs: DataFrame, t: Fraction) -> DataFrame:
    """Position filters on rows (x, nx, px, y, ny, py), one for each common prefix shingle of a pair."""
    # The first common shingle of a linked pair stands early enough in both that the rest can still hold the overlap.
    least = (F.col("nx") + F.col("ny")) * t.numerator
    early = [(F.col(n) - F.col(p)) * (t.numerator + t.denominator) >= least for n, p in (("nx", "px"), ("ny", "py"))]
    one = pairs.where(early[0] & early[1]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.max("px").alias("px"), F.max("py").alias("py"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
    most = F.col("c") + F.least(F.col("nx") - 1 - F.col("px"), F.col("ny") - 1 - F.col("py"))
    return one.where(most * (t.numerator + t.denominator) >= least).select("x", "y")


def _close_lengths(a, b, t: Fraction):
    return F.least(a, b).cast("long") * t.denominator >= F.greatest(a, b).cast("long") * t.numerator


def _between(rows: DataFrame, t: Fraction) -> tuple:
    """The least and the greatest length that a partner of a posting's document can have, if this is their first common prefix shingle."""
    def over(a, b: int):
        return F.floor((a + 0.5) / b)  # whole numbers divided without rounding up

    n, left = F.col("n").cast("long"), (F.col("n") - F.col("pos")).cast("long")
    return over(n * t.numerator + (t.denominator - 1), t.denominator).cast("int"), (over(left * (t.numerator + t.denominator), t.numerator) - n).cast("int")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, shelf: Shelf | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id.

    Ids are integers (cast to long; what can't be cast counts as null or raises, as the
    session's cast rules say). Words are lower-cased (A-Z) and split at white space; a set
    holds the distinct runs of `size` words, of a shorter text the whole sequence; texts
    that are null, empty or without words have an empty set and link with nothing. The
    component is the smallest id reachable by links. Rows with one id are one document that
    links where any of its texts does, all in one component; rows without an id link with
    nothing and have component null. An empty table gives an empty result; other columns
    play no part.
    """
    spark, shelf = docs.sparkSession, shelf or Shelf(docs.sparkSession, "jaccard")
    t = Fraction(threshold).limit_denominator(1000)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = every.where("doc_id is not null")
    plain, found = _signed(every, size, shelf)
    levels = spark.sparkContext.broadcast(found)
    classes = classes_of(plain, shelf)
    postings = repeated(_prefixes(texts, size, t, levels, 0), hot_level(plain.count()))
    # Copies of a class leave here, exactly; the table is small by now.
    postings = postings.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    postings = shelf.put(postings.select("token", "doc_id", "n", "pos"), "postings")
    rules = Rules(lambda a, b: _close_lengths(a, b, t), lambda rows: _between(rows, t), lambda pairs: _plausible(pairs, t))
    return linked(plain, classes, postings, rules, lambda pairs, label: _verified(pairs, texts, size, t, levels, shelf, label), shelf)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents with all their columns, one id of each component (the smallest); documents without an id stay.

    What stays in the shared folder are the ids of the documents that go.
    """
    shelf = Shelf(docs.sparkSession, "near")
    found = jaccard_components(docs, id_col, text_col, size, threshold, shelf)
    name = free_name("_gone", docs.columns)
    gone = shelf.put(found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    shelf.keep("gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")

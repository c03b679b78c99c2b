"""Exact substring deduplication on bytes by suffix arrays.

Every byte goes that is covered by a 200-byte string which also starts anywhere else.
What could repeat is found first, then sorted:

1.  Anchors. A rolling hash is taken of every GRAM bytes; each 200-byte window is owned
    by an anchor, the smallest hash in it. Equal windows have anchors of equal hash.
    A hash that occurs once, over all texts, owns no repeated window.
2.  Segments. Texts with repeated anchors give, for each, the bytes of the windows that it
    owns. Equal segments are one, with a count (partial counts before the shuffle): a
    passage or copy that a third of the documents hold is one segment for the sorting.
3.  Splitting. An anchor with more than GROUP different segments is split by the bytes next
    to it: windows in which the anchor stands at offsets a..b-1 all hold the a bytes
    before it and the 201-b bytes from it on, so those bytes are the key of a group of its
    own. Offsets are cut in WAYS parts a time, until every group is small or all its
    windows are equal; a window goes to one group and no group is left out.
4.  Suffix arrays. A task sorts the groups dealt to it, SORT_BYTES at a time: suffixes
    smaller than their successor directly, the rest induced by bucket scans, then common
    prefixes of neighbours (suffixes.py). Neighbours with 200 bytes in common are repeated
    windows. A segment alone in its group has nothing to be sorted against: if it stands in
    several places, all its windows repeat.
5.  The windows found return to their texts by a join, and texts are cut and hashed.

Texts are named by 95 bits of two hashes; documents with one text share its work.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_of
from .shared import Shelf, text_or_empty
from .suffixes import DEPTH, repeated_windows
from .words import buffers, slices

GRAM = 40
REACH = DEPTH - GRAM + 1
#: Different segments that are sorted as one group, and parts that the offsets of a larger group are cut into.
GROUP, WAYS = 1000, 4
SORT_BYTES, SLICE = 1 << 20, 1 << 18
_RNG = np.random.Generator(np.random.PCG64(77))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = int(_RNG.integers(1, 1 << 60, dtype=np.uint64)) * 8 + 5
_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, base, np.uint64))])[:n]


_tables: dict[str, np.ndarray] = {}


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, for all positions with so many."""
    n = len(data)
    if len(_tables.get("up", ())) < n:
        _tables["up"], _tables["down"] = _powers(_P, n + n // 4), _powers(_INVERSE, n + n // 4)
    h = _BYTE[data]
    h *= _tables["up"][:n]
    np.cumsum(h, out=h)
    out = h[GRAM - 1 :].copy()
    out[1:] -= h[: n - GRAM]
    out *= _tables["down"][: n - GRAM + 1]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _sliding_least(h: np.ndarray) -> np.ndarray:
    """Least value of each REACH neighbouring values."""
    span = 1
    while span < REACH:
        step = min(span, REACH - span)
        h, span = np.minimum(h[:-step], h[step:]), span + step
    return h


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, hash, first window, last window, weight) of the anchors of texts that lie one after another in `data`.

    An anchor owns neighbouring windows with one least hash, REACH of them at most; all
    anchors together own each window once. Its weight is 2 if its hash also stands where
    one of its windows starts that isn't the last (as in periodic text): only then can two
    of its own windows be equal, as equal windows hold it at equal offsets. Else it is 1.
    """
    able = np.flatnonzero(ends - begins >= DEPTH)
    if not len(able):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, none
    h = gram_hashes(data)
    least = _sliding_least(h)
    n = len(least)
    fresh = np.append(True, least[1:] != least[:-1])
    fresh[begins[able]] = True
    # Windows across the end of a text are none.
    inside = np.zeros(n + 1, np.int32)
    inside[begins[able]] += 1
    np.add.at(inside, ends[able] - DEPTH + 1, -1)
    cut = np.flatnonzero(fresh & (np.cumsum(inside[:-1]) > 0))
    text = able[np.searchsorted(begins[able], cut, "right") - 1]
    many = np.minimum(np.append(cut[1:], n), ends[text] - DEPTH + 1) - cut
    if many.max() > REACH:
        pieces = -(-many // REACH)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        text, cut, many = np.repeat(text, pieces), np.repeat(cut, pieces) + step * REACH, np.minimum(np.repeat(many, pieces) - step * REACH, REACH)
    here = np.concatenate([[0], np.cumsum(h[:n] == least, dtype=np.int32)])
    weight = 1 + (here[cut + many - 1] > here[cut])
    return text, least[cut], cut - begins[text], cut + many - 1 - begins[text], weight


def _anchor_rows(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2"))
            everything, offsets = buffers(batch.column("text"))
            for first, last in slices(offsets, SLICE):
                part = offsets[first : last + 1] - offsets[first]
                text, h, lo, hi, weight = anchors(everything[offsets[first] : offsets[last]], part[:-1], part[1:])
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h.view(np.int64), weight.astype(np.int32), t1[first + text], t2[first + text], lo.astype(np.int32), hi.astype(np.int32))], ["h", "weight", "t1", "t2", "lo", "hi"])

    return texts.mapInArrow(run, "h long, weight int, t1 long, t2 int, lo int, hi int")


def _segments(rows: DataFrame) -> DataFrame:
    """A row for each repeated anchor of the texts; `key` names the group, the anchor stands at offsets from `oa` to below `ob` of its windows."""
    data = F.col("text").cast("binary")
    one = F.transform("found", lambda a: F.struct(a["h"].alias("h"), F.substring(data, a["lo"] + 1, a["hi"] - a["lo"] + DEPTH).alias("seg"), a["lo"].alias("lo")))
    rows = rows.select("t1", "t2", F.explode(one).alias("a")).select(F.col("a.h").alias("key"), "a.h", F.lit(0).alias("oa"), F.lit(REACH).alias("ob"), "a.seg", "t1", "t2", "a.lo")
    return rows.withColumns(_named())


def _named() -> dict[str, Column]:
    """A 128-bit name for the bytes of a segment; groups hold each segment's bytes once, so it only carries results back."""
    return {"s1": F.xxhash64("seg"), "s2": F.xxhash64(F.lit(7), "seg")}


def _split(rows: DataFrame) -> DataFrame:
    """The segments of groups that are too large, cut by where the anchor stands in their windows."""

    def run(batches):
        for batch in batches:
            out = []
            for key, h, oa, ob, seg, t1, t2, lo in zip(*(batch.column(c).to_pylist() for c in ("key", "h", "oa", "ob", "seg", "t1", "t2", "lo")), strict=True):
                hits = np.flatnonzero(gram_hashes(np.frombuffer(seg, np.uint8)).view(np.int64) == h)
                width, most = -(-(ob - oa) // WAYS), len(seg) - DEPTH
                before = -1
                for p in hits.tolist():
                    # The windows from before+1 to p hold the anchor at p first.
                    for a in range(oa, ob, width):
                        b = min(a + width, ob)
                        s, e = max(before + 1, p - b + 1), min(p - a, most)
                        if s <= e:
                            shared = seg[p - a : p + 1 + DEPTH - b]
                            out.append((xxhash.xxh3_64_intdigest(b"%d %d " % (key, a) + shared) - (1 << 63), h, a, b, seg[s : e + DEPTH], t1, t2, lo + s))
                    before = p
                if len(out) > 20_000:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    def pack(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    i, j = pa.int64(), pa.int32()
    schema = pa.schema([("key", i), ("h", i), ("oa", j), ("ob", j), ("seg", pa.binary()), ("t1", i), ("t2", j), ("lo", j)])
    return rows.select(schema.names).mapInArrow(run, "key long, h long, oa int, ob int, seg binary, t1 long, t2 int, lo int").withColumns(_named())


def _sorted_windows(distinct: DataFrame) -> DataFrame:
    """(key, s1, s2, a, b): runs a..b of repeated windows of different segments; the rows of a group are sorted together."""

    def judged(rows: pa.RecordBatch):
        key, s1, s2, many = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "s1", "s2", "many"))
        edge = np.append(key[1:] != key[:-1], True)
        alone = edge & np.append(True, edge[:-1]) & (many > 1)
        text, offsets = buffers(rows.column("seg"))
        lengths = np.diff(offsets)
        at = np.flatnonzero(alone)
        yield from found(key[at], s1[at], s2[at], np.zeros(len(at), np.int64), lengths[at] - DEPTH)
        rest = np.flatnonzero(~alone)
        # Whole groups, SORT_BYTES of them at a time.
        ends = np.flatnonzero(edge[rest]) + 1
        total, first = np.concatenate([[0], np.cumsum(lengths[rest])]), 0
        while first < len(rest):
            fit = ends[ends > first]
            last = int(fit[max(int(np.searchsorted(total[fit], total[first] + SORT_BYTES, "right")) - 1, 0)])
            yield from compared(rows, rest[first:last], lengths, many, key, s1, s2)
            first = last

    def compared(rows, rest, lengths, many, key, s1, s2):
        text, offsets = buffers(rows.column("seg").take(pa.array(rest)))
        text, lengths = text[offsets[0] : offsets[-1]], lengths[rest]
        begins = np.cumsum(lengths) - lengths
        hit = repeated_windows(text, lengths)
        twice = many[rest] > 1
        cover = np.zeros(len(text) + 1, np.int32)
        np.add.at(cover, begins[twice], 1)
        np.add.at(cover, begins[twice] + lengths[twice] - DEPTH + 1, -1)
        place = np.flatnonzero(hit | (np.cumsum(cover[:-1]) > 0))
        if len(place):
            owner = np.searchsorted(begins, place, "right") - 1
            new = np.append(True, (np.diff(place) > 1) | (np.diff(owner) > 0))
            first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(place)) - 1
            which = rest[owner[first]]
            yield from found(key[which], s1[which], s2[which], place[first] - begins[owner[first]], place[last] - begins[owner[first]])

    def found(key, s1, s2, a, b):
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(s1), pa.array(s2), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["key", "s1", "s2", "a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("seg").nbytes
            if size > SORT_BYTES:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                # All but the last group are whole.
                keys = rows.column("key").to_numpy(zero_copy_only=False)
                cut = int(np.searchsorted(keys, keys[-1], "left"))
                if cut:
                    yield from judged(rows.slice(0, cut))
                held, size = [rows.slice(cut)], rows.slice(cut).column("seg").nbytes
        if held:
            yield from judged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    dealt = distinct.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "s1", "s2", "seg", "many").mapInArrow(run, "key long, s1 long, s2 long, a int, b int")


def _windows(segments: DataFrame, shelf: Shelf) -> list[DataFrame]:
    """Tables (t1, t2, a, b): the repeated windows a..b of texts."""
    out, level = [], 0
    while True:
        distinct = shelf.put(segments.groupBy("key", "seg", "s1", "s2").agg(F.count(F.lit(1)).alias("many")), f"distinct{level}")
        large = shelf.put(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > GROUP).select("key"), f"large{level}")
        more = not large.isEmpty()
        windows = _sorted_windows(distinct.join(large, "key", "left_anti") if more else distinct)
        places = segments.select("key", "s1", "s2", "t1", "t2", "lo").join(windows, ["key", "s1", "s2"])
        out.append(shelf.put(places.select("t1", "t2", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b")), f"places{level}"))
        shelf.drop(f"distinct{level}")
        if not more:
            shelf.drop("segments", *[f"segments{k}" for k in range(level + 1)])
            return out
        level += 1
        segments = shelf.put(_split(segments.join(large, "key")), f"segments{level}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; null where none was removed).

    Null text counts as empty. Texts shorter than 200 bytes keep all. Rows are judged by
    their text, so repeated rows and null ids need no rule; two rows with one text of 200
    bytes or more lose it all. An empty table gives an empty result; other columns play no part.
    """
    shelf = Shelf(docs.sparkSession, "suffixes")
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.shiftright(F.xxhash64(F.lit(7), "text"), 33).cast("int"), "n": F.octet_length("text")})

    found = shelf.put(_anchor_rows(rows.select("t1", "t2", "text")), "found")
    repeated = found.groupBy("h").agg(F.sum("weight").alias("w")).where("w > 1").drop("w")
    # Stored, so that the join deals out both sides anew and can split a hash that many texts share.
    repeated = shelf.put(repeated, "repeated")
    # collect_set over one text: at most its own anchors, and copies of the text add nothing.
    wanted = found.join(repeated, "h").groupBy("t1", "t2").agg(F.collect_set(F.struct("h", "lo", "hi")).alias("found"))
    wanted = shelf.put(wanted, "wanted")
    shelf.drop("found", "repeated")

    def passing(ids: DataFrame):
        sent = sc.broadcast(bloom_of(ids))

        @F.arrow_udf("boolean")
        def may(t1: pa.Array) -> pa.Array:
            return pa.array(sent.value.has(t1.to_numpy(zero_copy_only=False)))

        return may

    may = passing(wanted.select("t1"))
    segments = _segments(rows.select("t1", "t2", "text").where(F.col("n") >= DEPTH).where(may("t1")).join(wanted, ["t1", "t2"]))
    segments = shelf.put(segments, "segments")
    shelf.drop("wanted")
    parts = _windows(segments, shelf)
    cuts = shelf.put(reduce(DataFrame.unionByName, parts).groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("cuts")), "cuts")
    shelf.drop(*[f"places{k}" for k in range(len(parts))])

    @F.arrow_udf("struct<n_removed: long, n_spans: long, kept: binary, kept_sha256: string>")
    def cut(text: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for value, spans in zip(text, cuts, strict=True):
            if not spans.is_valid:
                out.append((0, 0, None, None))
                continue
            data, kept, at, removed, many = value.as_buffer().to_pybytes(), [], 0, 0, 0
            for a, b in sorted((s["a"], s["b"] + DEPTH) for s in spans.as_py()):
                if a > at or not many:
                    kept.append(data[at:a])
                    removed, many = removed + b - a, many + 1
                    at = b
                elif b > at:
                    removed, at = removed + b - at, b
            kept = b"".join([*kept, data[at:]])
            out.append((removed, many, kept, hashlib.sha256(kept).hexdigest()))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), (), ()), types, strict=True)], ["n_removed", "n_spans", "kept", "kept_sha256"])

    may_lose = passing(cuts.select("t1"))
    out = rows.withColumn("sha", F.sha2("text", 256)).withColumn("text", F.when((F.col("n") >= DEPTH) & may_lose("t1"), F.col("text")))
    out = out.join(cuts, ["t1", "t2"], "left").withColumn("cut", cut("text", "cuts"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_bytes"), "cut.n_removed", "cut.n_spans", F.coalesce("cut.kept_sha256", "sha").alias("kept_sha256"), "cut.kept")

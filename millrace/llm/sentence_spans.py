"""Substring deduplication by sliding sentence spans.

A text is cut into sentences, and every run of several consecutive sentences is hashed
(128 bits). A run starts at each sentence and ends with the first sentence that makes it
at least LEAST_SENTENCES sentences and LEAST_WORDS words, so equal passages give equal
runs wherever they stand. Runs are joined globally: a hash that occurs more than once has
a first occurrence (smallest id, then position), and the sentences that any other
occurrence covers are removed.

A sentence ends after . ! or ? (or an end mark of another script) before white space, and
at a line end. Inside a sentence there are further cuts where the words say so: after a
word whose hash is the least of itself and REACH words on either side, if these are all of
one sentence. So a cut depends on nothing but the REACH words around it, and a passage is
cut alike wherever it stands, whatever comes before it, from its first few words on; what
is lost are the words up to the first shared cut and after the last. A character of a
script without spaces (Chinese, Thai and others) counts as a word.

The hash table is an aggregate with partial minima before the shuffle; the join back from
repeated hashes to their occurrences is one that adaptive execution splits, so a passage
that a third of all documents share is not one task's work. Texts are shuffled once, to
their document's list of runs. A document is named by its id and 95 bits of a hash of its
text, so that rows with one id, or without any, are told apart by their texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shelf, text_or_empty
from .words import buffers, mix, slices

LEAST_SENTENCES, LEAST_WORDS, REACH, SLICE = 2, 13, 4, 1 << 17
_SPACE, _END, _SINGLE, _MARK = 1, 2, 4, 8
_RNG = np.random.Generator(np.random.PCG64(31))
#: Bases of the polynomial hashes of words and, twice, of runs.
_BASES = [int(x) * 8 + 5 for x in _RNG.integers(1, 1 << 60, 3, dtype=np.uint64)]
_FACTOR = np.uint64(int(_RNG.integers(1, 1 << 62, dtype=np.uint64)) * 2 + 1)


def _kinds() -> np.ndarray:
    """Bits for each character; single ones and their marks are those of scripts without spaces."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x20000):
        kinds[c] = _SPACE * chr(c).isspace()
    for c in ".!?…‼⁇⁈⁉‽。｡．！？؟۔।॥።፧፨։។៕။᠃᠉":
        kinds[ord(c)] |= _END
    for a, b in ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF)):
        for c in range(a, b + 1):
            kinds[c] |= _MARK if unicodedata.category(chr(c))[0] == "M" else _SINGLE
    for a, b in ((0x3001, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF61, 0xFF9F), (0x20000, 0x3FFFF)):
        kinds[a : b + 1] |= _SINGLE
    for c in "！，．：；？":
        kinds[ord(c)] |= _SINGLE
    return kinds


_KINDS = _kinds()


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class _Prefix:
    """Polynomial hashes of runs of values modulo 2**64, the same wherever a run stands."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values) + 1
        if len(_tables.get(base, ((),))[0]) < n:
            most = n + n // 4
            _tables[base] = tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(most, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
        up, self.down = _tables[base]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: n - 1], dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


@dataclass
class Slice:
    """Sentences of the documents first..first+len(many): `at` is the first word of each, `place` its byte in its document."""

    first: int
    doc: np.ndarray
    many: np.ndarray
    at: np.ndarray
    place: np.ndarray
    words: int
    hashes: np.ndarray
    sizes: np.ndarray


def _chars(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and the byte that each begins at; bytes that are no UTF-8 are characters of their own."""
    raw = data.tobytes()
    try:
        return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), np.flatnonzero((data & 0xC0) != 0x80)
    except UnicodeDecodeError:
        texts = [raw[a:b].decode(errors="surrogateescape") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        width[(chars >= 0xD800) & (chars < 0xE000)] = 1
        return chars, np.cumsum(width) - width


def sliced(column: pa.Array) -> Iterator[Slice]:
    everything, offsets = buffers(column)
    for first, last in slices(offsets, SLICE):
        part = offsets[first : last + 1] - offsets[first]
        chars, byte = _chars(everything[offsets[first] : offsets[last]], part)
        docs, none = last - first, np.zeros(0, np.int64)
        edge = np.searchsorted(byte, part)
        kinds = _KINDS[chars]
        inside = (kinds & _SPACE) == 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        if (kinds & _SINGLE).any():
            begin |= (kinds & _SINGLE) != 0
            begin[1:] |= inside[1:] & ((kinds[:-1] & (_SINGLE | _MARK)) != 0) & ((kinds[1:] & _MARK) == 0)
        heads = edge[:-1][edge[:-1] < len(chars)]
        begin[heads] = inside[heads]
        starts = np.flatnonzero(begin)
        n = len(starts)
        if not n:
            yield Slice(first, none, np.zeros(docs, np.int64), none, none, 0, np.zeros(0, np.uint64), part[1:] - part[:-1])
            continue
        stops = np.flatnonzero(inside & np.append(~inside[1:] | begin[1:], True))
        opens = np.append(True, (kinds[stops[:-1]] & _END) != 0)
        doc_word = np.searchsorted(starts, edge)
        opens[doc_word[:-1][doc_word[:-1] < n]] = True
        lines = np.searchsorted(starts, np.flatnonzero(chars == 10))
        opens[lines[lines < n]] = True
        hashes = _Prefix((chars.astype(np.uint64) + np.uint64(1)) * _FACTOR, _BASES[0]).of(starts, stops + 1)
        if n > 2 * REACH:
            of, least, span = np.cumsum(opens), mix(hashes, 5), 1
            here = least[REACH : n - REACH]
            while span < 2 * REACH + 1:
                step = min(span, 2 * REACH + 1 - span)
                least, span = np.minimum(least[:-step], least[step:]), span + step
            opens[REACH + 1 : n - REACH + 1] |= (here == least) & (of[: n - 2 * REACH] == of[2 * REACH :])
        at = np.flatnonzero(opens)
        doc = np.searchsorted(doc_word[1:], at, "right")
        yield Slice(first, doc, np.bincount(doc, minlength=docs), at, byte[starts[at]] - part[doc], n, hashes, part[1:] - part[:-1])


def reach(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The sentences at which a run starts, and the first sentence after each run; sentences are numbered through the slice."""
    here = np.arange(len(s.at))
    to = np.maximum(np.searchsorted(np.append(s.at, s.words), s.at + LEAST_WORDS), here + LEAST_SENTENCES)
    fits = to <= np.cumsum(s.many)[s.doc]
    return here[fits], to[fits]


def runs(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash, document, first sentence in it) of every run of a slice."""
    here, to = reach(s)
    words = np.append(s.at, s.words)
    h1, h2 = (_Prefix(mix(s.hashes, k), _BASES[k]).of(words[here], words[to]) for k in (1, 2))
    return h1, h2, s.doc[here], here - (np.cumsum(s.many) - s.many)[s.doc[here]]


def _spans(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, n1, place): place holds the run's first sentence below 32 bits and 31 more bits of the text's hash above."""

    def run(batches):
        for batch in batches:
            doc_id, n1, n2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n1", "n2"))
            for s in sliced(batch.column("text")):
                h1, h2, doc, at = runs(s)
                if len(h1):
                    doc = s.first + doc
                    yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc_id[doc]), pa.array(n1[doc]), pa.array((n2[doc].astype(np.int64) << 32) | at)], ["h1", "h2", "doc_id", "n1", "place"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, n1 long, place long")


def _cut(s: Slice, data: np.ndarray, starts: np.ndarray, found: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """What is left of the texts of a slice, and the sentences and words that go, from the first sentences of each text's repeated runs."""
    n, head = len(s.at), np.cumsum(s.many) - s.many
    here, to = reach(s)
    ends = np.zeros(n, np.int64)
    ends[here] = to
    at = np.concatenate([head[i] + f for i, f in enumerate(found)] or [head[:0]]).astype(np.int64)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, ends[at], -1)
    gone = np.cumsum(cover[:-1]) > 0
    sizes = np.diff(np.append(s.at, s.words))
    counts = np.bincount(s.doc, gone, len(s.many)).astype(np.int64)
    words = np.bincount(s.doc, sizes * gone, len(s.many)).astype(np.int64)
    # Bytes of sentences that go; each runs to the start of the next, or to the end of its text.
    first = s.place + starts[s.doc]
    last = np.append(first[1:], 0)
    close = np.cumsum(s.many)[s.many > 0] - 1
    last[close] = (starts + s.sizes)[s.many > 0]
    mask = np.zeros(len(data) + 1, np.int32)
    np.add.at(mask, first[gone] - starts[0], 1)
    np.add.at(mask, last[gone] - starts[0], -1)
    keep = np.cumsum(mask[:-1]) == 0
    kept = []
    for i, (a, size) in enumerate(zip((starts - starts[0]).tolist(), s.sizes.tolist(), strict=True)):
        text = data[a : a + size]
        kept.append((text[keep[a : a + size]] if counts[i] else text).tobytes())
    return kept, counts, words


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (what is left), n_sentences, n_removed, removed_words.

    Ids are integers (cast to long). Null text counts as empty; an empty text has no
    sentences. A document without repeated runs keeps its text as it is. Of occurrences the
    one with the smallest id comes first, then the one whose text has the smallest hash,
    then the smallest position; a null id comes after all others. Rows with one id, or
    without id, are told apart by their texts. Repeated rows (same id and text) are one
    document, and stay or lose sentences alike. An empty table gives an empty result;
    other columns play no part.
    """
    shelf = Shelf(docs.sparkSession, "spans")
    last = 2**63 - 1
    rows = docs.select(F.col(id_col).cast("long").alias("real_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumns({"n1": F.xxhash64("text"), "n2": F.shiftright(F.xxhash64(F.lit(7), "text"), 33).cast("int")})
    spans = _spans(rows.select("doc_id", "n1", "n2", "text"))
    here = F.struct("doc_id", "n1", "place")
    repeated = spans.groupBy("h1", "h2").agg(F.min(here).alias("lo"), F.count(F.lit(1)).alias("k")).where("k > 1").select("h1", "h2", "lo")
    repeated = shelf.put(repeated, "repeated")
    later = spans.join(repeated, ["h1", "h2"]).where(here > F.col("lo"))
    # collect_set over one document: at most its own runs, and repeated rows add nothing.
    at = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    later = shelf.put(later.groupBy("doc_id", "n1", F.shiftright("place", 32).cast("int").alias("n2")).agg(F.collect_set(at).alias("runs")), "later")
    shelf.drop("repeated")

    @F.arrow_udf("struct<text: binary, n_sentences: long, n_removed: long, removed_words: long>")
    def cut(text: pa.Array, found: pa.Array) -> pa.Array:
        everything, offsets = buffers(text)
        lists, ends = found.flatten().to_numpy(zero_copy_only=False), np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        columns = [], [], [], []
        for s in sliced(text):
            span = range(s.first, s.first + len(s.many))
            starts = offsets[s.first : s.first + len(s.many)]
            own = [lists[(ends[i - 1] if i else 0) : ends[i]] for i in span]
            kept, gone, words = _cut(s, everything[starts[0] : starts[-1] + s.sizes[-1]], starts, own)
            for column, values in zip(columns, (kept, s.many, gone, words), strict=True):
                column.extend(values)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), *[pa.int64()] * 3), strict=True)], ["text", "n_sentences", "n_removed", "removed_words"])

    joined = rows.join(later, ["doc_id", "n1", "n2"], "left").withColumn("out", cut("text", "runs"))
    return joined.select(F.col("real_id").alias("doc_id"), F.col("out.text").cast("string").alias("text"), "out.n_sentences", "out.n_removed", "out.removed_words")

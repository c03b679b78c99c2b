"""A suffix array by two-stage sorting, in numpy.

Suffixes smaller than their successors are sorted directly, by ranks of their next 40
bytes, again and again among those still equal; all others are induced by one scan over
the buckets of first bytes, from small to large: whatever stands in front of a suffix in
the text and has a larger byte goes to the next free place of its own bucket. Order is
exact to DEPTH bytes and left open beyond.
"""

from __future__ import annotations

import numpy as np

DEPTH = 200
#: Bytes that one rank stands for, and bits of a place in the text where key and place fit one number.
RANKED, PLACE_BITS = 40, 21


def _order(keys: np.ndarray) -> np.ndarray:
    """Stable order of keys below 2**42. Where places fit beside them, numbers are sorted instead of places, which is several times faster."""
    n = len(keys)
    if n > 1 << PLACE_BITS:
        return np.argsort(keys, kind="stable")
    packed = (keys << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << PLACE_BITS) - 1)
    return packed.view(np.int64)


def _ranked(keys: np.ndarray) -> np.ndarray:
    order = _order(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
    return out


def _ahead(ranks: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros(len(ranks), np.uint64)
    if step < len(ranks):
        np.add(ranks[step:], np.uint64(1), out=out[:-step])
    return out


def _pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Keys of pairs of ranks; of more than 2**21 places, their ranks among each other come first."""
    if len(high) > 1 << PLACE_BITS:
        return (high << np.uint64(32)) | low
    return (high << np.uint64(PLACE_BITS)) | low


def ranks(text: np.ndarray) -> np.ndarray:
    """The rank of the RANKED bytes from each position on; the end of the text is smaller than any byte."""
    padded = np.concatenate([text, np.zeros(4, np.uint8)])
    key = text.astype(np.uint64)
    for k in range(1, 5):
        key <<= np.uint64(8)
        key |= padded[k : k + len(text)]
    out = _ranked(key)
    for step in (5, 10, 20):
        out = _ranked(_pairs(out, _ahead(out, step)))
    return out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    n = len(text)
    if n < 2:
        return np.zeros(n, bool)
    # A position is decided by the next change of byte, its own run's end.
    change = np.flatnonzero(text[1:] != text[:-1])
    lengths = np.diff(np.concatenate([[-1], change]))
    up = np.repeat(text[change] < text[change + 1], lengths)
    return np.append(up, np.zeros(n - len(up), bool))


def _direct(chosen: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The chosen suffixes sorted by their first DEPTH bytes."""
    order = chosen[_order(ranks[chosen])]
    key = ranks[order]
    group = np.cumsum(np.append(False, key[1:] != key[:-1])).astype(np.uint64) if len(order) else np.zeros(0, np.uint64)
    for at in range(RANKED, DEPTH, RANKED):
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(tied):
            break
        ahead = _ahead(ranks, at)[order[tied]]
        by = _order(_pairs(group[tied], ahead))
        order[tied] = order[tied][by]
        # A group is named by its first place in the order, so that names stay ordered when it splits.
        key, was = ahead[by], group[tied][by]
        whole = np.append(True, ~same)
        whole[tied] = np.append(True, (key[1:] != key[:-1]) | (was[1:] != was[:-1]))
        group = np.cumsum(whole).astype(np.uint64)
    return order


def suffix_array(text: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    direct = _direct(np.flatnonzero(smaller_than_successor(text)), ranks)
    ends = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        induced = waiting[c]
        if not induced and ends[c] == ends[c + 1]:
            continue
        front = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        induced = [front]
        while len(front):
            front = front[front > 0] - 1
            front = front[text[front] == c]
            induced.append(front)
        bucket = np.concatenate([*induced, direct[ends[c] : ends[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        before, first = before[first > c], first[first > c]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        cuts = np.append(np.flatnonzero(np.append(True, first[1:] != first[:-1])), len(first)) if len(first) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            waiting[first[a]].append(before[a:b])
    return np.concatenate(out)


def repeated_windows(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where in `text`, pieces of these lengths one after another, a DEPTH-byte string of a piece starts that also starts elsewhere."""
    begins = np.cumsum(lengths) - lengths
    whole = np.zeros(len(text) + 1, np.int32)
    able = lengths >= DEPTH
    np.add.at(whole, begins[able], 1)
    np.add.at(whole, begins[able] + lengths[able] - DEPTH + 1, -1)
    starts_here = np.cumsum(whole[:-1]) > 0
    names = ranks(text)
    order = suffix_array(text, names)
    order = order[starts_here[order]]
    # Adjacent common prefixes, RANKED bytes at a time, as far as they reach.
    alike = np.arange(max(len(order) - 1, 0))
    for k in range(0, DEPTH, RANKED):
        alike = alike[names[order[alike] + k] == names[order[alike + 1] + k]]
    hit = np.zeros(len(text), bool)
    hit[order[alike]] = hit[order[alike + 1]] = True
    return hit

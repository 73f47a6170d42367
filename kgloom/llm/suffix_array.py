"""Two-stage suffix sorting over a byte buffer, in numpy, to a fixed depth.

Only the suffixes smaller than their successors are sorted directly. All others are induced: scanning the
buckets of first bytes upwards, each suffix already in place puts the one that starts a byte before it, if that is
larger than its successor, next in its own bucket. Both kinds are in order to ``DEPTH`` bytes at least, so equal
prefixes up to there are neighbours.
"""

from __future__ import annotations

import numpy as np

DEPTH = 104


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the empty suffix is the smallest."""
    n = len(text)
    edge = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # last place of each run of equal bytes
    rises = np.append(text[edge[:-1]] < text[edge[:-1] + 1], False)
    return np.repeat(rises, np.diff(edge, prepend=-1))


def eights(text: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a big-endian number, zeros after the end (and 13 numbers more)."""
    wide = np.concatenate((text, np.zeros(DEPTH + 8, np.uint8))).astype(np.uint64)
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        wide[:-step] = (wide[:-step] << np.uint64(shift)) | wide[step:]
    return wide


def sort_directly(at: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Places in the order of their next DEPTH bytes: by eight bytes, then ties by the next eight."""
    order = at[np.argsort(wide[at], kind="stable")]
    same = np.append(False, wide[order][1:] == wide[order][:-1])
    for k in range(8, DEPTH, 8):
        tied = same.copy()
        tied[:-1] |= same[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group, places = np.cumsum(~same[where]), order[where]
        key = wide[places + k]
        by = np.lexsort((key, group))
        order[where], group, key = places[by], group[by], key[by]
        same[where[1:]] = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        same[where[0]] = False
    return order


def suffix_array(text: np.ndarray, wide: np.ndarray | None = None) -> np.ndarray:
    """All places of text in the order of their suffixes (to DEPTH bytes)."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    direct = smaller_than_next(text)
    start = sort_directly(np.flatnonzero(direct), eights(text) if wide is None else wide)
    bounds = np.searchsorted(text[start], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        induced = waiting[c]
        step = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        induced = [step]
        while len(step):  # runs of the byte c, one byte further each time
            step = step[step > 0] - 1
            step = step[text[step] == c]
            induced.append(step)
        bucket = np.concatenate((*induced, start[bounds[c] : bounds[c + 1]]))
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            for part in np.split(before, np.flatnonzero(first[1:] != first[:-1]) + 1):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, wide: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each place's suffix shares with that of the place before it in order, ``most`` at most; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for k in range(0, most, 8):
        x = wide[order[open_] + k] ^ wide[order[open_ - 1] + k]
        differ = x != 0
        some = x[differ]
        zero = np.zeros(len(some), np.int64)
        for shift in (32, 16, 8):
            high = (some >> np.uint64(64 - shift)) == 0
            zero += high * (shift // 8)
            some = np.where(high, some << np.uint64(shift), some)
        out[open_[differ]] = k + zero
        open_ = open_[~differ]
        out[open_] = k + 8
    return np.minimum(out, most)

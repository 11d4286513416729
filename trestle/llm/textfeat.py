"""Words and shingles of texts as 64-bit hashes, for whole Arrow columns at once.

A word is a run of ASCII letters, digits and bytes above 127; ASCII letters count
as lower case. A script without spaces has long words, so that near copies in it
are found by their ASCII parts alone. Hashes depend on the word's bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import text_bytes, worker_cache

_PRIME = 0x9E3779B97F4A7C15
#: bytes of text that are hashed at once; a longer text is a piece of its own
PIECE = 1 << 19


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the word (uint64 in and out)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _tables():
    cache = worker_cache()
    if "word" not in cache:
        kind = np.zeros(256, bool)
        kind[48:58] = kind[65:91] = kind[97:123] = kind[128:] = True
        value = np.arange(256, dtype=np.uint64)
        value[65:91] += 32
        cache["word"] = kind, (value + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return cache["word"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    cache = worker_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + (1 << 17))
        both = []
        for base in (_PRIME, pow(_PRIME, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                p[done : done + step] = p[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            both.append(p)
        have = both[0], both[1]
        if n <= PIECE + (1 << 17):
            cache["powers"] = have
    return have


def pieces(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``PIECE`` bytes each."""
    size = np.cumsum(ends - starts)
    i = 0
    while i < len(size):
        base = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, base + PIECE, side="right")))
        yield i, j
        i = j


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, row of each word in it (from 0) and the words' hashes, in order, piece by piece.

    A longer text than ``PIECE`` is hashed in parts that end between words, so that
    its temporaries stay small.
    """
    buf, starts, ends = text_bytes(column)
    for i, j in pieces(starts, ends):
        full = np.flatnonzero(ends[i:j] > starts[i:j])
        if not len(full):
            yield i, j, np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        s, e = starts[i:j][full], ends[i:j][full]
        if len(full) == 1 and e[0] - s[0] > 2 * PIECE:
            h = np.concatenate([_hashes(buf[lo:hi], np.zeros(1, np.int64))[1] for lo, hi in _parts(buf, int(s[0]), int(e[0]))])
            yield i, j, np.full(len(h), full[0]), h
            continue
        lo, hi = int(s[0]), int(e[-1])
        begin, h = _hashes(buf[lo:hi], s - lo)
        yield i, j, full[np.searchsorted(s - lo, begin, side="right") - 1], h


def _parts(buf: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``PIECE`` bytes that cut no word."""
    kind = _tables()[0]
    while lo < hi:
        cut = min(lo + PIECE, hi)
        while cut < hi:
            gap = np.flatnonzero(~kind[buf[cut : min(cut + PIECE, hi)]])
            if len(gap):
                cut += int(gap[0])
                break
            cut = min(cut + PIECE, hi)
        yield lo, cut
        lo = cut


def _hashes(b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash of each word in ``b``, in which texts start at ``s``."""
    kind, value = _tables()
    w = kind[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[s] = True
    before = np.concatenate([[False], w[:-1]])
    begin = np.flatnonzero(w & (~before | edge[:-1]))
    after = np.concatenate([w[1:], [False]])
    end = np.flatnonzero(w & (~after | edge[1:])) + 1
    power, inverse = _powers(len(b))
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value[b] * power[: len(b)], out=total[1:])
    return begin, mix64((total[end] - total[begin]) * inverse[begin])


def shingles(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of ``n`` words; a row with fewer words has one shingle of all its words."""
    if not len(h):
        return row, h
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    count = np.diff(np.concatenate([first, [len(row)]]))
    mult = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(n)]
    out = h * mult[0]
    for k in range(1, n):
        same = np.zeros(len(h), bool)
        same[:-k] = row[k:] == row[:-k]
        part = np.zeros(len(h), np.uint64)
        part[:-k] = h[k:] * mult[k]
        out += np.where(same, part, np.uint64(0))
    nth = np.arange(len(row)) - np.repeat(first, count)
    left = np.repeat(count, count) - nth
    keep = (left >= n) | (nth == 0)
    return row[keep], mix64(out[keep])

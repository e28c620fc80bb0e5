"""Words of texts, as columns and as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words; all else is part of a word.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text as an array; none for null and empty texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def hex_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, joined by `|` (null parts are empty): 52 bits."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_INV = np.uint64(_inverse(int(_BASE)))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words of UTF-8 bytes: their first byte's place and a 64-bit hash.

    A word's hash is a polynomial in its bytes, so one running sum over the bytes gives all.
    """
    blank = _BLANK[data]
    edge = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    out = np.empty(len(start), np.uint64)
    block, at = 1 << 20, 0
    while at < len(start):  # blocks of words keep the arrays small and inside the caches
        to = max(at + 1, int(np.searchsorted(end, start[at] + block, "right")))
        low, high = start[at], end[to - 1]
        n = int(high - low)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[data[low:high]].astype(np.uint64) + np.uint64(1)) * _powers(n), out=run[1:])
        back = np.full(n, _INV, np.uint64)
        back[0] = 1
        back = np.cumprod(back, dtype=np.uint64)
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = mix((run[e] - run[s]) * back[s] + (e - s).astype(np.uint64))
        at = to
    return start, out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one byte array with a blank after each, and where each begins."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return data, np.concatenate(([0], np.cumsum(lengths)))


def blocks(texts: list[bytes], size: int = 8 << 20):
    """Slices of a list of texts of about `size` bytes each, so that work arrays stay bounded by a text and this."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > size:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


#: Odd multipliers for the places of an n-gram.
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n word hashes."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out += hashes[k : k + count] * _PLACES[k]
    return mix(out)


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """For each UTF-8 text the sorted distinct hashes of its n-word shingles.

    A text of fewer words is one shingle of them all; one without words has none.
    """
    out: list[np.ndarray] = []
    for i, j in blocks(texts):
        data, begin = joined(texts[i:j])
        start, hashes = word_hashes(data)
        edge = np.searchsorted(start, begin)
        every = grams(hashes, n)
        for k in range(j - i):
            a, b = edge[k], edge[k + 1]
            if b - a >= n:
                one = np.sort(every[a : b - n + 1])
                out.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
            elif b > a:
                out.append(grams(hashes[a:b], b - a) + np.uint64(b - a))
            else:
                out.append(np.zeros(0, np.uint64))
    return out

"""Word shingles of whole texts as sorted sets of 64-bit hashes, with numpy.

A word is a run of bytes other than space and the five control characters 09-0D;
A-Z are lower-cased first.  A text of at least ``k`` words has its distinct
k-word shingles, a shorter one its whole word sequence as one shingle, a text
without words none.  Everything works on the UTF-8 buffer of an Arrow column, in
blocks of about ``BLOCK`` bytes, so memory stays bounded by the block or by the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_M = 0x9E3779B97F4A7C15 | 1
_INV = pow(_M, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size == BLOCK + 1:  # those of a longer text aren't kept
            _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b, o


def _block_sets(b: np.ndarray, o: np.ndarray, k: int) -> list[np.ndarray]:
    n_docs = len(o) - 1
    empty = np.zeros(0, np.uint64)
    if not len(b):
        return [empty] * n_docs
    b = _LOWER[b]
    word = _IS_WORD[b]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    inner = o[(o > 0) & (o < len(b))]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    if not len(starts):
        return [empty] * n_docs
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_M, len(b)), out=sums[1:])
    words = mix64((sums[ends] - sums[starts]) * _power(_INV, len(b))[starts])
    first = np.searchsorted(starts, o)  # of each document's words
    grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
    salt = np.uint64(_M)
    for j in range(k):
        salt = salt * np.uint64(_M)
        grams += mix64(words[j : j + len(grams)] + salt) * (salt | np.uint64(1))
    grams = mix64(grams)
    out = []
    for d in range(n_docs):
        lo, hi = first[d], first[d + 1]
        if hi - lo >= k:
            g = np.sort(grams[lo : hi - k + 1])
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        elif hi > lo:
            h = np.uint64(hi - lo)
            for w in words[lo:hi]:
                h = mix64(np.asarray([h * np.uint64(_M) + w]))[0]
            out.append(np.asarray([h], np.uint64))
        else:
            out.append(empty)
    return out


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted set of each text, in order.  Null counts as empty."""
    with np.errstate(over="ignore"):
        b, o = _buffers(texts)
        i, n = 0, len(o) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(o, o[i] + BLOCK, side="right")) - 1)
            j = min(j, n)
            yield from _block_sets(b[o[i] : o[j]], o[i : j + 1] - o[i], k)
            i = j


def fingerprint(s: np.ndarray) -> int:
    """Of a whole set, as a signed 64-bit integer.  Sets of one fingerprint are taken as one."""
    with np.errstate(over="ignore"):
        x = np.asarray([s.sum(dtype=np.uint64) * np.uint64(_M) ^ mix64(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)
        return int(mix64(x).view(np.int64)[0])

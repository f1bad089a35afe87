"""Words of a batch of texts as 64-bit hashes, computed with numpy over the whole byte buffer.

A word is a maximal run of characters other than ASCII characters that are
neither letters nor digits, U+0080-U+00BF, U+2000-U+207F and U+3000-U+303F
(``WORD`` says the same as a pattern).  Texts are lower-cased first.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x00-/:-@\[-`{-\xbf -ⁿ　-〿]+"

_BLOCK = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP + np.uint64(salt))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    is_word = np.zeros(256, bool)
    is_word[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
    is_word[128:] = True
    base, inverse = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
    powers = np.full(_BLOCK * 2, base, np.uint64)
    back = np.full(_BLOCK * 2, inverse, np.uint64)
    powers[0] = back[0] = 1
    with np.errstate(over="ignore"):
        return is_word, seeds(256, 11), np.cumprod(powers, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the offset at which each begins (and the end). Null is empty."""
    a = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


class Words(NamedTuple):
    hash: np.ndarray  # of each word
    at: np.ndarray  # index of each text's first word, and the number of words
    start: np.ndarray  # byte offset of each word in ``data``
    end: np.ndarray
    data: np.ndarray  # lower-cased bytes of all texts
    offset: np.ndarray  # of each text in ``data``

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def _word_mask(data: np.ndarray, offset: np.ndarray) -> np.ndarray:
    mask = _tables()[0][data]
    n = len(data)
    for lead, low, high, width in ((0xC2, 0x80, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3)):
        p = np.flatnonzero(data == lead)
        p = p[p + 1 < n]
        p = p[(data[p + 1] >= low) & (data[p + 1] <= high)]
        for k in range(width):
            mask[np.minimum(p + k, n - 1)] = False
    return mask


def words(texts: pa.Array) -> Words:
    data, offset = text_bytes(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    n = len(data)
    mask = _word_mask(data, offset)
    before = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, mask[:-1]
        first = offset[:-1]
        before[first[first < n]] = False
    start = np.flatnonzero(mask & ~before)
    # A word ends where the mask does, or where the next text begins.
    after = np.empty(n, bool)
    if n:
        after[-1], after[:-1] = False, mask[1:]
        last = offset[1:] - 1
        after[last[(last >= 0) & (last < n)]] = False
    end = np.flatnonzero(mask & ~after) + 1
    return Words(_hashes(data, start, end), np.searchsorted(start, offset, "left"), start, end, data, offset)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words, block by block so that memory is bounded by the block and the longest word."""
    _, byte, powers, back = _tables()
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            lo = int(start[i])
            j = max(i + 1, int(np.searchsorted(end, lo + _BLOCK, "right")))
            hi = int(end[j - 1])
            if hi - lo > len(powers):
                out[i] = _long(data[lo:hi])
                i += 1
                continue
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(byte[data[lo:hi]] * powers[: hi - lo], out=sums[1:])
            s = start[i:j] - lo
            out[i:j] = (sums[end[i:j] - lo] - sums[s]) * back[s]
            i = j
    return mix(out)


def _long(data: np.ndarray) -> np.uint64:
    """The same hash for one word longer than the tables."""
    _, byte, powers, _ = _tables()
    total, shift = 0, 1
    base = int(powers[1])
    for at in range(0, len(data), _BLOCK):
        part = data[at : at + _BLOCK]
        with np.errstate(over="ignore"):
            total = (total + int(np.sum(byte[part] * powers[: len(part)], dtype=np.uint64)) * shift) % (1 << 64)
        shift = shift * pow(base, len(part), 1 << 64) % (1 << 64)
    return np.uint64(total)


def grams(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring words, ignoring where texts end (one for each word but the last n-1)."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(seeds(n, salt) | _ONE):
            out += h[k : k + m] * c
    return mix(out)


def shingles(w: Words, n: int, salt: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word ``n``-gram hashes of each text, and where each text's begin.

    A text of 1 to n-1 words has one shingle, of all of them; a text without words has none.
    """
    count = np.diff(w.at)
    all_grams = grams(w.hash, n, salt)
    doc = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(count - n + 1, 0)) - np.maximum(count - n + 1, 0), np.maximum(count - n + 1, 0))
    value = all_grams[w.at[doc] + inside] if len(doc) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([grams(w.hash[w.at[d] : w.at[d + 1]], int(count[d]), salt)[0] for d in short], np.uint64)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, extra])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return value, np.searchsorted(doc, np.arange(len(count) + 1))

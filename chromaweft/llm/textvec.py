"""Texts as numpy arrays: code points, character n-gram buckets, word and shingle hashes.

Workers get Arrow batches; `pieces` cuts them into runs of bounded size, so memory does not depend on the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
SPACE = np.uint32(32)
_P = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes of text at most (one row may be longer)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size + 64)
    at = 0
    while at < len(size):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    release()


@lru_cache(1)
def _trim():
    """The C library's malloc_trim, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Give freed memory back: workers live on from task to task, and what one of them keeps another cannot have."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def strings(column: pa.Array) -> list[str]:
    """Null counts as empty."""
    return [x or "" for x in column.to_pylist()]


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Lower case and any white space as a blank, for the basic plane; NUL too, as it separates texts here."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        low = c.lower()
        if c.isspace() or i == 0:
            out[i] = 32
        elif len(low) == 1:
            out[i] = min(ord(low), 0xFFFF)
    return out


@lru_cache(1)
def alnum_table() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(1 << 16)])


@lru_cache(1)
def alpha_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and n + 1 bounds."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def look_up(table: np.ndarray, cp: np.ndarray, beyond) -> np.ndarray:
    """table[cp] for the basic plane, `beyond` for the rest (an array of cp's length or a value)."""
    if len(cp) and cp.max() >= 1 << 16:
        high = cp >= 1 << 16
        return np.where(high, beyond, table[np.where(high, 0, cp)])
    return table[cp]


def has_letter(texts: list[str]) -> np.ndarray:
    cp, bounds = points(texts)
    letter = look_up(alpha_table(), cp, False)
    for i in np.flatnonzero(cp >= 1 << 16):
        letter[i] = chr(cp[i]).isalpha()
    count = np.concatenate([[0], np.cumsum(letter)])
    return count[bounds[1:]] > count[bounds[:-1]]


def ngram_buckets(texts: list[str], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all character n-grams and the index of their text, in bounded chunks.

    Texts are folded and stand between blanks. Bucket 1 << bits is none (an n-gram that would leave its text).
    """
    cp, bounds = points([f"\x00 {x} " for x in texts])
    first = bounds[:-1]
    cp = look_up(fold_table(), cp, cp).astype(np.uint32)
    cp[first] = 0
    top = max(orders)
    none = np.uint32(1 << bits)
    for at in range(0, len(cp), WINDOW):
        view = cp[at : at + WINDOW + top - 1]
        n_here = min(WINDOW, len(cp) - at)
        a, b = np.searchsorted(first, [at, at + len(view)])
        cuts = first[a:b] - at
        doc = np.searchsorted(first, np.arange(at, at + n_here), side="right") - 1
        h = np.zeros(len(view), np.uint32)
        for n in range(1, top + 1):
            if len(view) < n:
                break
            h = h[: len(view) - n + 1] * np.uint32(0x01000193) + (view[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
            if n not in orders:
                continue
            x = h[:n_here] ^ (h[:n_here] >> np.uint32(15))
            x = (x + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
            x = (x ^ (x >> np.uint32(13))) * np.uint32(0x27D4EB2F)
            x >>= np.uint32(32 - bits)
            wrong = (cuts[:, None] - np.arange(n)).ravel()
            x[wrong[(wrong >= 0) & (wrong < len(x))]] = none
            yield x, doc[: len(x)]


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs (np.unique hashes, which is much slower here)."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P ** i and its inverse, modulo 2 ** 64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, WINDOW + 1024)
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[:] = out
    return _powers[0], _powers[1]


@lru_cache(4)
def _letters(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Per code point of the basic plane: a random 64-bit value of its folded form, and whether it is part of a word."""
    value = mix((np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    if kind == "alnum":  # any letters and digits, in lower case
        return value[fold_table()], alnum_table()
    # anything but blank, tab, LF, VT, FF and CR; A-Z in lower case
    low = np.arange(1 << 16)
    low[65:91] += 32
    word = np.ones(1 << 16, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return value[low], word


def words(texts: list[str], kind: str = "alnum") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the index of each word's text."""
    cp, bounds = points([x + "\n" for x in texts])
    values, is_word = _letters(kind)
    hashes, docs = [], []
    at = 0
    while at < len(cp):
        to = min(len(cp), at + WINDOW)
        while to < len(cp):  # end the window behind a separator
            back = np.flatnonzero(~look_up(is_word, cp[max(at, to - 4096) : to], True))
            if len(back):
                to = max(at, to - 4096) + int(back[-1]) + 1
                break
            to = min(len(cp), to + 4096)
        view = cp[at:to]
        inside = look_up(is_word, view, True)
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = powers(len(view) + 1)
        value = look_up(values, view, mix(view.astype(np.uint64) + np.uint64(1 << 40)) if len(view) and view.max() >= 1 << 16 else np.uint64(0))
        total = np.zeros(len(view) + 1, np.uint64)
        np.cumsum(value * power[: len(view)], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * inverse[start]))
        docs.append(np.searchsorted(bounds, start + at, side="right") - 1)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(docs)


def shingles(word: np.ndarray, doc: np.ndarray, n_docs: int, n: int = 5, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of n words in a row per text, sorted within each text, and n_docs + 1 bounds.

    short: a text of 1 to n - 1 words has one shingle of all its words; else it has none.
    """
    factor = [np.uint64(pow(0xA0761D6478BD642F, k, 1 << 64)) for k in range(n)]
    k = len(word) - n + 1
    if k > 0:
        same = doc[:k] == doc[n - 1 :]
        h = np.zeros(k, np.uint64)
        for i in range(n):
            h += word[i : i + k] * factor[i]
        h, d = mix(h[same]), doc[:k][same]
    else:
        h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if short and len(word):
        count = np.bincount(doc, minlength=n_docs)
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            first = np.searchsorted(doc, few)
            extra = [mix(np.array([sum(int(word[f + i]) * int(factor[i]) for i in range(count[t])) + int(count[t]) & _M64], np.uint64))[0] for f, t in zip(first, few)]
            h, d = np.concatenate([h, np.array(extra, np.uint64)]), np.concatenate([d, few])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(n_docs + 1))


_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 31, 512, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, 512, dtype=np.uint32)


def permuted(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th random order of 32-bit values, k < 512."""
    v = x * _A[k] + _B[k]
    return (v ^ (v >> np.uint32(16))) * np.uint32(0x7FEB352D)


def minima(h: np.ndarray, bounds: np.ndarray, ks: range) -> np.ndarray:
    """MinHash values of each text's shingles, one row per text (its row is 0 without shingles)."""
    out = np.zeros((len(ks), len(bounds) - 1), np.uint32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        x = (h >> np.uint64(32)).astype(np.uint32)
        for i, k in enumerate(ks):
            out[i, full] = np.minimum.reduceat(permuted(x, k), bounds[full])
    return out.T

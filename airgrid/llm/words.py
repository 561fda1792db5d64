"""Words of whole Arrow text columns as numpy arrays of spans and 64-bit hashes.

A column slice is looked at as one run of UTF-8 bytes.  Which bytes belong to
words is a table of 256 entries, so each operator has its own idea of a word.
Hashes are polynomials modulo 2**64 over random byte values, taken from running
sums: each byte is touched a fixed number of times, however long the words are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows that are worked on at a time.
SLICE_ROWS = 60_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def byte_table(not_word: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes outside the ranges given."""
    lut = np.ones(256, bool)
    for a, b in not_word:
        lut[a : b + 1] = False
    return lut


#: Letters and digits of ASCII and everything beyond it.
ALNUM = byte_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Everything but ASCII white space.
VISIBLE = byte_table([(0x20, 0x20), (0x09, 0x0D)])


#: ASCII letters in lower case, digits and all bytes beyond ASCII as they are; all else is a blank.
_FOLDED = bytes((b + 32 if 65 <= b <= 90 else b) if ALNUM[b] else 32 for b in range(256))


def folded_words(text: bytes) -> list[bytes]:
    """The runs of letters, digits and bytes beyond ASCII, A-Z as a-z."""
    return text.translate(_FOLDED).split()


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        one = np.full(n, _BASE, np.uint64)
        inv = np.full(n, _INV, np.uint64)
        one[0] = inv[0] = 1
        return np.cumprod(one, dtype=np.uint64), np.cumprod(inv, dtype=np.uint64)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    v = np.random.default_rng(20240115).integers(1 << 62, 1 << 63, 256, dtype=np.uint64)
    v[65:91] = v[97:123]  # A-Z as a-z
    return v


@lru_cache(maxsize=1)
def _cased_values() -> np.ndarray:
    return np.random.default_rng(20240116).integers(1 << 62, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: all bits of the result depend on all bits of ``x``."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``len(col) + 1`` offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string_view(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def row_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (or one row)."""
    _, off = column_bytes(col)
    a, n = 0, len(off) - 1
    while a < n:
        b = min(a + SLICE_ROWS, max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1))
        yield a, b
        a = b


def word_spans(data: np.ndarray, off: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and ``len(off)`` bounds: the words of row i are bounds[i]:bounds[i+1]."""
    m = lut[data]
    s, e = m.copy(), m.copy()
    if len(m):
        s[1:] &= ~m[:-1]
        e[:-1] &= ~m[1:]
        first = off[:-1][off[:-1] < off[1:]]
        last = off[1:][off[:-1] < off[1:]] - 1
        s[first] = m[first]
        e[last] = m[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the words; ``fold``: A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = SLICE_BYTES if len(data) <= SLICE_BYTES else 1 << int(len(data) - 1).bit_length()
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_byte_values() if fold else _cased_values())[data] * power[: len(data)], out=run[1:])
        return mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and their bounds by row; a row of fewer words, but not none, has one run."""
    n = np.diff(bounds)
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], count)
    end = np.repeat(bounds[1:], count)
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        for j in range(k):
            p = at + j
            ok = p < end
            total = total * np.uint64(0xD6E8FEB86659FD93) + np.where(ok, h[np.minimum(p, len(h) - 1)], np.uint64(0))
        return mix(total), out

"""Vectorised text kernels shared by the training-data operators.

Each kernel works on the UTF-8 bytes of many texts at once. Batches are cut at text boundaries into pieces of a few
megabytes, so that temporaries stay in cache and memory doesn't grow with the batch; a text is never cut.

Words are runs of ASCII letters (lower-cased), digits and the code points U+00C0-U+1FFF and U+A000-U+DFFF; each code
point of U+3000-U+9FFF, U+E000-U+FFFF and above U+FFFF is a word of its own (scripts without spaces); all else separates.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = (1 << 20) - 64
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

WORD_RE = re.compile("[0-9a-z\u00c0-\u1fff\ua000-\udfff]+|[\u3000-\u9fff\ue000-\uffff\U00010000-\U0010ffff]")
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str) -> list[str]:
    """The words of one text in plain Python: the definition that `words` must agree with."""
    return WORD_RE.findall(text.translate(_ASCII_LOWER))


def _classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    for a, b in ((48, 58), (65, 91), (97, 123), (0xC3, 0xE2), (0xEA, 0xEE)):
        c[a:b] = 1
    c[0xE3:0xEA] = 2
    c[0xEE:0xF5] = 2
    c[0x80:0xC0] = 9  # continuation: takes the class of its lead
    return c


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.lru_cache(maxsize=2)
def _power_table(bits: int, inverse: bool) -> np.ndarray:
    t = np.full(1 << bits, _BASE_INV if inverse else _BASE, U64)
    t[0] = 1
    return np.cumprod(t, dtype=U64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, or those of the inverse."""
    return _power_table(max(20, int(n).bit_length()), inverse)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of x over all of the result."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    if not large and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32, n + 1, column.offset * (8 if large else 4)).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about `limit` bytes; a longer text stands alone."""
    buf, off = utf8(column)
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to, buf[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: first byte, end byte; for each row the index of its first word (n+1 values); the running hash for `span_hash`."""
    n = len(buf)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(off), np.int64), np.zeros(1, U64)
    c = _CLASS[buf]
    cont = c == 9
    single = None
    if cont.any():
        at = np.flatnonzero(cont)
        c[at] = c[at - 1]
        for _ in range(2):
            more = at[c[at] == 9]
            if not len(more):
                break
            c[more] = c[more - 1]
            at = more
        single = c == 2
    inside = c == 1
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    rows = off[:-1][off[:-1] < n]
    start[rows] = inside[rows]
    stop = inside.copy()  # last byte of a word
    stop[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > 0] - 1
    stop[last] = inside[last]
    if single is not None and single.any():
        start |= single & ~cont
        end = single.copy()
        end[:-1] &= ~single[1:] | ~cont[1:]
        end[last] = single[last]
        stop |= end
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    running = np.empty(n + 1, U64)
    running[0] = 0
    v = _LOWER[buf].astype(U64)
    v += U64(1)
    v *= powers(n)
    np.cumsum(v, out=running[1:])
    return s, e, np.searchsorted(s, off), running


def span_hash(running: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the (ASCII-lower-cased) bytes s..e."""
    return mix((running[e] - running[s]) * powers(len(running), True)[s])


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: 64-bit hash, first byte, end byte; and for each row the index of its first word (n+1 values)."""
    s, e, first, running = spans(buf, off)
    return span_hash(running, s, e), s, e, first


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the n+1 index boundaries."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each row and their n+1 boundaries. A row of 1 to k-1 words has one, of all its words."""
    count = np.diff(first)
    many = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(count)), many)
    at = np.arange(bounds[-1]) - bounds[row] + first[row]
    padded = np.concatenate([h, np.zeros(k, U64)])
    out = np.zeros(len(at), U64)
    short = count[row] < k
    for i in range(k):
        x = padded[at + i]
        if short.any():
            x = np.where(short & (i >= count[row]), U64(0), x)
        out *= U64(0xBF58476D1CE4E5B9)
        out += x
    return mix(out), bounds

"""Token arrays straight from Arrow string buffers.

The operators of this package read whole corpora, so none of them loops over
words in Python. A batch of texts is one UTF-8 buffer; here it becomes NumPy
arrays of tokens (a 64-bit hash, and the byte range in the buffer) with the
range of tokens of each document.

Two token definitions are used, both stated in bytes so that SQL can say them:

``words``     maximal runs of bytes other than ASCII white space
              (tab, LF, VT, FF, CR, space), compared exactly;
``terms``     maximal runs of ASCII letters, ASCII digits and non-ASCII
              characters, with ASCII capitals made small.

Null texts count as empty texts; an empty text has no tokens. A text may be of
any length: it is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Documents are handled in groups of about so many bytes (a longer document is a group of its own).
CHUNK_BYTES = 1 << 20

_WS = (9, 10, 11, 12, 13, 32)
WORDS = np.arange(256, dtype=np.uint8)
WORDS[list(_WS)] = 0
TERMS = np.zeros(256, dtype=np.uint8)
TERMS[48:58] = np.arange(48, 58)
TERMS[97:123] = np.arange(97, 123)
TERMS[65:91] = np.arange(97, 123)
TERMS[128:] = np.arange(128, 256)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    t = rng.integers(0, 1 << 64, size=(64, 256), dtype=np.uint64)
    t[:, 0] = 0  # separators add nothing to a token's sum
    powers = rng.integers(0, 1 << 64, size=256, dtype=np.uint64) | np.uint64(1)
    return t.reshape(-1), powers


_TAB, POWERS = _tables()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that low and high bits are as good."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Tokens:
    """Tokens of documents ``first`` to ``first + n_docs`` of a batch."""

    first: int
    data: np.ndarray  #: translated bytes of the group, 0 where no token is
    raw: np.ndarray  #: the bytes as they were
    bounds: np.ndarray  #: byte offsets of the documents in ``data``
    start: np.ndarray  #: first byte of each token
    end: np.ndarray  #: byte after each token
    hash: np.ndarray  #: uint64 of each token
    doc: np.ndarray  #: document (from 0 in this group) of each token
    off: np.ndarray  #: token offsets of the documents

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    def token(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (int64, from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=column.offset * 8)
    lo, hi = int(off[0]), int(off[-1])
    raw = np.frombuffer(data, dtype=np.uint8, count=hi - lo, offset=lo) if hi > lo else np.zeros(0, np.uint8)
    return raw, off - lo


def groups(offsets: np.ndarray, chunk: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``chunk`` bytes each, covering all."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + chunk, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def tokenize(column: pa.Array, table: np.ndarray = WORDS, chunk: int = CHUNK_BYTES, hashes: bool = True) -> Iterator[Tokens]:
    """Tokens of a string column, in groups of documents; every document comes exactly once."""
    raw, offsets = string_buffers(column)
    for i, j in groups(offsets, chunk):
        lo, hi = int(offsets[i]), int(offsets[j])
        part = raw[lo:hi]
        bounds = offsets[i : j + 1] - lo
        data = table[part]
        inside = data != 0
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edges = bounds[(bounds > 0) & (bounds < len(part))]
        opens[edges] |= inside[edges]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        closes[edges - 1] |= inside[edges - 1]
        start = np.flatnonzero(opens)
        end = np.flatnonzero(closes) + 1
        off = np.searchsorted(start, bounds)
        doc = np.repeat(np.arange(j - i), np.diff(off))
        h = np.zeros(0, np.uint64)
        if hashes and len(start):
            spans = np.diff(np.append(start, len(part)))
            pos = np.arange(start[0], len(part), dtype=np.int32)
            pos -= np.repeat(start.astype(np.int32), spans)
            body = data[start[0] :]
            if int((end - start).max()) > 64:
                value = _TAB[((pos & 63) << 8) | body] * (((pos >> 6) << 1) | 1).astype(np.uint64)
            else:
                value = _TAB[((pos & 63) << 8) | body]
            h = mix64(np.add.reduceat(value, start - start[0]))
        yield Tokens(i, data, part, bounds, start, end, h, doc, off)


def rolling(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of ``k`` consecutive tokens at each position of one array (len - k + 1 values)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    q = POWERS[seed]
    out = h[:n].copy()
    for j in range(1, k):
        out *= q
        out += h[j : j + n]
    return mix64(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by doubling."""
    return _sliding(x, w, np.minimum)


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    return _sliding(x, w, np.maximum)


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    size, cur = 1, x
    while size * 2 <= w:
        cur = op(cur[:-size], cur[size:])
        size *= 2
    if size < w:
        cur = op(cur[: len(cur) - (w - size)], cur[w - size :])
    return cur[:n]

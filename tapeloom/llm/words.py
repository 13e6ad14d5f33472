"""Words and fingerprints of Arrow text columns, whole batches at a time.

A batch is worked on in chunks of a megabyte or less, so memory follows the
chunk (or one document, where that is longer), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
# For steps whose workers go on to others: a word's arrays take about 30 times the bytes of its chunk.
SMALL_CHUNK = 1 << 18

# Odd multipliers of the published 64-bit finaliser and a base for polynomials.
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15

_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
# From this length on a word's code is a digest: a polynomial modulo 2**64 loses bits of long words that alternate regularly.
DIGEST_BYTES = 32
# Every ASCII byte but letters and digits, for comparisons that ignore punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
# A random 64-bit value for each byte, from a fixed seed.
VALUE = np.random.Generator(np.random.PCG64(20260101)).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any of their bits can serve as a bucket."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = pow(_BASE, -1, 1 << 64)
            out = []
            for base in (_BASE, inverse):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


POWERS = _Powers()


class Chunk(NamedTuple):
    """Rows ``first .. first + len(off) - 2`` of a batch: their bytes and where each begins."""

    first: int
    buf: np.ndarray
    off: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column (null: empty) into chunks of whole rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield Chunk(i, raw[off[i]:off[j]], off[i:j + 1] - off[i])
        i = j


class Words(NamedTuple):
    """Words of a chunk in order; ``at[d] .. at[d + 1]`` are those of its d-th row."""

    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    at: np.ndarray


def words(chunk: Chunk, fold: bool = True, cut: np.ndarray | None = None, blanks: np.ndarray = _SEPARATES) -> Words:
    """Runs of bytes other than blanks and \\t..\\r with a 64-bit code each; A-Z count as a-z if ``fold``.

    Words end where a row ends, and before the bytes that ``cut`` marks; ``blanks`` names other separators. The text is hashed in segments cut at blanks, so one
    very long row needs no more than its words and one segment.
    """
    buf, off = chunk.buf, chunk.off
    n = len(buf)
    blank = blanks[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    if cut is not None:
        edge[:n] |= cut
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= blank[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    code = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK_BYTES, side="right")))
        a, b = start[i], end[j - 1]
        part = buf[a:b]
        up, down = POWERS.get(b - a + 1)
        run = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(VALUE[_FOLD[part] if fold else part] * up[:-1], out=run[1:])
        code[i:j] = (run[end[i:j] - a] - run[start[i:j] - a]) * down[start[i:j] - a]
        i = j
    code = with_digests(mix(code), buf, start, end, fold)
    return Words(start, end, code, np.searchsorted(start, off))


def with_digests(code: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """The codes, those of words of DIGEST_BYTES and more replaced by a digest of their bytes."""
    for k in np.flatnonzero(end - start >= DIGEST_BYTES).tolist():
        part = buf[start[k]:end[k]]
        code[k] = int.from_bytes(blake2b((_FOLD[part] if fold else part).tobytes(), digest_size=8).digest(), "little")
    return code


def folded(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _FOLD[buf]


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One code for each tuple of equally long code arrays; order matters."""
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        out = mix(out * np.uint64(_BASE) + p)
    return out


def row_of(at: np.ndarray) -> np.ndarray:
    """Row number of each word."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the slices ``start[i] : start[i] + size[i]``, one after another."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return np.arange(total) - np.repeat(before - start, size)

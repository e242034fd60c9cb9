"""Words, shingles and hashes of whole Arrow text columns, as flat numpy arrays.

A text column is cut into chunks of rows of about a megabyte, so that memory stays bounded by a chunk or by
the longest single text. Words are runs of bytes other than space and \\t \\n \\v \\f \\r; a null text has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

# Odd 64-bit multipliers of the polynomial and of the mixing steps
BASE = 0x9E3779B97F4A7C15
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Space and ASCII punctuation: what separates words where case and punctuation don't count
SEPARATOR = SPACE.copy()
SEPARATOR[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * MIX[0]
    h = h ^ (h >> np.uint64(27))
    h = h * MIX[1]
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int = BASE) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK_BYTES + 1)
        factors = np.full(size, base & (2**64 - 1), np.uint64)
        factors[0] = 1
        known = np.cumprod(factors)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = known
    return known[:n]


@dataclass
class Texts:
    """Rows first .. first + n - 1 of a batch: their bytes and where each row starts (n + 1 offsets)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Consecutive rows of a string or binary column, about `limit` bytes at a time; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield Texts(first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of some texts in order; row i has words ptr[i] .. ptr[i + 1] - 1."""

    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def words_of(texts: Texts, separator: np.ndarray = SPACE) -> Words:
    gap = separator[texts.data]
    n = len(gap)
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = gap[:-1]
    after[:-1] = gap[1:]
    inner = texts.offsets[(texts.offsets > 0) & (texts.offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(~gap & after) + 1
    return Words(start, end, np.searchsorted(start, texts.offsets).astype(np.int64))


def word_hashes(texts: Texts, words: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, the same in every text and chunk."""
    n = len(texts.data)
    values = (LOWER[texts.data] if lower else texts.data).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n), out=sums[1:])
    return mixed((sums[words.end] - sums[words.start]) * powers(n + 1, _INVERSE)[words.start])


def shingle_hashes(hashes: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and the row pointers of them. A row of fewer than k words, but not of none,
    has one shingle of all its words."""
    counts = np.diff(ptr)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    short = np.repeat(counts < k, counts)
    place = np.arange(n) - np.repeat(ptr[:-1], counts)
    left = np.repeat(counts, counts) - place
    for j in range(k):
        part = np.zeros(n, np.uint64)
        if j < n:
            part[:n - j] = hashes[j:]
        part[left <= j] = 0
        rolled = rolled * np.uint64(BASE) + part
    keep = np.where(short, place == 0, left >= k)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return mixed(rolled[keep]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def weighted(hashes: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of every row with their counts: hash, row, count, in no order of use."""
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    key = hashes ^ mixed(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    key = key[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(head)
    return hashes[order[at]], row[order[at]], np.diff(np.concatenate([at, [len(key)]]))


def signed(h: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as the signed longs Spark has."""
    return pa.array(np.ascontiguousarray(h).view(np.int64))

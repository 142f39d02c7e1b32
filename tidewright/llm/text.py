"""Vectorised byte-level text primitives over Arrow string columns: words, word hashes and chunking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that are worked on at a time; the arrays over them take some fifty times as much.
CHUNK_BYTES = 1 << 18

_GENERATOR = np.random.Generator(np.random.PCG64(20240607))
_BYTE_HASH = _GENERATOR.integers(0, 2**64, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

#: Word separators of the ``[^\x20\x09-\x0D]+`` rule.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of the ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` rule, after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) <= n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, CHUNK_BYTES) + 1, base, dtype=U64)
            steps[0] = 1
            held = _powers[base] = np.cumprod(steps, dtype=U64)
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers, so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def running_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span of the bytes can be had."""
    sums = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_HASH[data] * _power(_BASE, len(data))[: len(data)], out=sums[1:], dtype=U64)
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the spans, wherever in the bytes they stand; to be mixed before use."""
    with np.errstate(over="ignore"):
        return (sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(sums))[starts]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), ends


@dataclass
class Words:
    """The words of consecutive rows: row ``i`` has words ``first[i]`` to ``first[i + 1]``."""

    rows: slice
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        with np.errstate(over="ignore"):
            plain = span_hashes(running_hash(self.data), self.starts, self.ends)
            return mix(plain + (self.ends - self.starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def row_of_word(self) -> np.ndarray:
        """The row, from 0 in these rows, of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def spans(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that no row bound crosses."""
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(mask))]
    before[inner] = False
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of consecutive rows of about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield slice(i, min(j, n))
        i = min(j, n)


def words(column: pa.Array, is_word: np.ndarray, lower: bool = True) -> Iterator[Words]:
    """The words of a string column, chunk by chunk; whole texts are read."""
    data, offsets = utf8(column)
    for rows in row_chunks(offsets):
        at = offsets[rows.start : rows.stop + 1]
        part = data[at[0] : at[-1]]
        part = LOWER[part] if lower else part
        bounds = at - at[0]
        starts, ends = spans(is_word[part], bounds)
        yield Words(rows, part, starts, ends, np.searchsorted(starts, bounds))


def count_words(column: pa.Array, is_word: np.ndarray) -> np.ndarray:
    """Words of each row."""
    out = [w.counts for w in words(column, is_word, lower=False)]
    return np.concatenate(out) if out else np.empty(0, np.int64)

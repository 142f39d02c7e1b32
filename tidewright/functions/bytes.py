"""Byte-level codecs as Arrow-batched functions: zig-zag varints, delta, run-length and dictionary blobs, CRC-32C.

The formats are this library's own. Each blob begins with its length or count, so a codec needs no marker inside the
data, and the codec's name is kept beside the blob.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reversed Castagnoli polynomial (fixed value).
CASTAGNOLI = 0x82F63B78


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(CASTAGNOLI), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()
_STEPS = _TABLE.tolist()
#: Least and most lanes that a long byte string is cut into, and the size from which it is.
LANES, MOST_LANES, LONG = 256, 4096, 1 << 14


def _crc_plain(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = crc >> 8 ^ _STEPS[(crc ^ byte) & 0xFF]
    return crc ^ 0xFFFFFFFF


def _apply(columns: list[int], x: int) -> int:
    """A bit matrix, given by its columns, times a bit vector."""
    out = 0
    while x:
        low = x & -x
        out ^= columns[low.bit_length() - 1]
        x ^= low
    return out


@lru_cache(maxsize=256)
def _append_zeros(n: int) -> tuple[int, ...]:
    """The bit matrix that takes a checksum over n more zero bytes, by repeated squaring."""
    step = [(1 << k) >> 8 ^ _STEPS[(1 << k) & 0xFF] for k in range(32)]
    out = [1 << k for k in range(32)]
    while n:
        if n & 1:
            out = [_apply(step, c) for c in out]
        step = [_apply(step, c) for c in step]
        n >>= 1
    return tuple(out)


def crc32c(data: bytes | None) -> int | None:
    """CRC-32C of a byte string. A long one is cut into lanes that are run through side by side and then joined."""
    if data is None:
        return None
    if len(data) < LONG:
        return _crc_plain(data)
    n = max(LANES, min(MOST_LANES, len(data) >> 11))
    width = len(data) // n
    lanes = np.frombuffer(data, np.uint8, n * width).reshape(n, width).T.astype(np.uint32)
    crc = np.full(n, 0xFFFFFFFF, np.uint32)
    for column in lanes:
        crc = crc >> np.uint32(8) ^ _TABLE[(crc ^ column) & np.uint32(0xFF)]
    total, move = 0, _append_zeros(width)
    for lane in (crc ^ np.uint32(0xFFFFFFFF)).tolist():
        total = _apply(move, total) ^ lane
    tail = data[n * width :]
    return _apply(_append_zeros(len(tail)), total) ^ _crc_plain(tail)


def zigzag(values: np.ndarray) -> np.ndarray:
    """Signed to unsigned, so that small magnitudes are small numbers."""
    values = values.astype(np.int64)
    return (values << 1 ^ values >> 63).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.uint64)
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def varint(values: np.ndarray) -> bytes:
    """Unsigned integers in groups of seven bits, low first, the high bit set where more follow."""
    values = values.astype(np.uint64)
    if not len(values):
        return b""
    size = np.ones(len(values), int)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    place = np.arange(10)
    groups = (values[:, None] >> (7 * place).astype(np.uint64)[None, :] & np.uint64(0x7F)).astype(np.uint8)
    groups |= np.where(place[None, :] < size[:, None] - 1, 0x80, 0).astype(np.uint8)
    return groups[place[None, :] < size[:, None]].tobytes()


def unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, starts) if len(starts) else np.empty(0, np.uint64)


def delta_encode(data: bytes) -> bytes:
    """Little-endian 64-bit integers as zig-zag varints of their differences; a tail of under 8 bytes is kept as it is."""
    n = len(data) // 8
    values = np.frombuffer(data, "<i8", n)
    with np.errstate(over="ignore"):
        steps = np.diff(values, prepend=np.int64(0))
    return struct.pack("<IB", n, len(data) - 8 * n) + data[8 * n :] + varint(zigzag(steps))


def delta_decode(blob: bytes) -> bytes:
    _, tail = struct.unpack_from("<IB", blob)
    with np.errstate(over="ignore"):
        values = np.cumsum(unzigzag(unvarint(blob[5 + tail :])), dtype=np.int64)
    return values.astype("<i8").tobytes() + blob[5 : 5 + tail]


def rle_encode(data: bytes) -> bytes:
    """Runs of equal bytes: the bytes, then the run lengths as varints."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1]])) if len(raw) else np.empty(0, int)
    runs = np.diff(at, append=len(raw))
    return struct.pack("<I", len(at)) + raw[at].tobytes() + varint(runs)


def rle_decode(blob: bytes) -> bytes:
    (n,) = struct.unpack_from("<I", blob)
    return np.repeat(np.frombuffer(blob, np.uint8, n, 4), unvarint(blob[4 + n :]).astype(np.int64)).tobytes()


SHORTEST, LONGEST = 3, 16


def dictionary_encode(data: bytes) -> bytes:
    """Greedy longest matches of recurring n-grams: literals and references are told apart by a count before each.

    N-grams are counted at every place; one enters the dictionary if it recurs more than twice and pays for itself.
    """
    words: list[bytes] = []
    for n in range(LONGEST, SHORTEST - 1, -1):
        found = Counter(data[i : i + n] for i in range(len(data) - n + 1))
        words += [w for w, c in found.items() if c > 2 and c * n > n + 4]
    number = {w: i for i, w in enumerate(words)}
    lengths = sorted({len(w) for w in words}, reverse=True)
    used: dict[int, int] = {}
    tokens: list[int] = []
    literal, at = bytearray(), 0
    literals = bytearray()

    def flush() -> None:
        if literal:
            tokens.append(len(literal) << 1)
            literals.extend(literal)
            literal.clear()

    while at < len(data):
        for n in lengths:
            k = number.get(data[at : at + n])
            if k is not None:
                flush()
                tokens.append(used.setdefault(k, len(used)) << 1 | 1)
                at += n
                break
        else:
            literal.append(data[at])
            at += 1
    flush()
    kept = [words[k] for k in used]
    head = varint(np.array([len(kept), len(tokens), len(literals), *map(len, kept)], np.uint64))
    return struct.pack("<I", len(head)) + head + b"".join(kept) + bytes(literals) + varint(np.array(tokens, np.uint64))


def dictionary_decode(blob: bytes) -> bytes:
    (size,) = struct.unpack_from("<I", blob)
    n, _, n_literals, *lengths = unvarint(blob[4 : 4 + size]).astype(int).tolist()
    at, words = 4 + size, []
    for k in lengths[:n]:
        words.append(blob[at : at + k])
        at += k
    literals, place, out = blob[at : at + n_literals], 0, []
    for token in unvarint(blob[at + n_literals :]).astype(int).tolist():
        if token & 1:
            out.append(words[token >> 1])
        else:
            out.append(literals[place : place + (token >> 1)])
            place += token >> 1
    return b"".join(out)


def _zlib(level: int) -> Callable[[bytes], bytes]:
    return lambda data: zlib.compress(data, level)


#: Codecs by name: (encode, decode).
CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "none": (bytes, bytes),
    "delta": (delta_encode, delta_decode),
    "rle": (rle_encode, rle_decode),
    "dictionary": (dictionary_encode, dictionary_decode),
    "gzip": (_zlib(6), zlib.decompress),
}
try:
    import pyarrow as pa

    for _name in ("zstd", "snappy", "lz4"):
        # Arrow's block codecs do not keep the length, so it goes before the block.
        CODECS[_name] = (
            lambda data, c=_name: struct.pack("<I", len(data)) + pa.Codec(c).compress(data, asbytes=True),
            lambda blob, c=_name: pa.Codec(c).decompress(blob[4:], struct.unpack_from("<I", blob)[0], asbytes=True),
        )
except ImportError:  # pragma: no cover
    pass


def _by_codec(which: int):
    def run(codec: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or c is None else CODECS[c][which](bytes(d)) for c, d in zip(codec, data, strict=True)], dtype=object)

    return F.pandas_udf(run, "binary")


def encode(codec: Column, data: Column) -> Column:
    """Each blob by the codec that its row names."""
    return _by_codec(0)(codec, data)


def decode(codec: Column, blob: Column) -> Column:
    """The inverse of ``encode``."""
    return _by_codec(1)(codec, blob)


def checksum(data: Column) -> Column:
    """CRC-32C as a long."""
    return F.pandas_udf(lambda s: pd.Series([crc32c(x) for x in s], dtype="Int64"), "long")(data)

"""Scalar functions of the library as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_DIGITS = 20


def log_key(seq: Column) -> Column:
    """A sequence as text whose order is that of the numbers: padded by zeros to 20 digits."""
    return F.lpad(seq.cast("string"), KEY_DIGITS, "0")


def key_sequence(key: Column) -> Column:
    """The sequence of such a key."""
    return key.cast("long")


def swap_bytes(value: Column, width: int) -> Column:
    """A number of ``width`` bytes read in the other byte order; one of eight bytes is signed."""
    digits = F.lpad(F.hex(value), 2 * width, "0")
    swapped = F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(width, 0, -1)])
    return F.conv(swapped, 16, -10 if width == 8 else 10).cast("long")


def command_key(checksum: Column, ack: Column, command_hash: Column) -> Column:
    """The XOR by which a command is scrambled."""
    return checksum.bitwiseXOR(ack).bitwiseXOR(command_hash)


def in_subnet(address: Column, bits: int = 24) -> Column:
    """The subnet number of an address given as a number."""
    return F.shiftright(address, 32 - bits)


def address_number(ip: Column) -> Column:
    """A dotted address as a number."""
    parts = F.split(ip, r"\.")
    return sum((parts[i].cast("long") * 256 ** (3 - i) for i in range(1, 4)), parts[0].cast("long") * 256**3)


def distance(a: Column, b: Column) -> Column:
    """How far apart two unsigned numbers lie."""
    return F.greatest(a, b) - F.least(a, b)


def ratio(a: Column, b: Column, none: float = 1.0) -> Column:
    """``a / b``, and ``none`` where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(none))


def name_uuid(text: Column) -> Column:
    """An id in the form of a UUID that depends on the text alone."""
    h = F.sha2(text, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))

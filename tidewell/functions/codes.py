"""Integer codes and their sizes as column expressions: zigzag, varint, bit scans, checksums."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The least numbers whose cubes take 2, 3, ... 27 bytes of 7 bits; the cube of no 64-bit number takes more.
_CUBES = [bisect_left(range(2**63 - 1), 2 ** (7 * n), key=lambda x: x**3) for n in range(1, 27)]


def zigzag(x: Column) -> Column:
    """Signed to unsigned order: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-(x.bitwiseAND(F.lit(1).cast("long"))))


def leading_zeros(x: Column) -> Column:
    """Of 64 bits; 64 for 0."""
    return F.when(x == 0, 64).otherwise(64 - F.length(F.bin(x)))


def trailing_zeros(x: Column) -> Column:
    return F.when(x == 0, 64).otherwise(F.length(F.bin(x.bitwiseAND(-x))) - 1)


def varint_size(x: Column) -> Column:
    """Bytes of an unsigned variable-length integer of 7 bits a byte."""
    return F.greatest(F.lit(1), F.ceil((64 - leading_zeros(x)) / 7)).cast("int")


def varint_size_of_cube(x: Column) -> Column:
    """Bytes of the unsigned variable-length integer that is x cubed, told from x, as the cube may be more than 64 bits; 1 below 0."""
    return sum(((x >= F.lit(n)).cast("int") for n in _CUBES), F.lit(1))


def signed_varint_size(x: Column) -> Column:
    """Bytes of a signed one, which is doubled before it is written."""
    return varint_size(F.shiftleft(x, 1))


def checksum(x: Column) -> Column:
    """CRC-32 (IEEE) of bytes or text."""
    return F.crc32(x)

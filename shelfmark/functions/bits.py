"""Bytes, bits and checksums."""

from __future__ import annotations

from binascii import crc_hqx

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import bounded


def uint(data: Column, at: int | Column, width: int, *, big: bool = False) -> Column:
    """The unsigned integer of 1 to 7 bytes at a byte place counted from 0."""
    part = F.substring(data, at + 1, F.lit(width))
    digits = F.hex(part)
    if not big and width > 1:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.when(F.octet_length(part) == width, F.conv(digits, 16, 10).cast("long"))


def packed(x: Column, width: int, *, big: bool = False) -> Column:
    """An unsigned integer as 1 to 8 bytes, the inverse of uint; higher bits are dropped."""
    digits = F.right(F.lpad(F.hex(x.cast("long")), 16, "0"), F.lit(2 * width))
    pairs = F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))
    return F.unhex(digits if big else F.array_join(F.reverse(pairs), ""))


def sign_extended(x: Column, width: int) -> Column:
    """A signed value of so many bytes from its unsigned one."""
    half = 1 << 8 * width - 1
    return x - F.when(x >= half, 2 * half).otherwise(0)


def ones(x: Column) -> Column:
    return F.bit_count(x)


def zeros(x: Column, width: int = 32) -> Column:
    return F.lit(width) - F.bit_count(x)


def lowest_one(x: Column) -> Column:
    return x.bitwiseAND(F.negate(x))


def trailing_zeros(x: Column, width: int = 32) -> Column:
    return F.when(x == 0, width).otherwise(F.bit_count(lowest_one(x) - 1))


def power_of_two_from(x: Column) -> Column:
    """The least power of two that is not less."""
    bits = F.length(F.conv((F.greatest(x, F.lit(1)) - 1).cast("string"), 10, 2))
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits))


def power_of_two_above(x: Column) -> Column:
    """The least power of two that is greater."""
    return power_of_two_from(x + 1)


def four_and_four(x: Column) -> Column:
    """A byte spread over two: its odd bits, then its even bits, all others set."""
    return F.shiftright(x, 1).bitwiseOR(F.lit(0xAA)) * 256 + x.bitwiseOR(F.lit(0xAA))


def from_four_and_four(odd: Column, even: Column) -> Column:
    return F.shiftleft(odd, 1).bitwiseOR(F.lit(1)).bitwiseAND(even).bitwiseAND(F.lit(0xFF))


def free_chunks(bitmap: Column) -> Column:
    """Clear bits of an allocation bitmap."""
    nibble = F.split(F.hex(bitmap), "")
    used = F.aggregate(F.filter(nibble, lambda c: c != ""), F.lit(0), lambda n, c: n + F.bit_count(F.conv(c, 16, 10).cast("int")))
    return F.octet_length(bitmap) * 8 - used


def all_zero(data: Column) -> Column:
    return F.hex(data).rlike("^0*$")


def crc32(data: Column) -> Column:
    return F.crc32(data)


#: Every byte with its bits in reverse order.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _crc16(data: Column, seed: int, reflected: bool) -> Column:
    """CRC-16 of polynomial 1021, plain or reflected, in C over each value."""
    bounded()

    def turned(crc: int) -> int:
        return int(f"{crc:016b}"[::-1], 2)

    @F.pandas_udf("int")
    def run(rows: pd.Series) -> pd.Series:
        if reflected:
            out = [None if b is None else turned(crc_hqx(bytes(b).translate(_REVERSED), turned(seed))) for b in rows]
        else:
            out = [None if b is None else crc_hqx(b, seed) for b in rows]
        return pd.Series(out, dtype="Int32")

    return run(data)


def crc16_xmodem(data: Column, seed: int = 0) -> Column:
    return _crc16(data, seed, False)


def crc16_kermit(data: Column, seed: int = 0) -> Column:
    return _crc16(data, seed, True)

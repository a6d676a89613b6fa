"""Byte strings of old machines as text.

The character sets are Python codecs, applied to Arrow batches: Spark's own encode and
decode know other sets, and translate is a hash lookup for each character.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import bounded

_HALF = bytes(range(128, 256)).decode("latin-1")


def decoded(data: Column, codec: str = "mac_roman") -> Column:
    """Text of bytes in mac_roman or cp437."""
    bounded()

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda b: None if b is None else bytes(b).decode(codec))

    return run(data)


def encoded(text: Column, codec: str = "mac_roman") -> Column:
    """Inverse of decoded(); characters that the set lacks become `?`."""
    bounded()

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else t.encode(codec, "replace"))

    return run(text)


def encodable(text: Column, codec: str = "mac_roman") -> Column:
    """Whether the set has all characters."""
    bounded()
    table = dict.fromkeys(map(ord, bytes(range(256)).decode(codec)))

    @F.pandas_udf("boolean")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else not t.translate(table))

    return run(text)


def high_ascii(data: Column) -> Column:
    """Text of bytes whose high bit means nothing."""
    low = "".join(chr(i) for i in range(128))
    return F.translate(F.decode(data, "ISO-8859-1"), _HALF, low)


def length_prefixed(data: Column) -> Column:
    """Text of a string whose first byte is its length."""
    n = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")
    return F.decode(F.substring(data, F.lit(2), n), "ISO-8859-1")


def four_characters(x: Column) -> Column:
    """A 32-bit type code as its four characters."""
    return decoded(F.unhex(F.lpad(F.hex(x.cast("long")), 8, "0")))


def from_four_characters(s: Column) -> Column:
    return F.when(F.octet_length(encoded(s)) == 4, F.conv(F.hex(encoded(s)), 16, 10).cast("long"))

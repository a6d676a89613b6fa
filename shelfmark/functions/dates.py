"""Packed dates of old file systems, to timestamps without a zone and back.

What is no date becomes null; status() tells none from invalid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bits(x: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(x.cast("long"), low).bitwiseAND(F.lit((1 << n) - 1)).cast("int")


def _made(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)"))


def _shifted(*parts: tuple[Column, int]) -> Column:
    out = F.lit(0).cast("long")
    for c, n in parts:
        out = out + F.shiftleft(c.cast("long"), n)
    return out


def from_prodos(x: Column) -> Column:
    """Year, month and day in the low 16 bits, hour and minute in the high; years under
    40 are of the next century."""
    year = _bits(x, 9, 7)
    made = _made(F.when(year < 40, year + 2000).otherwise(year + 1900), _bits(x, 5, 4), _bits(x, 0, 5), _bits(x, 24, 5), _bits(x, 16, 6), F.lit(0))
    return F.when(x != 0, made)


def to_prodos(t: Column) -> Column:
    """Zero where the year is not 1940 to 2039."""
    packed = _shifted((F.year(t) % 100, 9), (F.month(t), 5), (F.day(t), 0), (F.hour(t), 24), (F.minute(t), 16))
    return F.when(F.year(t).between(1940, 2039), packed).otherwise(0)


def pascal_none(x: Column) -> Column:
    """Whether a Pascal date stands for none: month 0, or a year of 100 to 127."""
    return (_bits(x, 0, 4) == 0) | (_bits(x, 9, 7) >= 100)


def from_pascal(x: Column) -> Column:
    """Month in 4 bits, day in 5, year in 7, from the lowest; see pascal_none()."""
    year = _bits(x, 9, 7)
    return F.when(~pascal_none(x), _made(F.when(year < 40, year + 2000).otherwise(year + 1900), _bits(x, 0, 4), _bits(x, 4, 5), F.lit(0), F.lit(0), F.lit(0)))


def to_pascal(t: Column) -> Column:
    return F.when(F.year(t).between(1940, 2039), _shifted((F.year(t) % 100, 9), (F.day(t), 4), (F.month(t), 0))).otherwise(0)


def _since(epoch: str, seconds: Column) -> Column:
    """Seconds after a date, whatever the session's time zone."""
    return F.expr(f"TIMESTAMP_NTZ '{epoch} 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def _seconds(epoch: str, t: Column) -> Column:
    whole = F.expr(f"TIMESTAMP_NTZ '{epoch} 00:00:00'")
    return F.timestamp_diff("DAY", whole, t) * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def from_hfs(x: Column) -> Column:
    """Seconds since 1904; zero is none."""
    return F.when(x != 0, _since("1904-01-01", x))


def to_hfs(t: Column) -> Column:
    seconds = _seconds("1904-01-01", t.cast("timestamp_ntz"))
    return F.when(seconds.between(1, 0xFFFFFFFF), seconds).otherwise(0)


def from_msdos(date: Column, time: Column) -> Column:
    return F.when(date != 0, _made(_bits(date, 9, 7) + 1980, _bits(date, 5, 4), _bits(date, 0, 5), _bits(time, 11, 5), _bits(time, 5, 6), _bits(time, 0, 5) * 2))


def to_msdos_date(t: Column) -> Column:
    return F.when(F.year(t).between(1980, 2107), _shifted((F.year(t) - 1980, 9), (F.month(t), 5), (F.day(t), 0))).otherwise(0)


def to_msdos_time(t: Column) -> Column:
    return _shifted((F.hour(t), 11), (F.minute(t), 5), (F.floor(F.second(t) / 2), 0))


def from_gs(x: Column) -> Column:
    """Eight bytes from the lowest: second, minute, hour, year since 1900 (under 40: since
    2000), day and month (both from 0), one unused, weekday."""
    year = _bits(x, 24, 8)
    return F.when(x != 0, _made(F.when(year < 40, year + 2000).otherwise(year + 1900), _bits(x, 40, 8) + 1, _bits(x, 32, 8) + 1, _bits(x, 16, 8), _bits(x, 8, 8), _bits(x, 0, 8)))


def to_gs(t: Column) -> Column:
    packed = _shifted((F.second(t), 0), (F.minute(t), 8), (F.hour(t), 16), (F.year(t) - 1900, 24), (F.day(t) - 1, 32), (F.month(t) - 1, 40), (F.dayofweek(t), 56))
    return F.when(F.year(t).between(1900, 2155), packed).otherwise(0)


#: The signed 32-bit number that stands for no date.
NO_UNIX = -(1 << 31)


def from_unix(x: Column) -> Column:
    """Seconds since 1970, a signed 32-bit number; the least is none."""
    return F.when(x != NO_UNIX, _since("1970-01-01", x))


def to_unix(t: Column) -> Column:
    """NO_UNIX for null and for what 32 bits can't hold."""
    ntz = t.cast("timestamp_ntz")
    seconds = F.when(ntz >= F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), _seconds("1970-01-01", ntz)).otherwise(_seconds("1900-01-01", ntz) - 25567 * 86400)
    return F.when(seconds.between(NO_UNIX, 0x7FFFFFFF), seconds).otherwise(F.lit(NO_UNIX).cast("long"))


def status(packed: Column, made: Column, none: Column | None = None) -> Column:
    """`none` for a zero or null, or where none says so, `invalid` for what makes no date,
    else `valid`."""
    nothing = packed.isNull() | (packed == 0 if none is None else none)
    return F.when(nothing, "none").when(made.isNull(), "invalid").otherwise("valid")

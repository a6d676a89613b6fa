"""Values as text, and text as values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of the access bits, from the highest.
ACCESS_LETTERS = "dnb??iwr"


def hex_value(x: Column, least: int = 2) -> Column:
    """`$` and lower-case hex digits, 2, 4, 6 or 8 of them, at least so many."""
    digits = F.lower(F.hex(x.cast("long")))
    width = F.greatest(F.lit(least), (F.ceil(F.length(digits) / 2) * 2).cast("int"))
    return F.concat(F.lit("$"), F.lpad(digits, width, F.lit("0")))


def date_text(t: Column) -> Column:
    """dd-MMM-yy HH:mm; `[No Date]` for null."""
    return F.coalesce(F.date_format(t, "dd-MMM-yy HH:mm"), F.lit("[No Date]"))


def access_letters(x: Column) -> Column:
    """A letter for each access bit that is set, from the highest."""
    return F.concat(*[F.when(x.cast("long").bitwiseAND(F.lit(128 >> i)) != 0, c).otherwise("") for i, c in enumerate(ACCESS_LETTERS)])


def comp_percent(part: Column, whole: Column) -> Column:
    """What the stored part is of the whole, halves to the even: `??%` unknown, `--%` nothing
    of nothing, `0%` something of nothing, `<1%`, and no more than `999%`."""
    p = F.bround(part * 100.0 / F.when(whole != 0, whole))
    return F.when(part.isNull() | whole.isNull() | (part < 0) | (whole < 0), "??%").when(whole == 0, F.when(part == 0, "--%").otherwise("0%")).when((p == 0) & (part != 0), "<1%").when(p > 999, "999%").otherwise(F.concat(p.cast("long").cast("string"), F.lit("%")))


def size_text(n: Column, unit: int = 1024) -> Column:
    """A size on disk: whole units of 256 bytes (sectors), 512 (blocks) or others, whole KB
    for 1024; from 10 MB on in MB, from 1 GB on in GB, with one decimal."""
    step = lambda d, u, places: F.format_string(f"%.{places}f{u}", n / float(d))
    name = {256: "sector", 512: "block"}.get(unit, "unit")
    whole = F.floor(n / unit)
    small = step(1 << 10, "KB", 0) if unit == 1024 else F.concat(whole.cast("string"), F.lit(f" {name}"), F.when(whole == 1, "").otherwise("s"))
    large = F.when(n >= 1 << 30, step(1 << 30, "GB", 1)).otherwise(step(1 << 20, "MB", 1))
    return F.when(n < 10 << 20, small).otherwise(large)


def csv_field(v: Column) -> Column:
    """Quoted, with quotes doubled, where it holds a comma, a quote or a line end, or starts
    or ends in a space.  Null is empty."""
    s = F.coalesce(v, F.lit(""))
    return F.when(s.rlike(r'[,"\r\n]|^ | $'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_line(*fields: Column) -> Column:
    return F.concat_ws(",", *map(csv_field, fields))


def newlines(text: Column) -> Column:
    """CR, LF and CRLF each as one LF."""
    return F.regexp_replace(text, "\r\n|\r", "\n")


def parsed_int(s: Column) -> Column:
    """A decimal number, hex digits after `$` or `0x`, or binary digits after `%`; else null."""
    t = F.trim(s)
    return (
        F.when(t.rlike(r"^[+-]?[0-9]{1,18}$"), F.when(t.rlike(r"^[+-]?[0-9]{1,18}$"), t).cast("long"))
        .when(t.rlike(r"^\$[0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 2, 99), 16, 10).cast("long"))
        .when(t.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 99), 16, 10).cast("long"))
        .when(t.rlike(r"^%[01]{1,62}$"), F.conv(F.substring(t, 2, 99), 2, 10).cast("long"))
    )


# Bytes of each unit of a size.
SIZE_UNITS = {"k": 1 << 10, "kb": 1 << 10, "kib": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "mib": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "gib": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "tib": 1 << 40, "blk": 512, "blocks": 512}


def size_bytes(s: Column, track_bytes: int = 16 * 256, *, blocks: bool = False) -> Column:
    """`800KB`, `280 blk` or `35trk` in bytes; null for what is none of these, and for more
    than a signed 32-bit number of units.  blocks: no unit means blocks.  No track_bytes:
    tracks are refused."""
    pattern = r"^([0-9]{1,18})\s*([A-Za-z]*)\s*$"
    number, unit = F.regexp_extract(s, pattern, 1), F.lower(F.regexp_extract(s, pattern, 2))
    units = SIZE_UNITS | {"": 512 if blocks else 1} | ({"trk": track_bytes, "tracks": track_bytes} if track_bytes else {})
    table = F.create_map(*[x for k, v in units.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    value = F.when(number != "", number).cast("long")
    return F.when(value <= 0x7FFFFFFF, value * table[unit])


def int_list_text(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), ",")


def text_int_list(s: Column) -> Column:
    return F.when(s == "", F.array().cast("array<int>")).otherwise(F.split(s, ",").cast("array<int>"))


def option_map(s: Column) -> Column:
    """`k=v,k=v` as a map; a key alone maps to null."""
    return F.str_to_map(s, F.lit(","), F.lit("="))


def option_text(m: Column) -> Column:
    """A map as `k=v,k=v`, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def labelled(code: Column, labels: dict) -> Column:
    """The label of a code; the code itself where there is none."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[code], code.cast("string"))


"""Codes and their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of file types, by type.
DOS_TYPES = {0x04: "T", 0xFA: "I", 0xFC: "A", 0x06: "B", 0xF2: "S", 0xFE: "R", 0xF3: "AA", 0xF4: "BB"}
PASCAL_TYPES = {0x00: "Untyped", 0x01: "Bad", 0x02: "Code", 0x03: "Text", 0xF3: "Info", 0x05: "Data", 0xF4: "Graf", 0x08: "Foto", 0xF5: "S.dir"}

# Names of the formats in which forks are stored, and of kinds of media.
FORK_FORMATS = {
    "plain": "Stored", "squeeze": "Squeeze", "lzw1": "LZW/1", "lzw2": "LZW/2", "lzc12": "LZC-12", "lzc16": "LZC-16", "deflate": "Deflate", "bzip2": "Bzip2", "zx0": "ZX0", "shrink": "Shrink",
    "implode": "Implode", "lzhuf": "LZHuf",
}
MEDIA_KINDS = {"unknown": "Unknown", "gcr525": 'GCR 5.25"', "gcr35ss": 'GCR SS/DD 3.5"', "gcr35ds": 'GCR DS/DD 3.5"', "mfm720": 'MFM DS/DD 3.5" 720KB', "mfm1440": 'MFM DS/HD 3.5" 1440KB'}


def _named(code: Column, labels: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[code]


def dos_type(file_type: Column) -> Column:
    """One or two letters of a file type on DOS volumes; `?` for others."""
    return F.coalesce(_named(file_type.cast("int"), DOS_TYPES), F.lit("?"))


def pascal_type(file_type: Column) -> Column:
    """A word for a file type on Pascal volumes; `?` for others."""
    return F.coalesce(_named(file_type.cast("int"), PASCAL_TYPES), F.lit("?"))


def fork_format(code: Column) -> Column:
    """`?` and the code for an unknown one."""
    return F.coalesce(_named(code, FORK_FORMATS), F.concat(F.lit("?"), code))


def media_kind(code: Column) -> Column:
    return F.coalesce(_named(code, MEDIA_KINDS), F.concat(F.lit("?"), code))


def type_abbreviations(rows: DataFrame, table: DataFrame, file_type: str) -> DataFrame:
    """rows with the abbreviation of their type from a table (type, abbrev) of all types; an
    empty one for a type out of range."""
    named = table.select(F.col("type").alias(file_type), "abbrev")
    return rows.join(named, file_type, "left").withColumn("abbrev", F.coalesce("abbrev", F.lit("")))


def types_by_abbreviation(rows: DataFrame, table: DataFrame, abbrev: str) -> DataFrame:
    """rows with the type that an abbreviation of two or three letters names, whatever the
    case, -1 for none.  Of types that share one the least counts."""
    least = table.groupBy(F.rpad("abbrev", 3, " ").alias("_abbrev")).agg(F.min("type").alias("type"))
    key = F.when(F.length(abbrev).between(2, 3), F.rpad(F.upper(abbrev), 3, " "))
    return rows.withColumn("_abbrev", key).join(least, "_abbrev", "left").drop("_abbrev").withColumn("type", F.coalesce("type", F.lit(-1)))

"""Directories of file archives and wrapped files, by byte expressions.

Each reader takes files (path, content) and gives a row for each entry or record, in one
pass without a shuffle.  Files of other kinds give no rows, and what lies past the end of a
file is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits, charsets, dates
from . import containers

#: Bytes of a header or record of MacBinary and Binary II files.
UNIT = 128


def apple_single(files: DataFrame) -> DataFrame:
    """(path, double, entry, kind, start, length): the entries of AppleSingle files and of
    AppleDouble headers.  kind: 1 data fork, 2 resource fork, 3 name, 4 comment, 8 dates, 9
    finder info, 11 attributes."""
    c = F.col("content")
    own = containers.kind_of_content(c)
    rows = files.select("path", "content", own.alias("k"), bits.uint(c, 24, 2, big=True).alias("n")).where("k in ('applesingle', 'appledouble') and n > 0")
    each = rows.select("path", "content", "k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("entry"))
    field = lambda at: bits.uint(c, (26 + at + F.col("entry") * 12).cast("int"), 4, big=True)
    return each.select("path", (F.col("k") == "appledouble").alias("double"), F.col("entry").cast("int").alias("entry"), field(0).alias("kind"), field(4).alias("start"), field(8).alias("length"))


def mac_binary(files: DataFrame) -> DataFrame:
    """(path, name, type, creator, data_len, rsrc_len, rsrc_start, created, modified, whole):
    the headers of MacBinary files.  They have no signature: zeros at 0, 74 and 82, a name
    of 1 to 63 characters and forks that the file has room for tell them.  whole: the
    checksum of later versions fits."""
    c = F.col("content")
    byte, long = (lambda at: bits.uint(c, at, 1)), (lambda at: bits.uint(c, at, 4, big=True))
    text = lambda at, n: charsets.decoded(F.substring(c, F.lit(at + 1), n))
    padded = lambda n: F.ceil(n / UNIT) * UNIT
    rows = files.where(F.octet_length("content") >= UNIT).select("path", "content", F.octet_length(c).alias("size"), byte(1).alias("n"), long(83).alias("data_len"), long(87).alias("rsrc_len"))
    good = (byte(0) == 0) & (byte(74) == 0) & (byte(82) == 0) & F.col("n").between(1, 63) & (F.col("data_len") + F.col("rsrc_len") > 0) & (UNIT + padded(F.col("data_len")) * (F.col("rsrc_len") > 0).cast("int") + F.greatest("rsrc_len", F.when(F.col("rsrc_len") == 0, F.col("data_len")).otherwise(0)) <= F.col("size"))
    crc = bits.crc16_xmodem(F.substring(c, 1, 124)) == bits.uint(c, 124, 2, big=True)
    return rows.where(good).select("path", text(2, F.col("n").cast("int")).alias("name"), text(65, F.lit(4)).alias("type"), text(69, F.lit(4)).alias("creator"), "data_len", "rsrc_len", (UNIT + padded(F.col("data_len"))).cast("long").alias("rsrc_start"), dates.from_hfs(long(91)).alias("created"), dates.from_hfs(long(95)).alias("modified"), crc.alias("whole"))


def binary_two(files: DataFrame) -> DataFrame:
    """(path, record, name, file_type, aux_type, access, storage, length, start, modified):
    the records of Binary II files.  Each has a header of 128 bytes and its data, filled up
    to a multiple of that; the last byte of a header tells how many follow, 255 at most."""
    c = F.col("content")
    is_header = lambda at: (F.hex(F.substring(c, at + 1, F.lit(3))) == "0A474C") & (bits.uint(c, at + 18, 1) == 2) & (at + UNIT <= F.octet_length(c))
    after = lambda at: (at + UNIT + F.ceil(bits.uint(c, at + 20, 3) / UNIT) * UNIT).cast("int")

    def step(state: Column, _: Column) -> Column:
        # Bound once: a lambda's expressions are evaluated wherever they stand.
        one = F.when(bits.uint(c, F.element_at(state, -1) + 127, 1) > 0, after(F.element_at(state, -1)))
        return F.concat(state, F.filter(F.array(one), lambda x: F.coalesce(is_header(x), F.lit(False))))

    places = F.aggregate(F.sequence(F.lit(1), bits.uint(c, 127, 1).cast("int")), F.array(F.lit(0)), step)
    first = files.where(F.octet_length("content") >= UNIT).where(is_header(F.lit(0)))
    starts = F.when(bits.uint(c, 127, 1) > 0, places).otherwise(F.array(F.lit(0)))
    # A record's row has its own header only, not the whole file.
    heads = F.transform(starts, lambda x: F.struct(x.alias("at"), F.substring(c, x + 1, F.lit(UNIT)).alias("head")))
    each = first.select("path", F.posexplode(heads).alias("record", "r")).select("path", "record", F.col("r.at").alias("at"), F.col("r.head").alias("head"))
    h = F.col("head")
    stamp = F.shiftleft(bits.uint(h, 12, 2), 16) + bits.uint(h, 10, 2)
    name = F.decode(F.substring(h, F.lit(25), bits.uint(h, 23, 1).cast("int")), "ISO-8859-1")
    return each.select("path", "record", name.alias("name"), bits.uint(h, 4, 1).alias("file_type"), bits.uint(h, 5, 2).alias("aux_type"), bits.uint(h, 3, 1).alias("access"), bits.uint(h, 7, 1).alias("storage"), bits.uint(h, 20, 3).alias("length"), (F.col("at") + UNIT).cast("long").alias("start"), dates.from_prodos(stamp).alias("modified"))


def nufx_archive(files: DataFrame) -> DataFrame:
    """(path, records, created, modified, version, length): the master headers of NuFX
    archives."""
    c = F.col("content")
    field = lambda at, n: bits.uint(c, at, n)
    # Eight bytes don't fit an unsigned read; the last is the weekday, which dates don't need.
    stamp = lambda at: dates.from_gs(field(at, 6))
    return files.where(containers.kind_of_content(c) == "nufx").select("path", field(8, 4).alias("records"), stamp(12).alias("created"), stamp(20).alias("modified"), field(28, 2).alias("version"), field(38, 4).alias("length"))

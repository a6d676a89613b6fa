"""Directories and partition maps of disk images, by byte expressions.

Most readers take a few blocks of every image and explode their fixed-size slots, so a scan
of many images is one pass without a shuffle.  Pascal volumes' slots cross block borders, so
the four directory blocks of each image are put together; ProDOS directories are followed
from block to block by joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits, charsets, dates
from ..operators.lineage import cut


def _slots(rows: DataFrame, key: list[str], data: str, first: int, size: int, count: int) -> DataFrame:
    """(*key, slot, e): count slots of so many bytes from byte place first on."""
    at = rows.select(*key, data, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("slot"))
    return at.select(*key, "slot", F.substring(data, F.col("slot") * size + first + 1, F.lit(size)).alias("e"))


def _prodos_entries(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """The file rows of directory blocks (path, chunk, data, and the columns to keep): 13
    entries of 39 bytes after four bytes of links.  Entries without a storage type are free,
    and headers of volumes and directories are left out."""
    slots = _slots(blocks, ["path", "chunk", *keep], "data", 4, 39, 13)
    e = F.col("e")
    first = bits.uint(e, 0, 1)
    storage = F.shiftright(first, 4)
    stamp = lambda at: F.shiftleft(bits.uint(e, at + 2, 2), 16) + bits.uint(e, at, 2)
    rows = slots.select("path", "chunk", *keep, "slot", F.decode(F.substring(e, F.lit(2), first.bitwiseAND(F.lit(15)).cast("int")), "ISO-8859-1").alias("name"), storage.alias("storage"), bits.uint(e, 16, 1).alias("file_type"), bits.uint(e, 17, 2).alias("key"), bits.uint(e, 19, 2).alias("blocks_used"), bits.uint(e, 21, 3).alias("data_len"), bits.uint(e, 31, 2).alias("aux_type"), bits.uint(e, 30, 1).alias("access"), dates.from_prodos(stamp(24)).alias("created"))
    return rows.where(F.col("storage").between(1, 13))


def prodos_directory(blocks: DataFrame, key_block: int = 2) -> DataFrame:
    """(path, folder, chunk, slot, name, storage, file_type, key, blocks_used, data_len,
    aux_type, access, created): all files of ProDOS volumes, from chunks() (path, chunk,
    data).

    Directory blocks are linked, and an entry of storage type 13 is a directory with a key
    block of its own.  Each round reads the blocks that the round before has found, by a
    join on image and block, and goes on to their links and directories, until nothing is
    new; a block is read once, so damaged links can't go in circles.  folder is the path of
    directories, empty for the volume's own.
    """
    spark = blocks.sparkSession
    now = cut(blocks.where(F.col("chunk") == key_block).select("path", "chunk", F.lit("").alias("folder")).distinct())
    seen, out = now, None
    while not now.isEmpty():
        here = cut(blocks.join(now, ["path", "chunk"]).select("path", "chunk", "data", "folder"))
        rows = _prodos_entries(here, ["folder"])
        out = rows if out is None else out.unionByName(rows)
        following = here.select("path", bits.uint(F.col("data"), 2, 2).alias("chunk"), "folder").where("chunk > 0")
        below = rows.where("storage = 13").select("path", F.col("key").alias("chunk"), F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), "name").alias("folder"))
        more = following.unionByName(below).groupBy("path", "chunk").agg(F.min("folder").alias("folder"))
        now = cut(more.join(seen.select("path", F.col("chunk").cast("long").alias("chunk")), ["path", "chunk"], "left_anti"))
        seen = seen.unionByName(now)
    return _prodos_entries(spark.createDataFrame([], "path string, chunk int, data binary, folder string"), ["folder"]) if out is None else out


def dos_catalog(files: DataFrame) -> DataFrame:
    """(path, sector, slot, name, kind, locked, sectors, list_track, list_sector): files of
    DOS 3.3 volumes in DOS-ordered images (path, content).

    The catalog fills sectors 15 to 1 of track 17, seven entries of 35 bytes in each from
    byte 11 on.  Entries never used (track 0) or deleted (track 255) are left out, and so
    are images too short to have a catalog.
    """
    track = 17 * 16 * 256
    sectors = files.where(F.octet_length("content") >= track + 4096).select("path", "content", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("sector"))
    data = sectors.select("path", "sector", F.substring("content", F.col("sector") * 256 + track + 1, F.lit(256)).alias("data"))
    e = F.col("e")
    kind = bits.uint(e, 2, 1)
    rows = _slots(data, ["path", "sector"], "data", 11, 35, 7).withColumn("list_track", bits.uint(e, 0, 1)).where("list_track between 1 and 254")
    return rows.select("path", "sector", "slot", F.rtrim(charsets.high_ascii(F.substring(e, 4, 30))).alias("name"), kind.bitwiseAND(F.lit(127)).alias("kind"), (kind >= 128).alias("locked"), bits.uint(e, 33, 2).alias("sectors"), "list_track", bits.uint(e, 1, 1).alias("list_sector"))


def pascal_directory(blocks: DataFrame) -> DataFrame:
    """(path, slot, name, kind, first, next, data_len, modified): files of Pascal volumes
    (path, chunk, data), all four directory blocks being given.

    Slot 0 tells the volume and how many files there are; a file's length is 512 for each
    block but the last, and what is used of that.
    """
    whole = blocks.where("chunk between 2 and 5").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk", F.hex("data").alias("h")))).alias("b")).where(F.size("b") == 4)
    joined = whole.select("path", F.unhex(F.array_join("b.h", "")).alias("data"))
    counted = joined.select("path", "data", bits.uint(F.col("data"), 16, 2).alias("files"))
    e = F.col("e")
    rows = _slots(counted, ["path", "files"], "data", 0, 26, 78).where("slot between 1 and files")
    first, after = bits.uint(e, 0, 2), bits.uint(e, 2, 2)
    return rows.select("path", "slot", charsets.length_prefixed(F.substring(e, 7, 16)).alias("name"), bits.uint(e, 4, 2).bitwiseAND(F.lit(15)).alias("kind"), first.alias("first"), after.alias("next"), ((after - first - 1) * 512 + bits.uint(e, 22, 2)).alias("data_len"), dates.from_pascal(bits.uint(e, 24, 2)).alias("modified"))


def cpm_directory(blocks: DataFrame, first_block: int, count: int) -> DataFrame:
    """(path, user, name, extents, records): files of CP/M volumes whose directory fills
    count chunks from first_block on.  A file's extents are 32-byte slots of one name and
    user; unused slots have user E5."""
    e = F.col("e")
    text = lambda at, n: F.rtrim(charsets.high_ascii(F.substring(e, at + 1, n)))
    rows = _slots(blocks.where(F.col("chunk").between(first_block, first_block + count - 1)), ["path", "chunk"], "data", 0, 32, 16)
    named = rows.select("path", bits.uint(e, 0, 1).alias("user"), F.concat_ws(".", text(1, 8), F.when(text(9, 3) != "", text(9, 3))).alias("name"), bits.uint(e, 15, 1).alias("records")).where("user < 16")
    return named.groupBy("path", "user", "name").agg(F.count("*").alias("extents"), F.sum("records").alias("records"))


def apple_partitions(blocks: DataFrame) -> DataFrame:
    """(path, part, start, count, name, kind) of Apple partition maps: a block for each
    partition from block 1 on, as many as the first says."""
    d = F.col("data")
    maps = blocks.where((F.col("chunk") >= 1) & (F.hex(F.substring(d, 1, 2)) == "504D"))
    size = maps.where("chunk = 1").select("path", bits.uint(d, 4, 4, big=True).alias("parts"))
    text = lambda at: F.substring_index(charsets.decoded(F.substring(d, at + 1, 32)), "\0", 1)
    return maps.join(size, "path").where("chunk <= parts").select("path", F.col("chunk").alias("part"), bits.uint(d, 8, 4, big=True).alias("start"), bits.uint(d, 12, 4, big=True).alias("count"), text(16).alias("name"), text(48).alias("kind"))


def partition_blocks(blocks: DataFrame, partitions: DataFrame, width: int = 4096) -> DataFrame:
    """(path, part, chunk, data): the blocks of each partition, numbered from its start.
    The range join is an equi-join on image and bins of so many blocks."""
    last = F.col("start") + F.col("count") - 1
    spread = partitions.where("count > 0").select("path", "part", "start", "count", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))).alias("bin"))
    hit = F.col("chunk").between(F.col("start"), last)
    return blocks.withColumn("bin", F.floor(F.col("chunk") / width)).join(spread, ["path", "bin"]).where(hit).select("path", "part", (F.col("chunk") - F.col("start")).alias("chunk"), "data")

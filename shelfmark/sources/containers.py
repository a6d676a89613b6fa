"""Container files as DataFrames: what they are, what they hold, and their blocks.

Files are read by Spark's binaryFile source, so any store works that Spark reads.  Kinds,
header fields and blocks come from byte expressions; only member lists of zip files are
parsed in Python, a batch of files at a time.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits

BLOCK = 512

# Fixed values: (extensions, kinds that they suggest, the likeliest first, the order of
# sectors that they hint at, whether files may be created under them).
EXTENSION_ROWS = (
    (("co",), ("sectors",), "cpm", True),
    (("do", "d13"), ("sectors",), "dos", True),
    (("po", "iso", "hdv"), ("sectors",), "prodos", True),
    (("img",), ("sectors", "diskcopy", "dart"), "physical", False),
    (("dsk",), ("sectors", "diskcopy"), "dos", True),
    (("nib",), ("nibbles",), "physical", True),
    (("nb2",), ("nibbles",), "physical", False),
    (("raw",), ("sectors", "nibbles"), "dos", False),
    (("woz",), ("woz",), "physical", True),
    (("moof",), ("moof",), "physical", True),
    (("2mg", "2img"), ("2img",), None, True),
    (("dart",), ("dart",), "prodos", True),
    (("dc", "dc42", "dc6", "image"), ("diskcopy", "sectors", "dart"), "prodos", True),
    (("app",), ("trackstar",), "physical", True),
    (("zip",), ("zip",), None, True),
    (("shk", "sdk"), ("nufx",), None, True),
    (("bxy", "sea", "bse"), ("nufx",), None, False),
    (("bny", "bqy"), ("binary2",), None, True),
    (("acu",), ("applelink",), None, True),
    (("wav",), ("audio",), None, True),
    (("gz",), ("gzip",), None, True),
    (("as",), ("applesingle",), None, True),
    (("macbin",), ("macbinary",), None, True),
    (("ddd",), ("ddd",), "physical", True),
)
EXTENSIONS = {e: (kinds, order, create) for many, kinds, order, create in EXTENSION_ROWS for e in many}

# Fixed values: (kind, byte place, hex digits) of signatures.
SIGNATURES = (
    ("zip", 0, "504B0304"), ("zip", 0, "504B0506"), ("gzip", 0, "1F8B"), ("2img", 0, "32494D47"), ("nufx", 0, "4E F5 46 E9 6C E5".replace(" ", "")),
    ("woz", 0, "574F5A31FF0A0D0A"), ("woz", 0, "574F5A32FF0A0D0A"), ("moof", 0, "4D4F4F46FF0A0D0A"), ("applesingle", 0, "00051600"), ("appledouble", 0, "00051607"), ("binary2", 0, "0A474C"), ("audio", 0, "52494646"),
)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length, content) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length", "content")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _by_extension(ext: Column, value: Callable) -> Column:
    return F.create_map(*[x for e, row in EXTENSIONS.items() for x in (F.lit(e), value(row))])[F.lower(ext)]


def kinds_of_extension(ext: Column) -> Column:
    """Kinds that an extension suggests, in order; none is an empty list."""
    return F.coalesce(_by_extension(ext, lambda r: F.array(*map(F.lit, r[0]))), F.array().cast("array<string>"))


def order_of_extension(ext: Column) -> Column:
    """The sector order that an extension hints at; null for none."""
    return _by_extension(ext, lambda r: F.lit(r[1]).cast("string"))


def creatable(ext: Column) -> Column:
    """Whether files of this extension may be created; false for an unknown one."""
    return F.coalesce(_by_extension(ext, lambda r: F.lit(r[2])), F.lit(False))


def kind_of_content(content: Column) -> Column:
    """The kind whose signature the bytes carry; `sectors` for a whole number of blocks
    without one; else null."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, at, digits in SIGNATURES:
        out = out.when(F.hex(F.substring(content, at + 1, len(digits) // 2)) == digits, kind)
    return out.when((F.octet_length(content) > 0) & (F.octet_length(content) % BLOCK == 0), "sectors")


def identified(files: DataFrame) -> DataFrame:
    """files with kind: the first kind of the extension that the content agrees with, else
    the content's own, which is tried last."""
    own = kind_of_content(F.col("content"))
    said = kinds_of_extension(extension(F.col("path")))
    agreed = F.element_at(F.filter(said, lambda k: k == own), 1)
    return files.withColumn("kind", F.coalesce(F.when(F.size(F.filter(said, lambda k: k == own)) > 0, agreed), own))


def image_headers(files: DataFrame) -> DataFrame:
    """Fields of 2IMG headers: format (0 DOS order, 1 ProDOS order, 2 nibbles), place and
    length of the data, volume number if the header has one, and whether all fit."""
    c = F.col("content")
    field = lambda at, n: bits.uint(c, at, n)
    rows = files.where(kind_of_content(c) == "2img").select("path", F.decode(F.substring(c, 5, 4), "ISO-8859-1").alias("creator"), field(8, 2).alias("header_len"), field(12, 4).alias("format"), field(16, 4).alias("flags"), field(20, 4).alias("blocks"), field(24, 4).alias("data_start"), field(28, 4).alias("data_len"), F.octet_length(c).alias("length"))
    volume = F.when(F.col("flags").bitwiseAND(F.lit(0x100)) != 0, F.col("flags").bitwiseAND(F.lit(0xFF)))
    return rows.withColumn("volume", volume).withColumn("fits", F.col("data_start") + F.col("data_len") <= F.col("length"))


def chunks(files: DataFrame, *, keep_zero: bool = False) -> DataFrame:
    """(path, chunk, data): blocks of raw images and of 2IMG files.  Blocks of zeros are
    left out, as holes of sparse files are, unless asked for."""
    c = F.col("content")
    start = F.when(kind_of_content(c) == "2img", bits.uint(c, 24, 4)).otherwise(0).cast("int")
    size = F.when(kind_of_content(c) == "2img", bits.uint(c, 28, 4)).otherwise(F.octet_length(c)).cast("int")
    rows = files.select("path", "content", start.alias("start"), F.floor(size / BLOCK).cast("int").alias("n")).where("n > 0")
    cut = rows.select("path", "content", "start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk")).select("path", "chunk", F.substring("content", F.col("start") + F.col("chunk") * BLOCK + 1, F.lit(BLOCK)).alias("data"))
    return cut if keep_zero else cut.where(~bits.all_zero(F.col("data")))


def members(files: DataFrame) -> DataFrame:
    """(path, ordinal, name, is_dir, data_len, data_size, crc32, method, good) of the
    members of zip and gzip files.  good: the data unpack to the checksum.  A file that
    can't be read has one row with a null name and good false; nothing is raised."""

    def of(path: str, data: bytes) -> list[tuple]:
        try:
            if data[:2] == b"\x1f\x8b":
                plain = zlib.decompress(data, 31)
                return [(path, 0, path.rsplit("/", 1)[-1].removesuffix(".gz"), False, len(plain), len(data), zlib.crc32(plain), 8, True)]
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                rows = []
                for i, e in enumerate(z.infolist()):
                    try:
                        good = zlib.crc32(z.read(e)) == e.CRC
                    except Exception:  # a damaged member is a row, not a failed job
                        good = False
                    rows.append((path, i, e.filename, e.is_dir(), e.file_size, e.compress_size, e.CRC, e.compress_type, good))
                return rows
        except Exception:  # nor is a damaged file
            return [(path, 0, None, False, None, None, None, None, False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "ordinal", "name", "is_dir", "data_len", "data_size", "crc32", "method", "good"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        for batch in batches:
            rows = [r for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in of(p, c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    packed = files.where(kind_of_content(F.col("content")).isin("zip", "gzip")).select("path", "content")
    return packed.mapInArrow(run, "path string, ordinal int, name string, is_dir boolean, data_len long, data_size long, crc32 long, method int, good boolean")


"""Helpers that several operators of this package share.

Batches of texts come as Arrow columns; words are found and hashed with numpy over
about a megabyte of text at once, so that no step pays a Python call for each word.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text and rows that JVM and Python workers exchange at once.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

#: Separators of the contracts' plain words: space and \\x09 to \\x0D.
PLAIN = bytes(32 if 9 <= i <= 13 else i for i in range(256))
#: The same with A-Z lower-cased.
PLAIN_LOWER = PLAIN.lower()
#: Words of ASCII letters, digits and all other code points from 0x80 on, lower-cased.
ALNUM_LOWER = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, whatever the length of the texts, and
    let workers import this package from where the driver found it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.  Where none is set, a local session gets one of
    its own; on a cluster that would part the executors, so it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        there = spark.conf.get("spark.checkpoint.dir", None)
        if not there:
            if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            there = tempfile.mkdtemp(prefix="shelfmark-checkpoint-")
        sc.setCheckpointDir(there)
    return sc.getCheckpointDir()


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends there, and
    work that several later steps need is done once.  Dropped as the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shelfmark_path = path
    return out


def forget(table: DataFrame) -> None:
    """Drop a table of written() that no later step reads."""
    _drop(table.sparkSession, table._shelfmark_path)


def slot(doc: Column) -> tuple[Column, Column]:
    """(number, bit) of a doc in bits_of()."""
    return F.shiftrightunsigned(F.xxhash64(doc), 44).cast("int"), F.xxhash64(doc).bitwiseAND(63).cast("int")


def bits_of(need: DataFrame) -> DataFrame:
    """(slot, bits): the docs of need (doc) as bits of 2**20 numbers, one by a hash each.
    They are sent to every task: some 40 MB at most, however many docs there are."""
    at, bit = slot(F.col("doc"))
    return need.groupBy(at.alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))


def only(rows: DataFrame, need: DataFrame) -> DataFrame:
    """The rows whose doc is among those of need, and few others, so that a join on doc need
    not shuffle all of them."""
    at, bit = slot(F.col("doc"))
    held = rows.withColumn("slot", at).join(F.broadcast(bits_of(need)), "slot")
    return held.where(F.bit_get("bits", bit) == 1).select(*rows.columns)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """run, giving memory back to the system as it ends: workers live on, and what one
    stage held would else count against the next."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of each text."""
    return column.cast(pa.large_binary()).to_pylist()


def powers(n: int) -> np.ndarray:
    """Powers of the word hash's base, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        out = np.full(size, _BASE, np.uint64)
        out[0] = 1
        _powers[:] = [np.cumprod(out, dtype=np.uint64)]
    return _powers[0]


_inverse: list[np.ndarray] = []


def _inverses(n: int) -> np.ndarray:
    if not _inverse or len(_inverse[0]) < n:
        size = max(n, 1 << 20)
        out = np.full(size, _BASE_INV, np.uint64)
        out[0] = 1
        _inverse[:] = [np.cumprod(out, dtype=np.uint64)]
    return _inverse[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (splitmix64's finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(texts: list[bytes | None], table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, words of each text): byte ranges in the texts joined by a
    space, 64-bit hashes and counts.  table: translates bytes; 32 then separates."""
    joined = b" ".join(t or b"" for t in texts).translate(table)
    raw = np.frombuffer(joined, np.uint8)
    lengths = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.not_equal(raw, 32, out=inside[1:-1].view(bool))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw.astype(np.uint64) * powers(len(raw))[: len(raw)], out=sums[1:], dtype=np.uint64)
    h = (sums[end] - sums[start]) * _inverses(len(raw))[start]
    h = mix(h ^ ((end - start).astype(np.uint64) << np.uint64(48)))
    ends = np.cumsum(lengths + 1) - 1
    upto = np.searchsorted(start, ends)
    return start, end, h, np.diff(upto, prepend=0)


def chunks(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about that many bytes, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n + 1
    if at < len(texts):
        yield at, len(texts)


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of k words that lies in one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    text_end = np.repeat(np.cumsum(counts), counts)[:n]
    at = np.flatnonzero(np.arange(n) + k <= text_end)
    return mix(out[at]), at


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text, the 64 bits that are 1 in over half of its hashes (none: 0)."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
    # Counts are kept in lanes of 16 bits, so at most 65,535 hashes are summed at once.
    cut = np.unique(np.concatenate([first] + [np.arange(a, a + n, 65535) for a, n in zip(first, counts[full], strict=True) if n > 65535]))
    owner = np.searchsorted(first, cut, side="right") - 1
    lanes, need = np.uint64(0x0001000100010001), counts[full].astype(np.int64)
    got = np.zeros(len(full), np.uint64)
    for s in range(16):
        part = np.add.reduceat((h >> np.uint64(s)) & lanes, cut)
        for lane in range(4):
            ones = np.zeros(len(full), np.int64)
            np.add.at(ones, owner, ((part >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
            got |= (2 * ones > need).astype(np.uint64) << np.uint64(16 * lane + s)
    out[full] = got
    return out

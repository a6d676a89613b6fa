"""Allocation maps, ranges and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


#: Rows up to which a dimension table is broadcast.
FEW_ROWS = 10_000


def usage(claims: DataFrame, bitmap: DataFrame) -> DataFrame:
    """(chunk, owner, marked, n_claims, conflict) of every chunk that is claimed or marked.

    claims: (chunk, owner, scan_ordinal), the first claimant owns; bitmap: (chunk, marked).
    Claims are summed up before the join, so a chunk claimed often stays one row.
    """
    first = claims.groupBy("chunk").agg(F.min_by("owner", "scan_ordinal").alias("owner"), F.count("*").alias("n_claims"))
    return first.join(bitmap, "chunk", "full").select("chunk", "owner", F.coalesce("marked", F.lit(False)).alias("marked"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), (F.coalesce("n_claims", F.lit(0)) > 1).alias("conflict"))


def usage_counts(used: DataFrame) -> DataFrame:
    free = F.col("n_claims") == 0
    return used.agg(F.count_if("marked").alias("marked"), F.count_if(F.col("marked") & free).alias("unused_marked"), F.count_if(~F.col("marked") & ~free).alias("used_unmarked"), F.count_if("conflict").alias("conflicts"))


def ranges(values: DataFrame, column: str, *by: str) -> DataFrame:
    """(*by, low, high, n) of runs of consecutive integers.

    Runs are found within blocks of 2**16 values.  Only runs that reach a block's border
    can go on in the next block; there are two of them in a block at most, and only they
    are put in one order.
    """
    distinct = values.select(*by, F.col(column).cast("long").alias("v")).where("v is not null").distinct().withColumn("b", F.shiftright("v", 16))
    inside = W.Window.partitionBy(*by, "b").orderBy("v")
    runs = distinct.withColumn("g", F.col("v") - F.row_number().over(inside)).groupBy(*by, "b", "g").agg(F.min("v").alias("low"), F.max("v").alias("high")).select(*by, "low", "high")
    low_bits = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFF))
    border = (low_bits("low") == 0) | (low_bits("high") == 0xFFFF)
    order = (W.Window.partitionBy(*by) if by else W.Window).orderBy("low")
    open_ = runs.where(border).withColumn("new", F.when(F.lag("high").over(order) + 1 == F.col("low"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
    joined = open_.groupBy(*by, "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).select(*by, "low", "high")
    return runs.where(~border).unionByName(joined).select(*by, "low", "high", (F.col("high") - F.col("low") + 1).alias("n"))


def within_partitions(chunks: DataFrame, partitions: DataFrame, width: int = 1024) -> DataFrame:
    """Chunks with the partition that holds them: chunks (chunk, ...), partitions (part,
    start, count).  The range join is an equi-join on bins of so many chunks; a partition
    is repeated for each bin it touches."""
    last = F.col("start") + F.col("count") - 1
    spread = partitions.where("count > 0").select("part", "start", "count", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))).alias("bin"))
    hit = (F.col("chunk") >= F.col("start")) & (F.col("chunk") <= last)
    return chunks.withColumn("bin", F.floor(F.col("chunk") / width)).join(spread, "bin").where(hit).drop("bin")


def described(rows: DataFrame, table: DataFrame, kind: str, aux: str) -> DataFrame:
    """rows with the description of their type: of the table's ranges (type, low, high,
    pos, description) that hold, the one with the highest pos.  Distinct keys are joined by
    type, with the range as a further condition; the table is broadcast where it is small."""
    keys = rows.select(kind, aux).distinct()
    small = table.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    hits = keys.join(F.broadcast(table) if small else table, (keys[kind] == table["type"]) & keys[aux].between(table["low"], table["high"]))
    best = hits.groupBy(kind, aux).agg(F.max_by("description", "pos").alias("description"))
    return rows.join(best, [kind, aux], "left")


def defragmented(extents: DataFrame, by: list[str], order: str, length: str, first: int = 0) -> DataFrame:
    """extents with new_start: where each begins when all lie one after another."""
    before = W.Window.partitionBy(*by).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    return extents.withColumn("new_start", F.lit(first) + F.coalesce(F.sum(length).over(before), F.lit(0)))


def copied_blocks(source: DataFrame, target: DataFrame, start: int, to: int, count: int) -> DataFrame:
    """target chunks (chunk, data) with count of source's, from start on, written at to."""
    new = source.where(F.col("chunk").between(start, start + count - 1)).select((F.col("chunk") - start + to).alias("chunk"), "data")
    return target.where(~F.col("chunk").between(to, to + count - 1)).unionByName(new)


def written_blocks(target: DataFrame, patches: DataFrame, limit: int | None = None) -> DataFrame:
    """target chunks (chunk, data) with those of patches in their place; patches outside the
    first limit chunks are refused and leave the target as it is."""
    new = patches if limit is None else patches.where(F.col("chunk").between(0, limit - 1))
    return target.join(new.select("chunk"), "chunk", "left_anti").unionByName(new.select(*target.columns))


def replaced_partition(target: DataFrame, source: DataFrame, start: int, count: int) -> DataFrame:
    """target chunks (chunk, data) with a partition's overwritten by a whole image; of the
    partition what lies past a smaller image's end stays.  A larger image raises an error."""
    top = source.agg(F.max("chunk").alias("top"))
    if (top.first()["top"] or 0) >= count:
        raise ValueError(f"the image does not fit in {count} chunks")
    return written_blocks(target, source.withColumn("chunk", F.col("chunk") + start))


def data_lengths(extents: DataFrame, by: list[str], length: str, hole: Column) -> DataFrame:
    """(*by, stored): the length of what is not a hole; zero where all is."""
    return extents.groupBy(*by).agg(F.coalesce(F.sum(F.when(~hole, F.col(length))), F.lit(0)).cast("long").alias("stored"))


def hex_rows(rows: DataFrame, key: str, data: Column, width: int = 16) -> DataFrame:
    """(key, address, bytes, shown): a row for each so many bytes, in hex and as text, dots
    for what can't be shown."""
    # One pass over each value's digits, so that no row carries the whole value.
    digits = F.regexp_extract_all(F.hex(data), F.lit(f".{{1,{2 * width}}}"), F.lit(0))
    cut = rows.where(F.octet_length(data) > 0).select(key, F.posexplode(digits).alias("i", "part"))
    shown = F.regexp_replace(F.decode(F.unhex("part"), "ISO-8859-1"), r"[^\x20-\x7e]", ".")
    return cut.select(key, F.lower(F.lpad(F.hex(F.col("i").cast("long") * width), 6, "0")).alias("address"), F.lower("part").alias("bytes"), shown.alias("shown"))


def records(rows: DataFrame, key: str, text: Column, length: int) -> DataFrame:
    """(key, record, value): texts cut into records of a fixed length."""
    # One pass over each text, where substring would count from its start for each record.
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{length}}}"), F.lit(0))
    return rows.select(key, F.posexplode(parts).alias("record", "value"))


# Physical place of each logical sector of a track, by order.
SKEW = {
    "physical": (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15),
    "dos": (0, 13, 11, 9, 7, 5, 3, 1, 14, 12, 10, 8, 6, 4, 2, 15),
    "prodos": (0, 2, 4, 6, 8, 10, 12, 14, 1, 3, 5, 7, 9, 11, 13, 15),
    "cpm": (0, 3, 6, 9, 12, 15, 2, 5, 8, 11, 14, 1, 4, 7, 10, 13),
}


def reordered(sector: Column, source: str, target: str) -> Column:
    """The number that a sector of one order has in another."""
    inverse = [SKEW[target].index(i) for i in SKEW[source]]
    return F.element_at(F.array(*map(F.lit, inverse)), sector + 1)

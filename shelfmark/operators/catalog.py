"""Scans, listings and overlays of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import formats, paths
from .lineage import cut


def listing(entries: DataFrame, path: str = "path") -> DataFrame:
    """Paths alone, control characters made visible."""
    return entries.select(paths.printable(F.col(path)).alias("path"))


def catalog(entries: DataFrame, *, wide: bool = False) -> DataFrame:
    """Type, auxiliary type, date, lengths, format and name of entries; wide adds the
    attributes and the compression percentage.  Damaged or doubtful entries carry `!`."""
    bad = F.col("is_damaged") | F.col("is_dubious") if {"is_damaged", "is_dubious"} <= set(entries.columns) else F.lit(False)
    shown = F.when(bad, F.concat(F.lit("!"), "data_fmt")).otherwise(F.col("data_fmt"))
    narrow = [F.col("container_id"), F.col("ordinal"), paths.printable(F.col("path")).alias("path"), formats.hex_value(F.col("file_type"), 2).alias("type"), formats.hex_value(F.col("aux_type"), 4).alias("aux"), F.col("data_len"), shown.alias("format")]
    more = [formats.access_letters(F.col("access")).alias("access"), formats.date_text(F.col("mod_when")).alias("modified"), formats.size_text(F.col("data_len"), 512).alias("length"), formats.comp_percent(F.col("data_size"), F.col("data_len")).alias("percent"), F.coalesce("rsrc_len", F.lit(0)).alias("rsrc_len")]
    return entries.select(*narrow, *(more if wide else []))


def best_format(data_fmt: Column, rsrc_fmt: Column) -> Column:
    """The data fork's format; the resource fork's, if that is known, where the data fork's
    is unknown or plain."""
    known = F.when(data_fmt != "unknown", data_fmt)
    return F.coalesce(F.when((rsrc_fmt != "unknown") & (known.isNull() | (known == "plain")), rsrc_fmt), known, F.lit("unknown"))


def overlay(entries: DataFrame, sidecars: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Attributes of a sidecar, where there is one and it has them, before the entry's own.
    A left equi-join on a unique key: entries without a sidecar stay, sidecars without an
    entry do not count."""
    side = sidecars.select(key, *[F.col(c).alias(f"_side_{c}") for c in columns])
    joined = entries.join(side, key, "left")
    return joined.select(*[F.coalesce(f"_side_{c}", c).alias(c) if c in columns else F.col(c) for c in entries.columns])


def glob_filter(entries: DataFrame, patterns: list[str], path: str = "path", *, subtree: bool = True) -> DataFrame:
    """Entries that a pattern matches; subtree: a matched directory brings all below it."""
    return entries.where(paths.matches_any(F.col(path), patterns, prefix=subtree))


def unmatched(entries: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """(pattern, used): whether each pattern matches anything, in one pass."""
    hits = entries.agg(*[F.coalesce(F.max(paths.matches(F.col(path), p, prefix=True)), F.lit(False)).alias(f"p{i}") for i, p in enumerate(patterns)])
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"p{i}").alias("used")) for i, p in enumerate(patterns)])
    return hits.select(F.explode(rows).alias("r")).select("r.*")


def find(entries: DataFrame, needle: str, name: str, order: str, after: int, *, back: bool = False) -> DataFrame:
    """The next (previous) entry whose name holds needle, whatever the case, past a place
    in order; beyond the end the search goes on from the other."""
    hits = entries.where(F.contains(F.lower(F.col(name)), F.lit(needle.lower())))
    ahead = F.col(order) < after if back else F.col(order) > after
    way = F.desc if back else F.asc
    return hits.orderBy(F.when(ahead, 0).otherwise(1), way(order)).limit(1)


def flatten(roots: DataFrame, levels: list[DataFrame], depth: int) -> DataFrame:
    """(id, parent, path, depth) of a tree given level by level.

    roots: (id, name); levels: (id, parent, name) from the top down, of which at most
    `depth` are opened.
    """
    now = roots.select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("name").alias("path"), F.lit(0).alias("depth"))
    out = now
    for i, rows in enumerate(levels[:depth], 1):
        up = now.select(F.col("id").alias("parent"), F.col("path").alias("up"))
        now = rows.select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"), "name").join(up, "parent").select("id", "parent", F.concat_ws("/", "up", "name").alias("path"), F.lit(i).alias("depth"))
        out = out.unionByName(now)
    return out


def missing_directories(entries: DataFrame, path: str = "path") -> DataFrame:
    """Directories that entries lie in but that are not entries themselves."""
    above = entries.select(F.explode(paths.ancestors(F.col(path))).alias("path")).distinct()
    return above.join(entries.select(F.col(path).alias("path")), "path", "left_anti")


def moved(entries: DataFrame, source: str, target: str, path: str = "path") -> DataFrame:
    """Entries with a file or a subtree renamed."""
    hit = (F.col(path) == source) | F.startswith(F.col(path), F.lit(source + "/"))
    return entries.withColumn(path, F.when(hit, F.concat(F.lit(target), F.expr(f"substring(`{path}`, {len(source) + 1})"))).otherwise(F.col(path)))


def attributes_set(entries: DataFrame, patterns: list[str], values: dict, path: str = "path") -> DataFrame:
    """Entries with attributes replaced where a pattern matches."""
    hit = paths.matches_any(F.col(path), patterns, prefix=True)
    return entries.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def upserted(target: DataFrame, source: DataFrame, key: str, *, overwrite: bool = True) -> DataFrame:
    """Rows of both; of a key that both have, the source's (the target's without overwrite)."""
    low, high = (target, source) if overwrite else (source, target)
    return low.join(high.select(key), key, "left_anti").unionByName(high)


def ranked(candidates: DataFrame, by: list[str], score: str, priority: str, *, stop: int | None = None) -> DataFrame:
    """The best candidate of each group: highest score, then lowest priority.  stop: a
    search in order of priority ends at the first candidate with so high a score, so later
    ones don't count."""
    if stop is not None:
        seen = W.Window.partitionBy(*by).orderBy(priority).rowsBetween(W.Window.unboundedPreceding, -1)
        past = F.coalesce(F.max(F.when(F.col(score) >= stop, 1)).over(seen), F.lit(0))
        candidates = candidates.withColumn("_past", past).where("_past = 0").drop("_past")
    best = W.Window.partitionBy(*by).orderBy(F.desc(score), F.asc(priority))
    return candidates.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place in each group's order, from 1.  Groups of any size: rows are
    dealt by ranges of (by, order), numbered within a range, and moved on by what earlier
    ranges hold of the group.  The ranges are written before they are counted, so both
    passes see the same ones.  Rows that tie wholly have places in any order; nulls go first."""
    keys = [f"_k{i}" for i in range(len(order))]
    dealt = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*by, *keys)
    dealt = cut(dealt.withColumn("_range", F.spark_partition_id()))
    # One row for each group and range it reaches into: as many as ranges and groups.
    held = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = W.Window.partitionBy(*by).orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)
    moved_on = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_range"]]
    inside = W.Window.partitionBy(*by, "_range").orderBy(*keys)
    out = dealt.withColumn("_place", F.row_number().over(inside)).alias("a").join(moved_on.alias("b"), same)
    return out.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("_place") + F.col("_before")).alias(name))


def opens(parent: Column, child: Column, depth: str) -> Column:
    """Whether a nested container is opened.  parent: zip, gzip, nufx, archive, filesystem
    or multipart; child: file, archive, image, part or embed; depth: `shallow`, `subvol`
    or `max`.  Files that may turn out to be containers are `file`."""
    if depth == "max":
        return F.lit(True)
    wrapped = (parent == "gzip") | ((parent == "nufx") & (child == "part"))
    if depth == "shallow":
        return wrapped | ((parent == "nufx") & (child == "file"))
    volume = (parent == "multipart") | (parent.isin("zip", "archive") & (child == "image")) | ((parent == "filesystem") & (child == "embed"))
    return F.when(child == "file", parent != "filesystem").otherwise(wrapped | volume)


def add_set(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, data_path, rsrc_path) of host files to add: a file and its header file are one
    entry.  A header's name is the file's with `._` before it, else `%` before it, else
    `.rsrc` after it, in the same directory; the first that is there is taken.  A header
    without a file is an entry with no data; a file without a header has no rsrc_path."""
    name, folder = paths.file_name(F.col(path)), paths.directory_name(F.col(path))
    rows = files.select(F.col(path).alias("p"), folder.alias("folder"), name.alias("name"))
    size = F.length("name")
    rule = F.when(F.startswith("name", F.lit("._")) & (size > 2), 0).when(F.startswith("name", F.lit("%")) & (size > 1), 1).when(F.col("name").rlike(r"(?i).\.rsrc$"), 2)
    short = F.expr("CASE rule WHEN 0 THEN substring(name, 3) WHEN 1 THEN substring(name, 2) ELSE left(name, length(name) - 5) END")
    ruled = rows.withColumn("rule", rule)
    heads = ruled.where("rule is not null").withColumn("name", short).groupBy("folder", "name").agg(F.min_by("p", F.struct("rule", "p")).alias("rsrc_path"))
    data = ruled.where("rule is null").select("folder", "name", F.col("p").alias("data_path"))
    whole = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
    return data.join(heads, ["folder", "name"], "full").select(whole.alias("path"), "data_path", "rsrc_path")

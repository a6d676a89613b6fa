"""Queries over the given tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, charsets, dates, formats, labels, names, paths
from ..operators import catalog as C
from ..operators import chunks as K
from ..operators.lineage import cut
from ..sources import archives, containers, volumes
from .entries import DOCUMENT_ENTRIES, bitmap, claims, document_entries, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


E_ = f"WITH e AS ({DOCUMENT_ENTRIES})"


@registered("list_paths", f"{E_} SELECT ordinal, path FROM e")
def list_paths(spark, sf_dir):
    return document_entries(spark, sf_dir).select("ordinal", paths.printable(F.col("path")).alias("path"))


@registered(
    "catalog_wide",
    f"""{E_}
SELECT container_id, ordinal, path, '$' || printf('%02x', file_type) AS "type", '$' || CASE WHEN aux_type < 65536 THEN printf('%04x', aux_type) END AS aux, data_len,
  CASE WHEN toxic = 1 THEN '!' || lang ELSE lang END AS format,
  CASE WHEN access & 128 > 0 THEN 'd' ELSE '' END || CASE WHEN access & 64 > 0 THEN 'n' ELSE '' END || CASE WHEN access & 32 > 0 THEN 'b' ELSE '' END
    || CASE WHEN access & 16 > 0 THEN '?' ELSE '' END || CASE WHEN access & 8 > 0 THEN '?' ELSE '' END || CASE WHEN access & 4 > 0 THEN 'i' ELSE '' END || CASE WHEN access & 2 > 0 THEN 'w' ELSE '' END || CASE WHEN access & 1 > 0 THEN 'r' ELSE '' END AS access,
  '[No Date]' AS modified,
  data_len // 512 || ' block' || CASE WHEN data_len // 512 = 1 THEN '' ELSE 's' END AS length,
  CASE WHEN data_len = 0 AND data_size = 0 THEN '--%' WHEN data_len = 0 THEN '0%' WHEN round_even(data_size * 100.0 / data_len, 0) > 999 THEN '999%'
    ELSE round_even(data_size * 100.0 / data_len, 0)::BIGINT || '%' END AS percent,
  coalesce(quality, 0)::BIGINT AS rsrc_len
FROM e LEFT JOIN labels ON e.ordinal = labels.doc_id""",
)
def catalog_wide(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ordinal"), F.col("quality").cast("long").alias("rsrc_len"), (F.col("toxic") == 1).alias("is_damaged"))
    entries = document_entries(spark, sf_dir).withColumn("data_fmt", F.col("lang")).join(labels, "ordinal", "left")
    entries = entries.withColumn("is_damaged", F.coalesce("is_damaged", F.lit(False))).withColumn("is_dubious", F.lit(False)).withColumn("mod_when", F.lit(None).cast("timestamp_ntz"))
    return C.catalog(entries, wide=True)


@registered("catalog_narrow", f"""{E_} SELECT container_id, ordinal, path, '$' || printf('%02x', file_type) AS "type", '$' || printf('%04x', aux_type) AS aux, data_len, lang AS format FROM e""")
def catalog_narrow(spark, sf_dir):
    return C.catalog(document_entries(spark, sf_dir).withColumn("data_fmt", F.col("lang")))


@registered("glob_filter", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(?:[^/]*e[^/]*BOLT|.ed[^/]*)$', 'is')")
def glob_filter(spark, sf_dir):
    return C.glob_filter(table(spark, sf_dir, "part"), ["*e*BOLT", "?ed*"], "p_name", subtree=False).select("p_partkey", "p_name")


@registered("glob_subtree", f"{E_} SELECT ordinal, path FROM e WHERE regexp_matches(path, '^(?:src1./(?:de|fr)|src2/en/[^/]*7)(?:/.*)?$', 'is')")
def glob_subtree(spark, sf_dir):
    return C.glob_filter(document_entries(spark, sf_dir), ["src1?/de", "SRC1?/fr/", "src2/en/*7"]).select("ordinal", "path")


@registered("glob_unmatched", "SELECT * FROM (VALUES ('*bolt'), ('no such*'), ('?ed*')) AS t(pattern), LATERAL (SELECT coalesce(bool_or(regexp_matches(p_name, CASE pattern WHEN '*bolt' THEN '^[^/]*bolt(/.*)?$' WHEN 'no such*' THEN '^no such[^/]*(/.*)?$' ELSE '^.ed[^/]*(/.*)?$' END, 'is')), false) AS used FROM part)")
def glob_unmatched(spark, sf_dir):
    return C.unmatched(table(spark, sf_dir, "part"), ["*bolt", "no such*", "?ed*"], "p_name")


@registered("find_next", "SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey <= 100, p_partkey) AS n FROM part WHERE contains(lower(p_name), 'e b')) WHERE n = 1")
def find_next(spark, sf_dir):
    return C.find(table(spark, sf_dir, "part"), "E b", "p_name", "p_partkey", 100).select("p_partkey", "p_name")


@registered("find_previous", "SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey >= 3, p_partkey DESC) AS n FROM part WHERE contains(lower(p_name), 'e b')) WHERE n = 1")
def find_previous(spark, sf_dir):
    return C.find(table(spark, sf_dir, "part"), "E b", "p_name", "p_partkey", 3, back=True).select("p_partkey", "p_name")


@registered("sidecar_overlay", f"{E_} SELECT ordinal, path, coalesce(quality + 1000, e.data_len)::BIGINT AS data_len, coalesce(toxic, e.file_type)::SMALLINT AS file_type FROM e LEFT JOIN labels ON ordinal = doc_id")
def sidecar_overlay(spark, sf_dir):
    side = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ordinal"), (F.col("quality") + 1000).cast("long").alias("data_len"), F.col("toxic").cast("short").alias("file_type"))
    return C.overlay(document_entries(spark, sf_dir), side, "ordinal", ["data_len", "file_type"]).select("ordinal", "path", "data_len", "file_type")


@registered("sidecar_names", "SELECT doc_id, '__MACOSX/' || source || '/' || lang || '/._' || doc_id AS sidecar FROM documents")
def sidecar_names(spark, sf_dir):
    return document_entries(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), paths.sidecar_path(F.col("path")).alias("sidecar"))


@registered("ext_to_kind", "SELECT page_id, ext, coalesce(kind, 'unknown') AS kind FROM (SELECT page_id, regexp_extract(url, '\\.([a-z0-9]+)(?:[/?#]|$)', 1) AS ext FROM pages) LEFT JOIN (VALUES ('com', 'commercial'), ('net', 'network'), ('org', 'organisation')) AS k(ext, kind) USING (ext)")
def ext_to_kind(spark, sf_dir):
    kinds = spark.createDataFrame([("com", "commercial"), ("net", "network"), ("org", "organisation")], "ext string, kind string")
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"\.([a-z0-9]+)(?:[/?#]|$)", 1).alias("ext"))
    return pages.join(F.broadcast(kinds), "ext", "left").select("page_id", "ext", F.coalesce("kind", F.lit("unknown")).alias("kind"))


TYPES = [(1, 0, 1000, 0, "low"), (1, 900, 1200, 1, "middle"), (2, 0, 99999, 2, "any"), (2, 1000, 1100, 3, "special"), (4, 1, 1, 4, "one")]


@registered(
    "type_range_desc",
    """WITH t(type, low, high, pos, description) AS (VALUES (1, 0, 1000, 0, 'low'), (1, 900, 1200, 1, 'middle'), (2, 0, 99999, 2, 'any'), (2, 1000, 1100, 3, 'special'), (4, 1, 1, 4, 'one')),
p AS (SELECT p_partkey, p_size % 5 AS kind, p_retailprice::INTEGER AS aux FROM part)
SELECT p_partkey, kind, aux, arg_max(description, pos) AS description FROM p LEFT JOIN t ON kind = type AND aux BETWEEN low AND high GROUP BY ALL""",
)
def type_range_desc(spark, sf_dir):
    kinds = spark.createDataFrame(TYPES, "type int, low int, high int, pos int, description string")
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).alias("kind"), F.bround("p_retailprice").cast("int").alias("aux"))
    return K.described(rows, kinds, "kind", "aux").select("p_partkey", "kind", "aux", "description")


USED = """WITH c AS (SELECT l_orderkey AS chunk, min(l_partkey) AS owner, count(*) AS n_claims FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS chunk, o_orderstatus <> 'F' AS marked FROM orders),
u AS (SELECT chunk, owner, coalesce(marked, false) AS marked, coalesce(n_claims, 0) AS n_claims, coalesce(n_claims, 0) > 1 AS conflict FROM c FULL JOIN b USING (chunk))"""


@registered("first_claimant", f"{USED} SELECT * FROM u")
def first_claimant(spark, sf_dir):
    return K.usage(claims(spark, sf_dir), bitmap(spark, sf_dir))


@registered("chunk_usage", f"{USED} SELECT count_if(marked)::BIGINT AS marked, count_if(marked AND n_claims = 0)::BIGINT AS unused_marked, count_if(NOT marked AND n_claims > 0)::BIGINT AS used_unmarked, count_if(conflict)::BIGINT AS conflicts FROM u")
def chunk_usage(spark, sf_dir):
    return K.usage_counts(K.usage(claims(spark, sf_dir), bitmap(spark, sf_dir)))


ISLANDS = "SELECT min(v) AS low, max(v) AS high, count(*) AS n FROM (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM ({})) GROUP BY g"


@registered("free_ranges", ISLANDS.format("SELECT o_orderkey AS v FROM orders WHERE o_orderstatus = 'F'"))
def free_ranges(spark, sf_dir):
    return K.ranges(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderkey")


@registered("unused_ranges", f"{USED} " + ISLANDS.format("SELECT chunk AS v FROM u WHERE marked AND n_claims = 0"))
def unused_ranges(spark, sf_dir):
    used = K.usage(claims(spark, sf_dir), bitmap(spark, sf_dir))
    return K.ranges(used.where("marked AND n_claims = 0"), "chunk")


@registered("customer_ranges", "SELECT k, min(v) AS low, max(v) AS high, count(*) AS n FROM (SELECT o_orderstatus AS k, o_orderkey AS v, o_orderkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS g FROM orders) GROUP BY k, g")
def customer_ranges(spark, sf_dir):
    return K.ranges(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "k"), "o_orderkey", "k")


@registered("integrity_counts", "SELECT l_linestatus, count(*) AS files, count_if(l_tax > 0)::BIGINT AS forks, count_if(l_discount > 0.05)::BIGINT AS failures, bool_and(l_quantity > 0) AS healthy FROM lineitem GROUP BY 1")
def integrity_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("files"), F.count_if(F.col("l_tax") > 0).alias("forks"), F.count_if(F.col("l_discount") > 0.05).alias("failures"), F.bool_and(F.col("l_quantity") > 0).alias("healthy"))


@registered("note_counts", "SELECT event_type AS level, count(*) AS n, count(DISTINCT user_id) AS sources FROM events GROUP BY 1")
def note_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("level")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("sources"))


@registered("child_counts", "SELECT n_nationkey, n_name, count(c_custkey) AS children FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def child_counts(spark, sf_dir):
    children = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("children"))
    return table(spark, sf_dir, "nation").join(children, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("children", F.lit(0)).alias("children"))


def _tree(spark, sf_dir, depth):
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations = nation.select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    customers = customer.select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    return C.flatten(region.select(key("r", "r_regionkey").alias("id"), F.col("r_name").alias("name")), [nations, customers], depth)


TREE = """WITH RECURSIVE x AS (
  SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
t AS (SELECT id, parent, name AS path, 0 AS depth FROM x WHERE parent IS NULL UNION ALL SELECT x.id, x.parent, t.path || '/' || x.name, t.depth + 1 FROM x JOIN t ON x.parent = t.id)
SELECT * FROM t WHERE depth <= {}"""


@registered("tree_flatten", TREE.format(9))
def tree_flatten(spark, sf_dir):
    return _tree(spark, sf_dir, 2)


@registered("depth_limited", TREE.format(1))
def depth_limited(spark, sf_dir):
    return _tree(spark, sf_dir, 1)


@registered("best_candidate", "SELECT o_custkey, o_orderkey, score FROM (SELECT o_custkey, o_orderkey, (o_totalprice / 1000)::BIGINT AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_totalprice / 1000)::BIGINT DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_candidate(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.bround(F.col("o_totalprice") / 1000).cast("long").alias("score"))
    return C.ranked(rows, ["o_custkey"], "score", "o_orderkey")


@registered(
    "first_good_candidate",
    """SELECT o_custkey, o_orderkey, score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS n FROM (
  SELECT *, coalesce(max((score >= 300)::INTEGER) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM (
    SELECT o_custkey, o_orderkey, (o_totalprice / 1000)::BIGINT AS score FROM orders)) WHERE past = 0) WHERE n = 1""",
)
def first_good_candidate(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.bround(F.col("o_totalprice") / 1000).cast("long").alias("score"))
    return C.ranked(rows, ["o_custkey"], "score", "o_orderkey", stop=300)


@registered("defrag_starts", "SELECT o_custkey, o_orderkey, floor(o_totalprice)::BIGINT AS length, (10 + coalesce(sum(floor(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS new_start FROM orders")
def defrag_starts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("length"))
    return K.defragmented(rows, ["o_custkey"], "o_orderkey", "length", 10)


@registered("sort_tiebreak", "SELECT c_nationkey, c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment DESC, lower(c_name) DESC) AS place FROM customer")
def sort_tiebreak(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("c_nationkey").orderBy(F.desc("c_mktsegment"), F.desc(F.lower("c_name")))
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment", F.row_number().over(order).cast("long").alias("place"))


UPSERT = "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'", "SELECT o_orderkey, o_custkey + 1000000 AS o_custkey, round(o_totalprice, 2) AS price FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"


def _halves(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))
    new = orders.where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01 00:00:00'").select("o_orderkey", (F.col("o_custkey") + 1000000).alias("o_custkey"), F.round("o_totalprice", 2).alias("price"))
    return old, new


@registered("upsert_copy", f"WITH a AS ({UPSERT[0]}), b AS ({UPSERT[1]}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def upsert_copy(spark, sf_dir):
    return C.upserted(*_halves(spark, sf_dir), "o_orderkey")


@registered("copy_no_overwrite", f"WITH a AS ({UPSERT[0]}), b AS ({UPSERT[1]}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def copy_no_overwrite(spark, sf_dir):
    return C.upserted(*_halves(spark, sf_dir), "o_orderkey", overwrite=False)


@registered("copy_collisions", f"WITH a AS ({UPSERT[0]}), b AS ({UPSERT[1]}) SELECT o_orderkey FROM b SEMI JOIN a USING (o_orderkey)")
def copy_collisions(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return new.join(old, "o_orderkey", "left_semi").select("o_orderkey")


@registered("missing_dirs", f"{E_} SELECT DISTINCT source AS path FROM e UNION SELECT DISTINCT source || '/' || lang FROM e")
def missing_dirs(spark, sf_dir):
    return C.missing_directories(document_entries(spark, sf_dir))


@registered("moved_paths", f"{E_} SELECT ordinal, CASE WHEN path LIKE 'src3/en/%' THEN 'old/english' || substr(path, 8) ELSE path END AS path FROM e")
def moved_paths(spark, sf_dir):
    return C.moved(document_entries(spark, sf_dir), "src3/en", "old/english").select("ordinal", "path")


@registered("set_attributes", f"{E_} SELECT ordinal, CASE WHEN lang = 'de' THEN 195 ELSE access END::SMALLINT AS access, CASE WHEN lang = 'de' THEN 7 ELSE aux_type END AS aux_type FROM e")
def set_attributes(spark, sf_dir):
    out = C.attributes_set(document_entries(spark, sf_dir), ["*/DE"], {"access": 195, "aux_type": 7})
    return out.select("ordinal", F.col("access").cast("short").alias("access"), "aux_type")


@registered("deleted_entries", f"{E_} SELECT ordinal, path FROM e WHERE lang <> 'fr'")
def deleted_entries(spark, sf_dir):
    entries = document_entries(spark, sf_dir)
    return entries.join(C.glob_filter(entries, ["*/fr"]).select("ordinal"), "ordinal", "left_anti").select("ordinal", "path")


@registered("difference_marked", "SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 40)")
def difference_marked(spark, sf_dir):
    claimed = table(spark, sf_dir, "lineitem").where("l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").where("p_size % 2 = 0").join(claimed, "p_partkey", "left_anti").select("p_partkey")


PERCENT = "CASE WHEN {1} = 0 AND {0} = 0 THEN '--%' WHEN {1} = 0 THEN '0%' WHEN round_even({0} * 100.0 / {1}, 0) = 0 AND {0} <> 0 THEN '<1%' WHEN round_even({0} * 100.0 / {1}, 0) > 999 THEN '999%' ELSE round_even({0} * 100.0 / {1}, 0)::BIGINT || '%' END"


@registered("comp_percent", f"SELECT l_returnflag, l_linestatus, part, whole, {PERCENT.format('part', 'whole')} AS percent FROM (SELECT l_returnflag, l_linestatus, sum(CASE WHEN l_discount > 0.05 THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS part, sum(l_quantity::BIGINT)::BIGINT AS whole FROM lineitem GROUP BY 1, 2)")
def comp_percent(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.when(F.col("l_discount") > 0.05, q).otherwise(0)).alias("part"), F.sum(q).alias("whole"))
    return rows.withColumn("percent", formats.comp_percent(F.col("part"), F.col("whole")))


@registered("size_text", "SELECT o_orderkey, CASE WHEN n < 10485760 THEN printf('%.0fKB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1fMB', n / 1048576.0) ELSE printf('%.1fGB', n / 1073741824.0) END AS size, CASE WHEN n < 10485760 THEN n // 512 || ' block' || CASE WHEN n // 512 = 1 THEN '' ELSE 's' END WHEN n < 1073741824 THEN printf('%.1fMB', n / 1048576.0) ELSE printf('%.1fGB', n / 1073741824.0) END AS blocks FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 7 + 600 AS n FROM orders)")
def size_text(spark, sf_dir):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 7 + 600
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.size_text(n).alias("size"), formats.size_text(n, 512).alias("blocks"))


@registered("date_text", "SELECT o_orderkey, strftime(o_orderdate, '%d-%b-%y %H:%M') AS text FROM orders")
def date_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.date_text(F.col("o_orderdate")).alias("text"))


@registered("prodos_pack", "SELECT o_orderkey, ((year(o_orderdate) % 100) * 512 + month(o_orderdate) * 32 + day(o_orderdate) + hour(o_orderdate) * 16777216 + minute(o_orderdate) * 65536)::BIGINT AS packed, date_trunc('minute', o_orderdate) AS back FROM orders")
def prodos_pack(spark, sf_dir):
    packed = dates.to_prodos(F.col("o_orderdate"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", packed.cast("long").alias("packed"))
    return rows.withColumn("back", dates.from_prodos(F.col("packed")))


@registered("pascal_pack", "SELECT o_orderkey, ((year(o_orderdate) % 100) * 512 + day(o_orderdate) * 16 + month(o_orderdate))::BIGINT AS packed, date_trunc('day', o_orderdate) AS back FROM orders")
def pascal_pack(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dates.to_pascal(F.col("o_orderdate")).cast("long").alias("packed"))
    return rows.withColumn("back", dates.from_pascal(F.col("packed")))


@registered("hfs_pack", "SELECT event_id, (epoch(ts)::BIGINT + 2082844800)::BIGINT AS packed, date_trunc('second', ts) AS back FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def hfs_pack(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", dates.to_hfs(F.col("ts")).cast("long").alias("packed"))
    return rows.withColumn("back", dates.from_hfs(F.col("packed")))


@registered("msdos_pack", "SELECT event_id, ((year(ts) - 1980) * 512 + month(ts) * 32 + day(ts))::BIGINT AS d, (hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2)::BIGINT AS t, date_trunc('minute', ts) + to_seconds(second(ts) // 2 * 2) AS back FROM events")
def msdos_pack(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", dates.to_msdos_date(F.col("ts")).cast("long").alias("d"), dates.to_msdos_time(F.col("ts")).cast("long").alias("t"))
    return rows.withColumn("back", dates.from_msdos(F.col("d"), F.col("t")))


@registered("gs_pack", "SELECT event_id, (second(ts) + minute(ts) * 256 + hour(ts) * 65536 + (year(ts) - 1900) * 16777216 + (day(ts) - 1) * 4294967296 + (month(ts) - 1) * 1099511627776 + (dayofweek(ts) + 1) * 72057594037927936)::BIGINT AS packed, date_trunc('second', ts) AS back FROM events")
def gs_pack(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", dates.to_gs(F.col("ts")).cast("long").alias("packed"))
    return rows.withColumn("back", dates.from_gs(F.col("packed")))


@registered("date_status", "SELECT p_partkey, p_size % 16 AS month, CASE WHEN p_size % 16 + p_size = 0 THEN 'none' WHEN p_size % 16 BETWEEN 1 AND 12 AND p_size % 30 > 0 AND p_size % 30 <= day(last_day(make_date(2001, greatest(1, least(12, p_size % 16)), 1))) THEN 'valid' ELSE 'invalid' END AS status FROM part")
def date_status(spark, sf_dir):
    packed = (F.lit(1 << 9) + (F.col("p_size") % 16) * 32 + F.col("p_size") % 30).alias("packed")
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 16).alias("month"), packed)
    return rows.select("p_partkey", "month", dates.status(F.col("packed"), dates.from_prodos(F.col("packed"))).alias("status"))


@registered("access_letters", "SELECT p_partkey, CASE WHEN p_size & 128 > 0 THEN 'd' ELSE '' END || CASE WHEN p_size & 64 > 0 THEN 'n' ELSE '' END || CASE WHEN p_size & 32 > 0 THEN 'b' ELSE '' END || CASE WHEN p_size & 16 > 0 THEN '?' ELSE '' END || CASE WHEN p_size & 8 > 0 THEN '?' ELSE '' END || CASE WHEN p_size & 4 > 0 THEN 'i' ELSE '' END || CASE WHEN p_size & 2 > 0 THEN 'w' ELSE '' END || CASE WHEN p_size & 1 > 0 THEN 'r' ELSE '' END AS letters FROM part")
def access_letters(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", formats.access_letters(F.col("p_size")).alias("letters"))


@registered("type_suffix", "SELECT p_partkey, printf('#%02x%04x', p_size, p_partkey % 65536) AS suffix FROM part")
def type_suffix(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", paths.attribute_suffix(F.col("p_size"), F.col("p_partkey") % 65536).alias("suffix"))


@registered("csv_field", """SELECT doc_id, CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) OR contains(text, chr(13)) OR text LIKE ' %' OR text LIKE '% ' THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def csv_field(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", formats.csv_field(F.col("text")).alias("field"))


@registered("newline_norm", "SELECT doc_id, text AS plain FROM documents")
def newline_norm(spark, sf_dir):
    mixed = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return table(spark, sf_dir, "documents").select("doc_id", formats.newlines(mixed).alias("plain"))


@registered("option_map", """SELECT event_id, 'k=' || json_extract_string(props, '$.k') || ',user=' || user_id AS options FROM events""")
def option_map(spark, sf_dir):
    text = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(",k="), F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", formats.option_text(formats.option_map(text)).alias("options"))


@registered("records_split", "SELECT doc_id, record::INTEGER AS record, substr(text, record * 100 + 1, 100) AS value FROM (SELECT doc_id, text, unnest(range((length(text) + 99) // 100)) AS record FROM documents)")
def records_split(spark, sf_dir):
    return K.records(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), 100)


@registered("hex_rows", """WITH r AS (SELECT item_id, i, substr(h, i * 32 + 1, 32) AS b FROM (SELECT item_id, hex(encode(text)) AS h, unnest(range((strlen(text) + 15) // 16)) AS i FROM benchmark)),
c AS (SELECT item_id, i, b, list_transform(range(length(b) // 2), lambda k: ('0x' || substr(b, k * 2 + 1, 2))::INTEGER) AS v FROM r)
SELECT item_id, printf('%06x', i * 16) AS address, lower(b) AS bytes, array_to_string(list_transform(v, lambda x: CASE WHEN x BETWEEN 32 AND 126 THEN chr(x) ELSE '.' END), '') AS shown FROM c""")
def hex_rows(spark, sf_dir):
    return K.hex_rows(table(spark, sf_dir, "benchmark"), "item_id", F.encode("text", "utf-8"))


@registered("path_parts", f"{E_} SELECT ordinal, ordinal::VARCHAR AS name, source || '/' || lang AS folder, 3 AS n_parts FROM e")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return document_entries(spark, sf_dir).select("ordinal", paths.file_name(p).alias("name"), paths.directory_name(p).alias("folder"), F.size(paths.components(p)).alias("n_parts"))


@registered("escaped_urls", "SELECT page_id, regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g') AS host_name, replace(replace(replace(replace(replace(url, '%', '%%'), '/', '%2f'), ':', '%3a'), '?', '%3f'), '*', '%2a') AS escaped, url AS back, regexp_replace(url, '[<>:\"\\\\|?*]', '_', 'g') AS host_path FROM pages")
def escaped_urls(spark, sf_dir):
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").select("page_id", url, paths.host_name(url).alias("host_name"), paths.escaped_name(url).alias("escaped"))
    return rows.select("page_id", "host_name", "escaped", paths.unescaped_name(F.col("escaped")).alias("back"), paths.host_path(url).alias("host_path"))


@registered("hex_values", "SELECT o_orderkey, CASE WHEN o_orderkey < 256 THEN printf('$%02x', o_orderkey) WHEN o_orderkey < 65536 THEN printf('$%04x', o_orderkey) ELSE printf('$%06x', o_orderkey) END AS text, o_orderkey AS back FROM orders")
def hex_values(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", formats.hex_value(F.col("o_orderkey")).alias("text"))
    return rows.withColumn("back", formats.parsed_int(F.col("text")))


@registered("size_bytes", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size * 512 WHEN 2 THEN p_size * 4096 WHEN 4 THEN p_size * 1099511627776 END::BIGINT AS bytes FROM part")
def size_bytes(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("KB", " blk ", "trk", "parsec", " TiB", "block"))), F.col("p_size") % 6 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", formats.size_bytes(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@registered("int_lists", "SELECT user_id, string_agg(event_id, ',' ORDER BY event_id) AS text, list_sum(list(event_id))::BIGINT AS total FROM events GROUP BY 1")
def int_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("a"))
    text = rows.select("user_id", formats.int_list_text(F.col("a")).alias("text"))
    return text.withColumn("total", F.aggregate(formats.text_int_list(F.col("text")), F.lit(0).cast("long"), lambda s, x: s + x))


@registered("bit_functions", "SELECT p_partkey, bit_count(p_size)::INTEGER AS ones, (32 - bit_count(p_size))::INTEGER AS zeros, (p_size & -p_size) AS lowest, bit_count((p_size & -p_size) - 1)::INTEGER AS trailing, (2 ** ceil(log2(p_size)))::BIGINT AS power, ((((p_size >> 1) | 170) * 256) + (p_size | 170))::INTEGER AS spread, p_size AS back FROM part")
def bit_functions(spark, sf_dir):
    x = F.col("p_size")
    spread = bits.four_and_four(x)
    rows = table(spark, sf_dir, "part").select("p_partkey", bits.ones(x).cast("int").alias("ones"), bits.zeros(x).cast("int").alias("zeros"), bits.lowest_one(x).alias("lowest"), bits.trailing_zeros(x).cast("int").alias("trailing"), bits.power_of_two_from(x).alias("power"), spread.cast("int").alias("spread"))
    return rows.withColumn("back", bits.from_four_and_four(F.shiftright("spread", 8), F.col("spread").bitwiseAND(F.lit(255))))


@registered("integer_reads", "SELECT item_id, ('0x' || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT AS u16, ('0x' || substr(h, 1, 8))::BIGINT AS u32_big FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark)")
def integer_reads(spark, sf_dir):
    data = F.encode("text", "utf-8")
    return table(spark, sf_dir, "benchmark").select("item_id", bits.uint(data, 0, 2).alias("u16"), bits.uint(data, 0, 4, big=True).alias("u32_big"))


@registered("charset_roundtrip", "SELECT doc_id, length(text) AS n, text AS back FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7Fäöüßéèêàçùâîôûëïñáíóú¿¡ÄÖÜÉÈÊÀÇÑÓÁÍÚœŒ]')")
def charset_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(charsets.encodable(F.col("text"))).withColumn("data", charsets.encoded(F.col("text")))
    return rows.select("doc_id", F.octet_length("data").cast("long").alias("n"), charsets.decoded(F.col("data")).alias("back"))


@registered("type_codes", "SELECT c_custkey, substr(c_mktsegment, 1, 4) AS code, ('0x' || hex(encode(substr(c_mktsegment, 1, 4))))::BIGINT AS number FROM customer")
def type_codes(spark, sf_dir):
    code = F.substring("c_mktsegment", 1, 4)
    rows = table(spark, sf_dir, "customer").select("c_custkey", charsets.from_four_characters(code).alias("number"))
    return rows.select("c_custkey", charsets.four_characters(F.col("number")).alias("code"), "number")


@registered("partition_chunks", "SELECT o_orderkey AS chunk, n_nationkey AS part FROM orders JOIN nation ON o_orderkey >= n_nationkey * 37 AND o_orderkey < n_nationkey * 37 + 20 + n_nationkey")
def partition_chunks(spark, sf_dir):
    parts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("part"), (F.col("n_nationkey") * 37).alias("start"), (F.col("n_nationkey") + 20).alias("count"))
    return K.within_partitions(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk")), parts, 16).select("chunk", "part")


@registered("partition_listing", "SELECT row_number() OVER (ORDER BY start) AS part, r_name AS name, start, count FROM (SELECT r_name, min(n_nationkey) AS start, count(*) AS count FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)")
def partition_listing(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.min("n_nationkey").alias("start"), F.count("*").alias("count"))
    named = rows.join(table(spark, sf_dir, "region"), "r_regionkey")
    return named.select(F.row_number().over(Window.orderBy("start")).cast("long").alias("part"), F.col("r_name").alias("name"), "start", "count")


@registered("copied_blocks", "SELECT chunk, data FROM (SELECT p_partkey AS chunk, p_name AS data FROM part WHERE p_partkey NOT BETWEEN 50 AND 79 UNION ALL SELECT p_partkey - 100 + 50, p_brand FROM part WHERE p_partkey BETWEEN 100 AND 129)")
def copied_blocks(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return K.copied_blocks(part.select(F.col("p_partkey").alias("chunk"), F.col("p_brand").alias("data")), part.select(F.col("p_partkey").alias("chunk"), F.col("p_name").alias("data")), 100, 50, 30)


@registered("sector_orders", "SELECT o_orderkey, [0, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 15][o_orderkey % 16 + 1] AS prodos FROM orders")
def sector_orders(spark, sf_dir):
    sector = (F.col("o_orderkey") % 16).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", K.reordered(sector, "dos", "prodos").alias("prodos"))


@registered("stream_compare", "SELECT a.p_partkey AS p_partkey, a.p_type = b.p_type AS same FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def stream_compare(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.encode("p_type", "utf-8").alias("other"))
    return part.join(other, "p_partkey").select("p_partkey", (F.encode("p_type", "utf-8") == F.col("other")).alias("same"))


@registered("content_kinds", f"""SELECT p_partkey, CASE WHEN p_partkey % 14 < 12 THEN {[k for k, _, _ in containers.SIGNATURES]}[p_partkey % 14 + 1] WHEN p_partkey % 14 = 12 THEN 'sectors' END AS kind FROM part""")
def content_kinds(spark, sf_dir):
    # Names behind a signature, or padded to whole blocks, or as they are.
    pick, name = (F.col("p_partkey") % 14).cast("int"), F.encode("p_name", "utf-8")
    signature = F.get(F.array(*[F.lit(digits) for _, _, digits in containers.SIGNATURES]), pick)
    whole = F.rpad(name, F.lit(512), F.lit(b"\x01"))
    content = F.when(signature.isNotNull(), F.concat(F.unhex(signature), name)).when(pick == 12, whole).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", containers.kind_of_content(content).alias("kind"))


@registered("health_rollup", "SELECT n_regionkey, bool_and(c_acctbal >= 0) AS healthy, count_if(c_acctbal < 0)::BIGINT AS faults FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def health_rollup(spark, sf_dir):
    # Customers are summed up by nation first, so the join moves a row for each nation.
    by_nation = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.bool_and(F.col("c_acctbal") >= 0).alias("healthy"), F.count_if(F.col("c_acctbal") < 0).alias("faults"))
    return by_nation.join(table(spark, sf_dir, "nation"), "n_nationkey").groupBy("n_regionkey").agg(F.bool_and("healthy").alias("healthy"), F.sum("faults").alias("faults"))


@registered("free_space", "SELECT p_brand, sum(8 - bit_count(p_size))::BIGINT AS free FROM part GROUP BY 1")
def free_space(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", bits.free_chunks(F.unhex(F.lpad(F.hex(F.col("p_size").cast("long")), 2, "0"))).alias("free"))
    return rows.groupBy("p_brand").agg(F.sum("free").cast("long").alias("free"))


# A checksum's table by rule, then one step for each byte.
CRC = """WITH t AS (SELECT list(list_reduce(list_prepend({start}, range(8)), lambda c, i: {bit})::BIGINT ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
b AS (SELECT {key}, list_transform(range(strlen(text)), lambda k: ('0x' || substr(h, k * 2 + 1, 2))::BIGINT) AS v FROM (SELECT {key}, text, hex(encode(text)) AS h FROM {table}))"""
SHIFT = {"crc32": "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END", "kermit": "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 33800) ELSE c >> 1 END", "xmodem": "CASE WHEN c & 32768 > 0 THEN xor(c << 1, 4129) & 65535 ELSE (c << 1) & 65535 END"}
DOWN = "list_reduce(list_prepend({0}::BIGINT, v), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))"
UP = "list_reduce(list_prepend(0::BIGINT, v), lambda c, x: xor((c << 8) & 65535, t[(xor(c >> 8, x) & 255) + 1]))"


@registered("crc32_parts", f"{CRC.format(start='n', bit=SHIFT['crc32'], key='doc_id', table='documents')} SELECT doc_id, xor({DOWN.format(4294967295)}, 4294967295)::BIGINT AS crc32 FROM b, t")
def crc32_parts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", bits.crc32(F.encode("text", "utf-8")).alias("crc32"))


@registered("crc16_parts", f"""WITH x AS ({CRC.format(start='n << 8', bit=SHIFT['xmodem'], key='page_id', table="(SELECT page_id, coalesce(url, '') AS text FROM pages)")} SELECT page_id, ({UP})::INTEGER AS xmodem FROM b, t),
y AS ({CRC.format(start='n', bit=SHIFT['kermit'], key='page_id', table="(SELECT page_id, coalesce(url, '') AS text FROM pages)")} SELECT page_id, ({DOWN.format(0)})::INTEGER AS kermit FROM b, t)
SELECT page_id, xmodem, kermit FROM x JOIN y USING (page_id)""")
def crc16_parts(spark, sf_dir):
    data = F.encode(F.coalesce("url", F.lit("")), "utf-8")
    return table(spark, sf_dir, "pages").select("page_id", bits.crc16_xmodem(data).alias("xmodem"), bits.crc16_kermit(data).alias("kermit"))


@registered("pascal_dates", """SELECT o_orderkey, m, y, CASE WHEN m = 0 OR y >= 100 THEN 'none' WHEN m > 12 OR d = 0 OR d > day(last_day(make_date(CASE WHEN y < 40 THEN 2000 ELSE 1900 END + y, least(greatest(m, 1), 12), 1))) THEN 'invalid' ELSE 'valid' END AS status
FROM (SELECT o_orderkey, o_orderkey % 16 AS m, (o_orderkey // 16) % 32 AS d, (o_orderkey * 7) % 128 AS y FROM orders)""")
def pascal_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (k % 16).alias("m"), ((k * 7) % 128).alias("y"), (k % 16 + F.floor(k / 16) % 32 * 16 + (k * 7) % 128 * 512).alias("packed"))
    x = F.col("packed")
    return rows.select("o_orderkey", "m", "y", dates.status(x, dates.from_pascal(x), dates.pascal_none(x)).alias("status"))


@registered("extension_kinds", "WITH x(i, ext, kinds, ord, can) AS (VALUES " + ", ".join(f"({i}, '{e}', '{'+'.join(k)}', {'NULL' if o is None else repr(o)}, {c})" for i, (e, (k, o, c)) in enumerate([*containers.EXTENSIONS.items(), ("bin", ((), None, False))])) + ") SELECT p_partkey, ext, kinds, ord AS sector_order, can AS creatable FROM part JOIN x ON i = p_partkey % " + str(len(containers.EXTENSIONS) + 1))
def extension_kinds(spark, sf_dir):
    every = F.array(*map(F.lit, [*containers.EXTENSIONS, "bin"]))
    file = F.concat("p_name", F.lit("."), F.upper(F.get(every, (F.col("p_partkey") % (len(containers.EXTENSIONS) + 1)).cast("int"))))
    ext = containers.extension(file)
    return table(spark, sf_dir, "part").select("p_partkey", ext.alias("ext"), F.array_join(containers.kinds_of_extension(ext), "+").alias("kinds"), containers.order_of_extension(ext).alias("sector_order"), containers.creatable(ext).alias("creatable"))


TYPE_CASE = lambda of: "CASE t " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in of.items()) + " ELSE '?' END"


@registered("type_names", f"SELECT p_partkey, t AS file_type, {TYPE_CASE(labels.DOS_TYPES)} AS dos, {TYPE_CASE(labels.PASCAL_TYPES)} AS pascal FROM (SELECT p_partkey, (p_partkey % 256)::INTEGER AS t FROM part)")
def type_names(spark, sf_dir):
    t = (F.col("p_partkey") % 256).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("file_type"), labels.dos_type(t).alias("dos"), labels.pascal_type(t).alias("pascal"))


@registered("office_names", """SELECT c_custkey, CASE WHEN t BETWEEN 25 AND 27 THEN array_to_string(list_transform(range(length(n)), lambda i: CASE WHEN (((a & 255) << 8) | (a >> 8)) & (32768 >> i) > 0 THEN replace(lower(substr(n, i + 1, 1)), '.', ' ') ELSE replace(upper(substr(n, i + 1, 1)), ' ', '.') END), '') ELSE n END AS name
FROM (SELECT c_custkey, substr(c_name, 1, 15) AS n, (c_custkey % 5 + 23)::INTEGER AS t, ((c_custkey * 7919) % 65536)::INTEGER AS a FROM customer)""")
def office_names(spark, sf_dir):
    name, kind, aux = F.substring("c_name", 1, 15), (F.col("c_custkey") % 5 + 23).cast("int"), (F.col("c_custkey") * 7919 % 65536).cast("int")
    return table(spark, sf_dir, "customer").select("c_custkey", names.office_cased(name, kind, aux).alias("name"))


def _be(x, width):
    """x as so many bytes in hex, the highest first."""
    return F.lpad(F.hex(x.cast("long")), 2 * width, "0")


def _le(x, width):
    return F.array_join(F.reverse(F.regexp_extract_all(_be(x, width), F.lit("(..)"), F.lit(1))), "")


def _text(s, width):
    return F.rpad(F.hex(F.encode(s, "ISO-8859-1")), 2 * width, "0")


def _files(rows, key, *parts):
    """(path, content): a file for each row, of parts in hex.  Cut here, or the optimizer
    would build a file anew wherever a reader looks at its bytes."""
    return cut(rows.select(F.col(key).cast("string").alias("path"), F.unhex(F.concat(*parts)).alias("content")))


@registered("macbinary_headers", "SELECT p_partkey::VARCHAR AS path, p_name AS name, upper(substr(p_type, 1, 4)) AS type, p_size + 100 AS data_len, p_partkey % 300 AS rsrc_len, 128 + (p_size + 227) // 128 * 128 AS rsrc_start, p_partkey % 2 = 0 AS whole FROM part")
def macbinary_headers(spark, sf_dir):
    zero = lambda n: F.lit("00" * n)
    rows = table(spark, sf_dir, "part").withColumn("data_len", F.col("p_size") + 100).withColumn("rsrc_len", F.col("p_partkey") % 300)
    head = F.concat(zero(1), _be(F.length("p_name"), 1), _text(F.col("p_name"), 63), _text(F.upper(F.substring("p_type", 1, 4)), 4), F.lit("54657374"), zero(10), _be(F.col("data_len"), 4), _be(F.col("rsrc_len"), 4), zero(33))
    # Every other checksum is wrong.
    crc = bits.crc16_xmodem(F.unhex(head)).bitwiseXOR((F.col("p_partkey") % 2).cast("int"))
    data = F.rpad(F.lit(""), 2 * (F.ceil(F.col("data_len") / 128) * 128 + F.col("rsrc_len")).cast("int"), F.lit("41"))
    files = _files(rows, "p_partkey", head, _be(crc, 2), zero(2), data)
    return archives.mac_binary(files).select("path", "name", "type", "data_len", "rsrc_len", "rsrc_start", "whole")


@registered("applesingle_entries", """SELECT p_partkey::VARCHAR AS path, p_partkey % 3 = 0 AS double, e::INTEGER AS entry, [3, 9, 1, 2][e + 1]::BIGINT AS kind, 100 + e * p_size AS start, p_size + e AS length FROM part, range(p_partkey % 5) AS r(e) WHERE e < 4""")
def applesingle_entries(spark, sf_dir):
    k, n = F.col("p_partkey"), F.least(F.col("p_partkey") % 5, F.lit(4))
    each = F.transform(F.slice(F.array(*map(F.lit, (3, 9, 1, 2))), F.lit(1), n.cast("int")), lambda kind, i: F.concat(_be(kind, 4), _be(100 + i * F.col("p_size"), 4), _be(F.col("p_size") + i, 4)))
    files = _files(table(spark, sf_dir, "part"), "p_partkey", F.when(k % 3 == 0, "00051607").otherwise("00051600"), F.lit("00020000" + "00" * 16), _be(n, 2), F.array_join(each, ""))
    return archives.apple_single(files)


@registered("binary2_records", """WITH l AS (SELECT l_orderkey, l_partkey, l_quantity::BIGINT * 7 AS len, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) - 1 AS record FROM lineitem)
SELECT l_orderkey::VARCHAR AS path, record::INTEGER AS record, 'PART.' || l_partkey AS name, l_partkey % 256 AS file_type, l_partkey % 65536 AS aux_type, len AS length,
  (128 + coalesce(sum(128 + (len + 127) // 128 * 128) OVER (PARTITION BY l_orderkey ORDER BY record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM l""")
def binary2_records(spark, sf_dir):
    # An archive for each order, with a record for each of its items.
    zero = lambda n: F.lit("00" * n)
    length = (F.col("l_quantity").cast("long") * 7).alias("len")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", length))).alias("items"))
    left = F.size("items") - 1

    def record(x, i):
        name = F.concat(F.lit("PART."), x["l_partkey"].cast("string"))
        head = F.concat(F.lit("0A474CC3"), _le(x["l_partkey"] % 256, 1), _le(x["l_partkey"] % 65536, 2), F.lit("01"), zero(10), F.lit("0200"), _le(x["len"], 3), _be(F.length(name), 1), _text(name, 103), _be(left - i, 1))
        return F.concat(head, F.rpad(F.lit(""), (F.ceil(x["len"] / 128) * 256).cast("int"), F.lit("42")))

    files = _files(items, "l_orderkey", F.array_join(F.transform("items", record), ""))
    return archives.binary_two(files).select("path", "record", "name", "file_type", "aux_type", "length", "start")


@registered("prodos_tree", """SELECT 'disk' AS path, '' AS folder, 'R' || r_regionkey AS name, 13 AS storage, (10 + r_regionkey)::BIGINT AS key, 512 AS data_len FROM region
UNION ALL SELECT 'disk', 'R' || n_regionkey, 'N' || n_nationkey, 1, (100 + n_nationkey)::BIGINT, n_nationkey * 3 FROM nation""")
def prodos_tree(spark, sf_dir):
    # A volume whose directories are regions, and their files nations.
    zero = lambda n: F.lit("00" * n)
    entry = lambda kind, name, key, length: F.concat(_be(kind * 16 + F.length(name), 1), _text(name, 15), F.lit("04"), _le(key, 2), _le(F.lit(1), 2), _le(length, 3), zero(15))
    block = lambda entries: F.unhex(F.rpad(F.concat(zero(4), F.lit("E4" + "00" * 38), F.array_join(entries, "")), 1024, "0"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    files = nation.groupBy("n_regionkey").agg(F.collect_list(entry(F.lit(1), name("N", "n_nationkey"), F.col("n_nationkey") + 100, F.col("n_nationkey") * 3)).alias("e"))
    below = files.select(F.lit("disk").alias("path"), (F.col("n_regionkey") + 10).alias("chunk"), block(F.col("e")).alias("data"))
    top = region.agg(F.collect_list(entry(F.lit(13), name("R", "r_regionkey"), F.col("r_regionkey") + 10, F.lit(512))).alias("e")).select(F.lit("disk").alias("path"), F.lit(2).alias("chunk"), block(F.col("e")).alias("data"))
    return volumes.prodos_directory(top.unionByName(below)).select("path", "folder", "name", "storage", "key", "data_len")


@registered("hex_dump", "SELECT doc_id, printf('%06x', i * 16) AS address, lower(substr(h, i * 32 + 1, 32)) AS bytes FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range((strlen(text) + 15) // 16)) AS i FROM documents)")
def hex_dump(spark, sf_dir):
    return K.hex_rows(table(spark, sf_dir, "documents"), "doc_id", F.encode("text", "utf-8")).drop("shown")

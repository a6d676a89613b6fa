"""More queries: what commands on catalogs do, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, formats, names, paths
from ..operators.catalog import numbered
from .entries import document_entries, table
from .registry import E_, registered


@registered("get_attribute", f"{E_} SELECT ordinal, aux_type FROM e WHERE path = 'src1/en/' || ordinal")
def get_attribute(spark, sf_dir):
    entries = document_entries(spark, sf_dir)
    return entries.where(F.col("path") == F.concat(F.lit("src1/en/"), F.col("ordinal").cast("string"))).select("ordinal", "aux_type")


@registered("metadata_set", """SELECT event_id, '{' || 'k=' || json_extract_string(props, '$.k') || '}' AS before, 'k=new,user=' || user_id AS after, json_extract_string(props, '$.k') IS NULL AS gone FROM events""")
def metadata_set(spark, sf_dir):
    meta = F.from_json("props", "map<string,string>")
    user = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.lit("new"))
    kept = F.map_filter(meta, lambda k, v: k != "k")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("{"), formats.option_text(meta), F.lit("}")).alias("before"), formats.option_text(F.map_concat(kept, user)).alias("after"), meta["k"].isNull().alias("gone"))


@registered("multi_catalog", "SELECT kind, id, name, row_number() OVER (PARTITION BY kind ORDER BY upper(name), id) AS place FROM (SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer)")
def multi_catalog(spark, sf_dir):
    pick = lambda t, k, n: table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(k).alias("id"), F.col(n).alias("name"))
    rows = pick("part", "p_partkey", "p_name").unionByName(pick("supplier", "s_suppkey", "s_name")).unionByName(pick("customer", "c_custkey", "c_name"))
    return numbered(rows, ["kind"], [F.upper("name"), F.col("id")])


@registered("bad_chunks", "SELECT l_shipmonth, count(*) AS checked, count_if(l_tax >= 0.07)::BIGINT AS unreadable, count_if(l_discount >= 0.09)::BIGINT AS unwritable FROM (SELECT *, strftime(l_shipdate, '%Y-%m') AS l_shipmonth FROM lineitem) GROUP BY 1")
def bad_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth"))
    return rows.agg(F.count("*").alias("checked"), F.count_if(F.col("l_tax") >= 0.07).alias("unreadable"), F.count_if(F.col("l_discount") >= 0.09).alias("unwritable"))


@registered("classic_listing", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '*' ELSE ' ' END || upper(substr(p_type, 1, 1)) || ' ' || lpad(p_size::VARCHAR, 3, '0') || ' ' || upper(p_name) AS line FROM part")
def classic_listing(spark, sf_dir):
    lock = F.when(F.col("p_size") % 5 == 0, "*").otherwise(" ")
    line = F.concat(lock, F.upper(F.substring("p_type", 1, 1)), F.lit(" "), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" "), F.upper("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


@registered("tree_dump", "SELECT n_nationkey AS id, 2 AS depth, repeat('  ', 1) || n_name AS line FROM nation UNION ALL SELECT c_custkey, 3, repeat('  ', 2) || c_name FROM customer")
def tree_dump(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit(2).alias("depth"), F.col("n_name").alias("name"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(3).alias("depth"), F.col("c_name").alias("name"))
    rows = nations.unionByName(customers)
    return rows.select("id", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), "name").alias("line"))


@registered("valid_names", "SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z][A-Za-z0-9.]{0,14}$') AS fits, CASE WHEN length(n) > 15 THEN substr(n, 1, 7) || '..' || right(n, 6) ELSE n END AS name FROM (SELECT p_partkey, p_name, CASE WHEN regexp_matches(p_name, '^[A-Za-z]') THEN '' ELSE 'X' END || regexp_replace(p_name, '[^A-Za-z0-9.]', '.', 'g') AS n FROM part)")
def valid_names(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", names.valid(name, "prodos").alias("fits"), names.adjusted(name, "prodos").alias("name"))


@registered("mixed_case_names", "SELECT c_custkey, substr(c_name, 1, 15) AS name FROM customer")
def mixed_case_names(spark, sf_dir):
    short = F.substring("c_name", 1, 15)
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.replace(F.upper(short), F.lit(" "), F.lit(".")).alias("raw"), names.case_bits(short).alias("bits"))
    return rows.select("c_custkey", names.cased(F.col("raw"), F.col("bits")).alias("name"))


@registered("converter_ranking", "SELECT page_id, tag, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, place) AS n FROM (SELECT page_id, tag, place, CASE tag WHEN 'hex' THEN 1 WHEN 'text' THEN CASE WHEN regexp_matches(url, '[?#]') THEN 1 ELSE 3 END ELSE CASE WHEN contains(url, '.html') THEN 9 ELSE 0 END END AS score FROM pages, (VALUES ('hex', 0), ('text', 1), ('page', 2)) AS t(tag, place))) WHERE n = 1")
def converter_ranking(spark, sf_dir):
    from ..operators.catalog import ranked

    url = F.col("url")
    score = {"hex": F.lit(1), "text": F.when(url.rlike("[?#]"), 1).otherwise(3), "page": F.when(F.contains(url, F.lit(".html")), 9).otherwise(0)}
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(i).alias("place"), s.alias("score")) for i, (t, s) in enumerate(score.items())]))
    rows = table(spark, sf_dir, "pages").select("page_id", each.alias("c")).select("page_id", "c.*")
    return ranked(rows, ["page_id"], "score", "place").select("page_id", "tag", "score")


@registered("made_directories", "SELECT path FROM (SELECT DISTINCT source || '/' || lang AS path FROM documents UNION SELECT 'src1/xx' UNION SELECT 'src2/en')")
def made_directories(spark, sf_dir):
    folders = document_entries(spark, sf_dir).select(paths.directory_name(F.col("path")).alias("path")).distinct()
    wanted = spark.createDataFrame([("src1/xx",), ("src2/en",)], "path string")
    return folders.unionByName(wanted.join(folders, "path", "left_anti"))


@registered("unix_dates", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS packed, date_trunc('second', ts) AS back FROM events")
def unix_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", dates.to_unix(F.col("ts")).alias("packed"))
    return rows.withColumn("back", dates.from_unix(F.col("packed")))


@registered("set_size_limits", "SELECT p_partkey, p_size, CASE WHEN p_size * 512 <= 8192 THEN 'small' WHEN p_size * 512 <= 16384 THEN 'medium' ELSE 'large' END AS layout FROM part WHERE p_size * 512 <= 20480")
def set_size_limits(spark, sf_dir):
    layouts = spark.createDataFrame([(0, 8192, "small"), (8193, 16384, "medium"), (16385, 20480, "large")], "low int, high int, layout string")
    size = F.col("p_size") * 512
    return table(spark, sf_dir, "part").join(F.broadcast(layouts), size.between(F.col("low"), F.col("high"))).select("p_partkey", "p_size", "layout")

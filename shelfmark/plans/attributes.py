"""More queries: types, nesting, sets to add and blocks, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, mac, paths
from ..operators import catalog as C
from ..operators import chunks as K
from .entries import table
from .registry import registered


@registered("mac_types", """SELECT p_partkey, t AS file_type, a AS aux_type, hex(encode(CASE WHEN n IS NULL THEN '' ELSE n END)) || CASE WHEN n IS NULL THEN '70' || printf('%02X%04X', t, a) ELSE '' END AS type,
  CASE n WHEN 'dImg' THEN 'dCpy' ELSE 'pdos' END AS creator, t AS back_type, CASE WHEN n IN ('PSYS', 'PS16') THEN 0 ELSE a END AS back_aux, coalesce(n <> 'dImg', true) AS preferred
FROM (SELECT *, CASE WHEN t = 224 AND a = 5 THEN 'dImg' WHEN t = 0 AND a = 0 THEN 'BINA' WHEN t = 4 AND a = 0 THEN 'TEXT' WHEN t = 215 AND a = 0 THEN 'MIDI' WHEN t = 216 AND a = 0 THEN 'AIFF' WHEN t = 216 AND a = 1 THEN 'AIFC'
  WHEN t = 255 THEN 'PSYS' WHEN t = 179 AND a // 256 <> 219 THEN 'PS16' END AS n
FROM (SELECT p_partkey, ([0, 4, 215, 216, 224, 255, 179, 6][p_partkey % 8 + 1])::INTEGER AS t, ([0, 1, 5, 56064 + p_partkey % 256, p_partkey % 65536][p_partkey // 8 % 5 + 1])::INTEGER AS a FROM part))""")
def mac_types(spark, sf_dir):
    k = F.col("p_partkey")
    t = F.get(F.array(*map(F.lit, (0, 4, 215, 216, 224, 255, 179, 6))), (k % 8).cast("int"))
    a = F.get(F.array(F.lit(0), F.lit(1), F.lit(5), (56064 + k % 256).cast("int"), (k % 65536).cast("int")), (F.floor(k / 8) % 5).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", t.alias("file_type"), a.alias("aux_type"))
    rows = rows.withColumn("m", mac.mac_type(F.col("file_type"), F.col("aux_type")))
    rows = rows.withColumn("b", mac.numeric_type(F.col("m.type"), F.col("m.creator")))
    return rows.select("p_partkey", "file_type", "aux_type", F.hex(F.encode("m.type", "ISO-8859-1")).alias("type"), "m.creator", F.col("b.file_type").alias("back_type"), F.col("b.aux_type").alias("back_aux"), "b.preferred")


PARENTS = ("zip", "gzip", "nufx", "archive", "filesystem", "multipart")
CHILDREN = ("file", "archive", "image", "part", "embed")


@registered("depth_gate", f"""SELECT page_id, parent, child, parent = 'gzip' OR (parent = 'nufx' AND child IN ('file', 'part')) AS shallow,
  (parent, child) IN (('zip', 'file'), ('zip', 'image'), ('archive', 'file'), ('archive', 'image'), ('nufx', 'file'), ('nufx', 'part'), ('filesystem', 'embed')) OR parent IN ('gzip', 'multipart') AS subvol, true AS every
FROM (SELECT page_id, {list(PARENTS)}[page_id % 6 + 1] AS parent, {list(CHILDREN)}[page_id // 6 % 5 + 1] AS child FROM pages)""")
def depth_gate(spark, sf_dir):
    pick = lambda of, i: F.get(F.array(*map(F.lit, of)), i.cast("int"))
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", pick(PARENTS, k % 6).alias("parent"), pick(CHILDREN, F.floor(k / 6) % 5).alias("child"))
    return rows.select("*", *[C.opens(F.col("parent"), F.col("child"), depth).alias(name) for depth, name in (("shallow", "shallow"), ("subvol", "subvol"), ("max", "every"))])


@registered("add_set_order", """SELECT path, data_path, rsrc_path, row_number() OVER (ORDER BY coalesce(data_path, rsrc_path)) AS place FROM (SELECT f || d AS path, CASE WHEN d % 7 > 0 THEN f || d END AS data_path,
  CASE WHEN d % 3 = 0 THEN f || '._' || d WHEN d % 4 = 0 THEN f || '%' || d WHEN d % 5 = 0 THEN f || d || '.rsrc' END AS rsrc_path FROM (SELECT source || '/' || lang || '/' AS f, doc_id AS d FROM documents)) WHERE data_path IS NOT NULL OR rsrc_path IS NOT NULL""")
def add_set_order(spark, sf_dir):
    # Each document is a file, but every seventh is missing; some have one header file or more.
    folder, d = F.concat_ws("/", "source", "lang"), F.col("doc_id")
    name = d.cast("string")
    files = F.filter(F.array(F.when(d % 7 > 0, name), F.when(d % 3 == 0, F.concat(F.lit("._"), name)), F.when(d % 4 == 0, F.concat(F.lit("%"), name)), F.when(d % 5 == 0, F.concat(name, F.lit(".rsrc")))), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "documents").where("source is not null and lang is not null").select(folder.alias("folder"), F.explode(files).alias("name")).select(F.concat_ws("/", "folder", "name").alias("path"))
    return C.numbered(C.add_set(rows), [], [F.coalesce("data_path", "rsrc_path")])


@registered("written_blocks", "SELECT p_partkey AS chunk, CASE WHEN s_suppkey IS NULL THEN p_name ELSE s_name END AS data FROM part LEFT JOIN supplier ON s_suppkey = p_partkey AND s_suppkey < 500 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey < 500 AND s_suppkey NOT IN (SELECT p_partkey FROM part)")
def written_blocks(spark, sf_dir):
    target = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk"), F.col("p_name").alias("data"))
    patches = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chunk"), F.col("s_name").alias("data"))
    return K.written_blocks(target, patches, 500)


@registered("replaced_partition", "SELECT s_suppkey + 20 AS chunk, s_name AS data FROM supplier UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey - 20 NOT IN (SELECT s_suppkey FROM supplier)")
def replaced_partition(spark, sf_dir):
    target = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk"), F.col("p_name").alias("data"))
    image = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chunk"), F.col("s_name").alias("data"))
    return K.replaced_partition(target, image, 20, 1 << 40)


@registered("data_lengths", "SELECT l_orderkey, coalesce(sum(l_quantity::BIGINT) FILTER (WHERE l_discount > 0), 0)::BIGINT AS stored FROM lineitem GROUP BY 1")
def data_lengths(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("len", F.col("l_quantity").cast("long"))
    return K.data_lengths(rows, ["l_orderkey"], "len", ~(F.col("l_discount") > 0))


@registered("integer_writes", "SELECT o_orderkey, substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) AS little, h AS big, CASE WHEN o_orderkey = 0 THEN 1 ELSE 1::BIGINT << length(bin(o_orderkey)) END AS above FROM (SELECT o_orderkey, printf('%016X', o_orderkey * 7919) AS h FROM orders)")
def integer_writes(spark, sf_dir):
    x = F.col("o_orderkey") * 7919
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(bits.packed(x, 3)).alias("little"), F.hex(bits.packed(x, 8, big=True)).alias("big"), bits.power_of_two_above(F.col("o_orderkey")).alias("above"))


MARKED, BARE = "".join(m for _, m in paths.UNMARKED), "".join(c * len(m) for c, m in paths.UNMARKED)


@registered("ascii_texts", rf"SELECT doc_id, md5(regexp_replace(regexp_replace(translate(text, '{MARKED}', '{BARE}'), '[\x{{10000}}-\x{{10FFFF}}]', '??', 'g'), '[^\x00-\x7f\x{{2400}}-\x{{241f}}\x{{2421}}]', '?', 'g')) AS digest FROM documents")
def ascii_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(paths.ascii_reduced(F.col("text")), "utf-8")).alias("digest"))

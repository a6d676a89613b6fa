"""The given tables seen as a catalog: entries, claims, bitmaps and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries: path source/lang/doc_id, data length n_chars."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.lit(0).cast("long").alias("container_id"), F.col("doc_id").alias("ordinal"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 256).cast("short").alias("file_type"), (F.col("doc_id") % 65536).cast("int").alias("aux_type"), (F.col("n_chars") % 256).cast("short").alias("access"), "lang", "source", F.col("n_chars").alias("data_len"), F.octet_length("text").cast("long").alias("data_size"))


#: The same rows in DuckDB SQL.
DOCUMENT_ENTRIES = """SELECT 0::BIGINT AS container_id, doc_id AS ordinal, source || '/' || lang || '/' || doc_id AS path, (doc_id % 256)::SMALLINT AS file_type,
  (doc_id % 65536)::INTEGER AS aux_type, (n_chars % 256)::SMALLINT AS access, lang, source, n_chars AS data_len, strlen(text)::BIGINT AS data_size FROM documents"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items claim their order's chunk, in order of their part's key."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("owner"), F.col("l_partkey").alias("scan_ordinal"))


def bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders mark their chunk unless they are finished."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"), (F.col("o_orderstatus") != "F").alias("marked"))

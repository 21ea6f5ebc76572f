"""Adapters from the test tables to the canonical tables: records, vectors, edges, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import storage_key


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records: workspace by id, kind by language, status by id, metadata as JSON."""
    d = read(spark, sf_dir, "documents")
    tenth = F.col("doc_id") % 10
    out = d.select(
        F.concat(F.lit("ws-"), (F.col("doc_id") % 4).cast("string")).alias("workspace_id"),
        F.col("lang").alias("source_kind"),
        F.col("doc_id").cast("string").alias("source_id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"),
        F.col("text").alias("body"),
        F.concat(F.lit('{"doc_id":"d'), F.col("doc_id").cast("string"), F.lit('","n_chars":'), F.col("n_chars").cast("string"), F.lit(',"project_id":"'), "source", F.lit('","tags":["'), "lang", F.lit('","'), "source", F.lit('"]}')).alias("metadata"),
        F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("uri"),
        F.concat(F.col("lang"), F.lit(" "), F.col("source")).alias("keywords"),
        F.when(tenth == 0, "archived").when(tenth == 1, "stale").otherwise("active").alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("updated_at"),
        F.col("doc_id"),
    )
    return out.select(storage_key(F.col("workspace_id"), F.col("source_kind"), F.col("source_id")).alias("storage_key"), "*")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(storage_key, embedding, label): vec_id is the document's id."""
    keys = records(spark, sf_dir).select("doc_id", "storage_key")
    return read(spark, sf_dir, "embeddings").join(keys, F.col("vec_id") == F.col("doc_id")).select("storage_key", "vec_id", "embedding", "label")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_key, dst_key, edge_type, weight): orders, parts, suppliers, customers, nations and regions."""

    def key(prefix: str, column: str):
        return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))

    line = read(spark, sf_dir, "lineitem")
    parts = [
        line.groupBy(key("order", "l_orderkey").alias("s"), key("part", "l_partkey").alias("d")).agg(F.max(1 - F.col("l_discount")).alias("w")).select("s", "d", F.lit("tests").alias("t"), "w"),
        line.groupBy(key("part", "l_partkey").alias("s"), key("supplier", "l_suppkey").alias("d")).agg(F.max(1 - F.col("l_discount")).alias("w")).select("s", "d", F.lit("implements").alias("t"), "w"),
        read(spark, sf_dir, "orders").select(key("order", "o_orderkey"), key("customer", "o_custkey"), F.lit("links_to"), F.lit(0.85)),
        read(spark, sf_dir, "customer").select(key("customer", "c_custkey"), key("nation", "c_nationkey"), F.lit("related"), F.lit(0.7)),
        read(spark, sf_dir, "supplier").select(key("supplier", "s_suppkey"), key("nation", "s_nationkey"), F.lit("related"), F.lit(0.9)),
        read(spark, sf_dir, "nation").select(key("nation", "n_nationkey"), key("region", "n_regionkey"), F.lit("links_to"), F.lit(0.8)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("src_key", "dst_key", "edge_type", "weight")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): the benchmark passages as queries."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: The same tables as common table expressions of DuckDB.
SQL = r"""
records AS (
  SELECT 'record:["ws-' || doc_id % 4 || '","' || lang || '","' || doc_id || '"]' AS storage_key,
         'ws-' || doc_id % 4 AS workspace_id, lang AS source_kind, CAST(doc_id AS VARCHAR) AS source_id,
         substring(split_part(text, chr(10), 1), 1, 60) AS title, text AS body,
         '{"doc_id":"d' || doc_id || '","n_chars":' || n_chars || ',"project_id":"' || source || '","tags":["' || lang || '","' || source || '"]}' AS metadata,
         'docs/' || source || '/' || doc_id || '.md' AS uri, lang || ' ' || source AS keywords,
         CASE doc_id % 10 WHEN 0 THEN 'archived' WHEN 1 THEN 'stale' ELSE 'active' END AS status, source, n_chars, doc_id
  FROM documents
), vectors AS (
  SELECT storage_key, vec_id, embedding, label FROM embeddings JOIN records ON vec_id = doc_id
), edges AS (
  SELECT 'order:' || l_orderkey AS src_key, 'part:' || l_partkey AS dst_key, 'tests' AS edge_type, max(1 - l_discount) AS weight FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'implements', max(1 - l_discount) FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'links_to', 0.85e0 FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'related', 0.7e0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'related', 0.9e0 FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'links_to', 0.8e0 FROM nation
)"""

"""A deterministic corpus with labelled queries, of any size, without a driver loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import storage_key

TOPICS = [f"topic{i:02d}" for i in range(16)]
KINDS = ["note", "issue", "commit", "docs"]


def corpus(spark: SparkSession, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records, golden): topic by (i + seed) mod 16, kind and workspace by (i + seed) mod 4; a query for each topic."""
    i = F.col("id") + seed
    topic, fourth = F.element_at(F.array(*map(F.lit, TOPICS)), (i % 16 + 1).cast("int")), (i % 4).cast("int")
    r = spark.range(n).select(F.concat(F.lit("ws-"), fourth.cast("string")).alias("workspace_id"), F.element_at(F.array(*map(F.lit, KINDS)), fourth + 1).alias("source_kind"), F.concat(F.lit("rec-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("source_id"), F.concat(topic, F.lit(" note "), F.col("id").cast("string")).alias("title"), F.concat(F.lit("Facts about "), topic, F.lit(".")).alias("body"), topic.alias("topic"))
    records = r.select(storage_key(F.col("workspace_id"), F.col("source_kind"), F.col("source_id")).alias("storage_key"), "*", F.lit("active").alias("status"))
    return records, records.groupBy(F.col("topic").alias("query")).agg(F.sort_array(F.collect_list("storage_key")).alias("relevant_ids"))

"""Operator 5: sharding by vector bin packing.

Each group of documents is a vector of bytes, tokens and rows; each shard has an equal share of
the three totals, plus `slack`, as capacity. Groups in descending size (their largest share of a
total) go to the shard where the dot product of the group's vector and the residual capacity, both
in shares of a shard, is highest among the shards that it fits; if it fits none, to the one that
it overfills least.

A group is never split. Groups come from an aggregation with partial sums, and each is placed by its
own vector, but for the dust: groups under 1/GRAIN of a shard in every dimension are first bundled by
hash into at most GRAIN bundles for each shard. So the driver places at most 4 * GRAIN units for each shard,
whatever the corpus, and what a bundle adds to a shard's imbalance is about 1/GRAIN. The documents meet the placement
in a broadcast of that bounded size, so texts are never shuffled.

Tokens are runs of characters that aren't white space. Defined results: null columns are a group
value like others; a null text counts no bytes and no tokens; very long texts count whole, and a group that
is larger than a shard's share goes to the shard that it overfills least; repeated rows count as often as they
occur and go to the same shard; ties go to the lower shard, equal groups by id. Extra columns aren't
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, only, written
from .packing import word_count

#: Production parameters.
SHARDS, SLACK, GRAIN = 64, 0.02, 1024


def place(sizes: np.ndarray, shards: int, slack: float = SLACK) -> np.ndarray:
    """The shard of each vector in `sizes`, which must be in the order of placement."""
    total = sizes.sum(axis=0)
    need = sizes / np.where(total > 0, total, 1) * shards
    left = np.full((shards, sizes.shape[1]), 1 + slack)
    out = np.empty(len(sizes), np.int64)
    for i, v in enumerate(need):
        fits = (left >= v - 1e-12).all(axis=1)
        if fits.any():
            at = int(np.where(fits, left @ v, -np.inf).argmax())
        else:
            at = int((v - left).max(axis=1).argmin())
        out[i] = at
        left[at] -= v
    return out


def order(sizes: np.ndarray) -> np.ndarray:
    """Indices in descending largest share of a total; equal ones stay in order."""
    total = sizes.sum(axis=0)
    return np.argsort(-(sizes / np.where(total > 0, total, 1)).max(axis=1), kind="stable")


def shard_documents(docs: DataFrame, group: Sequence[Column] | None = None, shards: int = SHARDS, slack: float = SLACK, grain: int = GRAIN) -> DataFrame:
    """(doc_id, group_id, shard, n_bytes, n_tokens) for each row of `docs`.

    The default groups are the documents of a source and language in 256 ranges of a hash of
    doc_id: fine enough that a hot source spreads over all shards.
    """
    spark = docs.sparkSession
    if group is None:
        docs = only(docs, ["doc_id", "text", "lang", "source"])
        group = [F.col("source"), F.col("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(256))]
    nulls = F.concat(*[F.when(g.isNull(), F.lit("1")).otherwise(F.lit("0")) for g in group])  # xxhash64 skips nulls
    rows = docs.select("doc_id", F.xxhash64(*group, nulls).alias("group_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(word_count(F.col("text")), F.lit(0)).alias("n_tokens"))
    rows = written(rows, "sizes")
    sums = [F.sum("n_bytes").alias("b"), F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("r")]
    groups = rows.groupBy("group_id").agg(*sums)
    total = rows.agg(*sums).first()
    if not total["r"]:
        return rows.select("doc_id", "group_id", F.lit(0).alias("shard"), "n_bytes", "n_tokens")
    alone = F.greatest(*[F.col(c) / F.lit(max(total[c], 1)) for c in "btr"]) >= 1 / (grain * shards)
    bundle = F.pmod("group_id", F.lit(shards * grain))
    units = groups.select(alone.alias("alone"), F.when(alone, F.col("group_id")).otherwise(bundle).alias("unit"), "b", "t", "r").groupBy("alone", "unit").agg(*[F.sum(c).alias(c) for c in "btr"]).toPandas()
    units = units.sort_values(["alone", "unit"], ignore_index=True)
    sizes = units[["b", "t", "r"]].to_numpy(float)
    by_size = order(sizes)
    units.loc[by_size, "shard"] = place(sizes[by_size], shards, slack)
    placed = spark.createDataFrame([(bool(a), int(b), int(c)) for a, b, c in zip(units["alone"], units["unit"], units["shard"])], "alone boolean, unit long, shard int")
    by_group = placed.filter("alone").select(F.col("unit").alias("group_id"), F.col("shard").alias("own"))
    by_hash = placed.filter("NOT alone").select(F.col("unit").alias("bundle"), "shard")
    out = rows.join(F.broadcast(by_group), "group_id", "left").withColumn("bundle", bundle).join(F.broadcast(by_hash), "bundle", "left")
    return out.select("doc_id", "group_id", F.coalesce("own", "shard").alias("shard"), "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))

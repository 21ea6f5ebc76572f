"""Fusion of ranked lanes and score calibration. Lanes are one DataFrame (query_id, lane, storage_key, rank, score)."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import keyword, vector

RRF_K = 60


def lane(hits: DataFrame, name: str) -> DataFrame:
    return hits.select("query_id", F.lit(name).alias("lane"), "storage_key", "rank", "score")


def weight(weights: Mapping[str, float] | None) -> Column:
    out = F.lit(1.0)
    for name, w in (weights or {}).items():
        if not (math.isfinite(w) and w >= 0):
            raise ValueError(f"the weight of {name} must be finite and not negative")
        out = F.when(F.col("lane") == name, float(w)).otherwise(out)
    return out


def reciprocal_rank(lanes: DataFrame, weights: Mapping[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, storage_key, score): sum of weight / (k + rank)."""
    return lanes.groupBy("query_id", "storage_key").agg(F.sum(weight(weights) / (k + F.col("rank"))).alias("score"))


def calibrated(lanes: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted sum of scores scaled to 0..1 within each lane; a lane of equal scores counts 0.5."""
    w = Window.partitionBy("query_id", "lane")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = lanes.withColumn("s", F.when(low == high, 0.5).otherwise((F.col("score") - low) / (high - low)))
    return scaled.groupBy("query_id", "storage_key").agg(F.sum(weight(weights) * F.col("s")).alias("score"))


def graph_maximum(fused: DataFrame, graph: DataFrame) -> DataFrame:
    """The greater of the fused score and the raw graph score."""
    g = graph.select("query_id", "storage_key", F.col("score").alias("g"))
    return fused.join(g, ["query_id", "storage_key"], "full_outer").select("query_id", "storage_key", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("g", F.lit(0.0))).alias("score"))


def normalized(hits: DataFrame) -> DataFrame:
    """Adds normalized_score, 0..1 within the query; 1 where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("normalized_score", F.when(low == high, 1.0).otherwise((F.col("score") - low) / (high - low)))


def provenance(lanes: DataFrame) -> DataFrame:
    """(query_id, storage_key, provenance): lane to (rank, raw score)."""
    entry = F.struct("lane", F.struct(F.col("rank"), F.col("score").alias("raw_score")))
    return lanes.groupBy("query_id", "storage_key").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("provenance"))


def best_of(hits: DataFrame) -> DataFrame:
    """Of repeated keys the highest score."""
    return hits.groupBy("query_id", "storage_key").agg(F.max("score").alias("score"))


def overlap(lanes: DataFrame, n: int) -> DataFrame:
    """(query_id, overlap): keys that all n lanes have; 0 for a single lane."""
    per = lanes.groupBy("query_id", "storage_key").agg(F.count_distinct("lane").alias("c"))
    return per.groupBy("query_id").agg(F.sum(F.when((F.col("c") == n) & F.lit(n > 1), 1).otherwise(0)).alias("overlap"))


def lane_confidence(name: str, score: Column, saturation: float = keyword.SATURATION) -> Column:
    if name == "vector":
        return vector.confidence(score)
    if name == "keyword":
        return keyword.confidence(score, saturation)
    if name == "graph":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    raise ValueError(f"no confidence for lane {name!r}")


class Isotonic:
    """A non-decreasing curve through knots; flat outside."""

    def __init__(self, xs: list[float], ys: list[float]):
        self.xs, self.ys = xs, ys

    def __call__(self, score: Column) -> Column:
        out = F.lit(self.ys[-1])
        for x0, x1, y0, y1 in reversed(list(zip(self.xs, self.xs[1:], self.ys, self.ys[1:]))):
            out = F.when(score < x1, y0 + (y1 - y0) * (score - x0) / (x1 - x0)).otherwise(out)
        return F.when(score <= self.xs[0], self.ys[0]).otherwise(out)

    def at(self, x: float) -> float:
        return float(np.interp(x, self.xs, self.ys))


def fit_isotonic(samples: DataFrame, minimum: int = 50) -> Isotonic | None:
    """From (score, label 0/1): pooled by score in Spark, adjacent violators on the driver. None if a class has fewer than `minimum`.

    The driver holds a row for each distinct score: round scores beforehand where there are millions.
    """
    pooled = samples.groupBy("score").agg(F.sum("label").cast("double").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("score").collect()
    positive, total = sum(r["s"] for r in pooled), sum(r["n"] for r in pooled)
    if min(positive, total - positive) < minimum:
        return None
    blocks: list[list[float]] = []  # low, high, sum, count
    for r in pooled:
        blocks.append([r["score"], r["score"], r["s"], r["n"]])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] > blocks[-1][2] / blocks[-1][3]:
            low, high, s, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + s, blocks[-1][3] + n]
    return Isotonic([(b[0] + b[1]) / 2 for b in blocks], [b[2] / b[3] for b in blocks])


def status_multiplier(status: Column) -> Column:
    return F.when(status == "archived", 0.5).when(status == "stale", 0.8).otherwise(1.0)


def record_time(prefer_updated: bool = True) -> Column:
    return F.col("updated_at") if prefer_updated else F.col("created_at")

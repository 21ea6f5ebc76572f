"""Retrieval metrics as aggregations, paired statistics and gates."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def metrics(results: DataFrame, gains: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query_id, recall, ndcg, mrr, ap): results (query_id, item, rank), gains (query_id, item, gain > 0).

    Recall and nDCG look at the first k, MRR and average precision at all; a query without relevant items has zeros.
    """
    g = gains.select("query_id", "item", F.col("gain").cast("double").alias("gain"))
    ideal = g.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "item")))
    ideal = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("i") <= k, F.col("gain") / F.log2(F.col("i") + 1.0))).alias("idcg"))
    return _metrics(results.join(g, ["query_id", "item"]), ideal, queries, k, digits)


def class_metrics(results: DataFrame, classes: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """`metrics` where a query's relevant items are the others of its class, each with gain 1: classes (item, class), queries are items.

    Pairs of one class are as the square of its items, so they are counted and never listed. An item without class has none.
    """
    c = classes.select("item", "class")
    sizes = c.filter("class IS NOT NULL").groupBy("class").agg((F.count(F.lit(1)) - 1).alias("n")).filter("n > 0")
    gain = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    ideal = c.join(sizes, "class").select(F.col("item").alias("query_id"), "n", gain.alias("idcg"))
    own = c.select(F.col("item").alias("query_id"), F.col("class").alias("own"))
    hit = results.join(c, "item").join(own, "query_id").filter((F.col("class") == F.col("own")) & (F.col("item") != F.col("query_id"))).select(*results.columns, F.lit(1.0).alias("gain"))
    return _metrics(hit, ideal, c.select(F.col("item").alias("query_id")), k, digits)


def _metrics(hit: DataFrame, ideal: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    hit = hit.withColumn("h", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    first = F.col("rank") <= k
    per = hit.groupBy("query_id").agg(
        F.count_distinct(F.when(first, F.col("item"))).alias("found"), F.sum(F.when(first, F.col("gain") / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.min("rank").alias("best"), F.sum(F.col("h") / F.col("rank")).alias("precisions"),
    )
    out = queries.select("query_id").distinct().join(ideal, "query_id", "left").join(per, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits)
    return out.select("query_id", zero(F.col("found") / F.col("n")).alias("recall"), zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(1.0 / F.col("best")).alias("mrr"), zero(F.col("precisions") / F.col("n")).alias("ap"))


METRICS = ["recall", "ndcg", "mrr", "ap"]


def slices(scores: DataFrame, labels: DataFrame, digits: int = 9) -> DataFrame:
    """(dimension, value, queries, means and quantiles): labels (query_id, dimension, value); all queries are the slice overall."""
    every = scores.select("query_id", F.lit("overall").alias("dimension"), F.lit("all").alias("value"))
    joined = scores.join(labels.select("query_id", "dimension", "value").union(every), "query_id")
    aggregates = [F.round(F.avg(m), digits).alias(f"mean_{m}") for m in METRICS]
    aggregates += [F.round(F.percentile("recall", q), digits).alias(f"recall_p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]
    return joined.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("queries"), *aggregates)


def source_coverage(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(query_id, coverage): the share of a query's expected kinds among those of its first k results."""
    seen = results.filter(F.col("rank") <= k).select("query_id", F.col("source_kind").alias("kind"), F.lit(1).alias("seen")).distinct()
    return expected.select("query_id", "kind").distinct().join(seen, ["query_id", "kind"], "left").groupBy("query_id").agg((F.count("seen") / F.count(F.lit(1))).alias("coverage"))


def known_rate(column: str):
    return F.avg(F.col(column).cast("int"))


def compare_means(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mean of b less mean of a for each metric."""
    mean = lambda df, p: df.agg(*[F.avg(m).alias(p + m) for m in METRICS])
    return mean(a, "a_").crossJoin(F.broadcast(mean(b, "b_"))).select(*[(F.col("b_" + m) - F.col("a_" + m)).alias(m) for m in METRICS])  # one row each


def paired(a: DataFrame, b: DataFrame, metric: str) -> list[tuple[float, float]]:
    """The two scores of each query; raises unless both have the same queries."""
    rows = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id", "full_outer").orderBy("query_id").collect()
    if any(r["x"] is None or r["y"] is None for r in rows):
        raise ValueError("the two runs have different queries")
    return [(r["x"], r["y"]) for r in rows]


@dataclass(frozen=True)
class Comparison:
    mean_difference: float
    p_value: float
    effect: float
    low: float
    high: float


def compare_paired(pairs: list[tuple[float, float]], iterations: int = 10_000, confidence: float = 0.95, seed: int = 0) -> Comparison:
    """Sign-flip permutation test (add-one p), Cohen's d of the differences and a bootstrap interval of their mean."""
    if not pairs:
        raise ValueError("nothing to compare")
    d = np.array([y - x for x, y in pairs], float)
    g = np.random.default_rng(seed)
    mean, n = float(d.mean()), len(d)
    extreme = sum(int((np.abs((g.choice((-1.0, 1.0), size=(m, n)) * d).mean(axis=1)) >= abs(mean) - 1e-12).sum()) for m in _chunks(iterations, n))
    spread = float(d.std(ddof=1)) if n > 1 else 0.0
    effect = mean / spread if spread else 0.0 if mean == 0 else math.copysign(math.inf, mean)
    means = np.concatenate([d[g.integers(n, size=(m, n))].mean(axis=1) for m in _chunks(iterations, n)])
    low, high = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
    return Comparison(mean, (extreme + 1) / (iterations + 1), effect, float(low), float(high))


def _chunks(iterations: int, n: int):
    step = max(1, 4_000_000 // max(1, n))
    return [min(step, iterations - i) for i in range(0, iterations, step)]


class GateError(Exception):
    pass


def gate(values: Mapping[str, float | None], minima: Mapping[str, float], maxima: Mapping[str, float] | None = None) -> list[str]:
    """What fails: values that are missing, below a minimum or above a maximum."""
    out = [f"{k}: {values.get(k)} is below {v}" for k, v in minima.items() if values.get(k) is None or values[k] < v]
    return out + [f"{k}: {values.get(k)} is above {v}" for k, v in (maxima or {}).items() if v is not None and (values.get(k) is None or values[k] > v)]


def enforce(values: Mapping[str, float | None], minima: Mapping[str, float], maxima: Mapping[str, float] | None = None) -> None:
    if failed := gate(values, minima, maxima):
        raise GateError("; ".join(failed))

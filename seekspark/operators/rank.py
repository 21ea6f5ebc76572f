"""Ordering, cuts, roll-ups, diversity and re-ranking of results (query_id, storage_key, score, rank)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vector import cosine


def ordered(hits: DataFrame, k: int | None = None, priority: str | None = None) -> DataFrame:
    order = ([F.desc(priority)] if priority else []) + [F.desc("score"), F.col("storage_key")]
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out if k is None else out.filter(F.col("rank") <= k)


def adaptive_limit(hits: DataFrame, requested: int, maximum: int = 100, ratio: float = 0.5, minimum: float = 0.0, max_gap: float = float("inf")) -> DataFrame:
    """Goes on past `requested` results while scores stay near the first and near the one before."""
    w = Window.partitionBy("query_id").orderBy("rank")
    top = F.first("score").over(w)
    fails = (F.col("score") < F.greatest(F.lit(minimum), top * ratio)) | ((F.lag("score").over(w) - F.col("score")) > max_gap)
    marked = hits.withColumn("_fail", F.when((F.col("rank") > requested) & fails, F.col("rank")))
    first = F.min("_fail").over(Window.partitionBy("query_id"))
    cap = max(requested, maximum)
    return marked.withColumn("_first", first).filter((F.col("rank") <= cap) & (F.col("rank") < F.coalesce("_first", F.lit(cap + 1)))).drop("_fail", "_first")


def identifier_priority(hits: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """priority 1 for the record that the query names by id, key, kind:id or workspace:kind:id."""
    q = queries.select("query_id", F.lower(F.trim("text")).alias("q"))
    r = records.select("storage_key", "workspace_id", "source_kind", "source_id")
    names = F.array(F.lower("source_id"), F.lower("storage_key"), F.lower(F.concat_ws(":", "source_kind", "source_id")), F.lower(F.concat_ws(":", "workspace_id", "source_kind", "source_id")))
    return hits.join(q, "query_id").join(r, "storage_key").withColumn("priority", F.array_contains(names, F.col("q")).cast("int")).drop("q", "workspace_id", "source_kind", "source_id")


def roll_up(hits: DataFrame, chunks: DataFrame, matches: int = 3) -> DataFrame:
    """(query_id, storage_key, score, chunk_matches): chunk hits come under their parent with the best score of either.

    chunks: (chunk_key, parent_key, chunk_id, start_pos, content).
    """
    c = chunks.select(F.col("chunk_key").alias("storage_key"), "parent_key", "chunk_id", "start_pos", "content")
    both = hits.join(c, "storage_key", "left").withColumn("parent", F.coalesce("parent_key", "storage_key"))
    entry = F.when(F.col("chunk_id").isNotNull(), F.struct((-F.col("score")).alias("negative"), "start_pos", "chunk_id", "content"))
    out = both.groupBy("query_id", F.col("parent").alias("storage_key")).agg(F.max("score").alias("score"), F.slice(F.array_sort(F.collect_list(entry)), 1, matches).alias("m"))
    return out.select("query_id", "storage_key", "score", F.transform("m", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), (-x["negative"]).alias("score"), x["content"].alias("content"))).alias("chunk_matches"))


def expand_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Each child's key becomes its parent's; of repeated keys the first stays. parents: (storage_key, parent_key)."""
    out = hits.join(parents.select("storage_key", "parent_key"), "storage_key", "left").withColumn("storage_key", F.coalesce("parent_key", "storage_key")).drop("parent_key")
    w = Window.partitionBy("query_id", "storage_key").orderBy("rank")
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def mmr(hits: DataFrame, vectors: DataFrame, trade_off: float = 0.7) -> DataFrame:
    """Re-orders each query's results by maximal marginal relevance; those without a vector come last, in order."""
    joined = hits.join(vectors.select("storage_key", "embedding"), "storage_key", "left").select("query_id", "storage_key", "score", "rank", "embedding")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", ignore_index=True)
        has = group["embedding"].map(lambda v: v is not None)
        own = group[has].reset_index(drop=True)
        if not len(own):
            return group[["query_id", "storage_key", "score"]].assign(rank=np.arange(1, len(group) + 1))
        low, high = own["score"].min(), own["score"].max()
        relevance = np.ones(len(own)) if low == high else ((own["score"] - low) / (high - low)).to_numpy()
        x = np.array(own["embedding"].tolist(), float).reshape(len(own), -1)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(size > 0, size, 1)
        near, left, order = np.zeros(len(own)), np.ones(len(own), bool), []
        for _ in range(len(own)):
            value = np.where(left, trade_off * relevance - (1 - trade_off) * near, -np.inf)
            at = int(value.argmax())
            order.append(at)
            left[at] = False
            near = np.maximum(near, np.clip(x @ x[at], 0, 1))
        out = pd.concat([own.iloc[order], group[~has]])
        out["rank"] = np.arange(1, len(out) + 1)
        return out[["query_id", "storage_key", "score", "rank"]]

    kinds = {n: hits.schema[n].dataType.simpleString() for n in ("query_id", "storage_key")}
    return joined.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, storage_key {kinds['storage_key']}, score double, rank int")


def rerank_texts(records: DataFrame, most: int) -> DataFrame:
    body = F.coalesce(F.nullif(F.col("indexed_text"), F.lit("")), F.col("body")) if "indexed_text" in records.columns else F.col("body")
    return records.select("storage_key", F.substring(F.concat_ws("\n", "title", body), 1, most).alias("text"))


def reranked(hits: DataFrame, scores: DataFrame, budget: int) -> DataFrame:
    """New order of the first `budget` results by (query_id, storage_key, new_score); one without a new score keeps its slot, the tail follows."""
    s = scores.select("query_id", "storage_key", F.col("new_score"))
    out = hits.join(s, ["query_id", "storage_key"], "left").withColumn("_in", (F.col("rank") <= budget) & F.col("new_score").isNotNull())
    by_new = Window.partitionBy("query_id", "_in").orderBy(F.desc("new_score"), "storage_key")
    by_old = Window.partitionBy("query_id", "_in").orderBy("rank")
    out = out.withColumns({"_new": F.row_number().over(by_new), "_old": F.row_number().over(by_old)})
    slots = out.filter("_in").select("query_id", F.col("_old").alias("_new"), F.col("rank").alias("_slot"))
    moved = out.filter("_in").join(slots, ["query_id", "_new"]).withColumns({"rank": F.col("_slot"), "score": F.col("new_score")}).drop("_slot")
    return moved.select(*hits.columns).union(out.filter("NOT _in").select(*hits.columns))


def cosine_scores(hits: DataFrame, vectors: DataFrame, query_vectors: DataFrame, digits: int = 9) -> DataFrame:
    """(query_id, storage_key, new_score): (cosine + 1) / 2 of the stored vectors."""
    q = query_vectors.select("query_id", F.col("embedding").alias("q"))
    return hits.join(vectors.select("storage_key", "embedding"), "storage_key").join(q, "query_id").select("query_id", "storage_key", F.round((cosine(F.col("embedding"), F.col("q")) + 1) / 2, digits).alias("new_score"))


def cascade(fast: pd.DataFrame, slow: Callable[[pd.DataFrame], np.ndarray], escalated: int = 15, gap: float = 0.1) -> pd.DataFrame:
    """One query's rows (storage_key, score) in fast order; the slow scorer decides near ties at the boundary.

    More than `escalated` rows: slow scores are wanted if the scores around the boundary are closer than
    `gap`, and are scaled to stay above the rest; else if the first two are.
    """
    rows = fast.sort_values(["score", "storage_key"], ascending=[False, True], ignore_index=True)
    n = len(rows)
    s = rows["score"].to_numpy()
    close = n > 1 and (s[escalated - 1] - s[escalated] < gap if n > escalated else s[0] - s[1] < gap)
    if not close:
        return rows
    head, tail = rows.iloc[:escalated].copy(), rows.iloc[escalated:]
    new = np.asarray(slow(head), float)
    if len(tail):
        floor = float(tail["score"].max())
        room = max(1.0 - floor, 1e-9)
        low, high = new.min(), new.max()
        scaled = np.ones(len(new)) if high == low else (new - low) / (high - low)
        new = floor + room * (1e-6 + (1 - 1e-6) * scaled)
    head["score"] = new
    return pd.concat([head.sort_values(["score", "storage_key"], ascending=[False, True]), tail], ignore_index=True)


def cascade_rerank(hits: DataFrame, slow: DataFrame, escalated: int = 15, gap: float = 0.1) -> DataFrame:
    """`cascade` for every query; slow: (query_id, storage_key, slow_score)."""
    joined = hits.join(slow, ["query_id", "storage_key"], "left").select("query_id", "storage_key", "score", F.coalesce("slow_score", F.lit(0.0)).alias("slow_score"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        out = cascade(group, lambda h: h["slow_score"].to_numpy(), escalated, gap)
        out["rank"] = np.arange(1, len(out) + 1)
        return out[["query_id", "storage_key", "score", "rank"]]

    kinds = {n: hits.schema[n].dataType.simpleString() for n in ("query_id", "storage_key")}
    return joined.groupBy("query_id").applyInPandas(one, f"query_id {kinds['query_id']}, storage_key {kinds['storage_key']}, score double, rank int")


def duplicates(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg((F.count(F.lit(1)) - F.count_distinct("storage_key")).alias("duplicates"))


def hydrated(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits with their records; bodies are joined after the cut. A key that no record has is dropped."""
    return hits.join(records, "storage_key")

"""Hybrid search as one DataFrame program over a table of queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters as flt
from ..operators import fusion, graph, keyword, rank, vector
from ..sources.store import stored
from .router import Config

Hook = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Policy:
    """User hooks; each takes and returns a DataFrame of hits (or results)."""

    candidate_filter: Hook | None = None
    score_adjuster: Hook | None = None
    result_filter: Hook | None = None
    post_process: Hook | None = None
    vector_ranking: Hook | None = None
    graph_targets: Hook | None = None
    query_expander: Callable[[DataFrame], DataFrame] | None = None
    reranker: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Engine:
    """Tables of one corpus: records, and where there are any vectors, edges and chunks."""

    records: DataFrame
    index: keyword.Index
    vectors: DataFrame | None = None
    edges: DataFrame | None = None
    chunks: DataFrame | None = None
    config: Config = Config()
    policy: Policy = field(default_factory=Policy)

    def lanes(self, queries: DataFrame, limit: int, filters: Mapping[str, Any] | None = None) -> DataFrame:
        """(query_id, lane, storage_key, rank, score). queries: (query_id, text) and, for the vector lane, embedding."""
        c = self.config
        budget = max(limit * c.candidate_multiplier, c.minimum_candidates)
        allowed = flt.apply(self.records, filters).select("storage_key")
        semantic = (filters or {}).get("retrieval_mode") in ("semantic", "semantic_only")
        out = None
        if not semantic:
            out = fusion.lane(keyword.search(self.index, queries, c.keyword_budget or budget, allowed), "keyword")
        if self.vectors is not None and "embedding" in queries.columns:
            own = self.vectors.join(allowed, "storage_key", "left_semi")
            hits = vector.top_k(own, queries.filter("embedding IS NOT NULL"), c.vector_budget or budget)
            hits = flt.policy(fusion.lane(hits, "vector"), self.policy.vector_ranking)
            out = hits if out is None else out.unionByName(hits)
        if out is None:
            raise ValueError("no lane can serve the queries")
        return flt.policy(out, self.policy.candidate_filter)

    def fused(self, lanes: DataFrame) -> DataFrame:
        c = self.config
        weights = {"vector": c.semantic_weight, "keyword": c.keyword_weight, "graph": c.graph_weight} if c.weighted else None
        return fusion.reciprocal_rank(lanes, weights, c.rrf_k) if c.fusion == "rrf" else fusion.calibrated(lanes, weights)

    def graph_lane(self, fused: DataFrame, direction: str = "outgoing", filters: Mapping[str, Any] | None = None) -> DataFrame:
        """Neighbours of each query's best hits that the filters allow, as every other lane's hits are."""
        seeds = flt.policy(fused, self.policy.graph_targets)
        hits = graph.expand(self.edges, seeds, self.config.max_graph_seeds, self.config.max_neighbors_per_seed, direction)
        hits = hits.join(flt.apply(self.records, filters).select("storage_key"), "storage_key", "left_semi")
        return fusion.lane(rank.ordered(hits), "graph")

    def search(self, queries: DataFrame, limit: int = 10, filters: Mapping[str, Any] | None = None, relationship: bool = False, direction: str = "outgoing", hydrate: bool = True) -> DataFrame:
        """(query_id, rank, storage_key, score, normalized_score, provenance) and, hydrated, the record's columns."""
        c = self.config
        lanes = stored(self.lanes(queries, limit, filters), "lanes")  # fused, compared and shown from one table
        fused = self.fused(lanes)
        if self.edges is not None and (relationship or c.adaptive_graph):
            found = self.graph_lane(fused, direction, filters)
            if not relationship:
                ready = graph.adaptive_ready(lanes, c.max_graph_seeds).filter("ready").select("query_id")
                found = found.join(ready, "query_id", "left_semi")
            direct = lanes
            lanes = lanes.unionByName(found)
            fused = fusion.graph_maximum(fused, found) if c.graph_fusion == "max" else self.fused(lanes)
            fused = graph.prioritized(fused, direct, relationship, c.graph_only_penalty)
        else:
            fused = fused.withColumn("priority", F.lit(0))
        if self.policy.score_adjuster:
            fused = self.policy.score_adjuster(fused)
        fused = fused.withColumn("score", F.round("score", 9))
        named = rank.identifier_priority(fused.drop("priority"), queries, self.records).select("query_id", "storage_key", F.col("priority").alias("exact"))
        fused = fused.join(named, ["query_id", "storage_key"], "left").withColumn("priority", F.coalesce("exact", F.lit(0)) * 10 + F.col("priority")).drop("exact")
        if self.chunks is not None:
            rolled = rank.roll_up(fused, self.chunks, c.max_chunk_matches)
            fused = rolled.join(fused.select("query_id", "storage_key", "priority"), ["query_id", "storage_key"], "left").fillna({"priority": 0})
        top = rank.ordered(fused, max(limit, c.maximum_limit) if c.adaptive_limit else limit, "priority")
        if c.adaptive_limit:
            top = rank.adaptive_limit(top, limit, c.maximum_limit, c.score_ratio_floor)
        if self.policy.reranker and c.rerank_budget:
            top = rank.reranked(top, self.policy.reranker(top), min(c.rerank_budget, limit))
        top = flt.policy(top, self.policy.post_process)
        out = fusion.normalized(top).join(fusion.provenance(lanes), ["query_id", "storage_key"], "left")
        if hydrate:
            out = flt.policy(rank.hydrated(out, self.records), self.policy.result_filter)
        return out


def engine(records: DataFrame, vectors: DataFrame | None = None, edges: DataFrame | None = None, chunks: DataFrame | None = None, config: Config = Config(), policy: Policy | None = None, index: keyword.Index | None = None) -> Engine:
    """`index` is a stored one; without it the records are indexed for each search anew."""
    return Engine(records, index or keyword.build(records), vectors, edges, chunks, config, policy or Policy())

"""Query planning on the driver: which lanes run, with which budgets and weights."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import analyze


@dataclass(frozen=True)
class Config:
    candidate_multiplier: int = 5
    minimum_candidates: int = 1
    keyword_budget: int | None = None
    vector_budget: int | None = None
    semantic_weight: float = 1.0
    keyword_weight: float = 1.0
    graph_weight: float = 1.0
    weighted: bool = False
    fusion: str = "rrf"  # or calibrated
    graph_fusion: str = "rrf"  # or max
    rrf_k: int = 60
    graph_depth: int = 1
    max_graph_seeds: int = 10
    max_neighbors_per_seed: int = 10
    adaptive_graph: bool = False
    graph_only_penalty: float = 0.5
    rerank_budget: int = 0
    expansion_strategy: str | None = None
    adaptive_limit: bool = False
    maximum_limit: int = 100
    score_ratio_floor: float = 0.5
    max_chunk_matches: int = 3

    def __post_init__(self):
        for name in ("candidate_multiplier", "minimum_candidates", "graph_depth", "max_graph_seeds", "max_neighbors_per_seed", "rrf_k"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        for name in ("keyword_budget", "vector_budget"):
            if (v := getattr(self, name)) is not None and v < 1:
                raise ValueError(f"{name} must be positive")
        for name in ("semantic_weight", "keyword_weight", "graph_weight"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.fusion not in ("rrf", "calibrated") or self.graph_fusion not in ("rrf", "max"):
            raise ValueError("unknown fusion")


@dataclass(frozen=True)
class Plan:
    query_type: str
    signals: dict
    keyword: bool
    vector: bool
    graph: bool
    keyword_budget: int
    vector_budget: int
    weights: dict[str, float]
    vector_bounded: bool
    rerank_budget: int
    expansion: str | None
    skipped: tuple[str, ...] = field(default=())


def _budget(config: Config, limit: int, own: int | None) -> int:
    return max(own if own is not None else limit * config.candidate_multiplier, config.minimum_candidates)


def route(queries: DataFrame, limit: int, config: Config = Config(), keyword: bool = True, vector: bool = True, graph: bool = False, graph_ready: bool = False, reranker: bool = False, mode: str = "hybrid") -> dict:
    """query_id to Plan for a small table of typed queries (query_id, text)."""
    if limit < 1:
        raise ValueError("limit must be positive")
    if mode in ("semantic", "semantic_only"):
        keyword = graph = False
    from pyspark.sql import functions as F

    q = F.col("text")
    kind = analyze.query_type(q)
    rows = queries.select("query_id", kind.alias("kind"), analyze.signals(q).alias("s"), analyze.adaptive_weights(F.when(analyze.is_factual(q), "factual").otherwise(kind), config.semantic_weight, config.keyword_weight, config.graph_weight).alias("w")).collect()
    out = {}
    for r in rows:
        s = r["s"].asDict(recursive=True)
        use_graph = graph and (s["relationship"] or (config.adaptive_graph and graph_ready))
        skipped = [f"{n}:unavailable" for n, there in (("keyword", keyword), ("vector", vector), ("graph", graph)) if not there]
        if graph and not s["relationship"]:
            skipped.append("graph:awaiting_seed_confidence" if config.adaptive_graph else "graph:query_not_relationship")
        if s["artifact"]:
            skipped.append("vector:awaiting_keyword_confidence" if keyword else "vector:keyword_unavailable_unbounded")
        expansion = config.expansion_strategy if not s["artifact"] and r["kind"] == "exploratory" else None
        if config.expansion_strategy and expansion is None:
            skipped.append("expansion:query_not_eligible")
        if config.rerank_budget and not reranker:
            skipped.append("rerank:unavailable")
        out[r["query_id"]] = Plan(r["kind"], s, keyword, vector, use_graph, _budget(config, limit, config.keyword_budget), _budget(config, limit, config.vector_budget), r["w"].asDict(), s["artifact"] and keyword, min(config.rerank_budget, limit) if reranker else 0, expansion, tuple(skipped))
    return out


def needs_expansion(found: int, limit: int, top: float | None) -> bool:
    return found < limit or top is None or top <= 0


def bounded_schedule(k: int, multiplier: float, most: int, rounds: int) -> list[int]:
    """Limits of repeated approximate scans."""
    out, n = [], float(k)
    for _ in range(rounds):
        out.append(min(most, int(-(-n // 1))))
        if out[-1] >= most:
            break
        n *= multiplier
    return out

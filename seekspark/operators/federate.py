"""Federated search: hits of several sources fused by reciprocal rank, one result for each identity or URI."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import uri_key
from ..sources.store import drop_path, stored
from .fusion import RRF_K

MAX_TOP_K, MAX_QUERY = 1000, 4096


def entities(hits: DataFrame) -> DataFrame:
    """Adds `entity`: the least name that hits share by identity or URI, directly or through others.

    hits: (query_id, source, identity, uri, rank). A hit without either is an entity of its own, by source and rank.
    The identities that share a URI are linked to the least of them, and what these stars leave unconnected
    is joined by `connected`.
    """
    given = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(c))
    hits = hits.withColumn("u", uri_key("uri"))
    pairs = hits.select("query_id", given("identity").alias("i"), given("u").alias("u")).filter("i IS NOT NULL AND u IS NOT NULL").distinct()
    first = pairs.groupBy("query_id", "u").agg(F.min("i").alias("m"))
    root = connected(pairs.join(first, ["query_id", "u"]).filter("i <> m").select("query_id", F.col("m").alias("a"), F.col("i").alias("b")))
    alone = F.coalesce(F.concat(F.lit("uri:"), given("u")), F.concat_ws(":", F.lit("n"), F.col("source"), F.col("rank").cast("string")))
    out = hits.join(first, ["query_id", "u"], "left").withColumn("node", F.coalesce(given("identity"), F.col("m"))).join(root, ["query_id", "node"], "left")
    return out.withColumn("entity", F.coalesce("root", "node", alone)).drop("m", "node", "root")


def connected(edges: DataFrame) -> DataFrame:
    """(query_id, node, root) of the nodes of undirected edges (query_id, a, b): root is the least node that one is connected with."""
    spark, by = edges.sparkSession, "query_id"
    now = stored(edges.select(by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    named = now.select(by, F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(by, "a", "a").distinct())
    if now.join(now.select(by, F.col("b").alias("a")), [by, "a"], "left_semi").isEmpty() and now.groupBy(by, "b").count().filter("count > 1").isEmpty():
        return named  # stars already
    before = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(by, "a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(by, F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(by, "a", "a").distinct())
        before = state
        both = now.union(now.select(by, "b", "a"))
        least = both.groupBy(by, "a").agg(F.min("b").alias("m")).select(by, "a", F.least("a", "m").alias("m"))
        large = both.join(least, [by, "a"]).filter("b > a").select(by, F.col("m").alias("a"), "b").filter("a <> b").distinct()
        least = large.groupBy(by, "b").agg(F.min("a").alias("m"))
        small = large.join(least, [by, "b"]).select(by, "m", F.explode(F.array("a", "b")).alias("y"))
        after = stored(small.filter("m <> y").select(by, F.col("m").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        drop_path(spark, now.stored_at)
        now = after


def fuse(hits: DataFrame, k: int = RRF_K, top_k: int | None = None, weights: Mapping[str, float] | None = None, digits: int = 9) -> DataFrame:
    """(query_id, entity, score, first_seen, sources, rank) over sources; each source counts once with its best rank."""
    own = entities(hits)
    best = own.groupBy("query_id", "source", "entity").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id", "source").orderBy("rank", "entity")
    best = best.withColumn("r", F.row_number().over(w))
    weight = F.lit(1.0)
    for s, v in (weights or {}).items():
        weight = F.when(F.col("source") == s, float(v)).otherwise(weight)
    out = best.groupBy("query_id", "entity").agg(F.round(F.sum(weight / (k + F.col("r"))), digits).alias("score"), F.min(F.struct("r", "source")).alias("first"), F.sort_array(F.collect_set("source")).alias("sources"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "entity")))
    out = out.select("query_id", "entity", "score", F.col("first.r").alias("first_seen"), "sources", "rank")
    return out if top_k is None else out.filter(F.col("rank") <= min(top_k, MAX_TOP_K))


@dataclass(frozen=True)
class Source:
    """A registered source: search gives hits (query_id, source, identity, uri, rank)."""

    name: str
    search: Callable[[DataFrame, int], DataFrame]
    kinds: Sequence[str] = ()
    workspaces: Sequence[str] = ()
    max_top_k: int = 100


@dataclass(frozen=True)
class Event:
    kind: str  # source, failed, provisional or final
    source: str | None = None
    results: list = field(default_factory=list)
    error: str | None = None


def selected(sources: Sequence[Source], names: Sequence[str] | None = None, kind: str | None = None, workspace: str | None = None) -> list[Source]:
    return [s for s in sources if (names is None or s.name in names) and (kind is None or not s.kinds or kind in s.kinds) and (workspace is None or not s.workspaces or workspace in s.workspaces)]


def events(sources: Sequence[Source], queries: DataFrame, top_k: int, seconds: float = 5.0, concurrency: int = 8, strict: bool = False) -> Iterator[Event]:
    """Runs the sources side by side; after each that ends a provisional fusion, at last the final one. A failed or late source is reported."""
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be 1 to {MAX_TOP_K}")
    if "text" in queries.columns and not queries.filter(F.length("text") > MAX_QUERY).isEmpty():
        raise ValueError(f"a query has at most {MAX_QUERY} characters")
    spark, found = queries.sparkSession, []
    columns = ["query_id", "source", "identity", "uri", "rank"]
    schema = None

    started: dict[str, float] = {}  # each source has its own time, from its own start

    def one(s: Source) -> tuple[list, object]:
        started[s.name] = time.monotonic()
        hits = s.search(queries, min(top_k, s.max_top_k)).filter(F.col("rank") <= top_k).select(*columns)
        return hits.collect(), hits.schema

    def fused() -> list:
        return fuse(spark.createDataFrame(found, schema), top_k=top_k).orderBy("query_id", "rank").collect() if found else []

    pool = ThreadPoolExecutor(max_workers=concurrency)
    try:
        open_ = {pool.submit(one, s): s for s in sources}
        while open_:
            ends = [started[s.name] + seconds for s in open_.values() if s.name in started]
            done, _ = wait(open_, timeout=max(0.0, min(ends) - time.monotonic()) if ends else 0.05, return_when=FIRST_COMPLETED)
            late = [f for f, s in open_.items() if f not in done and time.monotonic() - started.get(s.name, float("inf")) >= seconds]
            for f in late:
                s = open_.pop(f)
                if strict:
                    raise TimeoutError(s.name)
                yield Event("failed", s.name, error="timeout")
            for f in done:
                s = open_.pop(f)
                try:
                    rows, schema = f.result()
                except Exception as e:  # noqa: BLE001 - a source's failure is data in lenient mode
                    if strict:
                        raise
                    yield Event("failed", s.name, error=str(e)[:500])
                    continue
                found += rows
                yield Event("source", s.name, rows)
                if open_:
                    yield Event("provisional", results=fused())
        yield Event("final", results=fused())
    finally:
        pool.shutdown(wait=False, cancel_futures=True)

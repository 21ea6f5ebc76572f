"""Units of the retrieval operators that SQL doesn't cover, and the registered queries against DuckDB."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seekspark import catalog, catalog_units
from seekspark.functions import analyze, keys, text
from seekspark.operators import chunk, embed, evaluate, federate, filters, fusion, graph, keyword, rank, vector
from seekspark.plans import router, search
from seekspark.sources import discovery, store, synthetic
from seekspark.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    assert catalog_units
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_storage_keys(spark):
    for ws, kind, i in [("w", "k", "1"), (None, "k", 'a"b'), ("é/ü", "", "x\ny"), ("w", "k", "中")]:
        key = one(spark, keys.storage_key(F.lit(ws).cast("string"), F.lit(kind), F.lit(i)))
        assert one(spark, keys.parse_storage_key(F.lit(key))).asDict() == {"workspace_id": ws, "source_kind": kind, "source_id": i}
    for bad in ("record:[]", 'record:["a","b"]', 'record: ["a","b","c"]', "x", 'record:["a",null,"c"]'):
        assert one(spark, keys.parse_storage_key(F.lit(bad))) is None


@pytest.mark.parametrize("q,kind", [("parseHTML usage", "factual"), ("snake_case_name", "factual"), ("v1.2.3 notes", "factual"), ("src/app.py", "factual"), ("[[getUser]]", "navigational"), ("the guide", "navigational"), ("in the kitchen", "navigational"), ("how does it work", "exploratory"), ("plain words", "exploratory"), ('"exact words"', "factual")])
def test_query_types(spark, q, kind):
    assert one(spark, analyze.query_type(F.lit(q))) == kind


def test_graph_direction(spark):
    for q, d in [("what links to the parser?", "incoming"), ("which pages does a link to", "outgoing"), ("which notes are neighbors of x", "both"), ("upstream services", "incoming"), ("words", "outgoing")]:
        assert one(spark, analyze.graph_direction(F.lit(q))) == d


def test_score_ladders(spark):
    def score(q, **f):
        g = {"title": "", "body": "", "headers": "", "uri": ""} | f
        return one(spark, text.artifact_score(F.lit(q), F.lit(g["title"]), F.lit(g["body"]), F.lit(None).cast("string"), F.lit(g["headers"]), F.lit(g["uri"])))

    assert score("alpha", title="Alpha") == 80 + 102 + 0
    assert score("alpha", title="the alpha case") == 24 + 88
    assert score("alpha", headers="x > alpha") == max(14, 112 * 0.75) + 82
    assert score("a/b.py", uri="a/b.py") == 60 + 120
    assert score("b.py", uri="a/b.py") == 56 + 115
    assert score("alpha", body="has alpha in it") == 4 + 74
    assert score("", title="x") == 120.0 or score("", title="x") >= 0


def test_keyword_stages(spark):
    docs = [("k1", "Red fox", "the quick red fox", "u/1", ""), ("k2", "Blue", "a blue whale", "u/2", ""), ("k3", "Mixed", "red whale", "u/3", "")]
    r = spark.createDataFrame(docs, "storage_key string, title string, body string, uri string, keywords string")
    index = keyword.build(r)
    q = spark.createDataFrame([(1, "red fox"), (2, "fox whale"), (3, '"fox" whale'), (4, "fox"), (5, "nothing")], "query_id int, text string")
    found = {}
    for x in keyword.search(index, q, 10).orderBy("rank").collect():
        found.setdefault(x["query_id"], []).append((x["storage_key"], x["stage"]))
    assert found[1] == [("k1", "and")] and {k for k, _ in found[2]} == {"k1", "k2", "k3"} and found[2][0][1] == "or"
    assert 3 not in found and [k for k, _ in found[4]] == ["k1"] and 5 not in found
    fuzzy = keyword.fuzzy(index, r, spark.createDataFrame([(1, "quikc whale"), (2, "quickk fxxx")], "query_id int, text string"), 5).collect()
    assert [(x["query_id"], x["storage_key"]) for x in fuzzy] == []
    hit = keyword.fuzzy(index, r, spark.createDataFrame([(1, "bluee whalle")], "query_id int, text string"), 5).collect()
    assert [x["storage_key"] for x in hit] == ["k2"] and keyword.fuzzy_score("whalle", ["whale"]) > 0.9
    assert keyword.sanitized('a-b "two words" pre* OR.') == [("term", "a"), ("term", "b"), ("phrase", "two words"), ("prefix", "pre"), ("term", "OR")]


@pytest.mark.parametrize("block", [7, 4096])
def test_vector_top_k_in_blocks_and_by_query_block(spark, monkeypatch, block):
    monkeypatch.setattr(vector, "BLOCK_ROWS", block)
    g = np.random.default_rng(0)
    v = g.normal(size=(40, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, embedding array<double>")
    got = vector.top_k(df, df.select(F.col("k").alias("query_id"), "embedding"), 4, "k", skip_self=True).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    for i in range(40):
        assert [x["k"] for x in sorted((x for x in got if x["query_id"] == i), key=lambda x: x["rank"])] == sorted(range(40), key=lambda j: (-s[i, j], j))[:4]


def test_approximate_recall(spark, sf):
    assert catalog.QUERIES["vector_approximate_recall"](spark, sf).agg(F.avg("recall")).first()[0] >= 0.9


def test_isotonic(spark):
    data = [(i / 10, int(i >= 5)) for i in range(10) for _ in range(20)] + [(0.3, 1)] * 5
    curve = fusion.fit_isotonic(spark.createDataFrame(data, "score double, label int"))
    assert all(a <= b for a, b in zip(curve.ys, curve.ys[1:])) and curve.at(-1) == curve.ys[0] and curve.at(2) == 1
    assert abs(one(spark, curve(F.lit(0.45))) - curve.at(0.45)) < 1e-12
    assert fusion.fit_isotonic(spark.createDataFrame(data[:10], "score double, label int")) is None


def test_mmr_prefers_the_different(spark):
    h = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 0.9, 2), (1, "c", 0.5, 3), (1, "d", 0.1, 4)], "query_id int, storage_key string, score double, rank int")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.01]), ("c", [0.0, 1.0])], "storage_key string, embedding array<double>")
    assert [x["storage_key"] for x in rank.mmr(h, v, 0.5).orderBy("rank").collect()] == ["a", "c", "b", "d"]


def test_rerank_keeps_slots(spark):
    h = spark.createDataFrame([(1, c, 1.0 - i / 10, i + 1) for i, c in enumerate("abcde")], "query_id int, storage_key string, score double, rank int")
    new = spark.createDataFrame([(1, "a", 0.1), (1, "c", 0.9), (1, "e", 1.0)], "query_id int, storage_key string, new_score double")
    assert [x["storage_key"] for x in rank.reranked(h, new, 4).orderBy("rank").collect()] == ["c", "b", "a", "d", "e"]


def test_graph_walk_and_pagerank(spark):
    e = spark.createDataFrame([("a", "b", "links_to", 0.5), ("b", "c", "links_to", 0.5), ("a", "c", "related", 0.2), ("c", "a", "tests", 1.0)], "src_key string, dst_key string, edge_type string, weight double")
    s = spark.createDataFrame([("a",)], "seed string")
    two = {x["storage_key"]: (x["weight"], x["edge_type"]) for x in graph.neighbors(e, s, 2).collect()}
    assert two == {"b": (0.5, "links_to"), "c": (0.25, "links_to")}
    h = spark.createDataFrame([(1, "a", 2.0)], "query_id int, storage_key string, score double")
    p = {x["storage_key"]: x["score"] for x in graph.pagerank(e, h, depth=1).collect()}
    assert p == {"b": round(0.85 * 0.85, 9), "c": round(0.85 * 0.7, 9)}
    with pytest.raises(ValueError):
        store.upsert_edges(e.limit(0), e, spark.createDataFrame([("a",)], "storage_key string"))


def test_chunker():
    body = "# One\n\nintro\n\n## Two\n\n" + "word " * 60 + "\n\n```\n# not a heading\n```\n\nThree\n=====\n\n" + "\n\n".join("para " * 30 for _ in range(4))
    assert [(a, b) for a, b, _, _ in chunk.headings(body)] == [(1, "One"), (2, "Two"), (1, "Three")]
    parts = chunk.chunks("s", body, chunk.Sizes(50, 400, 20))
    assert parts[0].text.startswith("One") and parts[0].path == ("One", "Two") and any("_sub_1" in p.name for p in parts)
    assert any(p.text.startswith("[...") for p in parts)
    plain = chunk.chunks("s", "\n\n".join("x" * 300 for _ in range(5)), chunk.Sizes(10, 700, 0))
    assert [len(p.text) for p in plain] == [602, 602, 300]


def test_metrics_and_statistics(spark):
    res = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 3), (2, "z", 1)], "query_id int, item string, rank int")
    g = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 1.0), (2, "y", 1.0)], "query_id int, item string, gain double")
    m = {x["query_id"]: x for x in evaluate.metrics(res, g, spark.createDataFrame([(1,), (2,), (3,)], "query_id int"), 3).collect()}
    assert m[1]["recall"] == round(2 / 3, 9) and m[1]["mrr"] == 0.5 and m[1]["ap"] == round((1 / 2 + 2 / 3) / 3, 9)
    idcg = 1 + 1 / math.log2(3) + 0.5
    assert m[1]["ndcg"] == round((1 / math.log2(3) + 0.5) / idcg, 9) and m[3]["recall"] == 0
    c = evaluate.compare_paired([(0.1, 0.3), (0.2, 0.5), (0.3, 0.4), (0.1, 0.4)] * 5, 2000)
    assert c.mean_difference > 0 and c.p_value < 0.01 and c.low <= c.mean_difference <= c.high
    assert evaluate.gate({"recall": 0.7}, {"recall": 0.8}) and not evaluate.gate({"recall": 0.9}, {"recall": 0.8})


def test_federation_joins_identities_and_uris(spark):
    h = spark.createDataFrame([(1, "s1", "a", "http://H/x/", 1), (1, "s2", "b", "HTTP://h/x", 1), (1, "s2", "c", None, 2), (1, "s3", "b", "", 1)], "query_id int, source string, identity string, uri string, rank int")
    out = federate.fuse(h).orderBy("rank").collect()
    assert out[0]["sources"] == ["s1", "s2", "s3"] and len(out) == 2
    sources = [federate.Source("ok", lambda q, k: h), federate.Source("bad", lambda q, k: 1 / 0)]
    kinds = [e.kind for e in federate.events(sources, spark.createDataFrame([(1,)], "query_id int"), 5, 60)]
    assert kinds[-1] == "final" and "failed" in kinds and "source" in kinds


def test_tables_stream_and_reindex(spark, tmp_path):
    t = store.Tables(spark, f"file://{tmp_path}/tables")
    src = tmp_path / "in"
    rec = lambda lo, hi, b: spark.createDataFrame([(f"k{i}", f"t{i}", b, f"u{i}", "", i) for i in range(lo, hi)], "storage_key string, title string, body string, uri string, keywords string, updated_at long")
    rec(0, 5, "first text").write.parquet(str(src), mode="append")
    marks = store.Checkpoints(spark, f"file://{tmp_path}/cursor")
    for step in range(2):
        i = ingest.Ingestor(t, marks, "notes")
        i.start(spark.readStream.schema(rec(0, 1, "x").schema).parquet(str(src)), str(tmp_path / "check")).awaitTermination()
        rec(3, 8, "second text").write.parquet(str(src), mode="append")
    assert t.read("records").count() == 8 and marks.get(None, "notes") == "7"
    epoch = t.epoch("records")
    assert not t.upsert("records", t.read("records").limit(2)) and t.epoch("records") == epoch
    bad = spark.createDataFrame([("k9", "", "", "u", "", 1), ("k10", "t", "b", "u", "", 0)], rec(0, 1, "x").schema)
    with pytest.raises(ValueError):
        ingest.Ingestor(t, marks, "notes").write(bad, 9)
    lenient = ingest.Ingestor(t, marks, "notes", strict=False)
    lenient.write(bad, 9)
    assert lenient.receipts[0].rejected == 1 and lenient.receipts[0].cursor == "0" and t.read("records").count() == 9
    encode = embed.encoder(dim=8)
    t.replace(vectors=t.read("records").select("storage_key", F.lit("old").alias("model_name"), F.lit(8).alias("dim"), encode("title").alias("embedding")))
    r = ingest.Reindex(t, lambda d: d.withColumn("embedding", encode("body")), "new", 8)
    r.expand()
    assert r.backfill() == 9 and r.backfill() == 0
    r.validate()
    r.flip(None)
    assert r.active() == "new"
    with pytest.raises(ValueError):
        r.flip("other")


def test_cursor_is_held_before_the_first_rejected_row_of_any_batch(spark, tmp_path):
    schema = "storage_key string, title string, body string, uri string, keywords string, updated_at long"
    marks, t = store.Checkpoints(spark, f"file://{tmp_path}/cursor"), store.Tables(spark, f"file://{tmp_path}/tables")
    i = ingest.Ingestor(t, marks, "notes", strict=False)
    row = lambda k, at, text="x": (k, text, text, "u", "", at)
    for n, rows in enumerate(([row("a", 1), row("b", 2)], [row("c", 3), row("d", 4, ""), row("e", 5)], [row("f", 6)], [row("a", 1)])):
        i.write(spark.createDataFrame(rows, schema), n)
        assert marks.get(None, "notes") == ("2" if n == 0 else "3")
    assert t.read("records").count() == 5 and t.read("lengths").count() == 5 and t.epoch("records") == 3
    i.release()
    i.write(spark.createDataFrame([row("g", 7)], schema), 4)
    assert marks.get(None, "notes") == "7"
    files = [f for f in os.listdir(tmp_path / "tables") if f.startswith("current-")]
    assert len(files) == t.KEEP and not [f for f in files if "tmp" in f]
    (tmp_path / "tables" / "current-000000000099.json.half.tmp").write_text("{")  # a crash while a pointer was written
    assert t.read("records").count() == 6


def test_graph_lane_obeys_the_filters(spark):
    records, _ = synthetic.corpus(spark, 16)
    records = records.withColumns({"uri": F.lit(""), "keywords": F.lit(""), "status": F.when(F.col("source_id") == "rec-000005", "archived").otherwise("active")})
    own = {r["source_id"]: r["storage_key"] for r in records.collect()}
    pairs = [("rec-000001", "rec-000002"), ("rec-000001", "rec-000005"), ("rec-000001", "rec-000009")]  # another workspace, an archived one, a fit one
    e = spark.createDataFrame([(own[a], own[b], "links_to", 1.0) for a, b in pairs], "src_key string, dst_key string, edge_type string, weight double")
    q = spark.createDataFrame([(1, "topic01 note 1")], "query_id int, text string")
    out = search.engine(records, None, e).search(q, 5, {"workspace_id": "ws-1"}, relationship=True).collect()
    assert {r["source_id"] for r in out} == {"rec-000001", "rec-000009"}


def test_long_chains_of_identities_are_one_entity(spark):
    h = [(1, f"s{i % 3}", f"id{(i + 1) // 2:03d}", f"http://h/{i // 2}", i) for i in range(120)] + [(2, "s", "id000", "http://h/0", 1), (1, "s9", None, None, 500)]
    out = federate.fuse(spark.createDataFrame(h, "query_id int, source string, identity string, uri string, rank int")).collect()
    assert sorted((r["query_id"], r["entity"]) for r in out) == [(1, "id000"), (1, "n:s9:500"), (2, "id000")]


def test_mmr_without_vectors_keeps_the_order(spark):
    h = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 0.9, 2)], "query_id int, storage_key string, score double, rank int")
    v = spark.createDataFrame([], "storage_key string, embedding array<double>")
    assert [(x["storage_key"], x["rank"]) for x in rank.mmr(h, v).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_walks_relaxed_by_node_equal_walks_by_path(spark):
    g = np.random.default_rng(1)
    e = spark.createDataFrame([(f"n{a}", f"n{b}", str(g.choice(["links_to", "tests"])), round(float(g.uniform(0.1, 0.99)), 2)) for a, b in g.integers(0, 12, (40, 2)) if a != b], "src_key string, dst_key string, edge_type string, weight double")
    s = e.select(F.col("src_key").alias("seed")).distinct()
    for depth in (2, 4):
        paths = graph._paths(graph.oriented(e, "outgoing"), s, depth).groupBy("seed", "at").agg(F.max("weight").alias("w")).collect()
        got = {(r["seed"], r["storage_key"]): r["weight"] for r in graph.neighbors(e, s, depth).collect()}
        assert got == {(r["seed"], r["at"]): round(r["w"], 9) for r in paths}
    heavy = e.withColumn("weight", F.col("weight") * 3)  # beyond 1 the paths themselves are walked
    assert {(r["seed"], r["storage_key"]): r["weight"] for r in graph.neighbors(heavy, s, 3).collect()} == {(r["seed"], r["at"]): round(r["w"], 9) for r in graph._paths(graph.oriented(heavy, "outgoing"), s, 3).groupBy("seed", "at").agg(F.max("weight").alias("w")).collect()}


def test_ingest_stream_keeps_the_greatest_event_over_batches(spark, tmp_path):
    folder, want = tmp_path / "events.parquet", {}
    folder.mkdir()
    for n in range(10):  # more files than two triggers take, with ids that fall from file to file, then a late high one
        ids = range(900 - 100 * n, 910 - 100 * n) if n != 8 else range(2000, 2003)
        rows = [(e, None if e % 7 == 0 else e % 5) for e in ids]
        spark.createDataFrame(rows, "event_id long, user_id long").coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        (part,) = (tmp_path / f"part{n}").glob("*.parquet")
        os.utime(part.rename(folder / f"{n}.parquet"), (1_700_000_000 + 60 * n,) * 2)
        for e, u in rows:
            key = None if u is None else str(u)
            want[key] = max(e, want.get(key, e))
    assert sorted(map(tuple, catalog.QUERIES["ingest_stream"](spark, str(tmp_path)).collect()), key=str) == sorted(want.items(), key=str)


def test_search_of_misspelt_terms_is_fuzzy(spark):
    schema = "storage_key string, title string, body string, uri string, keywords string"
    r = spark.createDataFrame([(f"k{i}", f"note {i}", b, "", "") for i, b in enumerate(["distributed database systems", "distributed ledger", "garden flowers", "distributed database systems"])], schema)
    asked = {1: "distributde databse", 2: '"distributde databse"', 3: "distributed databse", 4: "databse", 5: "distributde databse.py", 6: "gardne flowres", 7: "garden flowers"}
    q = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    got = {}
    for x in keyword.search(keyword.build(r), q, 5).collect():
        got.setdefault(x["query_id"], set()).add((x["storage_key"], x["stage"]))
    both = {("k0", "fuzzy"), ("k3", "fuzzy")}
    assert got == {1: both, 3: {("k0", "or"), ("k1", "or"), ("k3", "or")}, 6: {("k2", "fuzzy")}, 7: {("k2", "and")}}
    own = keyword.search(keyword.build(r), q.filter("query_id = 1"), 1, r.filter("storage_key = 'k3'"))
    assert [(x["storage_key"], x["rank"]) for x in own.collect()] == [("k3", 1)]
    lanes = search.engine(r.withColumn("status", F.lit("active"))).lanes(q.filter("query_id = 1"), 10)
    assert {(x["lane"], x["storage_key"]) for x in lanes.collect()} == {("keyword", "k0"), ("keyword", "k3")}


def test_discovery(spark, tmp_path):
    for p in ("a.md", "b/c.txt", "b/d.py", ".hidden/e.md", "b/skip/f.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    found = discovery.discover(spark, [str(tmp_path), "/nowhere"], exclude=["*skip/*"]).collect()
    assert [x["relative"] for x in found] == ["a.md", "b/c.txt"]
    assert discovery.should_rebuild(None, {}) and discovery.readiness(3, 1) == "partial"


def test_filter_errors():
    for bad in ({"retrieval_mode": "odd"}, {"metadata_equals": {"a-b": 1}}, {"source_scoped_filters": {"en": {"other": 1}}}):
        with pytest.raises(ValueError):
            filters.predicate(bad)


def test_routing_and_whole_search(spark):
    q = spark.createDataFrame([(1, "what links to the parser"), (2, "src/app.py"), (3, "how is it done?")], "query_id int, text string")
    plans = router.route(q, 5, router.Config(expansion_strategy="s"), graph=True)
    assert plans[1].graph and plans[2].vector_bounded and plans[2].weights["keyword"] == 1.5 and plans[3].expansion == "s" and plans[3].keyword_budget == 25
    with pytest.raises(ValueError):
        router.Config(rrf_k=0)
    records, _ = synthetic.corpus(spark, 64)
    records = records.withColumns({"uri": F.lit(""), "keywords": F.lit("")})
    v = records.select("storage_key", embed.encoder(dim=16)("title").alias("embedding"))
    e = records.select(F.col("storage_key").alias("src_key"), F.lag("storage_key").over(store.Window.partitionBy("topic").orderBy("source_id")).alias("dst_key"), F.lit("links_to").alias("edge_type"), F.lit(0.9).alias("weight")).filter("dst_key IS NOT NULL")
    qs = spark.createDataFrame([(1, "topic03 note"), (2, "note:rec-000004")], "query_id int, text string").withColumn("embedding", embed.encoder(dim=16)("text"))
    out = search.engine(records, v, e).search(qs, 4, relationship=True).orderBy("query_id", "rank").collect()
    assert len([x for x in out if x["query_id"] == 1]) == 4
    assert [x["source_id"] for x in out if x["query_id"] == 2][0] == "rec-000004"


def test_plans_push_down_and_cut_early(spark, sf):
    from seekspark.sources import corpus

    plan = filters.apply(corpus.records(spark, sf), {"source_kinds": ["en"]}).select("storage_key")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lang" in plan or "lang" in plan.split("PushedFilters")[1]
    assert "text" not in plan.split("ReadSchema")[1]
    single = catalog.QUERIES["vector_topk_single"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in single


def test_nothing_else_imports_the_llm_subpackage():
    base = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(base, "seekspark")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "seekspark.llm" not in (t := open(os.path.join(folder, f)).read()) and "from .llm" not in t and "..llm" not in t


def test_synonyms_and_golden_sets(spark, tmp_path):
    from seekspark.functions.expand import synonyms
    from seekspark.operators import golden

    q = spark.createDataFrame([(1, "fast car"), (2, "plain")], "query_id int, text string")
    t = spark.createDataFrame([("car", ["auto", "Fast", "vehicle"]), ("fast", ["quick", "auto"])], "term string, synonyms array<string>")
    assert {r["query_id"]: r["expanded"] for r in synonyms(q, t).collect()} == {1: "fast car quick auto vehicle", 2: "plain"}
    assert {r["query_id"]: r["expanded"] for r in synonyms(q, t, 1).collect()}[1] == "fast car quick"
    path = tmp_path / "golden.json"
    path.write_text('{"entries": [{"query": "a", "relevant_ids": ["x", "y", "x"]}, {"query": "b", "relevant_ids": ["z"], "relevance": {"p": 2.0, "n": 0.0}}]}')
    g = golden.load(spark, str(path))
    want = [("a", "x", 1.0), ("a", "y", 1.0), ("b", "p", 2.0)]
    assert sorted(tuple(r) for r in golden.gains(g).collect()) == want
    golden.save(g, str(path))
    assert sorted(tuple(r) for r in golden.gains(golden.load(spark, str(path))).collect()) == want
    assert golden.compatible({"k": 3}, {"k": 5}) and golden.regressions({"metrics": {"recall": 0.5}}, {"metrics": {"recall": 0.8}}, {})


def test_embed_execute_of_odd_texts_equals_sql(spark, tmp_path):
    texts = ["\nno title", "", None, None, "a\nb", "x" * (2**24 + 2), "again", "again", "c"]
    ids = [0, 2, 4, 5, 7, 9, 12, 12, 13]
    d = str(tmp_path / "odd")
    os.makedirs(d)
    duckdb.connect().from_df(pd.DataFrame({"doc_id": ids, "text": texts, "lang": "en", "source": "src1", "n_chars": 1})).write_parquet(f"{d}/documents.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "lineitem", "orders", "customer", "supplier", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d if t == 'documents' else '/root/testdata/sf0.001'}/{t}.parquet'")
    got, want = catalog.QUERIES["embed_execute"](spark, d).toPandas(), con.sql(catalog.ORACLE_SQL["embed_execute"]).df()
    assert len(want) == 9 and rows(got) == rows(want)


@pytest.mark.parametrize("blocks", [(262_144, 512, 4_000_000), (7, 3, 100)])
def test_keyword_search_sends_on_k_rows_a_query_and_task(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_TERMS", "COUNT_ROWS", "CELLS"), blocks):
        monkeypatch.setattr(keyword, name, value)
    g = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)]
    bodies = [" ".join(g.choice(words, g.integers(0, 9))) for _ in range(150)] + ["w1 w2"] * 40  # ties
    r = spark.createDataFrame([(f"k{i:03d}", "", b, "", "") for i, b in enumerate(bodies)], "storage_key string, title string, body string, uri string, keywords string").repartition(3)
    asked = [(i, " ".join(g.choice(words, 3, replace=False))) for i in range(9)] + [(9, "w1 w2"), (10, "w1 nowhere"), (11, '"w1" nowhere'), (12, "w3")]
    q = spark.createDataFrame(asked, "query_id int, text string")
    index = keyword.build(r)
    docs = [b.split() for b in bodies]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    want = {}
    for i, t in asked:
        terms = list(dict.fromkeys(t.replace('"', "").split()))
        scores, whole = {}, {}
        for j, doc in enumerate(docs):
            own = [w for w in terms if w in doc]
            if own:
                idf = {w: max(1e-6, math.log((n - (df := sum(w in x for x in docs)) + 0.5) / (df + 0.5))) for w in own}
                scores[f"k{j:03d}"] = round(sum(idf[w] * doc.count(w) * 2.2 / (doc.count(w) + 1.2 * (0.25 + 0.75 * len(doc) / mean)) for w in own), 6)
                whole[f"k{j:03d}"] = len(own) == len(terms)
        fit = {x: s for x, s in scores.items() if whole[x] or not any(whole.values()) and len(terms) > 1 and '"' not in t}
        want[i] = sorted(fit, key=lambda x: (-fit[x], x))[:4]
    got = {}
    for x in keyword.search(index, q, 4, digits=6).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["storage_key"])
    assert got == {i: w for i, w in want.items() if w}
    assert keyword._scored(index, keyword.query_terms(q), 4).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3 * 2 * 4
    assert keyword.bm25(index, keyword.query_terms(q)).count() > 3 * 2 * 4 * len(asked)
    pre = spark.createDataFrame([(1, "w1"), (1, "w"), (1, "w1"), (2, "w11"), (2, "w1"), (3, "")], "query_id int, prefix string")
    assert sorted(map(tuple, keyword.prefix_terms(index, pre).collect())) == sorted([(1, w) for w in words] + [(2, w) for w in words if w.startswith("w1")])


@pytest.mark.parametrize("depth,most", [(1, 1000), (2, 3), (3, 1000), (3, 2), (4, 4), (5, 1000)])
def test_walks_with_restart_equal_plain_loops(spark, depth, most):
    g = np.random.default_rng(depth + most)
    kinds = ["implements", "links_to", "related", "tests"]
    edges = sorted({(f"n{a}", f"n{b}", str(g.choice(kinds))) for a, b in g.integers(0, 15, (50, 2))})
    hits = [(q, f"n{i}", float(s)) for q in range(3) for i, s in zip(g.choice(18, 6, replace=False), g.integers(1, 9, 6))]
    fan = {}
    for a, b, t in sorted(edges, key=lambda e: (-graph.TYPE_WEIGHTS[e[2]], e[1], e[2])):
        if len(fan.setdefault(a, [])) < 3:
            fan[a].append((b, t))
    want = {}
    for q in range(3):
        own = sorted((x for x in hits if x[0] == q), key=lambda x: (-x[2], x[1]))[:4]
        mass = {(x[1], x[1], None): x[2] / sum(y[2] for y in own) for x in own}
        for _ in range(depth):
            at = {}
            for (_, here, _), m in mass.items():
                at[here] = at.get(here, 0) + m
            going = set(sorted((n for n in at if at[n] >= 0.02), key=lambda n: (-at[n], n))[:most])
            new = {}
            for (seed, here, first), m in mass.items():
                for to, t in fan.get(here, []) if here in going else []:
                    key = (seed, to, first or t)
                    new[key] = new.get(key, 0) + m * 0.85 * graph.TYPE_WEIGHTS[t]
            mass = new
            for (seed, here, first), m in mass.items():
                each = want.setdefault((q, here), {})
                each[seed, first] = each.get((seed, first), 0) + m
    e = spark.createDataFrame([(*x, 1.0) for x in edges], "src_key string, dst_key string, edge_type string, weight double")
    h = spark.createDataFrame(hits, "query_id int, storage_key string, score double")
    got = {(r["query_id"], r["storage_key"]): (r["score"], r["seed"], r["edge_type"]) for r in graph.pagerank(e, h, 4, 3, depth=depth, floor=0.02, max_nodes=most).collect()}
    assert got == {k: (pytest.approx(sum(v.values()), abs=2e-9), *min(v, key=lambda x: (-round(v[x], 9), x))) for k, v in want.items()}


def test_graph_walks_keep_no_table_of_steps(spark, sf, monkeypatch):
    from seekspark.sources import corpus

    plan = catalog.QUERIES["graph_pagerank"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 12
    kept, n = [], corpus.edges(spark, sf).count()
    own = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: (kept.append(df.count()), own(df, name))[1])
    assert catalog.QUERIES["graph_multi_hop"](spark, sf).count() > n and max(kept) <= n


def test_grid_keeps_the_best_of_odd_vectors(spark, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(vector, "BLOCK_ROWS", 8)
    monkeypatch.setattr(vector, "TASK_SCORES", 500)
    g = np.random.default_rng(3)
    v = [x.tolist() for x in g.normal(size=(60, 6))]
    keys = [f"k{i:02d}" for i in range(60)]
    v[5], v[6], v[7], v[8] = v[4], v[4], [0.0] * 6, [1.0, 2.0]  # ties, no direction, another length
    rows_ = [*zip(keys, v), ("k04", v[4]), ("k04", v[9]), ("none", None)]
    df = spark.createDataFrame(rows_, "k string, embedding array<float>")
    got = {}
    for r in vector.top_k(df, df.select(F.col("k").alias("query_id"), "embedding").filter("k <> 'k04'"), 5, "k", skip_self=True).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["k"], r["score"]))
    real = [(k, np.array(x, np.float32).astype(float)) for k, x in rows_ if x]
    cos = lambda a, b: 0.0 if len(a) != len(b) or not a.any() or not b.any() else round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    for q, x in real:
        if q != "k04":
            want = sorted(((-cos(x, y), k) for k, y in real if k != q))[:5]
            assert [(k, pytest.approx(s)) for _, k, s in sorted(got[q])] == [(k, -s) for s, k in want]
    even = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(g.normal(size=(70, 6)))], "k long, embedding array<double>")
    near = vector.approximate(even, even.select(F.col("k").alias("query_id"), "embedding"), 30, "k", 2, 0.2, True)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan  # a pair is never a row
    unit = even.select("k", array_to_vector(F.transform("embedding", lambda x: x / vector.norm(F.col("embedding")))).alias("f"))
    h = {r["k"]: ([int(x[0]) for x in r["h"]], np.array(r["f"])) for r in BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=0.2, numHashTables=2, seed=7).fit(unit).transform(unit).collect()}
    want = {(i, j) for i in h for j in sorted((j for j in h if j != i and any(a == b for a, b in zip(h[i][0], h[j][0]))), key=lambda j: (-round(h[i][1] @ h[j][1], 9), j))[:30]}
    assert {(r["query_id"], r["k"]) for r in near.collect()} == want and len(want) < 30 * 70


def test_metrics_of_classes_equal_those_of_listed_gains(spark):
    c = spark.createDataFrame([(i, None if i % 7 == 0 else i % 4 if i < 20 else i) for i in range(24)], "item long, class long")
    res = spark.createDataFrame([(q, (q * 5 + j * 3) % 24, j) for q in range(24) for j in range(1, 9)], "query_id long, item long, rank int")
    q = c.select(F.col("item").alias("query_id"), "class")
    gains = q.join(c, "class").filter("query_id <> item").select("query_id", "item", F.lit(1.0).alias("gain"))
    for k in (3, 10):
        assert rows(evaluate.class_metrics(res, c, k).toPandas()) == rows(evaluate.metrics(res, gains, q, k).toPandas())


def test_fuzzy_sends_on_k_rows_a_set_of_terms_and_task(spark, monkeypatch):
    for name, value in (("CELLS", 300), ("FUZZY_BLOCK", 5), ("TASK_PAIRS", 200)):
        monkeypatch.setattr(keyword, name, value, raising=False)
    g = np.random.default_rng(4)
    words = ["distributed", "distribute", "database", "databases", "garden", "gardens", "gardener", "whale", "whales", "flower", "flowers", "ledger", "dist", "data"]
    bodies = [" ".join(g.choice(words, g.integers(1, 6))) for _ in range(90)]
    r = spark.createDataFrame([(f"k{i:02d}", "", b, "", "") for i, b in enumerate(bodies)], "storage_key string, title string, body string, uri string, keywords string").repartition(3)
    asked = ["distributde databse", "gardne whals", "flowrs gardenr", "legder database", "whale flower", "flower whale", "garden whale ledger", "xistributed database", "abc whale"] * 2
    index, want = keyword.build(r), {}
    for i, t in enumerate(asked):
        terms = t.split()
        scores = {}
        for j, b in enumerate(bodies):
            best = [keyword.fuzzy_score(x, b.split()) for x in terms]
            if min(best) >= keyword.FUZZY_RATIO and min(map(len, terms)) >= 4 and any(x[:3] == y[:3] for x in terms for y in b.split()):
                scores[f"k{j:02d}"] = round(sum(best), 9)
        want[i] = sorted(((s, x) for x, s in scores.items()), key=lambda y: (-y[0], y[1]))
    own, sent = keyword.ranked, []
    monkeypatch.setattr(keyword, "ranked", lambda hits, *a, **b: (sent.append(hits.count()), own(hits, *a, **b))[1])
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    got = {}
    for x in keyword.fuzzy(index, None, q, 2).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["score"], x["storage_key"]))
    assert got == {i: [(pytest.approx(s), x) for s, x in w[:2]] for i, w in want.items() if w} and len(got) > 9
    assert max(sent) <= 3 * 7 * 2 < sum(map(len, want.values()))
    allowed = r.filter("storage_key < 'k50'")
    every = {(x["query_id"], x["storage_key"]) for x in keyword.fuzzy(index, None, q, None, allowed).collect()}
    assert every == {(i, x) for i, w in want.items() for _, x in w if x < "k50"}

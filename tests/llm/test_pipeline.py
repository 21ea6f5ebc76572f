"""The pipeline's stages against the operators' own decisions, and its odd cases."""

import corpus_pipeline
from seekspark.llm import near_duplicates, outliers, packing, pii
from seekspark.llm.common import DOCUMENT_COLUMNS, documents, written

from .test_operators import DOCS, brute_lines, brute_pack, brute_pairs, odd_rows


def test_stages_hold_and_chain(spark, sf):
    docs = documents(spark, sf)
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        inputs.append(docs)
    for df in inputs[:-1]:
        assert df.columns == list(DOCUMENT_COLUMNS)
    counts = [df.count() for df in inputs]
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    lines = [x.strip(" ") for r in inputs[2].collect() for x in r["text"].split("\n") if x.strip(" ")]
    assert len(lines) == len(set(lines))
    joined = " ".join(r["text"] for r in inputs[4].collect())
    assert "@mail" not in joined and "AKIA" not in joined and "password=" not in joined
    packed = inputs[5].groupBy("doc_id").sum("n_tokens").collect()
    want = {r["doc_id"]: r["n"] for r in inputs[4].select("doc_id", packing.word_count(inputs[4].text).alias("n")).collect() if r["n"]}
    assert {r[0]: r[1] for r in packed} == want


def test_stages_equal_brute_force(spark, sf, monkeypatch):
    """Each stage recomputed in plain Python from its own input, but for the estimates and the model, which have their own tests."""
    docs = documents(spark, sf)
    own = outliers.scored(docs).collect()
    cut = outliers.chi2_quantile(outliers.D, outliers.QUANTILE)
    key = lambda rows: sorted((r["doc_id"], r["text"]) for r in rows)
    stages = dict(corpus_pipeline.STAGES)
    ruled = written(stages["quality_rules"](spark, docs, sf), "ruled")
    assert key(ruled.collect()) == key([r for r in own if r["distance"] is None or r["distance"] <= cut])
    lined = written(stages["line_dedup"](spark, ruled, sf), "lined")
    assert key(lined.collect()) == sorted(brute_lines([(r["doc_id"], r["text"]) for r in ruled.collect()]))
    rows = [(r["doc_id"], r["text"]) for r in lined.collect()]
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in brute_pairs(rows, near_duplicates.N, near_duplicates.THRESHOLD):
        a, b = sorted((top(a), top(b)))
        root[b] = a
    single = written(stages["ngram_jaccard_join"](spark, lined, sf), "single")
    kept = {r["doc_id"] for r in single.collect()}
    assert kept >= {i for i in root if top(i) == i} and len(kept) <= len({top(i) for i in root}) + 1
    tagger = pii.train(single)
    monkeypatch.setattr(pii, "train", lambda docs: tagger)
    private = {r["doc_id"]: r["text"] for r in stages["pii"](spark, single, sf).collect()}
    for r in single.collect():
        text = r["text"]
        for s, e, kind in tagger.spans([text])[0][::-1]:
            text = f"{text[:s]}[{kind}]{text[e:]}"
        assert private[r["doc_id"]] == text
    assert len(private) == single.count()
    found = stages["packing"](spark, single, sf).collect()
    pools = {}
    for x in found:
        pools.setdefault(x["pool"], []).append(x)
    for own in pools.values():
        lengths = sorted((x["n_tokens"] for x in own), reverse=True)
        want, got = {}, {}
        for n, at in zip(lengths, brute_pack(lengths, packing.CAPACITY, packing.FILL)):
            want.setdefault(at, []).append(n)
        for x in own:
            got.setdefault(x["sequence"], []).append(x["n_tokens"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty_and_odd_documents(spark, tmp_path, monkeypatch):
    small = pii.Tagger.trained(*pii.examples(["some plain words of a text"], 400), epochs=2)  # its training has its own tests
    monkeypatch.setattr(pii, "train", lambda docs: small)
    for n, rows in enumerate(([], odd_rows())):
        spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{n}")
        assert out.count() == 0 if not rows else {1, 4, 5} <= {r["doc_id"] for r in out.collect()}

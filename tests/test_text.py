import json
import math

import pytest

from ranklake.errors import DuplicateIdError, ModelError, OptionError, RankedListError, StoreError, UnknownIdError
from ranklake.functions import text as X
from ranklake.functions import tokenize
from ranklake.operators import fusion, ltr, metrics, sparse
from ranklake.plans.text import MODEL
from ranklake.sources import readers


def terms(spark, text, tokenizer):
    return spark.createDataFrame([(text,)], "t string").select(tokenize.terms("t", tokenizer).alias("x")).first().x


def test_tokenizers(spark):
    assert terms(spark, "foo_bar vectors x yz cars", tokenize.SIMPLE) == ["foo", "bar", "vector", "cars"]
    assert terms(spark, "RankQuantFastScan HTTPServer", tokenize.IDENTIFIERS) == "rankquantfastscan rank quant fast scan httpserver http server".split()
    assert terms(spark, "IO DB ab APIIds", tokenize.IDENTIFIERS) == ["apiid", "api", "ids"]
    assert terms(spark, None, tokenize.SIMPLE) == [] and terms(spark, "", tokenize.IDENTIFIERS) == []


DOCS = [(1, "alpha beta beta gamma"), (2, "alpha alpha delta"), (3, "omega"), (4, None), (5, "")]


@pytest.fixture(scope="module")
def index(spark):
    return sparse.build(spark.createDataFrame(DOCS, "row_id long, text string"))


def queries(spark, *q):
    return spark.createDataFrame(list(enumerate(q)), "qid long, query string")


def test_bm25_equals_the_formula(spark, index):
    got = {r.row_id: r.score for r in sparse.search(index, queries(spark, "alpha beta alpha"), 9).collect()}
    n, avg = 5, 8 / 5
    part = lambda tf, df, dl: math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({1: part(1, 2, 4) + part(2, 1, 4), 2: part(2, 2, 3)})
    assert sparse.search(index, queries(spark, "++", "nothing"), 9).count() == 0
    allowed = spark.createDataFrame([(2,)], "row_id long")
    assert {r.row_id: r.score for r in sparse.search(index, queries(spark, "alpha"), 9, allowed, True).collect()} == pytest.approx({2: part(2, 2, 3)})
    with pytest.raises(UnknownIdError):
        sparse.search(index, queries(spark, "alpha"), 9, spark.createDataFrame([(77,)], "row_id long"), True)
    with pytest.raises(OptionError):
        sparse.search(index, queries(spark, "alpha"), -1)


def test_ways_of_search_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"word{j % 9}" for j in range(i % 13))) for i in range(60)], "row_id long, text string").repartition(3)
    index, q = sparse.build(docs), queries(spark, "word1 word2 word8", "word0", "none", "word3 word3 word4")
    got = sorted(map(tuple, sparse.search(index, q, 5).collect()))
    few = docs.filter("row_id % 3 = 0").select("row_id")
    some = sorted(map(tuple, sparse.search(index, q, 5, few).collect()))
    assert len(got) == 15 and {r[2] % 3 for r in some} == {0}
    monkeypatch.setattr(sparse, "MOST_WANTED", 2)
    assert sorted(map(tuple, sparse.search(index, q, 5).collect())) == got
    assert sorted(map(tuple, sparse.search(index, q, 5, few).collect())) == some


def test_terms_are_pruned_before_they_are_shuffled(spark, index):
    plan = sparse.scored(index, queries(spark, "alpha"))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    group = next(i for i, x in enumerate(lines) if "Aggregate [term" in x and "row_id" in x)
    assert any("LeftSemi" in x for x in lines[group:])


def test_checks(spark, index):
    assert sparse.checks(index).filter("failures > 0").count() == 0
    sparse.check_same_rows(index, index.docs)
    with pytest.raises(StoreError):
        sparse.check_same_rows(index, index.docs.filter("row_id <> 3"))
    with pytest.raises(DuplicateIdError):
        sparse.check_unique(spark.createDataFrame([(1,), (1,)], "row_id long"))


def lists(df):
    return [(r.qid, r["rank"], r.row_id, r.score) for r in df.orderBy("qid", "rank").collect()]


def test_ranked_lists(spark):
    assert lists(fusion.single(spark, [2, 1, 2], [1.0, 1.0, 0.5])) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert lists(fusion.from_flat(spark, [4, 4, -1, -1, 3, 2], [0.9, 0.1, float("nan"), 0.2, 0.8, 0.7], 2)) == [(0, 1, 4, 0.9), (1, 1, 3, 0.8), (1, 2, 2, 0.7)]
    with pytest.raises(Exception, match="not finite"):
        fusion.single(spark, [1], [float("nan")]).collect()
    for bad in ([0, 2], [1, 3], [0, 2, 1, 3], []):
        with pytest.raises(RankedListError):
            fusion.check_offsets(bad, 3)
    good = fusion.single(spark, [1, 2], [3.0, 3.0])
    fusion.check_sorted(good)
    with pytest.raises(RankedListError):
        fusion.check_sorted(good.selectExpr("qid", "3 - rank as rank", "row_id", "score"))


def test_rrf(spark):
    h = lambda *x: spark.createDataFrame(list(x), "qid long, row_id long, score double")
    got = fusion.rrf(h((0, 2, 0.9), (0, 0, 0.8)), h((0, 0, 5.0))).orderBy("rank").collect()
    assert [(r.row_id, r.dense_rank, r.sparse_rank) for r in got] == [(0, 2, 1), (2, 1, None)]
    assert got[0].fused_score == pytest.approx(1 / 62 + 1 / 61)
    cut = fusion.rrf(h((0, 2, 0.9), (0, 0, 0.8)), h((0, 0, 5.0)), fusion.Rrf(dense_window=1, top_k=1)).collect()
    assert [(r.row_id, r.dense_rank) for r in cut] == [(0, None)]
    for c in (0.0, -1.0, float("nan")):
        with pytest.raises(OptionError):
            fusion.rrf(h(), h(), fusion.Rrf(c))
    with pytest.raises(OptionError):
        fusion.check_same_queries(h((0, 1, 1.0)), h((1, 1, 1.0)))


def test_measures(spark):
    run = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 9)], "qid long, rank int, row_id long")
    qrels = spark.createDataFrame([(0, 6, 2), (0, 7, 1), (1, 8, 1), (2, 1, 0)], "qid long, row_id long, relevance int")
    got = {r.qid: (r.recall, r.ndcg, r.mrr) for r in metrics.per_query(run, qrels).collect()}
    assert got[1] == (0, 0, 0) and set(got) == {0, 1}
    assert got[0] == pytest.approx((0.5, 3 / math.log2(3) / (3 + 1 / math.log2(3)), 0.5))
    assert metrics.throughput([2.0, 4.0], 6, [6.0]) == {"mean": 3.0, "queries_per_second": 2.0, "speedup": 2.0}
    assert metrics.throughput([], 6)["mean"] is None
    t = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    assert metrics.percentiles(t, "x", [0.5]).first().p50 == 4.5 and metrics.nearest_percentiles(t, "x", [0.5, 0.99]).first()[:] == (5.0, 9.0)


STUMPS = {
    "schema_version": "tree_ensemble.v1", "model_id": "m", "model_family": "xgboost_gbtree", "training_objective": "rank:pairwise", "booster": "gbtree", "base_score": 0.0, "learning_rate": 1.0,
    "feature_schema": {"schema_version": "features.v1", "feature_names": ["bm25_score", "bm25_rank", "rank_cos", "rank_cos_rank", "doc_len_chars", "query_len_chars", "rrf_score"]},
    "trees": [
        {"nodes": [{"split_feature": 1, "threshold": 2.5, "left": 1, "right": 2, "default_left": True}, {"leaf_value": 0.5}, {"leaf_value": -0.5}]},
        {"nodes": [{"split_feature": 6, "threshold": 0.03, "left": 1, "right": 2}, {"leaf_value": -0.1}, {"leaf_value": 0.2}]},
    ],
}


def test_tree_ensembles(spark, monkeypatch):
    rows = spark.createDataFrame([(0, 7, [3.0, 1.0, 0.9, 1.0, 100.0, 12.0, 0.04]), (0, 5, [2.0, 3.0, 0.8, 2.0, 100.0, 12.0, 0.02])], "qid long, row_id long, features array<float>")
    model = ltr.parse(json.dumps(STUMPS))
    want = [(0, 1, 7, 0.7), (0, 2, 5, -0.6)]
    assert [(q, n, r, round(s, 6)) for q, n, r, s in lists(ltr.rerank(rows, model))] == want
    monkeypatch.setattr(ltr, "EXPRESSION_NODES", 0)
    assert [(q, n, r, round(s, 6)) for q, n, r, s in lists(ltr.rerank(rows, model, 1))] == want[:1]
    with pytest.raises(ModelError):
        ltr.rerank(rows, model, names=["a"])
    with pytest.raises(Exception, match="finite features"):
        ltr.score(rows.selectExpr("qid", "row_id", "slice(features, 1, 3) as features"), model).collect()


def leaf(v):
    return {"leaf_value": v}


@pytest.mark.parametrize("change, message", [
    ({"schema_version": "v9"}, "schema"), ({"model_id": " "}, "id"), ({"model_family": "forest"}, "family"), ({"training_objective": "mse"}, "objective"), ({"booster": "dart"}, "booster"), ({"extra": 1}, "unknown"), ({"trees": []}, "trees"),
    ({"feature_schema": {"schema_version": "features.v1", "feature_names": ["a", "a"]}}, "twice"), ({"feature_schema": {"schema_version": "features.v1", "feature_names": ["doc_cat_match"]}}, "forbidden"),
    ({"feature_schema": {"schema_version": "features.v1", "feature_names": ["a"], "forbidden_features": ["a"]}}, "forbidden"), ({"trees": [{"nodes": [leaf(float("inf"))]}]}, "finite"),
    ({"trees": [{"nodes": [leaf(1), leaf(2)]}]}, "reached"), ({"trees": [{"nodes": [{"split_feature": 99, "threshold": 1, "left": 0, "right": 0}]}]}, "feature"),
    ({"trees": [{"nodes": [{"split_feature": 0, "threshold": 1, "left": 0, "right": 1}, leaf(1)]}]}, "cycle"), ({"trees": [{"nodes": [{"split_feature": 0, "threshold": 1, "left": 5, "right": 1}, leaf(1)]}]}, "range"), ({"trees": [{"nodes": [{"split_feature": 0}]}]}, "whole split"),
])
def test_models_that_are_refused(change, message):
    with pytest.raises(ModelError, match=message):
        ltr.parse(STUMPS | change)


def test_model_limits():
    for limits in (ltr.Limits(trees=1), ltr.Limits(nodes=2), ltr.Limits(depth=1), ltr.Limits(features=3), ltr.Limits(model_bytes=10)):
        with pytest.raises(ModelError):
            ltr.parse(json.dumps(STUMPS), limits)
    with pytest.raises(OptionError):
        ltr.parse(STUMPS, ltr.Limits(depth=0))
    assert ltr.parse(MODEL).nodes == 8


def test_features_need_their_sources(spark):
    fused = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.25)], "qid long, row_id long, fused_score double")
    bm25 = spark.createDataFrame([(0, 1, 1, 2.0)], "qid long, row_id long, rank int, score double")
    with pytest.raises(Exception, match="no finite bm25_score of row 2"):
        ltr.features(fused, ["bm25_score"], bm25=bm25).collect()
    got = {r.row_id: list(r.features) for r in ltr.features(fused, ["rrf_score", "bm25_rank"], bm25=bm25, fill=0).collect()}
    assert got == {1: [0.5, 1.0], 2: [0.25, 0.0]}
    for names, message in (([], "empty"), (["nope"], "unsupported"), (["dense_cos"], "needs the hits"), (["doc_len_chars"], "needs its table")):
        with pytest.raises(ModelError, match=message):
            ltr.features(fused, names)


def test_readers(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    q = readers.queries_jsonl(spark, file("q", '{"query_id": "a", "query": "x"}\n\n{"id": "b", "text": "y"}\n'))
    assert {tuple(r) for r in q.collect()} == {("a", "x"), ("b", "y")}
    for bad in ('{"id": "a"}', '{"id": " ", "text": "x"}', "", '{"id": "a", "text": "x"}\n{"id": "a", "text": "y"}'):
        with pytest.raises(ValueError):
            readers.queries_jsonl(spark, file("bad", bad))
    j = readers.qrels(spark, file("j", "# comment\na 7 1\na Q0 7 0.5\nb 8 2\n"))
    assert {tuple(r) for r in j.collect()} == {("a", 7, 0.5), ("b", 8, 2.0)}
    for bad in ("a 1", "a x 1", "a 1 nan", "a -1 1"):
        with pytest.raises(OptionError):
            readers.qrels(spark, file("bad", bad))
    c = readers.corpus_jsonl(spark, file("c", '{"_id": "1", "title": " T ", "text": "body"}\n{"_id": "2", "title": "", "text": "only"}'))
    assert {tuple(r) for r in c.collect()} == {("1", "T\nbody"), ("2", "only")}
    r = readers.benchmark_qrels(spark, file("r", "query-id\tcorpus-id\tscore\nq\t1\t1\nq\t2\t0\nq\t9\t3\n"), c)
    assert [tuple(x) for x in r.collect()] == [("q", "1", 1)]
    t = readers.truth_jsonl(spark, file("t", '{"row_index": 4}\n{"row_index": 2}\n'))
    assert sorted(map(tuple, t.collect())) == [(0, 4), (1, 2)]


def test_npy_and_cache(spark, tmp_path):
    import numpy as np

    m = np.arange(60, dtype=np.float32).reshape(15, 4)
    np.save(tmp_path / "m.npy", m)
    got = readers.npy(spark, str(tmp_path / "m.npy"), 4)
    assert {r.row_id: list(r.embedding) for r in got.collect()} == {i: list(map(float, v)) for i, v in enumerate(m)}
    np.save(tmp_path / "d.npy", m.astype(np.float64))
    with pytest.raises(OptionError):
        readers.npy(spark, str(tmp_path / "d.npy"))
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, text string")
    calls = []

    def embed(df):
        calls.append(1)
        return df.select("row_id", X.hash_embedding("text", 8).alias("embedding"))

    folder = f"file://{tmp_path}/cache"
    first = readers.cached_embeddings(texts, folder, embed)
    assert first.count() == 2 and readers.cached_embeddings(texts.repartition(2), folder, embed).count() == 2 and len(calls) == 1
    readers.cached_embeddings(texts, folder, embed, model="other")
    assert len(calls) == 2


def splitmix(text, dim):
    mask, h = (1 << 64) - 1, 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & mask
    state, out = h ^ 0x9E3779B97F4A7C15, []
    for _ in range(dim):
        z = (state + 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        state = z ^ (z >> 31)
        out.append((state >> 11) / 2**53 * 2 - 1)
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out]


def test_hash_embedding(spark):
    df = spark.createDataFrame([("a",), ("",), ("wörter und mehr",), (None,)], "t string")
    for r in df.select("t", X.hash_embedding("t", 16).alias("v")).collect():
        assert r.v is None if r.t is None else list(r.v) == pytest.approx(splitmix(r.t, 16), abs=1e-6)


def test_chunks(spark):
    text = "intro\n# A\nfirst\n## B\n" + "word " * 400 + "\n```\n# no heading\n```\n# C\nlast"
    files = spark.createDataFrame([("docs/x.md", text), ("y.md", None), ("z.md", "  \n")], "path string, text string")
    rows = X.markdown_chunks(files).orderBy("id").collect()
    assert [r.section for r in rows] == ["(no heading)", "A", *"BBBBB", "C"] and {r.doc_type for r in rows} == {"docs"}
    assert [r.id for r in rows] == [f"docs/x.md#{i:04d}" for i in range(8)] and rows[0].file_name == "x.md"
    assert all(len(r.document) <= 800 for r in rows) and "# no heading" in rows[6].document
    words = [f"w{i}" for i in range(900)]
    parts = X.pieces(" ".join(words), 100, 30)
    assert all(len(p) <= 100 for p in parts)
    seen = []
    for p in parts:
        own = p.split()
        start = 0 if not seen else own.index(seen[-1]) + 1 if seen[-1] in own else 0
        assert start > 0 or not seen  # an overlap with the one before
        seen += own[start:]
    assert seen == words
    assert "".join(X.pieces("x" * 2000, 800, 0)) == "x" * 2000

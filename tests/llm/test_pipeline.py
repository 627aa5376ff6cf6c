"""The pipeline held against plain loops over the same rows."""

import numpy as np
import pytest

import corpus_pipeline as P
from ranklake.llm import langid, quality, simhash
from ranklake.llm.packing import content_key, words
from tests.llm.test_simhash import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SF))
        out.append(docs.collect())
    return out


def test_stages_are_in_order():
    assert [n for n, _ in P.STAGES] == ["language", "quality", "exact_dedup", "simhash", "packing"] and P.ORACLE_SQL is None


def test_language(spark, steps):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    want = [r for r in steps[0] if r.text and not model.decide([r.text])[2][0]]
    assert sorted(steps[1]) == sorted(want)


def test_quality(spark, steps):
    before = spark.createDataFrame(steps[1], spark.read.parquet(f"{SF}/documents.parquet").schema)
    crf = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = [r for r in steps[1] if quality.content_shares(crf, [r.text])[0] >= 0.5]
    assert sorted(steps[2]) == sorted(want)


def test_exact_dedup(steps):
    first = {}
    for r in sorted(steps[2], key=lambda r: r.doc_id):
        first.setdefault(r.text, r)
    assert sorted(steps[3]) == sorted(first.values())


def test_simhash(steps):
    rows = sorted(steps[3], key=lambda r: r.doc_id)
    want = {rows[i].doc_id for i, k in enumerate(brute([r.text for r in rows], simhash.BITS)) if i == k}
    assert {r.doc_id for r in steps[4]} == want
    assert set(steps[4]) <= set(steps[3])


def test_packing(spark, steps):
    docs = spark.createDataFrame(steps[4], spark.read.parquet(f"{SF}/documents.parquet").schema)
    facts = {r.doc_id: r for r in docs.select("doc_id", words("text").alias("n"), "source", content_key("text").alias("c")).collect()}
    pieces = []
    for r in facts.values():
        for k in range(max(1, -(-r.n // 2048))):
            pieces.append((min(2048, r.n - k * 2048), r.doc_id, r.source, r.c, k))
    pieces.sort(key=lambda p: (-p[0], p[1], p[4]))
    bins, want = [], set()  # used, sources, clusters
    for n, doc, source, cluster, k in pieces:
        fits = [i for i, (used, s, c) in enumerate(bins) if used < 2048 and used + n <= 2048 and source not in s and cluster not in c]
        i = min(fits, key=lambda i: (2048 - bins[i][0], i), default=len(bins))
        if i == len(bins):
            bins.append([0, set(), set()])
        want.add((doc, k, n, i, bins[i][0]))
        bins[i][0] += n
        bins[i][1].add(source)
        bins[i][2].add(cluster)
    assert {(r.doc_id, r.piece, r["size"], r.bin, r.offset) for r in steps[5]} == want and len(steps[5]) == len(want)


def test_run_is_its_stages(spark, steps):
    assert sorted(map(str, P.run(spark, SF).collect())) == sorted(map(str, steps[5]))


def test_clean_documents_stay(spark, steps):
    """Of the documents labelled good, no more than one in twenty is rejected by language or quality."""
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    there = {r.doc_id for r in steps[0]} & good
    assert len(there & {r.doc_id for r in steps[2]}) >= 0.95 * len(there)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts, copies and an empty table go through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = max((r.text for r in docs.collect()), key=len)
    odd = spark.createDataFrame([(9_001, None, None, None, None), (None, "", "", "", 0), (9_002, text * 3, None, None, 1), (9_003, text * 3, "en", "s", 1), (9_003, text * 3, "en", "s", 1)], docs.schema)
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert 9_001 not in ids and None not in ids and len(ids & {9_002, 9_003}) <= 1
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "none/labels.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
    assert np.isfinite([r["size"] for r in out]).all()

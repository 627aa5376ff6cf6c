import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ranklake.llm import packing as P


def slow(pieces, capacity):
    bins, out = [], []
    for size, source, cluster in pieces:
        fit = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and b[0] and source not in b[1] and cluster not in b[2]]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        out.append((i, capacity - bins[i][0]))
        bins[i][0] -= size
        bins[i][1].add(source)
        bins[i][2].add(cluster)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(seed):
    r = random.Random(seed)
    n = [0, 1, 40, 300, 1200, 2500][seed]
    pieces = sorted(((r.randint(0, 60), r.choice("aaaaabcdefghijklmnop"), r.choice([0, 0, *range(1, 300)])) for _ in range(n)), key=lambda p: -p[0])
    assert P.pack(pieces, 100) == slow(pieces, 100)


def test_no_conflicts_and_all_is_packed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = P.best_fit(docs, docs_a_group=300).collect()
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    sizes, bins = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.doc_id] += r.size
        bins[r.group, r.bin].append(r)
    assert sizes == {r.doc_id: len(__import__("re").findall(r"[^ \t\n\x0b\f\r]+", r.text)) for r in docs.collect()}
    for own in bins.values():
        assert sum(r.size for r in own) <= 2048
        assert len({sources[r.doc_id] for r in own}) == len(own)
        at = 0
        for r in sorted(own, key=lambda r: (r.offset, -r.size)):
            assert r.offset == at
            at += r.size
    again = P.best_fit(docs.repartition(7), docs_a_group=300).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_odd_rows(spark):
    long = "word " * 5000
    rows = [(1, "a b", "s", 1), (1, "a b", "s", 1), (None, "a b c", None, 1), (2, None, "t", 2), (3, "", None, 2), (4, long, "u", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin int")
    got = P.best_fit(docs).collect()
    assert len(got) == 8
    assert sorted(r.size for r in got if r.doc_id == 4) == [904, 2048, 2048]
    assert len({r.bin for r in got if r.doc_id == 1}) == 2
    assert P.best_fit(docs.limit(0)).count() == 0


def test_near_copies_of_other_sources_share_no_bin(spark, tmp_path):
    from ranklake.llm import queries

    base = [f"word{i}" for i in range(300)]
    texts = [" ".join(base), " ".join([*base[:-1], "edited"]), " ".join(base).upper() + "!", "foo bar", "foobar", "other text here", None, None, "", "foo bar"]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cluster = {r.doc_id: r.cluster for r in P.clustered(docs).collect()}
    assert len(cluster) == len(rows)
    assert cluster[0] == cluster[1] == cluster[2] and cluster[3] == cluster[4] == cluster[9] and cluster[6] == cluster[7]
    assert len({cluster[k] for k in (0, 3, 5, 6, 8)}) == 5
    got = queries.op7_packing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    bins = [(r.group, r.bin, cluster[r.doc_id]) for r in got]
    assert len(set(bins)) == len(bins)


def test_clusters_take_sizes_and_keys_from_one_pass_over_the_words(spark, monkeypatch):
    from ranklake.llm import simhash

    plans = []
    monkeypatch.setattr(simhash, "written", lambda df, kept=simhash.written: plans.append(df._jdf.queryExecution().toString()) or kept(df))
    odd = ["snake_case_word", "SNAKE case\u00a0word", "a\x1cb\x85c\u2003d", "abcd", "", " \t\n", "!?", "_", "Ünïcode ÉTÉ", "ünïcode-été", "०१ ½ Ⅷ ²", "०१½ⅷ²", "ΟΔΟΣ", "οδος", "कि ख", "İstanbul", "x\x0by\fz", None]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(odd)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in P.clustered(docs).collect()}
    want = docs.select("doc_id", P.words("text").alias("n"), P.content_key("text").alias("key")).collect()
    assert {r.doc_id: r.n for r in want} == {i: r.size for i, r in got.items()}
    by_key = defaultdict(set)
    for r in want:
        by_key[r.key].add(got[r.doc_id].cluster)
    assert all(len(clusters) == 1 for clusters in by_key.values())
    assert plans and not any("regexp" in p for p in plans)


@pytest.mark.parametrize("kind", ["int", "short", "decimal(12,2)", "string", "date", "timestamp", "double", "binary"])
def test_ids_of_other_types_and_odd_sizes(spark, kind):
    made = {"date": "date_add(date'2024-01-01', cast(id as int))", "timestamp": "timestamp_seconds(id)", "binary": "cast(string(id) as binary)"}.get(kind, f"cast(id as {kind})")
    docs = spark.range(5).selectExpr(f"if(id = 4, null, {made}) as doc_id", "'a b c' as text", "string(id) as source", "if(id = 3, null, cast(id as long) * 10 - 10) as size")
    got = P.best_fit(docs, capacity=12, size=F.col("size"), cluster=F.col("source")).collect()
    ids = [r.doc_id for r in docs.collect()]
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, [*ids, ids[4], ids[4]]))
    assert sorted(r.size for r in got if r.doc_id is not None) == [0, 0, 0, 10]
    with pytest.raises(ValueError):
        P.best_fit(docs.withColumn("doc_id", F.array("doc_id")))


def test_sizes_may_be_tokens(spark):
    from ranklake.llm import bpe

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = docs.join(bpe.encode(docs), "doc_id")
    total = defaultdict(int)
    for r in P.best_fit(tokens, size=F.col("n_tokens")).collect():
        total[r.doc_id] += r.size
    assert total == {r.doc_id: r.n_tokens for r in tokens.collect()}

"""What small tables hide: steps whose faults show at some size only."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ranklake.config import SearchOptions, TwoStage
from ranklake.operators import dense, ids, sparse
from ranklake.stores import ltr_cache


def test_slots_of_more_rows_than_a_ranging_samples(spark):
    rows = spark.range(0, 40_000, 1, 8).select((F.col("id") * 7919 % 40_000).alias("row_id"), F.repeat(F.lit("x"), F.col("id").cast("int") % 9).alias("more"))
    together = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions would become one
    try:
        spark.conf.set(together, "false")
        got = ids.slots(rows, "row_id").agg(F.count("*"), F.count_distinct("slot"), F.count_if(F.col("slot") != F.col("row_id")), F.max(F.length("more"))).first()
    finally:
        spark.conf.unset(together)
    assert tuple(got) == (40_000, 40_000, 0, 8)


def _vectors(spark, n, key="row_id", parts=3):
    m = np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)
    m[1::4] = m[::4][: len(m[1::4])]  # copies tie
    return m, spark.createDataFrame([(i, [float(x) for x in v], i % 4 if i % 5 else None) for i, v in enumerate(m)], f"{key} long, embedding array<float>, group int").repartition(parts)


def _hits(df):
    return [(r.qid, r["rank"], r.row_id) for r in df.orderBy("qid", "rank").collect()]


def test_blocks_of_groups_find_what_pairs_find(spark, monkeypatch):
    monkeypatch.setattr(dense, "INDEX_BLOCK", 7)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 5)
    monkeypatch.setattr(dense, "CHUNK", 3)
    _, v = _vectors(spark, 90)
    index, q, groups = dense.build(v), v.withColumnRenamed("row_id", "qid"), v.select("row_id", "group")
    pairs = q.select("qid", "group").join(groups, "group").select("qid", "row_id")
    want = _hits(dense.search_per_query(index, q, 6, pairs))
    assert len({x[0] for x in want}) == 72 and _hits(dense.search_in_groups(index, q, 6, groups)) == want


def test_search_in_groups_lists_no_pairs(spark):
    _, v = _vectors(spark, 30)
    plan = dense.search_in_groups(dense.build(v), v.withColumnRenamed("row_id", "qid"), 3, v.select("row_id", "group"))._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan  # blocks meet, not rows


def test_an_index_in_shares_and_whole_is_searched_alike(spark, monkeypatch):
    monkeypatch.setattr(dense, "INDEX_BLOCK", 9)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 8)
    monkeypatch.setattr(dense, "CHUNK", 3)
    m, v = _vectors(spark, 120)
    index, q = dense.build(v), v.withColumnRenamed("row_id", "qid").filter("qid < 40")
    found = []
    for tasks in (1, 8):
        monkeypatch.setattr(dense, "TASKS", tasks)
        found.append([_hits(dense.search(index, q, 5)), _hits(dense.search(index, q, 5, SearchOptions.sign_two_stage(TwoStage(fixed=30)))), _hits(dense.float_search(v, q, 5))])
    assert found[0] == found[1]
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    s = np.round(unit[:40] @ unit.T, 9)
    assert found[0][2] == [(i, n + 1, int(r)) for i in range(40) for n, r in enumerate(np.lexsort((np.arange(120), -s[i]))[:5])]
    assert _hits(dense.float_search(v.withColumn("embedding", F.transform("embedding", lambda x: (x * 1e20).cast("float"))), q, 5, cosine=False))[0][0] == 0


def _texts(spark, n=60):
    return spark.createDataFrame([(i, " ".join(f"word{j % 9}" for j in range(i % 13)) if i % 7 else None) for i in range(n)], "row_id long, text string").repartition(3)


def test_terms_are_counted_in_place(spark, monkeypatch):
    monkeypatch.setattr(sparse, "SLICE", 20)
    docs = _texts(spark)
    index = sparse.build(docs)
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    want = sparse._counted(index.tokens.select("row_id", F.explode("terms").alias("term"))).select("term", "row_id", "tf")
    rows = sorted(map(tuple, want.collect()))
    assert rows and sorted(map(tuple, index.postings.collect())) == rows
    assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, want.groupBy("term").count().collect()))
    both = sparse.build(docs.unionByName(docs))  # a row that is there twice is still counted as one
    assert sorted((t, r, n) for t, r, n in both.postings.collect()) == [(t, r, 2 * n) for t, r, n in rows]


def test_text_search_in_groups_finds_what_pairs_find(spark, monkeypatch):
    docs = _texts(spark)
    index = sparse.build(docs)
    q = spark.createDataFrame([(i, f"word{i} word{i + 1} word8", i % 3 if i < 7 else None) for i in range(8)], "qid long, query string, group int")
    groups = docs.select("row_id", (F.col("row_id") % 3).alias("group")).unionByName(spark.createDataFrame([(1, 0), (1, 0), (5, None)], "row_id long, group long"))
    pairs = q.join(groups, "group").select("qid", "row_id")
    want = sorted(map(tuple, sparse.ranked(sparse.scored(index, q, pairs), 4).collect()))
    assert want and sorted(map(tuple, sparse.search_in_groups(index, q, 4, groups).collect())) == want
    assert sorted(map(tuple, sparse.search(index, q, 4, pairs).collect())) == want
    monkeypatch.setattr(sparse, "MOST_WANTED", 2)
    assert sorted(map(tuple, sparse.search_in_groups(index, q, 4, groups).collect())) == want


def test_repeated_postings_are_found(spark):
    index = sparse.build(_texts(spark))
    twice = replace(index, postings=index.postings.unionByName(index.postings.filter("row_id = 9")))
    got = {r.check: r.failures for r in sparse.checks(twice).collect()}
    assert got["postings are unique"] == index.postings.filter("row_id = 9").count() > 0 and got["lengths are sums of frequencies"] == 1


def test_features_are_made_once_for_a_cache(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def f(it):
        for b in it:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(1, 2, 1.0, [0.5]), (1, 3, 0.0, [0.25])], "qid long, row_id long, label float, features array<float>").coalesce(1)
    ltr_cache.write(rows.mapInArrow(f, rows.schema), spark.createDataFrame([(1,)], "qid long"), ["a"], str(tmp_path / "cache"))
    assert made.value == 2

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ranklake.llm import sharding as S


def shard_rows(df):
    return df.withColumn("place", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()).collect()


def test_splitters_are_exact_and_within_tolerance(spark):
    r = random.Random(7)
    rows = [(r.choice([None, *range(5000)]), r.randint(0, 400)) for _ in range(8000)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(5)
    cut = S.splitters(df, ["k"], "n", 13)
    assert cut.total == sum(n for _, n in rows) and len(cut.keys) == 12 and cut.rounds < 8
    for i, (key, below) in enumerate(zip(cut.keys, cut.below)):
        assert below == sum(n for k, n in rows if S.order_key((k,)) < key)
        assert abs(below - cut.total * (i + 1) / 13) <= 0.02 * cut.total / 13
    assert S.splitters(df.repartition(3), ["k"], "n", 13).keys == cut.keys


def test_ties_that_no_splitter_can_part(spark):
    df = spark.createDataFrame([(1, 10)] * 100 + [(2, 10)], "k long, n long")
    cut = S.splitters(df, ["k"], "n", 4)
    assert set(cut.keys) <= {((1, 1),), ((1, 2),)}
    assert S.splitters(df.limit(0), ["k"], "n", 4).keys == []
    assert S.splitters(df.withColumn("n", F.lit(0)), ["k"], "n", 4).total == 0


def test_nan_and_other_key_types(spark):
    nan = float("nan")
    rows = [(1.0, "a"), (nan, "b"), (None, "c"), (nan, "d"), (-0.0, "e"), (0.0, "e"), (float("inf"), "f"), (nan, "b")]
    df = spark.createDataFrame(rows, "k double, text string")
    got = shard_rows(S.histogram_sort(df, shard_mb=2e-6, key=["k"]))
    assert len(got) == 8 and max(r.place for r in got) > 1
    order = [S.order_key((r.k,)) for r in sorted(got, key=lambda r: (r.place, r.nth))]
    assert order == sorted(order) and order[-3:] == [((2, 0),)] * 3
    for kind in ("timestamp", "date", "decimal(20,2)", "string", "binary", "boolean", "float", "byte"):
        keyed = spark.range(40).select(F.lit("some text").alias("text"), F.expr({"timestamp": "timestamp_seconds(id * 4000)", "date": "date_add(date'2024-01-01', cast(id as int))", "boolean": "id % 2 = 0", "binary": "cast(string(id) as binary)"}.get(kind, f"cast(id as {kind})")).alias("k"))
        rows = shard_rows(S.histogram_sort(keyed, shard_mb=1e-4, key=["k"]))
        own = [r.k for r in sorted(rows, key=lambda r: (r.place, r.nth))]
        assert len(rows) == 40 and own == sorted(own) and len({r.place for r in rows}) > 1
    with pytest.raises(ValueError):
        S.histogram_sort(df.withColumn("k", F.array("k")), key=["k"])


def test_shards_grow_in_number_and_size(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(4000)], "doc_id long, text string")
    assert len({r.shard_id for r in S.histogram_sort(docs).select("shard_id").collect()}) == 3


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("hash__", F.lit("mine"))
    out = S.histogram_sort(docs, shard_mb=0.2)
    assert out.columns == [*docs.columns, "shard_id"]
    rows = shard_rows(out)
    assert sorted(r.doc_id for r in rows) == list(range(1000))
    assert all(r.place == r.shard_id for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard_id] += len(r.text.encode())
    even = sum(sizes.values()) / len(sizes)
    longest = max(len(r.text.encode()) for r in rows)
    assert len(sizes) >= 10 and all(abs(n - even) <= 0.04 * even + 2 * longest for n in sizes.values())
    by_place = sorted(rows, key=lambda r: (r.place, r.nth))
    assert [(r.source, r.doc_id) for r in by_place] == sorted((r.source, r.doc_id) for r in rows)


def test_odd_rows(spark):
    rows = [(1, "a", "s", "q"), (1, "a", "s", "q"), (None, "b", None, "q"), (2, None, "t", None), (3, "", None, "q"), (4, "x" * 3_000_000, "u", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard_id string")
    out = S.histogram_sort(docs, shard_mb=1)
    assert out.columns[-1] == "shard_id_"
    assert sorted(map(str, (tuple(r)[:4] for r in out.collect()))) == sorted(map(str, rows))
    assert S.histogram_sort(docs.limit(0)).count() == 0

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklake.llm import exact_dedup as E


def test_no_repeated_hash_is_missed():
    r = np.random.default_rng(1)
    h = r.integers(-(2**63), 2**63 - 1, 5000)
    h = np.concatenate([h, h[:700], h[:3]])
    r.shuffle(h)
    values, counts = np.unique(h, return_counts=True)
    found = E.possibly_repeated(h, np.zeros(len(h), bool), 12, block=500)
    assert set(values[counts > 1]) <= set(found)
    assert len(found) < 800


@pytest.mark.parametrize("mb", [64, 0])
def test_equals_brute_force(spark, mb):
    r = random.Random(3)
    texts = [None, "", " ", "a", "b" * 50_000, *map(str, range(200))]
    rows = [(r.choice([None, *range(300)]), r.choice(texts), r.choice("xyz"), i % 2) for i in range(600)]
    rows += rows[:50]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h__ string, shard__ int").repartition(5)
    want = {}
    for row in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[2], x[3])):
        want.setdefault(row[1], row)
    got = E.dedup(docs, max_filter_mb=mb)
    assert got.columns == docs.columns
    key = lambda x: (x[1] is None, x[1] or "", str(x))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.values(), key=key)


def test_only_possible_repeats_are_shuffled_and_empty_table(spark):
    docs = spark.createDataFrame([(i, str(i % 990)) for i in range(1000)], "doc_id long, text string")
    assert E.dedup(docs).count() == 990
    assert E.dedup(docs.limit(0)).count() == 0
    found = E.candidates(docs.select(F.xxhash64("text").alias("h")), 4, 12)
    assert 10 <= sum(len(r.found) for r in found.collect()) < 30
    assert sum(len(r.words) for r in E.filters(found, 12).collect()) <= 8


def test_fewer_bits_let_more_rows_through_but_miss_none():
    h = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 20_000)
    own, other, wrong = h[:10_000], h[10_000:], []
    for most in (1000, 4, 2, 1, 0):
        bits = E.affordable(10_000_000, 12, most)
        bloom = E.Bloom(len(own), bits)
        bloom.add(own)
        assert bloom.has(own).all()
        wrong.append(bloom.has(other).mean())
    assert wrong == sorted(wrong) and wrong[0] < 0.02 and 0.2 < wrong[1] < wrong[-1] == 1


def test_probe_equals_positions(spark):
    h = np.random.default_rng(6).integers(-(2**63), 2**63 - 1, 400)
    for bits in (12, 3, 0.7):
        bloom = E.Bloom(200, bits)
        bloom.add(h[:200])
        words = F.array(*(F.lit(int(x)) for x in bloom.words.view(np.int64)))
        df = spark.createDataFrame([(int(x),) for x in h], "h long").withColumn("words", words)
        assert [r.hit for r in df.select(F.expr(E.probe("h", "words", bits)).alias("hit")).collect()] == bloom.has(h).tolist()

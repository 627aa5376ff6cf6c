import random

import pytest
import tiktoken

from ranklake.llm import bpe


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=bpe.SPLIT, mergeable_ranks=bpe.vocabulary(bpe.RANKS), special_tokens={})


def texts():
    r = random.Random(1)
    marks = ["a", "é", "Z9", " ", "  ", "\n", "\t ", "'s", "'re", "'l", "'", "漢字", "🙂", "!?", "12", "the "]
    out = ["".join(r.choice(marks) for _ in range(n)) for n in (0, 1, 5, 63, 64, 65, 200, 1000, 5000)]
    return [*out, "x" * 700, " " * 700, "ab " + " " * 300 + "'re", "<|endoftext|>", None]


@pytest.mark.parametrize(("size", "overlap"), [(40, 12), (64, 30), (16_384, 256)])
def test_equals_the_plain_encoder(spark, plain, size, overlap):
    rows = [(None if i == 3 else i // 2, t, "x") for i, t in enumerate(texts())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = bpe.encode(df, chunk_chars=size, overlap=overlap).collect()
    want = [(a, None if t is None else plain.encode_ordinary(t)) for a, t, _ in rows]
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or [])
    assert sorted(((r.doc_id, r.token_ids) for r in got), key=order) == sorted(want, key=order)
    assert all(r.lossless for r in got if r.token_ids is not None)


def test_round_trip_and_empty_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    rows = bpe.decode(bpe.encode(df, chunk_chars=64, overlap=30).withColumnRenamed("lossless", "bytes")).collect()
    assert {r.doc_id: None if r.bytes_ is None else bytes(r.bytes_).decode() for r in rows} == {i: t for i, t in enumerate(texts())}
    assert bpe.encode(df.limit(0)).count() == 0


def test_real_documents(spark, plain):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.token_ids for r in bpe.encode(df, chunk_chars=1000, overlap=100).collect()}
    assert got == {r.doc_id: plain.encode_ordinary(r.text) for r in df.collect()}

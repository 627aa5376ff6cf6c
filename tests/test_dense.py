import numpy as np
import pytest

from ranklake.config import SearchOptions, SignLoad, SignPolicy, TwoStage, compatible, resolve_bits, sign_compatible
from ranklake.errors import DuplicateIdError, InvalidVectorError, MissingSignError, OptionError, ShapeError, UnknownIdError
from ranklake.indexes import IdIndex, SlotIndex
from ranklake.operators import dense
from ranklake.functions import encode as E


def synthetic(n, dim=64):
    r, c = np.arange(n)[:, None], np.arange(dim)[None]
    return (((r + 11) * (c + 7) + 23 * r + 3 * c) % 53 - 26) / 27


def table(spark, m, key="row_id", ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(m)), m)], f"{key} long, embedding array<float>")


def hits(df):
    return [(r.qid, r["rank"], r.row_id) for r in df.orderBy("qid", "rank").collect()]


def brute(docs, queries, k, bits=2, only=None):
    order = np.argsort(docs.astype(np.float32), axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(docs.shape[1])[None], 1)
    e = 2.0 * (ranks * 2**bits // docs.shape[1]) - (2**bits - 1)
    s = np.round(queries.astype(np.float32).astype(float) @ e.T, 9)
    rows = [i for i in range(len(docs)) if only is None or i in only]
    return [(q, n + 1, i) for q in range(len(queries)) for n, i in enumerate(sorted(rows, key=lambda i: (-s[q, i], i))[:k])]


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_exact_equals_brute_force(spark, bits):
    m = synthetic(96)
    got = dense.search(dense.build(table(spark, m), bits), table(spark, m[:4], "qid"), 5)
    assert hits(got) == brute(m, m[:4], 5, bits)


def test_two_stage_with_all_candidates_is_exact(spark):
    m = synthetic(60)
    index, q = dense.build(table(spark, m)), table(spark, m[:5], "qid")
    exact = hits(dense.search(index, q, 7))
    assert hits(dense.search(index, q, 7, SearchOptions.sign_two_stage(TwoStage(fixed=60)))) == exact
    few = hits(dense.search(index, q, 7, SearchOptions.sign_two_stage(TwoStage(fixed=3))))
    assert len(few) == 15 and {r for _, _, r in few} <= set(range(60))
    assert TwoStage().candidates(10, 10_000) == 320 and TwoStage().candidates(1, 10_000) == 256 and TwoStage().candidates(0, 5) == 0 and TwoStage(most=9).candidates(2, 5) == 5
    with pytest.raises(OptionError):
        dense.search(index, q, 7, SearchOptions.sign_two_stage(TwoStage(fixed=0)))


def test_two_stages_over_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "INDEX_BLOCK", 9)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    monkeypatch.setattr(dense, "HELD", 2)
    m = synthetic(90)
    differ = ((m[:11, None] > 0) != (m[None] > 0)).sum(2)
    want = []
    for q in range(11):
        near = sorted(range(90), key=lambda i: (differ[q, i], i))[:20]
        want += [(q, *h[1:]) for h in brute(m, m[q : q + 1], 7, only=set(near))]
    index = dense.build(table(spark, m[::-1], ids=range(89, -1, -1)).repartition(3))
    assert hits(dense.search(index, table(spark, m[:11], "qid"), 7, SearchOptions.sign_two_stage(TwoStage(fixed=20)))) == want
    found, report = dense.search_with_report(index, table(spark, m[:11], "qid"), 7, SearchOptions.sign_two_stage(TwoStage(fixed=20)))
    assert hits(found) == want and report.candidates == 20


def test_scale_and_order_of_rows_dont_matter(spark):
    m = synthetic(40)
    want = hits(dense.search(dense.build(table(spark, m)), table(spark, m[:3], "qid"), 6))
    assert hits(dense.search(dense.build(table(spark, m * 8)), table(spark, m[:3], "qid"), 6)) == want
    assert hits(dense.search(dense.build(table(spark, m[::-1], ids=range(39, -1, -1)).repartition(5)), table(spark, m[:3], "qid"), 6)) == want


def test_allowlists(spark):
    m = synthetic(50)
    index, q = dense.build(table(spark, m)), table(spark, m[:2], "qid")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "row_id long")
    assert hits(dense.search_allowed(index, q, 3, ids(4, 9, 9, 30, 41))) == brute(m, m[:2], 3, only={4, 9, 30, 41})
    assert hits(dense.search_allowed(index, q, 3, ids())) == []
    with pytest.raises(UnknownIdError):
        dense.search_allowed(index, q, 3, ids(4, 99))
    own = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 3), (1, 20)], "qid long, row_id long")
    got = hits(dense.search_per_query(index, q, 2, own))
    assert [x for x in got if x[0] == 1] == [(1, 1, 20)] and {r for x, _, r in got if x == 0} <= {1, 2, 3} and len(got) == 3
    with pytest.raises(OptionError):
        dense.search_per_query(index, q, 2, spark.createDataFrame([(7, 1)], "qid long, row_id long"))
    with pytest.raises(ShapeError):
        dense.search_mask(index, q, 2, spark.createDataFrame([(0, True)], "row_id long, allowed boolean"))


def test_limits_of_k(spark):
    m = synthetic(5)
    index, q = dense.build(table(spark, m)), table(spark, m[:1], "qid")
    assert len(hits(dense.search(index, q, 99))) == 5 and hits(dense.search(index, q, 0)) == []
    assert hits(dense.search(dense.create(spark, 64), q, 3)) == [] and hits(dense.search(dense.lazy(), q, 3)) == []
    with pytest.raises(OptionError):
        dense.search(index, q, -1)


def test_shapes_and_sign_policies(spark):
    assert [d for d in range(66) if compatible(d, 2)] == list(range(4, 66, 4)) and not compatible(65_536, 4) and not compatible(64, 3)
    assert [(d, b) for d in range(2, 257) for b in (1, 2, 4) if sign_compatible(d, b)] == [(64, 2), (128, 2), (192, 2), (256, 2)]
    with pytest.raises(ShapeError):
        dense.create(spark, 60, 2, SignPolicy.REQUIRED)
    with pytest.raises(ShapeError):
        dense.create(spark, 6, 2)
    plain = dense.build(table(spark, synthetic(5)), policy="disabled")
    assert not plain.has_sign
    with pytest.raises(MissingSignError):
        dense.search(plain, table(spark, synthetic(1), "qid"), 2, SearchOptions.sign_two_stage())
    assert len(hits(dense.search(plain, table(spark, synthetic(1), "qid"), 2, SearchOptions.sign_two_stage(), checked=False))) == 2
    assert resolve_bits() == 2 and resolve_bits(bit_width=4) == 4
    with pytest.raises(OptionError):
        resolve_bits(1, 2)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), 1e16, -1e17, None])
def test_wrong_coordinates_refuse_the_batch(spark, bad):
    rows = [(1, [0.0] * 64), (2, [0.5] * 10 + [bad] + [0.5] * 53)]
    t = spark.createDataFrame(rows, "row_id long, embedding array<float>")
    with pytest.raises(InvalidVectorError, match="row 2, coordinate 10"):
        dense.add(dense.create(spark, 64), t)
    with pytest.raises(Exception, match="invalid vector of row 2"):
        dense.build(t).rows.collect()
    with pytest.raises(ShapeError):
        dense.add(dense.create(spark, 64), spark.createDataFrame([(1, [1.0] * 32)], "row_id long, embedding array<float>"))


def test_expressions_equal_packed_codes(spark):
    m = synthetic(20)
    t = table(spark, m)
    want = {r.row_id: r.c for r in t.select("row_id", E.codes("embedding", 4).alias("c")).collect()}
    for r in dense.build(t, 4).rows.collect():
        assert E.unpack(np.frombuffer(bytes(r.codes), np.uint8)[None], 4)[0].tolist() == want[r.row_id]
    words = {r.row_id: r.w for r in t.select("row_id", E.sign_words("embedding", 64).alias("w")).collect()}
    for r in dense.build(t).rows.collect():
        assert np.frombuffer(bytes(r.sign), np.int64).tolist() == words[r.row_id]


def test_hand_checked_ids(spark):
    index = IdIndex(spark, 4)
    index.add_with_ids(np.array([[1, 2, 3, 4], [4, 3, 2, 1], [1, 3, 2, 4]]), [10, 20, 30])
    q = np.array([[1, 2, 3, 4]])
    scores = {r.row_id: r.score for r in index.search(q, 3).collect()}
    assert scores == {10: 10.0, 20: -10.0, 30: 8.0}
    assert hits(index.search(q, 1, [20, 30])) == [(0, 1, 30)]
    assert index.contains(10) and index.remove(10) and not index.remove(10) and not index.contains(10)
    assert hits(index.search(q, 1)) == [(0, 1, 30)]
    with pytest.raises(DuplicateIdError):
        index.add_with_ids(q, [20])
    with pytest.raises(DuplicateIdError):
        index.add_with_ids(np.vstack([q, q]), [50, 50])
    assert len(index) == 2
    assert hits(index.search_each(np.vstack([q, q]), 5, [[20], [30]])) == [(0, 1, 20), (1, 1, 30)]
    with pytest.raises(OptionError):
        index.search_each(q, 1, [])


def test_slots(spark, tmp_path):
    index = SlotIndex(spark, 4)
    index.add(np.eye(4)[:2])
    index.add(np.eye(4)[2:])
    assert hits(index.search(np.array([1.0, 0, 0, 0]), 1)) == [(0, 1, 0)]
    assert hits(index.search(np.eye(4), 1, [False, True, True, True]))[0][2] != 0
    assert index.swap_remove(0) == 3 and len(index) == 3
    with pytest.raises(UnknownIdError):
        index.swap_remove(9)
    index.write(str(tmp_path / "slots"))
    assert len(SlotIndex.load(spark, str(tmp_path / "slots"))) == 3
    with pytest.raises(ValueError):
        IdIndex.load(spark, str(tmp_path / "slots"))
    with pytest.raises(ShapeError):
        SlotIndex(spark).search(np.eye(4), 1)
    with pytest.raises(MissingSignError):
        SlotIndex.load(spark, str(tmp_path / "slots"), SignLoad.REQUIRE)


def test_plan_is_pruned_before_the_shuffle(spark):
    index = dense.build(table(spark, synthetic(30)))
    plan = dense.search(index, table(spark, synthetic(2), "qid"), 5)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2

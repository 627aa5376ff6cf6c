import json

import pytest
from pyspark.sql import functions as F

from ranklake.errors import FilterError
from ranklake.operators import filters as P

ROWS = [
    ("f1", {"area": "billing", "rank": 1, "created": "2026-01-10", "tag": "a"}),
    ("f2", {"area": "billing", "rank": 3, "created": "2026-03-01", "tag": "b"}),
    ("f3", {"area": "auth", "rank": 4, "created": "2026-05-20", "tag": "a"}),
    ("f4", {"area": "auth", "rank": 2, "created": "2026-02-15", "tag": "c"}),
    ("f5", {"area": "search", "rank": 4, "created": "2026-06-30", "tag": "b"}),
    ("f6", {"area": "search", "rank": 1, "created": "2026-04-05", "tag": None}),
]


def c(field, op, value):
    return {"field": field, "operator": op, "value": value}


NESTED = [
    (c("meta.area", "==", "billing"), "f1 f2"),
    (c("meta.area", "!=", "billing"), "f3 f4 f5 f6"),
    (c("meta.rank", ">", 2), "f2 f3 f5"),
    (c("meta.rank", ">=", 3), "f2 f3 f5"),
    (c("meta.rank", "<", 2), "f1 f6"),
    (c("meta.rank", "<=", 1), "f1 f6"),
    (c("meta.created", ">=", "2026-04-05"), "f3 f5 f6"),
    (c("meta.area", "in", ["billing", "search"]), "f1 f2 f5 f6"),
    (c("meta.area", "not in", ["billing", "search"]), "f3 f4"),
    ({"operator": "AND", "conditions": [c("meta.area", "==", "search"), c("meta.rank", ">=", 4)]}, "f5"),
    ({"operator": "OR", "conditions": [c("meta.area", "==", "billing"), c("meta.rank", "==", 4)]}, "f1 f2 f3 f5"),
    ({"operator": "NOT", "conditions": [c("meta.area", "==", "billing")]}, "f3 f4 f5 f6"),
    ({"operator": "AND", "conditions": [{"operator": "OR", "conditions": [c("meta.area", "==", "auth"), c("meta.area", "==", "search")]}, c("meta.rank", ">=", 4)]}, "f3 f5"),
    (c("area", "==", "billing"), "f1 f2"),
    (c("id", "==", "f3"), "f3"),
    (c("meta.area", "==", "nonexistent"), ""),
    (c("meta.tag", "==", None), "f6"),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(i, f"text {i}", json.dumps(m)) for i, m in ROWS], "id string, document string, metadata string").cache()


def test_nested_matrix(records):
    got = records.select("id", *(P.nested_filter(f).alias(f"c{i}") for i, (f, _) in enumerate(NESTED))).orderBy("id").collect()
    for i, (f, want) in enumerate(NESTED):
        assert " ".join(r.id for r in got if r[f"c{i}"]) == want, f
    with pytest.raises(FilterError):
        P.nested_filter(c("meta.area", "~", 1))
    assert P.nested_keys(NESTED[12][0]) == {"area", "rank"} and P.nested_keys(c("id", "==", 1)) == set()


LIST = {"s": "x", "n": 2, "b": True, "z": None, "l": ["p", "q"], "d": {"e": {"f": 1.5}}}


@pytest.mark.parametrize(
    ("key", "op", "value", "want"),
    [("s", "==", "x", True), ("s", "ne", "x", False), ("q", "!=", "x", True), ("q", "==", None, True), ("z", "eq", None, True), ("n", "==", 2.0, True), ("b", "==", 1, True), ("n", "==", "2", False), ("n", ">", 1, True), ("n", ">=", 2, True), ("n", "<", 2, False), ("b", ">", 0, False), ("s", ">", 0, False), ("n", ">", True, False), ("q", "<", 1, False), ("n", "in", [1, 2], True), ("s", "in", "xyz", False), ("q", "nin", ["a"], True), ("l", "any", ["q", "r"], True), ("l", "all", ["q", "r"], False), ("l", "all", ["q", "p"], True), ("l", "any", "p", True), ("s", "any", ["x"], False), ("d.e.f", "==", 1.5, True), ("d.e.f.g", "==", None, True), ("l", "==", ["p", "q"], True)],
)
def test_list_dialect(spark, key, op, value, want):
    df = spark.createDataFrame([(json.dumps(LIST),)], "metadata string")
    assert df.select(P.list_filter({"key": key, "operator": op, "value": value})).first()[0] is want


def test_list_logic(spark):
    df = spark.createDataFrame([(json.dumps(LIST),), (None,), ("not json",)], "metadata string")
    a, b = {"key": "n", "value": 2}, {"key": "s", "value": "y"}
    for f, want in (({"filters": [a, b]}, 0), ({"condition": "or", "filters": [a, b]}, 1), ({"condition": "not", "filters": [b]}, 3), ({"filters": []}, 3), ({"condition": "or", "filters": []}, 0), (None, 3)):
        assert df.filter(P.list_filter(f)).count() == want
    with pytest.raises(FilterError):
        P.list_filter({"condition": "not", "filters": [a, b]})
    with pytest.raises(NotImplementedError):
        P.list_filter({"key": "n", "operator": "like", "value": 1})


def test_portable(records, spark):
    ids = lambda f: " ".join(r.id for r in records.filter(P.portable(f)).orderBy("id").collect())
    assert ids({"area": "auth", "rank": 4}) == "f3"
    assert ids({}) == "f1 f2 f3 f4 f5 f6"
    assert ids({"missing": 1}) == ""
    assert ids({"area": "nowhere", "rank": "text"}) == ""  # the mismatch comes first
    with pytest.raises(Exception, match="compares"):
        ids({"rank": "text"})
    with pytest.raises(Exception, match="compares"):
        ids({"rank": True})
    with pytest.raises(FilterError):
        P.portable({"rank": [1]})
    exact = spark.createDataFrame([('{"x": 0.1}',), ('{"x": 1e-310}',), ('{"x": 123456789.123456789}',)], "metadata string")
    for x in (0.1, 1e-310, 123456789.123456789):
        assert exact.filter(P.portable({"x": x})).count() == 1


def test_callables_and_unknown_keys(records):
    assert P.callable_filter(records, lambda m: m["rank"] == 4).count() == 2
    assert P.callable_filter(records, lambda d, m: d.endswith("f1")).count() == 1
    assert [r.key for r in P.unknown_keys(records, ["area", "nope"]).collect()] == ["nope"]

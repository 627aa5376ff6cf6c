import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ranklake.llm import warc


def test_loser_tree():
    r = random.Random(4)
    for k in range(9):
        runs = [sorted(r.randint(0, 30) for _ in range(r.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_url_key(spark):
    cases = {
        "http://www.Example.com:80/A/b/?z=1&a=2#frag": "com,example)/a/b?a=2&z=1",
        "https://user@sub.example.org": "org,sub,example)/".replace("sub,example", "example,sub"),
        "https://example.org:8080/?": "org:8080,example)/",
        "": ")/",
        None: None,
    }
    df = spark.createDataFrame(list(cases.items()), "url string, want string")
    for row in df.withColumn("got", warc.url_key("url")).collect():
        assert row.got == row.want


def test_equals_brute_force(spark):
    r = random.Random(5)
    rows = [(r.choice([None, *range(40)]), r.choice([None, "http://a.b/" + r.choice("xyz"), "http://hot.example/"]), r.choice([None, "", "same", "other"]), r.choice([None, 0, 1, 1000]), "x") for _ in range(400)]
    rows += rows[:30]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at long, range string").repartition(6)
    for ranges, run in ((1, 9), (7, 1000), (60, 30)):
        got = [tuple(x) for x in warc.histories(pages, F.timestamp_micros("at"), ranges, run_rows=run).orderBy("seq").collect()]
        keyed = pages.select(warc.url_key("url").alias("k"), "at", "page_id", F.md5("html").alias("d"), F.octet_length("html").alias("n")).collect()
        want, before = [], None
        for i, x in enumerate(sorted((tuple(x) for x in keyed), key=warc.sort_key)):
            same = before is not None and before[0] == x[0]
            nth = nth + 1 if same else 1
            want.append((i, x[0], x[1], x[2], x[3], x[4], nth, not same or before[3] != x[3]))
            before = x
        micros = lambda t: None if t is None else int(t.replace(tzinfo=timezone.utc).timestamp() * 1e6) if t.tzinfo is None else t
        assert [(*x[:2], micros(x[2]), *x[3:]) for x in got] == want
    assert warc.histories(pages.limit(0), F.timestamp_micros("at")).count() == 0
    assert isinstance(got[-1][2], datetime)


def test_a_loser_tree_stops_and_goes_on():
    tree = warc.LoserTree([[1, 4, 9], [2, 3]])
    assert list(tree.below(4)) == [1, 2, 3]
    tree = warc.LoserTree([*tree.rest(), iter([5, 10])])
    assert list(tree) == [4, 5, 9, 10]


def test_string_ids_long_pages_and_a_hot_capture(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    rows = [("p", "http://hot.example/", "x")] * 300 + [(None, "http://a.b/" + "long/" * 20_000, "y" * 3_000_000), ("q", None, None), ("q", "http://a.b/", "")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)
    got = warc.histories(pages, F.lit(None), 4, run_rows=50).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(303))
    assert [r.page_id for r in got] == ["q", "q", None] + ["p"] * 300
    assert [r.capture_no for r in got] == [1, 1, 1, *range(1, 301)] and sum(r.changed for r in got) == 4
    assert got[2].length == 3_000_000

"""Measures of retrieval: recall, nDCG, reciprocal rank, overlap and latency."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, recall, ndcg, mrr) of every query that has a relevant document.

    run is (qid, rank, row_id), qrels (qid, row_id, relevance), where what is above 0 is relevant. Gains are 2^relevance - 1,
    discounts log2(rank + 1). A query that found nothing scores 0.
    """
    relevant = qrels.filter("relevance > 0").select("qid", "row_id", "relevance")
    discount = lambda r: F.log2(F.col(r).cast("double") + 1)
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    ideal = relevant.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("relevance"), "row_id")))
    best = ideal.groupBy("qid").agg(F.count("*").alias("n"), F.sum(F.when(F.col("place") <= k, gain / discount("place"))).alias("idcg"))
    met = run.filter(F.col("rank") <= k).join(relevant, ["qid", "row_id"]).groupBy("qid").agg(F.count("*").alias("hits"), F.sum(gain / discount("rank")).alias("dcg"), F.min("rank").alias("first"))
    zero = F.lit(0.0)
    return best.join(met, "qid", "left").select("qid", F.coalesce(F.col("hits") / F.col("n"), zero).alias("recall"), F.coalesce(F.col("dcg") / F.col("idcg"), zero).alias("ndcg"), F.coalesce(F.lit(1.0) / F.col("first"), zero).alias("mrr"))


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row (queries, recall, ndcg, mrr): means over the queries that have a relevant document."""
    return per_query(run, qrels, k).agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in ("recall", "ndcg", "mrr")))


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """One row (queries, overlap): the mean share of k that two runs have in common, over the queries of either."""
    cut = lambda r: r.filter(F.col("rank") <= k).select("qid", "row_id")
    queries = a.select("qid").union(b.select("qid")).distinct()
    common = cut(a).join(cut(b), ["qid", "row_id"]).groupBy("qid").agg(F.count("*").alias("c"))
    return queries.join(common, "qid", "left").agg(F.count("*").alias("queries"), F.avg(F.coalesce("c", F.lit(0)) / k).alias("overlap"))


def self_recall(run: DataFrame, truth: DataFrame, at: int) -> DataFrame:
    """One row (queries, recall): how many queries find their own row (qid, row_id) among the first at."""
    hit = run.filter(F.col("rank") <= at).select("qid", "row_id", F.lit(1.0).alias("hit")).distinct()
    return truth.select("qid", "row_id").join(hit, ["qid", "row_id"], "left").agg(F.count("*").alias("queries"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def percentiles(times: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with p50 and so on: exact percentiles, with linear interpolation."""
    return times.agg(*(F.expr(f"percentile(`{column}`, {p}D)").alias(f"p{100 * p:g}".replace(".", "_")) for p in shares))


def nearest_percentiles(times: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """The same by the nearest rank: the value at round((n - 1) p) of those in order."""
    values = F.array_sort(F.collect_list(column))
    one = lambda p: F.get(values, F.floor((F.size(values) - 1) * F.lit(float(p)) + F.lit(0.5)).cast("int"))
    return times.agg(*(one(p).alias(f"p{100 * p:g}".replace(".", "_")) for p in shares))


def decode(indices: DataFrame, ids: DataFrame) -> DataFrame:
    """(qid, rank, id) of hits (qid, rank, row_id) by a table (row_id, id); places below 0 are empty."""
    return indices.filter("row_id >= 0").join(ids, "row_id").select("qid", "rank", "id")


def repeat(action: Callable[[], object], times: int = 5, warm: int = 1) -> list[float]:
    """Seconds that an action takes, time and again, after warm runs."""
    for _ in range(warm):
        action()
    out = []
    for _ in range(times):
        start = time.perf_counter()
        action()
        out.append(time.perf_counter() - start)
    return out


def throughput(seconds: list[float], queries: int, baseline: list[float] | None = None) -> dict[str, float | None]:
    """Mean, queries a second, and how many times faster than a baseline; None where that would divide by 0."""
    mean = lambda x: sum(x) / len(x) if x else None
    m, base = mean(seconds), mean(baseline or [])
    return {"mean": m, "queries_per_second": queries / m if m else None, "speedup": base / m if base and m else None}

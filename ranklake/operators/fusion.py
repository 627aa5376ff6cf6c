"""Ranked lists: their rules, and reciprocal rank fusion of two."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklake.errors import OptionError, RankedListError
from ranklake.operators.dense import DECIMALS, HITS, ranked


def normalize(hits: DataFrame) -> DataFrame:
    """(qid, rank, row_id, score) of hits (qid, row_id, score): by score, then row_id, each row once, at its best.

    A null, NaN or infinite score raises where it is read. -0.0 counts as 0.0.
    """
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    good = F.when(finite, F.col("score").cast("double") + F.lit(0.0)).otherwise(F.raise_error(F.lit("a score is not finite")))
    best = hits.select("qid", "row_id", good.alias("score")).groupBy("qid", "row_id").agg(F.max("score").alias("score"))
    return ranked(best)


def from_lists(lists: DataFrame) -> DataFrame:
    """Hits of rows (qid, ids, scores): arrays side by side; negative ids are empty places and go with their scores."""
    pairs = lists.select("qid", F.explode(F.arrays_zip("ids", "scores")).alias("h")).select("qid", F.col("h.ids").cast("long").alias("row_id"), F.col("h.scores").cast("double").alias("score"))
    return normalize(pairs.filter("row_id >= 0"))


def from_offsets(spark: SparkSession, offsets: list[int], ids: list[int], scores: list[float]) -> DataFrame:
    """Hits of flat lists that offsets cut to queries 0, 1 and so on."""
    check_offsets(offsets, len(ids))
    if len(ids) != len(scores):
        raise RankedListError("as many scores as ids are needed")
    return from_lists(spark.createDataFrame([(i, ids[a:z], [float(s) for s in scores[a:z]]) for i, (a, z) in enumerate(zip(offsets, offsets[1:]))], "qid long, ids array<long>, scores array<double>"))


def from_flat(spark: SparkSession, ids: list[int], scores: list[float], queries: int) -> DataFrame:
    """Hits of flat lists with as many places for each query."""
    if queries < 0 or (queries and len(ids) % queries) or (not queries and ids):
        raise RankedListError("the lists don't divide by the queries")
    each = len(ids) // queries if queries else 0
    return from_offsets(spark, [i * each for i in range(queries + 1)], ids, scores)


def single(spark: SparkSession, ids: list[int], scores: list[float]) -> DataFrame:
    return from_offsets(spark, [0, len(ids)], ids, scores)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], HITS)


def check_offsets(offsets: list[int], n: int) -> None:
    if not offsets or offsets[0] != 0 or offsets[-1] != n or any(a > z for a, z in zip(offsets, offsets[1:])):
        raise RankedListError("offsets must rise from 0 to the number of hits")


def check_sorted(hits: DataFrame) -> None:
    """Raise unless hits (qid, rank, row_id, score) are ranked from 1 on by score, then row_id, each row once."""
    by = Window.partitionBy("qid").orderBy("rank")
    seen = hits.select("*", F.lag("score").over(by).alias("s"), F.lag("row_id").over(by).alias("r"), F.row_number().over(by).alias("n"), F.count("*").over(Window.partitionBy("qid", "row_id")).alias("c"))
    bad = "score is null or isnan(score) or abs(score) = double('inf') or rank <> n or c > 1 or s < score or (s = score and r >= row_id)"
    if row := seen.filter(bad).orderBy("qid", "rank").first():
        raise RankedListError(f"query {row.qid} is not in order at rank {row['rank']}")


@dataclass(frozen=True)
class Rrf:
    rank_constant: float = 60.0
    dense_window: int | None = None
    sparse_window: int | None = None
    top_k: int | None = None

    def check(self) -> None:
        if not math.isfinite(self.rank_constant) or self.rank_constant <= 0:
            raise OptionError("the rank constant must be finite and positive")


def check_same_queries(dense: DataFrame, sparse: DataFrame) -> None:
    """Raise unless both lists are of the same queries: tables with a column qid."""
    a, b = dense.select("qid").distinct(), sparse.select("qid").distinct()
    if not a.join(b, "qid", "left_anti").unionByName(b.join(a, "qid", "left_anti")).isEmpty():
        raise OptionError("the two lists are not of the same queries")


def rrf(dense: DataFrame, sparse: DataFrame, config: Rrf = Rrf()) -> DataFrame:
    """(qid, rank, row_id, fused_score, dense_rank, sparse_rank, dense_score, sparse_score).

    A row scores 1 / (rank_constant + rank) in each list that has it within its window. The windows cut before, top_k after.
    """
    config.check()

    def side(hits: DataFrame, name: str, window: int | None) -> DataFrame:
        own = normalize(hits)
        if window is not None:
            own = own.filter(F.col("rank") <= window)
        return own.select("qid", "row_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))

    both = side(dense, "dense", config.dense_window).join(side(sparse, "sparse", config.sparse_window), ["qid", "row_id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(config.rank_constant)) + F.col(c)), F.lit(0.0))
    fused = both.withColumn("fused_score", F.round(part("dense_rank") + part("sparse_rank"), 2 * DECIMALS))
    out = fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("fused_score"), "row_id")))
    if config.top_k is not None:
        out = out.filter(F.col("rank") <= config.top_k)
    return out.select("qid", "rank", "row_id", "fused_score", "dense_rank", "sparse_rank", "dense_score", "sparse_score")


def query_count(hits: DataFrame) -> int:
    return hits.select("qid").distinct().count()


def hits_of(hits: DataFrame, qid: int) -> DataFrame:
    """One query's hits, best first."""
    return hits.filter(F.col("qid") == qid).orderBy("rank")


def offsets(hits: DataFrame) -> DataFrame:
    """(qid, start, end): where each query's hits would be in one list of all. A row a query goes through one task."""
    sizes = hits.groupBy("qid").agg(F.count("*").alias("n"))
    end = F.sum("n").over(Window.orderBy("qid"))
    return sizes.withColumn("end", end).select("qid", (F.col("end") - F.col("n")).alias("start"), "end")

"""Feature tables for ranking models, kept with a manifest of digests."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.errors import StoreError
from ranklake.operators import ltr
from ranklake.shared import written
from ranklake.stores.bundle import Auxiliary
from ranklake.stores.files import Files, relative

MANIFEST = "features.json"


def check(rows: DataFrame, names: list[str], queries: DataFrame | None = None) -> None:
    """Raise unless rows (qid, row_id, label, features) have finite labels and features as many as names, each pair once, and
    only queries (qid) that are known."""
    ltr.check_features(rows, names)
    if not rows.filter("label is null or isnan(label) or abs(label) = float('inf')").isEmpty():
        raise StoreError("a label is not finite")
    if not rows.groupBy("qid", "row_id").count().filter("count > 1").isEmpty():
        raise StoreError("a query has a row twice")
    if queries is not None and not rows.join(queries.select("qid"), "qid", "left_anti").isEmpty():
        raise StoreError("a query of the features is not known")


def groups(rows: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(qid, n): rows of each query, 0 for those of queries that have none."""
    own = rows.groupBy("qid").agg(F.count("*").alias("n"))
    if queries is None:
        return own
    return queries.select("qid").distinct().join(own, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


def auxiliaries(rows: DataFrame, queries: DataFrame, folder: str = "ltr") -> dict[Auxiliary, DataFrame]:
    """The tables of a cache as auxiliaries of a bundle."""
    folder = relative(folder)
    return {Auxiliary(f"{folder}.rows", f"{folder}/rows"): rows, Auxiliary(f"{folder}.queries", f"{folder}/queries"): queries}


def write(rows: DataFrame, queries: DataFrame, names: list[str], path: str, provenance: dict[str, Any] | None = None, label_kind: str = "qrels") -> dict[str, Any]:
    """Write rows (qid, row_id, label, features) and queries (qid, ...) to path, the manifest last; returns the manifest."""
    spark = rows.sparkSession
    files = Files(spark, path)
    rows = written(rows)  # what makes them runs once, not for each check
    check(rows, names, queries)
    if files.exists(MANIFEST):
        raise StoreError(f"{path} has features already")
    rows.write.mode("overwrite").parquet(files.full("rows"))
    queries.write.mode("overwrite").parquet(files.full("queries"))
    n = spark.read.parquet(files.full("rows")).agg(F.count("*").alias("rows"), F.count_distinct("qid").alias("groups")).first()
    manifest = {"feature_names": names, "rows": n.rows, "groups": n.groups, "queries": queries.count(), "label_kind": label_kind, "provenance": provenance or {}, "files": files.digest_list("")}
    files.write_json(MANIFEST, manifest)
    return manifest


def verify(spark: SparkSession, path: str) -> dict[str, Any]:
    """The manifest, once the files have its digests."""
    files = Files(spark, path)
    if not files.exists(MANIFEST):
        raise StoreError(f"{path} has no features")
    m = files.read_json(MANIFEST)
    there = [f for f in files.digest_list("") if f["path"] != MANIFEST]
    if there != m["files"]:
        raise StoreError(f"the files of {path} are not those of its manifest")
    return m


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """(rows, queries, manifest), verified."""
    m = verify(spark, path)
    rows, queries = (spark.read.parquet(f"{path}/{t}") for t in ("rows", "queries"))
    if rows.count() != m["rows"]:
        raise StoreError(f"{path} doesn't have the {m['rows']} rows of its manifest")
    return rows, queries, m

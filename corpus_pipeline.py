"""A corpus pipeline: language, quality, copies, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ranklake.llm import exact_dedup, langid, packing, quality, simhash
from ranklake.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are in no language of docs' own labels, and those without text."""
    return langid.accepted(docs, langid.train(docs))


def content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which less than half is content; the line model is trained on sf_dir's labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept(docs, quality.train(docs, labels))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return simhash.dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places each document's pieces in bins."""
    return packing.best_fit(docs)


STAGES = [
    ("language", language),
    ("quality", content),
    ("exact_dedup", exact_copies),
    ("simhash", near_copies),
    ("packing", pack),
]

#: SQL can express neither the models nor the packing; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs

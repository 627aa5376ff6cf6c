"""The training-data operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.llm import bpe, exact_dedup, langid, licenses, lm, packing, quality, sharding, simhash, warc
from ranklake.llm.common import forget, written


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the outcome of decoding them again."""
    return bpe.encode(_t(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, and whether it is rejected."""
    docs = _t(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without exact copies."""
    return exact_dedup.dedup(_t(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content share of every document, and whether it is kept."""
    docs = _t(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _t(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures in order. The table has no capture time, so a second for each page_id since 2024 stands for it."""
    time = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id"))
    return warc.histories(_t(spark, sf_dir, "pages"), time)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence detections in every document."""
    return licenses.scan(_t(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document."""
    rows = packing.clustered(_t(spark, sf_dir, "documents"))
    return packing.best_fit(rows, size=F.col("size"), cluster=F.col("cluster"), text_col="cluster")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents by source and id over shards of even bytes."""
    return sharding.histogram_sort(_t(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have near duplicates, and which one of each group stays."""
    return simhash.groups(_t(spark, sf_dir, "documents"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-likelihood of every document."""
    blocks = written(lm.tokenise(_t(spark, sf_dir, "documents")), lm.ROW_GROUP_MB, lm.TEXTS)
    counts = written(lm.count_tokens(blocks), batch_rows=lm.BLOCKS)
    v = lm.vocabulary(counts)
    pieces = lm.deal(blocks, counts, v)
    forget(blocks)
    return lm.score(pieces, lm.train(pieces, counts, v), counts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_langid": op2_langid,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_sharding": op8_sharding,
    "op9_simhash": op9_simhash,
    "op10_lm": op10_lm,
}

SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, text, lang, source, n_chars
        FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents)
        WHERE nth = 1""",
    "op5_warc": r"""
        WITH a AS (SELECT *, regexp_replace(lower(trim(url)), '#.*$', '') AS u FROM pages),
        b AS (SELECT *, regexp_replace(u, '^[a-z][a-z0-9+.-]*://', '') AS rest FROM a),
        c AS (SELECT *, regexp_extract(rest, '^([^/?]*)', 1) AS place, regexp_replace(rest, '^[^/?]*', '') AS tail FROM b),
        d AS (SELECT *,
            regexp_replace(regexp_replace(regexp_replace(place, '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*[.]', '') AS host,
            regexp_replace(regexp_extract(tail, '^([^?]*)', 1), '/+$', '') AS path,
            array_to_string(list_sort(string_split(regexp_replace(tail, '^[^?]*[?]?', ''), '&')), '&') AS query FROM c),
        e AS (SELECT page_id, md5(html) AS digest, strlen(html) AS length,
            array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE path WHEN '' THEN '/' ELSE path END
                || CASE query WHEN '' THEN '' ELSE '?' || query END AS urlkey,
            make_timestamp((1704067200 + page_id) * 1000000) AS captured_at FROM d)
        SELECT row_number() OVER (ORDER BY urlkey NULLS FIRST, captured_at NULLS FIRST, page_id NULLS FIRST) - 1 AS seq,
            urlkey, captured_at, page_id, digest, length,
            row_number() OVER w AS capture_no, coalesce(lag(digest) OVER w IS DISTINCT FROM digest, true) AS changed
        FROM e WINDOW w AS (PARTITION BY urlkey ORDER BY captured_at NULLS FIRST, page_id NULLS FIRST)""",
}

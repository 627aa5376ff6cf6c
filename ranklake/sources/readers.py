"""Files of queries, judgements, corpora and vectors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklake.errors import DuplicateIdError, OptionError

#: Vectors that one task decodes at a time.
NPY_ROWS = 16_384


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter("trim(value) <> ''")


def _raise_first(bad: DataFrame, message: str) -> None:
    if row := bad.first():
        raise OptionError(f"{message}: {str(row[0])[:200]}")


def queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query) of JSON lines with query_id or id, and query or text; blank lines don't count.

    A line without either, a blank value and a repeated id are errors, as is a file without queries.
    """
    lines = _lines(spark, path)
    parsed = lines.select("value", F.from_json("value", "query_id string, id string, query string, text string").alias("j"))
    rows = parsed.select("value", F.coalesce("j.query_id", "j.id").alias("query_id"), F.coalesce("j.query", "j.text").alias("query"))
    _raise_first(rows.filter("query_id is null or query is null or trim(query_id) = '' or trim(query) = ''"), "a line needs an id and a query")
    if row := rows.groupBy("query_id").count().filter("count > 1").first():
        raise DuplicateIdError(f"query {row.query_id} is there {row['count']} times")
    if rows.isEmpty():
        raise OptionError("the file has no queries")
    return rows.select("query_id", "query")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, row_id, label) of lines with three fields, or four with an iteration in second place, and # for comments.

    If a pair is judged twice the later line holds.
    """
    # a file's offset orders its lines; monotonically_increasing_id follows partitions and lines within them
    lines = _lines(spark, path).withColumn("line", F.monotonically_increasing_id()).filter(~F.ltrim("value").startswith("#"))
    parts = lines.select("value", "line", F.split(F.trim("value"), r"\s+").alias("p"))
    n = F.size("p")
    row_id, label = F.get("p", n - 2), F.get("p", n - 1)
    rows = parts.select("value", "line", n.alias("n"), F.get("p", F.lit(0)).alias("query_id"), row_id.try_cast("long").alias("row_id"), label.try_cast("float").alias("label"))
    _raise_first(rows.filter("n not in (3, 4) or row_id is null or row_id < 0 or label is null or isnan(label) or abs(label) = float('inf')"), "a line needs three or four fields, an id and a finite label")
    return rows.groupBy("query_id", "row_id").agg(F.max_by("label", "line").alias("label"))


def joined_text(title: str | Column, text: str | Column) -> Column:
    """Title and text, trimmed, a line each; either alone where the other is blank."""
    clean = lambda c: F.nullif(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit(""))
    return F.concat_ws("\n", clean(title), clean(text))


def corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of JSON lines with _id, title and text."""
    j = _lines(spark, path).select(F.from_json("value", "_id string, title string, text string").alias("j"))
    return j.filter("j._id is not null").select(F.col("j._id").alias("doc_id"), joined_text("j.title", "j.text").alias("text"))


def benchmark_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of JSON lines with _id and text."""
    j = _lines(spark, path).select(F.from_json("value", "_id string, text string").alias("j"))
    return j.filter("j._id is not null").select(F.col("j._id").alias("query_id"), F.trim(F.coalesce("j.text", F.lit(""))).alias("text"))


def benchmark_qrels(spark: SparkSession, path: str, docs: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, relevance) above 0 of a tab-separated file with a heading; of docs and queries alone if given."""
    raw = spark.read.csv(path, sep="\t", header=True, schema="query_id string, doc_id string, relevance string", enforceSchema=True)
    rows = raw.select("query_id", "doc_id", F.col("relevance").try_cast("int").alias("relevance")).filter("relevance > 0")
    if docs is not None:
        rows = rows.join(docs.select("doc_id"), "doc_id", "left_semi")
    if queries is not None:
        rows = rows.join(queries.select("query_id"), "query_id", "left_semi")
    return rows.select("query_id", "doc_id", "relevance")


def truth_jsonl(spark: SparkSession, path: str, field: str = "row_index") -> DataFrame:
    """(qid, row_id): the row that each query, counted from 0, is to find; of JSON lines in order."""
    rows = _lines(spark, path).withColumn("line", F.monotonically_increasing_id()).select("line", F.get_json_object("value", f"$.{field}").try_cast("long").alias("row_id"))
    _raise_first(rows.filter("row_id is null or row_id < 0").select("line"), f"a line has no {field}")
    return rows.select((F.row_number().over(Window.orderBy("line")) - 1).cast("long").alias("qid"), "row_id")


def npy_header(raw: bytes) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and place of the data of a .npy file's first bytes."""
    import ast

    if raw[:6] != b"\x93NUMPY":
        raise OptionError("no .npy file")
    size, at = (struct.unpack("<H", raw[8:10])[0], 10) if raw[6] == 1 else (struct.unpack("<I", raw[8:12])[0], 12)
    head = ast.literal_eval(raw[at : at + size].decode("latin1"))
    if head["fortran_order"] or len(head["shape"]) != 2:
        raise OptionError("vectors must be rows of a plain matrix")
    return head["shape"], np.dtype(head["descr"]), at + size


def npy(spark: SparkSession, path: str, rows_a_task: int = NPY_ROWS, first_id: int = 0) -> DataFrame:
    """(row_id, embedding) of a matrix of float32 in a .npy file that all executors can open; each task reads its own rows."""
    local = path.removeprefix("file://")
    with open(local, "rb") as f:
        (n, dim), dtype, start = npy_header(f.read(4096))
    if dtype != np.dtype("<f4"):
        raise OptionError(f"vectors must be little-endian float32, not {dtype}")
    tasks = max(1, -(-n // rows_a_task))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in b.column("id").to_pylist():
                at = k * rows_a_task
                count = min(rows_a_task, n - at)
                v = np.fromfile(local, "<f4", count * dim, offset=start + at * dim * 4)
                ids = np.arange(first_id + at, first_id + at + count, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * dim), pa.array(v))], ["row_id", "embedding"])

    if not n:
        return spark.createDataFrame([], "row_id long, embedding array<float>")
    return spark.range(0, tasks, 1, tasks).mapInArrow(read, "row_id long, embedding array<float>")


def input_hash(texts: DataFrame, id_col: str, text_col: str, model: str) -> str:
    """A digest of all ids and texts, in whatever order they come, and of what embeds them."""
    part = F.sha2(F.concat_ws("\x00", F.lit(model), F.col(id_col).cast("string"), F.coalesce(text_col, F.lit(""))), 256)
    row = texts.select(F.xxhash64(part).alias("a"), F.xxhash64(part, F.lit(1)).alias("b")).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(0)).cast("string").alias(c) for c in "ab")).first()
    import hashlib

    return hashlib.sha256(f"{model}|{row.n}|{row.a}|{row.b}".encode()).hexdigest()


def cached_embeddings(texts: DataFrame, folder: str, embed, id_col: str = "row_id", text_col: str = "text", model: str = "") -> DataFrame:
    """embed(texts), kept as Parquet in folder under the digest of texts and model; read again if it has as many rows."""
    spark = texts.sparkSession
    path = f"{folder}/{input_hash(texts, id_col, text_col, model)}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        kept = spark.read.parquet(path)
        if kept.count() == texts.count():
            return kept
    embed(texts).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

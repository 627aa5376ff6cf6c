"""Vectors and records that arrive in streams: each micro-batch is encoded and appended, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ranklake.config import SignPolicy, check_shape, resolve_sign
from ranklake.functions.encode import encoded
from ranklake.operators.dense import Index


def append_vectors(stream: DataFrame, path: str, checkpoint: str, dim: int, bits: int = 2, policy: SignPolicy | str = SignPolicy.OPTIONAL, id_col: str = "row_id", vector_col: str = "embedding", trigger: dict | None = None) -> StreamingQuery:
    """Encode a stream of vectors and append them to the Parquet rows at path.

    A batch that is run again after a failure replaces what it wrote: rows lie in a folder for each batch. A wrong vector
    fails the batch. Ids are taken as they come; of a repeated one, read() keeps the first batch's row.
    """
    check_shape(dim, bits)
    sign = resolve_sign(dim, bits, policy)

    def write(batch: DataFrame, n: int) -> None:
        encoded(batch, dim, bits, sign, id_col, vector_col).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str, dim: int, bits: int = 2, policy: SignPolicy | str = SignPolicy.OPTIONAL) -> Index:
    """The index of what has been appended."""
    rows = spark.read.schema("row_id long, codes binary, sign binary, batch long").parquet(path)
    first = rows.groupBy("row_id").agg(F.min_by(F.struct("codes", "sign"), "batch").alias("r"))
    return Index(first.select("row_id", "r.codes", "r.sign"), dim, bits, SignPolicy.of(policy))

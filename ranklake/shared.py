"""The folder that all executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset and all runs on one machine (tests), a temporary folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ranklake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """This application's folder for tables within the shared one; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/ranklake-{spark.sparkContext.applicationId}"
    p, fs = _file_system(spark, path)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def written(df: DataFrame, row_group_mb: int | None = None, batch_rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; unlike a checkpoint it prunes columns. Lost executors lose nothing.

    row_group_mb keeps row groups small where rows are large, as a reader decodes one at a time; batch_rows does so with the
    batches that go to Python.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    writer = df.write if row_group_mb is None else df.write.option("parquet.block.size", row_group_mb << 20)
    usual = spark.conf.get(name)
    try:
        spark.conf.set(name, str(batch_rows or usual))
        writer.parquet(path)
    finally:
        spark.conf.set(name, usual)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove the tables of written() that nothing will read again."""
    for df in tables:
        p, fs = _file_system(df.sparkSession, df._written_at)
        fs.delete(p, True)

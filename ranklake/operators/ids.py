"""Row ids: additions, removals, look-ups, and slots for those who count positions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklake.errors import DuplicateIdError, OptionError, UnknownIdError
from ranklake.operators.dense import Index, add
from ranklake.shared import written


def check_new(index: Index, ids: DataFrame, id_col: str = "row_id") -> None:
    """Raise for ids that are null, negative, repeated among themselves or in the index already."""
    own = ids.select(F.col(id_col).cast("long").alias("row_id"))
    bad = own.agg(F.count_if(F.expr("row_id is null or row_id < 0")).alias("n")).first()
    if bad.n:
        raise OptionError("ids must be from 0 to 2^63 - 1")
    twice = own.groupBy("row_id").count().filter("count > 1").select("row_id")
    if index.rows is not None:
        twice = twice.unionByName(own.join(index.rows.select("row_id"), "row_id", "left_semi"))
    if row := twice.orderBy("row_id").first():
        raise DuplicateIdError(f"id {row.row_id} is there already")


def add_with_ids(index: Index, vectors: DataFrame, id_col: str = "row_id", vector_col: str = "embedding") -> Index:
    """add() for ids that must be new; a repeated one refuses the batch."""
    check_new(index, vectors, id_col)
    return add(index, vectors, id_col, vector_col)


def contains(index: Index, row_id: int) -> bool:
    return index.rows is not None and not index.rows.filter(F.col("row_id") == row_id).isEmpty()


def remove(index: Index, row_id: int) -> tuple[Index, bool]:
    """index without the row, and whether it had it; the others keep their vectors."""
    if not contains(index, row_id):
        return index, False
    return replace(index, rows=index.rows.filter(F.col("row_id") != row_id)), True


def remove_all(index: Index, ids: DataFrame, id_col: str = "row_id") -> Index:
    """index without all rows that ids names; unknown ones don't matter."""
    if index.rows is None:
        return index
    return replace(index, rows=index.rows.join(ids.select(F.col(id_col).cast("long").alias("row_id")), "row_id", "left_anti"))


def slots(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """rows with slot: positions from 0 in the order given. Counted by partition, so that no task holds all rows.

    Rows are written with their partitions: each ranging takes a sample of its own, so that two would part rows differently.
    """
    ranged = written(rows.repartitionByRange(order).select("*", F.spark_partition_id().alias("p__")))
    nth = F.row_number().over(Window.partitionBy("p__").orderBy(order)) - 1
    sizes = ranged.groupBy("p__").count()
    before = sizes.select("p__", F.coalesce(F.sum("count").over(Window.orderBy("p__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    return ranged.withColumn("nth__", nth).join(F.broadcast(before), "p__").withColumn("slot", F.col("before__") + F.col("nth__")).drop("p__", "nth__", "before__")


def swap_remove(slotted: DataFrame, slot: int) -> tuple[DataFrame, int]:
    """slotted (slot, ...) without a slot, whose place the last row takes; and the slot that row had."""
    last = slotted.agg(F.max("slot").alias("n")).first().n
    if last is None or not 0 <= slot <= last:
        raise UnknownIdError(f"no slot {slot}")
    return slotted.filter(F.col("slot") != slot).withColumn("slot", F.when(F.col("slot") == last, F.lit(slot)).otherwise(F.col("slot"))), last


def to_ids(hits: DataFrame, mapping: DataFrame) -> DataFrame:
    """Hits by slot as hits by id: (qid, rank, row_id, score); slots below 0 are empty places and go."""
    return hits.filter("slot >= 0").join(mapping.select("slot", "row_id"), "slot").select("qid", "rank", "row_id", "score")


def to_slots(ids: DataFrame, mapping: DataFrame, check: bool = True) -> DataFrame:
    """(slot, row_id) of ids (row_id), each once; with check an unknown one is an error."""
    own = ids.select("row_id").distinct()
    if check and (row := own.join(mapping, "row_id", "left_anti").orderBy("row_id").first()):
        raise UnknownIdError(f"no id {row.row_id}")
    return mapping.select("slot", "row_id").join(own, "row_id", "left_semi").select("slot", "row_id")

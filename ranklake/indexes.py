"""Indexes as objects: one whose rows are numbered by position, and one with ids of the caller's."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.config import SearchOptions, SignLoad, SignPolicy, resolve_bits
from ranklake.errors import OptionError, ShapeError
from ranklake.operators import dense, ids
from ranklake.stores import bundle


def vectors_table(spark: SparkSession, vectors: DataFrame | np.ndarray | Iterable, first: int = 0, id_col: str = "row_id", given: Iterable[int] | None = None) -> DataFrame:
    """(row_id, embedding) of a table, or of a matrix, or of a single vector, whose rows are numbered or have the ids given."""
    if isinstance(vectors, DataFrame):
        return vectors
    m = np.asarray(vectors, np.float64)
    if m.ndim == 1:
        m = m[None] if len(m) else m.reshape(0, 0)
    if m.ndim != 2:
        raise ShapeError("vectors must be the rows of a matrix")
    numbers = list(given) if given is not None else list(range(first, first + len(m)))
    if len(numbers) != len(m):
        raise ShapeError(f"{len(m)} vectors need as many ids, not {len(numbers)}")
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(numbers, m)], f"{id_col} long, embedding array<float>")


class _Base:
    kind = bundle.IDS

    def __init__(self, spark: SparkSession, dim: int | None = None, bits: int | None = None, bit_width: int | None = None, sign: SignPolicy | str = SignPolicy.OPTIONAL):
        bits = resolve_bits(bits, bit_width)
        self.spark = spark
        self.index = dense.create(spark, dim, bits, sign) if dim is not None else dense.lazy(bits, sign)

    def __len__(self) -> int:
        return len(self.index)

    @property
    def is_empty(self) -> bool:
        return self.index.rows is None or self.index.rows.isEmpty()

    @property
    def dim(self) -> int | None:
        return self.index.dim

    @property
    def bits(self) -> int:
        return self.index.bits

    @property
    def has_sign(self) -> bool:
        return self.index.has_sign

    def inspect(self) -> DataFrame:
        return self.index.describe(self.spark)

    def search_with_report(self, queries: DataFrame | np.ndarray, k: int, options: SearchOptions = SearchOptions()) -> tuple[DataFrame, dense.Report]:
        return dense.search_with_report(self.index, self._queries(queries), k, options)

    def _queries(self, queries: DataFrame | np.ndarray) -> DataFrame:
        if self.index.dim is None:
            raise ShapeError("an index without rows has no dimension yet")
        return vectors_table(self.spark, queries, id_col="qid")

    def write(self, path: str, auxiliaries: dict | None = None) -> dict[str, Any]:
        return bundle.write(self.index, path, self.kind, auxiliaries)

    @classmethod
    def load(cls, spark: SparkSession, path: str, sign: SignLoad = SignLoad.REQUIRE_IF_SUPPORTED, **options: Any):
        out = cls(spark)
        out.index = bundle.load(spark, path, cls.kind, sign, **options)
        return out


class SlotIndex(_Base):
    """Rows are numbered from 0 as they come; the row_id of hits is the slot."""

    kind = bundle.SLOTS

    def add(self, vectors: DataFrame | np.ndarray) -> None:
        """Append rows; of a table, in the order of its row_id."""
        n = len(self.index)
        table = vectors_table(self.spark, vectors, n)
        if isinstance(vectors, DataFrame):
            table = ids.slots(vectors.select("row_id", "embedding"), "row_id").select((F.col("slot") + n).cast("long").alias("row_id"), "embedding")
        self.index = dense.add(self.index, table)

    def search(self, queries: DataFrame | np.ndarray, k: int, mask: Iterable[bool] | DataFrame | None = None, options: SearchOptions = SearchOptions()) -> DataFrame:
        """Hits; a mask, a value for each slot, says which count, and then search is exact."""
        q = self._queries(queries)
        if mask is None:
            return dense.search(self.index, q, k, options)
        if not isinstance(mask, DataFrame):
            mask = self.spark.createDataFrame([(i, bool(x)) for i, x in enumerate(mask)], "row_id long, allowed boolean")
        return dense.search_mask(self.index, q, k, mask)

    def search_slots(self, queries: DataFrame | np.ndarray, k: int, slots: Iterable[int]) -> DataFrame:
        """Hits among slots, each of which must be there."""
        return dense.search_allowed(self.index, self._queries(queries), k, self.spark.createDataFrame([(int(s),) for s in slots], "row_id long"))

    def swap_remove(self, slot: int) -> int:
        """Remove a slot; the last row takes its place. The slot that row had."""
        from dataclasses import replace

        if self.index.rows is None:
            raise OptionError("the index has no rows")
        rows, last = ids.swap_remove(self.index.rows.withColumnRenamed("row_id", "slot"), slot)
        self.index = replace(self.index, rows=rows.withColumnRenamed("slot", "row_id").select("row_id", "codes", "sign"))
        return last


class IdIndex(_Base):
    """Rows have ids, which must be new."""

    def add_with_ids(self, vectors: DataFrame | np.ndarray, given: Iterable[int] | None = None) -> None:
        self.index = ids.add_with_ids(self.index, vectors_table(self.spark, vectors, given=given))

    def search(self, queries: DataFrame | np.ndarray, k: int, allowed: Iterable[int] | DataFrame | None = None, options: SearchOptions = SearchOptions()) -> DataFrame:
        """Hits; allowed ids, which must be there, say which rows count, and then search is exact."""
        q = self._queries(queries)
        if allowed is None:
            return dense.search(self.index, q, k, options)
        if not isinstance(allowed, DataFrame):
            allowed = self.spark.createDataFrame([(int(i),) for i in allowed], "row_id long")
        return dense.search_allowed(self.index, q, k, allowed)

    def search_each(self, queries: DataFrame | np.ndarray, k: int, allowed: list[Iterable[int]] | DataFrame) -> DataFrame:
        """Hits of each query within its own ids; as many lists as queries."""
        q = self._queries(queries)
        if not isinstance(allowed, DataFrame):
            if len(allowed) != q.count():
                raise OptionError("as many allowlists as queries are needed")
            allowed = self.spark.createDataFrame([(i, int(x)) for i, own in enumerate(allowed) for x in own], "qid long, row_id long")
        return dense.search_per_query(self.index, q, k, allowed)

    def search_in_groups(self, queries: DataFrame, k: int, groups: DataFrame) -> DataFrame:
        """Hits of each query (qid, embedding, group) within the rows of its group (row_id, group)."""
        return dense.search_in_groups(self.index, queries, k, groups)

    def remove(self, row_id: int) -> bool:
        self.index, had = ids.remove(self.index, row_id)
        return had

    def contains(self, row_id: int) -> bool:
        return ids.contains(self.index, row_id)

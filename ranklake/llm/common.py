"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ranklake.shared import forget, written

__all__ = ["STEP_CHARS", "arrow_schema", "batches", "forget", "map_batches", "need", "unused", "written"]

#: Characters that one numpy step handles at most (a longer text is a step of its own).
STEP_CHARS = 400_000


def need(df: DataFrame, *names: str) -> None:
    """Raise where a column that an operator reads is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    """The Arrow schema of what a function for mapInArrow returns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def batches(texts: list[str], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about so many characters together."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def map_batches(df: DataFrame, schema: str, f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with a DDL schema."""
    return df.mapInArrow(f, schema)

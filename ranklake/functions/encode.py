"""Rank codes and sign bits, as column expressions and, for whole tables, as Arrow batches.

A coordinate's code is its rank within the vector (ties by position) cut to 2^bits bins of one size; in scores bin c counts
2c - (2^bits - 1). Sign bits say which coordinates are positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.config import LIMIT


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def codes(vector: str | Column, bits: int) -> Column:
    """The codes, 0 to 2^bits - 1, in the order of the coordinates."""
    v, bins = _c(vector), 1 << bits
    by_value = F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    ranked = F.transform(by_value, lambda t, r: F.struct(t["i"].alias("i"), F.floor(r * bins / F.size(v)).cast("int").alias("c")))
    return F.transform(F.array_sort(ranked), lambda t: t["c"])


def centred(code: Column, bits: int) -> Column:
    return F.transform(code, lambda c: 2 * c - ((1 << bits) - 1))


def sign_words(vector: str | Column, dim: int) -> Column:
    """dim/64 longs; bit i of word w is set where coordinate 64 w + i is positive."""
    v = _c(vector)
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.when(F.get(v, i + 64 * w) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return F.array(*(word(w) for w in range(dim // 64)))


def hamming(a: str | Column, b: str | Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    """The dot product as a double; null if a part is null or the lengths differ."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: str | Column) -> Column:
    """v at length 1; a vector of zeros stays as it is."""
    c = _c(v)
    n = norm(c)
    return F.when(n > 0, F.transform(c, lambda x: x.cast("double") / n)).otherwise(F.transform(c, lambda x: x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """The cosine; 0 if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def prefix(v: str | Column, dim: int) -> Column:
    """The first dim coordinates; ranks and signs need no new length."""
    return F.slice(_c(v), 1, dim)


def is_valid(v: str | Column, dim: int | None = None) -> Column:
    """Whether v is a vector of dim finite coordinates below the limit; never null."""
    c = _c(v)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT))
    return F.coalesce(~bad & ((F.size(c) == dim) if dim else F.lit(True)), F.lit(False))


def first_invalid(df: DataFrame, vector: str, order: str, dim: int | None = None) -> DataFrame:
    """(row_id, coord) of the first coordinate, by order and position, that is not valid; no row if all are.

    A null vector, or one of another length than dim, counts at coordinate -1.
    """
    at = F.filter(F.transform(F.col(vector), lambda x, i: F.when(x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT), i)), lambda i: i.isNotNull())
    bad = F.when(F.col(vector).isNull() | ((F.size(vector) != dim) if dim else F.lit(False)), F.lit(-1)).otherwise(F.get(at, F.lit(0)))
    return df.select(F.col(order).alias("row_id"), bad.alias("coord")).filter("coord is not null").orderBy("row_id", "coord").limit(1)


# Arrow batches


def matrix(column: pa.Array, dim: int, dtype=np.float32) -> np.ndarray:
    """A column of float arrays of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dim)


def code_matrix(v: np.ndarray, bits: int) -> np.ndarray:
    order = np.argsort(v, axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(v.shape[1])[None], 1)
    return (ranks * (1 << bits) // v.shape[1]).astype(np.uint8)


def pack(code: np.ndarray, bits: int) -> np.ndarray:
    """dim * bits / 8 bytes a row, the first code in the lowest bits."""
    each = 8 // bits
    shifted = code.reshape(len(code), -1, each) << (np.arange(each, dtype=np.uint8) * bits)
    return np.bitwise_or.reduce(shifted, 2).astype(np.uint8)


def unpack(packed: np.ndarray, bits: int) -> np.ndarray:
    each = 8 // bits
    return ((packed[:, :, None] >> (np.arange(each, dtype=np.uint8) * bits)) & ((1 << bits) - 1)).reshape(len(packed), -1)


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A column of binaries of one width as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _binaries(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    data = np.ascontiguousarray(rows).tobytes()
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(data)]).cast(pa.binary())


def encoded(df: DataFrame, dim: int, bits: int, sign: bool, id_col: str = "row_id", vector_col: str = "embedding") -> DataFrame:
    """(row_id, codes, sign): packed codes and sign bits (null without sign) of each vector. Invalid ones raise."""
    source = df.select(F.col(id_col).cast("long").alias("row_id"), F.when(is_valid(vector_col, dim), F.col(vector_col)).otherwise(F.raise_error(F.concat(F.lit("invalid vector of row "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))).cast("array<float>").alias("v"))

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            v = matrix(b.column("v"), dim)
            signs = _binaries(np.packbits(v > 0, axis=1, bitorder="little")) if sign else pa.nulls(len(v), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row_id"), _binaries(pack(code_matrix(v, bits), bits)), signs], ["row_id", "codes", "sign"])

    return source.mapInArrow(f, "row_id long, codes binary, sign binary")

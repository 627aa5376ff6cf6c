"""Exact deduplication: a first pass finds possibly repeated hashes by Bloom filters, and only their rows are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklake.llm.common import need, unused, written

#: Positions of a hash in a filter, at most.
PROBES = 4


def probes(bits_each: float) -> int:
    """How many positions a hash has where there are so many bits for each."""
    return max(1, min(PROBES, round(0.69 * bits_each)))


def affordable(n: int, bits_each: float, most_mb: int) -> float:
    """Bits for each of n hashes, of filters that take most_mb together at most: the more hashes, the fewer bits."""
    return min(bits_each, (most_mb << 23) / max(1, n))


def positions(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The k bits of each hash, as in probe()."""
    u = h.view(np.uint64)
    a, b = u >> np.uint64(32), (u & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(k)], 1).astype(np.int64)


class Bloom:
    def __init__(self, n: int, bits_each: float):
        self.bits = 64 * max(1, int(n * bits_each / 64))
        self.k = probes(bits_each)
        self.words = np.zeros(self.bits // 64, np.uint64)

    def add(self, h: np.ndarray) -> None:
        p = positions(h, self.bits, self.k).ravel()
        np.bitwise_or.at(self.words, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))

    def has(self, h: np.ndarray) -> np.ndarray:
        p = positions(h, self.bits, self.k)
        return ((self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).all(1)


def possibly_repeated(hashes: np.ndarray, sure: np.ndarray, bits_each: int, block: int = 65_536) -> np.ndarray:
    """The hashes that come up again, by a filter of those before; sure: known to be repeated. Misses none, may add some."""
    seen, again = Bloom(len(hashes), bits_each), [hashes[sure]]
    for at in range(0, len(hashes), block):
        part, counts = np.unique(hashes[at : at + block], return_counts=True)
        again.append(part[(counts > 1) | seen.has(part)])
        seen.add(part)
    return np.unique(np.concatenate(again))


def candidates(hashes: DataFrame, shards: int, bits_each: int) -> DataFrame:
    """(shard, found): the possibly repeated hashes of each shard that has any. hashes: the column h."""

    def local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column("h").to_numpy(zero_copy_only=False) for b in it if b.num_rows]
        if parts:  # a hash leaves a task once, however often it has it
            h, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(((h.view(np.uint64) >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)), pa.array(h), pa.array(counts > 1)], ["shard", "h", "sure"])

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "h", "sure")) for b in it if b.num_rows]
        if not parts:
            return
        shard, h, sure = (np.concatenate(x) for x in zip(*parts))
        for s in np.unique(shard):
            own = shard == s
            again = possibly_repeated(h[own], sure[own], bits_each)
            if len(again):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([again], pa.list_(pa.int64()))], ["shard", "found"])

    return hashes.mapInArrow(local, "shard int, h long, sure boolean").repartition(shards, "shard").mapInArrow(merge, "shard int, found array<long>")


def filters(found: DataFrame, bits_each: float) -> DataFrame:
    """(shard, words): a Bloom filter of the hashes found of each shard, for probe()."""

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for shard, own in zip(b.column("shard"), b.column("found")):
                h = own.values.to_numpy()
                bloom = Bloom(len(h), bits_each)
                bloom.add(h)
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()], pa.int32()), pa.array([bloom.words.view(np.int64)], pa.list_(pa.int64()))], ["shard", "words"])

    return found.mapInArrow(f, "shard int, words array<long>")


def probe(h: str, words: str, bits_each: float) -> str:
    """SQL: whether the filter words, made with bits_each, has hash h; the same positions as positions()."""
    bits = f"(64L * size({words}))"
    at = [f"((shiftrightunsigned({h}, 32) + {i}L * ((({h}) & 4294967295L) | 1L)) % {bits})" for i in range(probes(bits_each))]
    return " and ".join(f"getbit(element_at({words}, cast({p} div 64 as int) + 1), cast({p} % 64 as int)) = 1" for p in at)


def _ordered(df: DataFrame, first: str) -> list:
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType)) and f.name != first]
    return [F.col(f"`{first}`").asc_nulls_last(), *(F.col(f"`{c}`").asc_nulls_last() for c in plain)]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_each: int = 12, max_filter_mb: int = 256) -> DataFrame:
    """One row of docs, with all its columns, for each different text: that of the least id, nulls last.

    Texts are compared whole, by their bytes; hashes only say which rows to compare. Null texts count as equal to each
    other, as empty ones do. Rows of the same text and id are told apart by their other plain columns, in order.

    The first pass reads hashes alone and makes filters of those that may be repeated. The second lets pass every row
    that they don't have and shuffles the others. Filters take max_filter_mb together at most, and are broadcast: hashes
    have bits_each bits, or as many as there is room for, and the fewer, the more other rows are shuffled along (at one
    bit for each about two thirds of them), with the same result.
    """
    need(docs, id_col, text_col)
    h, words, shard, rank = (unused(docs, x) for x in ("h__", "words__", "shard__", "rank__"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = docs.withColumn(h, F.xxhash64(F.col(f"`{text_col}`")))
    found = written(candidates(hashed.select(F.col(h).alias("h")), shards, bits_each))
    bits = affordable(found.agg(F.sum(F.size("found")).alias("n")).first().n or 0, bits_each, max_filter_mb)
    made = filters(found, bits).select(F.col("shard").alias(shard), F.col("words").alias(words))
    flagged = hashed.withColumn(shard, F.expr(f"cast(shiftrightunsigned({h}, 20) % {shards} as int)")).join(F.broadcast(made), shard, "left")
    hit = F.coalesce(F.expr(probe(h, words, bits)), F.lit(False))
    straight, again = flagged.filter(~hit).select(*(f"`{c}`" for c in docs.columns)), flagged.filter(hit).drop(words, shard)
    order = _ordered(docs, id_col)
    kept = again.withColumn(rank, F.row_number().over(Window.partitionBy(h, f"`{text_col}`").orderBy(*order))).filter(F.col(rank) == 1).drop(rank, h)
    return straight.unionByName(kept)

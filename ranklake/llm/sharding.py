"""Histogram sort: splitters are refined by exact byte counts until shards are even, then rows are exchanged once."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklake.llm.common import need, unused, written

Key = tuple


@dataclass
class Splitters:
    keys: list[Key]  # shard i holds the rows from keys[i-1] on and below keys[i]
    below: list[int]  # exact bytes below each
    total: int
    rounds: int


def order_key(values: tuple) -> Key:
    """Nulls first, NaN last, and all NaN alike."""
    return tuple((0, 0) if v is None else (2, 0) if v != v else (1, v) for v in values)


def splitters(keyed: DataFrame, columns: list[str], bytes_col: str, shards: int, tolerance: float = 0.02, probes: int = 16) -> Splitters:
    """Keys that cut keyed to shards of even bytes: below each is within tolerance of a shard what should be, or the nearest
    that its rows allow.

    Each round draws probes from every interval that holds open targets, some for each target, and counts the exact
    bytes and rows below each probe over all partitions. Drawn are the keys whose hashes are under a bound that follows from
    the interval's rows, so it doesn't matter how the rows are spread. A target is met when a probe is near enough, or when
    its interval has no key left within.
    """
    spark = keyed.sparkSession
    small = keyed.select(*columns, F.col(bytes_col).alias("n__"), F.xxhash64(*columns, F.lit(11)).alias("h__"))
    first = small.agg(F.sum("n__").alias("n"), F.count("*").alias("rows")).first()
    total, rows = first.n or 0, first.rows
    slack = tolerance * total / shards
    targets = [total * i / shards for i in range(1, shards)]
    known: dict[Key, tuple[int, int]] = {}  # bytes and rows below a key

    def draw(intervals: list[tuple[Key | None, Key | None, float]]) -> list[Key]:
        """Different keys strictly within the intervals (from, to, share of the hashes), which are in order and apart."""
        where = spark.sparkContext.broadcast(intervals)

        def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = where.value
            lows = [d[0] or () for d in own]
            most = max(d[2] for d in own)
            for b in it:
                share = [(h + 2**63) / 2**64 for h in b.column("h__").to_pylist()]
                near = [i for i, x in enumerate(share) if x < most]
                values = list(zip(*(b.column(c).take(pa.array(near, pa.int64())).to_pylist() for c in columns)))
                keep = []
                for i, v in zip(near, values):
                    key = order_key(v)
                    j = _above(lows, key) - 1
                    if j >= 0 and key != own[j][0] and (own[j][1] is None or key < own[j][1]) and share[i] < own[j][2]:
                        keep.append(i)
                yield b.select(columns).take(pa.array(keep, pa.int64()))

        schema = small.select(*columns).schema
        found = small.mapInArrow(f, schema).distinct().toArrow()  # values as the tasks have them
        return sorted(set(map(order_key, zip(*(c.to_pylist() for c in found.columns)))))

    def count(at: list[Key]) -> None:
        """Add to known what lies below each of at."""
        where = spark.sparkContext.broadcast(at)

        def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list[int]] = {}
            for b in it:
                for n, *values in zip(b.column("n__").to_pylist(), *(b.column(c).to_pylist() for c in columns)):
                    own = sums.setdefault(_above(where.value, order_key(values)), [0, 0])
                    own[0] += n
                    own[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in (0, 1))], ["i", "n", "r"])

        sums = {r.i: (r.n, r.r) for r in small.mapInArrow(f, "i int, n long, r long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("r").alias("r")).collect()}
        n = r = 0
        for i, key in enumerate(at):
            n, r = n + sums.get(i, (0, 0))[0], r + sums.get(i, (0, 0))[1]
            known[key] = n, r

    chosen: dict[int, Key] = {}
    rounds, wide = 0, dict.fromkeys([(None, None)], 1.0)
    while len(chosen) < len(targets) and rows:
        keys = sorted(known)
        below = [known[k][0] for k in keys]
        wanted: dict[tuple[Key | None, Key | None], list[int]] = {}
        for t, target in enumerate(targets):
            if t in chosen:
                continue
            i = bisect_left(below, target)
            near = [j for j in (i - 1, i) if 0 <= j < len(keys)]
            best = min(near, key=lambda j: abs(below[j] - target), default=None)
            bounds = keys[i - 1] if i else None, keys[i] if i < len(keys) else None
            if best is not None and abs(below[best] - target) <= slack or wide.get(bounds, 1.0) == 0:
                chosen[t] = keys[best] if best is not None else None
            else:
                wanted.setdefault(bounds, []).append(t)
        if not wanted:
            break
        intervals = []
        for (low, high), own in sorted(wanted.items(), key=lambda x: x[0][0] or ()):
            there = (known[high][1] if high else rows) - (known[low][1] if low else 0)
            intervals.append((low, high, min(1.0, wide.get((low, high), 1.0) * probes * len(own) / max(1, there))))
        fresh = [k for k in draw(intervals) if k not in known]
        for low, high, share in intervals:
            if not any((low is None or k > low) and (high is None or k < high) for k in fresh):
                wide[low, high] = 0 if share == 1 else 8 * wide.get((low, high), 1.0)  # 0: no key within
        if fresh:
            count(fresh)
            rounds += 1
    keys = sorted({k for k in chosen.values() if k is not None})
    return Splitters(keys, [known[k][0] for k in keys], total, rounds)


def _above(keys: list[Key], key: Key) -> int:
    """How many of keys are key or below it."""
    return bisect_right(keys, key)


def histogram_sort(docs: DataFrame, shard_mb: float | None = None, tolerance: float = 0.02, key: list[str] | None = None, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, sorted over shards of even bytes, and shard_id (shard_id_ where that name is taken).

    Rows are in the order of key (source and id, if not given; nulls first, NaN last and equal to each other), then of the text's
    hash; a row's bytes are its text's, or size, 0 for null and below. Key columns must not be nested. There is a shard for each
    shard_mb of text, one at least; where that is None, shards grow in number and in size: n MB make n^0.6 shards. Each splitter has within
    tolerance of a shard's bytes what it should have below; only rows that are equal in key and hash can't be parted, so
    that a shard holding a longer run of them may be larger and others empty. All rows are kept.

    Counting reads a narrow table of keys and sizes, written once; the rows move once, straight to their shard.
    """
    key = key or [c for c in ("source", id_col) if c in docs.columns]
    need(docs, text_col, *key)
    if nested := [k for k in key if isinstance(docs.schema[k].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]:
        raise ValueError(f"nested key columns: {', '.join(nested)}")
    spark = docs.sparkSession
    h, shard, n = unused(docs, "hash__"), unused(docs, "shard_id"), unused(docs, "bytes__")
    wide = docs.withColumn(h, F.xxhash64(F.col(f"`{text_col}`"))).withColumn(n, F.greatest(size if size is not None else F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long"))
    narrow = written(wide.select(*key, h, n))
    total = narrow.agg(F.sum(n).alias("n")).first().n or 0
    shards = max(1, -(-total // int(shard_mb * (1 << 20))) if shard_mb else ceil((total / (1 << 20)) ** 0.6))
    cut = splitters(narrow, [*key, h], n, shards, tolerance)
    found = spark.sparkContext.broadcast(cut.keys)
    places = [docs.columns.index(k) for k in key]
    names = [*docs.columns, h]

    def shard_batch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = found.value
        for b in it:
            values = zip(*(b.column(i).to_pylist() for i in (*places, len(names) - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_above(keys, order_key(v)) for v in values], pa.int32())], [*b.schema.names, shard])

    rows = wide.drop(n)
    placed = rows.mapInArrow(shard_batch, T.StructType([*rows.schema.fields, T.StructField(shard, T.IntegerType())]))
    moved = placed.repartitionById(len(cut.keys) + 1, F.col(shard))
    return moved.sortWithinPartitions(*(F.col(f"`{k}`").asc_nulls_first() for k in key), h).drop(h)

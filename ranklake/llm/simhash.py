"""SimHash near-deduplication: fingerprints that differ in few bits agree in some blocks, meet there, and are compared."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklake.llm.common import arrow_schema, forget, need, unused, written
from ranklake.llm.exact_dedup import Bloom, _ordered, affordable, probe

#: A fingerprint has 128 bits in 32 blocks of four, and two that differ in BITS at most are near: 13 of their blocks at least are
#: alike, so that in one of four groups of eight blocks at least four are.
BITS = 19
KEYS = [c for g in range(4) for c in combinations(range(8 * g, 8 * g + 8), 4)]
#: Rows of one key from which they are parted further: of the 28 other blocks of two that are near 9 at least are alike, so
#: that in one of four groups of seven at least three are.
MANY = 8192
#: Rows that are compared at once, for the cache.
ROWS = 65_536
#: Keys that a task compares at least.
TOGETHER = 4


class Fingerprints:
    """128-bit SimHash of a text's different words, in lower case, each of the same weight."""

    def __init__(self):
        self.words = re.compile(r"\w+").findall

    def of(self, text: str, words: list[str] | None = None) -> bytes:
        """16 bytes; a text without words counts as one word. Its words in lower case needn't be given."""
        different = set(self.words(text.lower()) if words is None else words) or {text}
        digests, ones = np.frombuffer(b"".join(map(xxhash.xxh128_digest, different)), np.uint8), np.zeros(128, np.int64)
        for i in range(0, len(digests), 16 * 255):  # so many as a byte can count
            ones += np.unpackbits(digests[i : i + 16 * 255]).reshape(-1, 128).sum(0, dtype=np.uint8)
        return np.packbits(2 * ones > len(different)).tobytes()


def blocks_of(fingerprints: np.ndarray) -> np.ndarray:
    """The 32 blocks of each row of 16 bytes."""
    out = np.empty((len(fingerprints), 32), np.uint8)
    out[:, ::2], out[:, 1::2] = fingerprints >> 4, fingerprints & 15
    return out


def key_of(blocks: np.ndarray, which: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(blocks), np.int32)
    for i in which:
        out = out << 4 | blocks[:, i]
    return out


def finer(which: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Further blocks of which rows that agree in those must agree in one choice, if they are near."""
    rest = [i for i in range(32) if i not in which]
    return [c for g in range(4) for c in combinations(rest[7 * g : 7 * g + 7], 3)]


class Forest:
    """Rows of 16 bytes, the components they are in so far, and the edges that connected them."""

    def __init__(self, fingerprints: np.ndarray):
        self.words = np.ascontiguousarray(fingerprints).view(np.uint64).reshape(-1, 2)
        self.parent = np.arange(len(fingerprints))
        self.edges: list[np.ndarray] = []

    def roots(self, rows: np.ndarray) -> np.ndarray:
        """The component of each row."""
        root = self.parent[rows]
        while len(further := np.flatnonzero(self.parent[root] != root)):
            root[further] = self.parent[root[further]]
        self.parent[rows] = root
        return root

    def meet(self, rows: np.ndarray, key: np.ndarray, word: int) -> None:
        """Connect those rows that are near and have one key. Of the two words of a row, that word is looked at first."""
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        lengths = np.diff(np.append(starts, len(key)))
        longest = np.argsort(-lengths, kind="stable")[: np.count_nonzero(lengths > 1)]
        starts, lengths = starts[longest], lengths[longest]
        ends, i = np.cumsum(lengths), 0
        while i < len(lengths):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - lengths[i] + ROWS, "right")))
            own = lengths[i:j]
            self._compare(rows[np.repeat(starts[i:j] - np.cumsum(own) + own, own) + np.arange(own.sum())], own, word)
            i = j

    def _compare(self, rows: np.ndarray, lengths: np.ndarray, word: int) -> None:
        """meet() for buckets that lie one after the other, the longest first: each row with the next, the one after it, and so
        on. Those that still have a row so far on come first, so that all are slices. Now and then, buckets of one component go."""
        step = 1
        while len(lengths):
            root, starts = self.roots(rows), np.cumsum(lengths) - lengths
            mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
            rows, lengths = rows[np.repeat(mixed, lengths)], lengths[mixed]
            values, bucket, ends = self.words[rows, word], np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths)
            differ, bits = np.empty(len(rows), np.uint64), np.empty(len(rows), np.uint8)
            lasts = np.searchsorted(-lengths, -np.arange(step, 8 * step)) - 1
            for last in lasts[lasts >= 0].tolist():
                n = int(ends[last]) - step
                np.bitwise_xor(values[:n], values[step : n + step], out=differ[:n])
                a = np.flatnonzero(np.bitwise_count(differ[:n], out=bits[:n]) <= BITS)
                a = a[bucket[a] == bucket[a + step]]
                a, b = rows[a], rows[a + step]
                near = np.bitwise_count(self.words[a] ^ self.words[b]).sum(1) <= BITS
                if near.any():
                    self._join(a[near], b[near])
                step += 1
            if (lasts < 0).any():
                return

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        of_a, of_b = self.roots(a), self.roots(b)
        apart, keep = np.flatnonzero(of_a != of_b), []
        for i, x, y in zip(apart.tolist(), of_a[apart].tolist(), of_b[apart].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                keep.append(i)
        self.edges.append(np.stack([a[keep], b[keep]]))
        self.parent[list(parent)] = [root(x) for x in list(parent)]


def spanning(fingerprints: np.ndarray, which: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Edges between rows (16 bytes each) that agree in those blocks and differ in BITS bits at most: of the rows that are so
    connected, as many as keep them connected."""
    blocks, forest = blocks_of(fingerprints), Forest(fingerprints)
    word = int(which[0] < 16)  # the one without the key: it has more bits to differ in
    key = key_of(blocks, which)
    large = np.bincount(key, minlength=1 << 4 * len(which))[key] > MANY
    few = np.flatnonzero(~large)
    forest.meet(few, key[few].astype(np.uint16), word)
    many = np.flatnonzero(large)
    for more in finer(which) if len(many) else []:
        forest.meet(many, key[many] << 12 | key_of(blocks[many], more), word)
    a, b = np.concatenate(forest.edges, 1) if forest.edges else np.zeros((2, 0), np.int64)
    return a, b


def _binaries(rows: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def block_edges(fps: DataFrame, parts_a_key: int = 1) -> DataFrame:
    """(a, b): edges between different fingerprints (fp) that connect all that are near.

    Every task sends each of its fingerprints to all keys, packed as bytes; the rows of a key, or of a range of its values, are
    compared in one task, within buckets of equal values.
    """

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = b"".join(x for b in it for x in b.column("fp").to_pylist())
        rows = np.frombuffer(data, np.uint8).reshape(-1, 16)
        blocks = blocks_of(rows) if parts_a_key > 1 else None
        for p, which in enumerate(KEYS if len(rows) else []):
            if parts_a_key == 1:
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([data], pa.binary())], ["part", "rows"])
                continue
            part = (key_of(blocks, which).astype(np.int64) * parts_a_key >> 16).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            part, ordered = part[order], rows[order]
            ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
            sent = [ordered[start:end].tobytes() for start, end in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(p * parts_a_key + part[ends - 1].astype(np.int64)), pa.array(sent, pa.binary())], ["part", "rows"])

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for b in it:
            for p, rows in zip(b.column("part").to_pylist(), b.column("rows").to_pylist()):
                parts.setdefault(p, []).append(rows)
        while parts:
            p, own = parts.popitem()
            rows = np.frombuffer(b"".join(own), np.uint8).reshape(-1, 16)
            a, b = spanning(rows, KEYS[p // parts_a_key])
            yield pa.RecordBatch.from_arrays([_binaries(rows[a]), _binaries(rows[b])], ["a", "b"])

    together = max(1, TOGETHER // parts_a_key)
    sent = fps.select("fp").mapInArrow(send, "part long, rows binary").repartitionById(-(-len(KEYS) * parts_a_key // together), F.expr(f"cast(part div {together} as int)"))
    return sent.mapInArrow(meet, "a binary, b binary").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b) but the roots themselves: root is the least node it is connected with.

    Large-star and small-star steps alternate until nothing changes; each round is written to the shared folder. The least
    neighbour of a node is joined to its edges, so that no task holds all edges of a hub.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if state.n == 0 or (state.n, state.s) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = state.n, state.s
        turned = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = now.unionByName(turned).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(turned.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        stars = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = written(stars.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct())
        forget(now, large)
        now = small


def _hashes(text_col: str) -> list:
    text = F.col(f"`{text_col}`")
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def labelled(docs: DataFrame, columns: dict[str, Column], text_col: str = "text", rows_a_part: int = 500_000, facts: dict[str, tuple[T.DataType, Callable[[str, list[str]], Any]]] | None = None) -> DataFrame:
    """The columns, by their names, then facts and group of each row of docs. The group is the same for those that are near.
    Facts are of a type each, from a text and its words in lower case. Group and facts of a null text are null."""
    names, facts = list(columns), facts or {}
    own = docs.select(*(c.alias(name) for name, c in columns.items()))
    rows = docs.select(*(c.alias(name) for name, c in columns.items()), F.col(f"`{text_col}`").alias("text"))
    made_here = T.StructType([*(T.StructField(name, kind) for name, (kind, _) in facts.items()), T.StructField("fp", T.BinaryType())])

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprints, kinds = Fingerprints(), arrow_schema(made_here).types
        for b in it:
            made: list[list] = [[] for _ in kinds]
            for text in b.column("text").to_pylist():
                words = [] if text is None else fingerprints.words(text.lower())
                for out, (_, fact) in zip(made, facts.values()):
                    out.append(None if text is None else fact(text, words))
                made[-1].append(None if text is None else fingerprints.of(text, words))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(x, kind) for x, kind in zip(made, kinds))], [*names, *made_here.names])

    made = written(rows.mapInArrow(f, T.StructType([*own.schema.fields, *made_here.fields])))
    fps = made.select("fp").filter("fp is not null").distinct()
    parts = max(1, min(1 << 16, -(-made.count() // rows_a_part)))  # a part is a value of the key at least
    roots = components(block_edges(fps, parts)).withColumnRenamed("node", "fp")
    return made.join(roots, "fp", "left").select(*names, *facts, F.coalesce("root", "fp").alias("group"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, rows_a_part: int) -> DataFrame:
    """(id, h1, h2, group): a row for each row of docs that has a text."""
    h1, h2 = _hashes(text_col)
    there = docs.filter(F.col(f"`{text_col}`").isNotNull())
    return labelled(there, {"id": F.col(f"`{id_col}`"), "h1": h1, "h2": h2}, text_col, rows_a_part)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_part: int = 500_000) -> DataFrame:
    """(doc_id, keep_doc_id, kept) of the rows of docs that have near duplicates; keep_doc_id is the least id of the group.

    Two texts are near if their fingerprints differ in BITS bits at most, and groups are what is so connected: no pair is
    missed. Copies, and rows repeated as they are, share a fingerprint. Empty texts are near each other; a null text is near nothing. Null ids come last; if all of a group are null, so is
    keep_doc_id. kept marks the rows with that id, all of them if it is repeated. Other columns are ignored.
    """
    need(docs, id_col, text_col)
    labelled = _labelled(docs, id_col, text_col, rows_a_part)
    sizes = labelled.groupBy("group").agg(F.count("*").alias("n"), F.min("id").alias("keep_doc_id")).filter("n > 1")
    return labelled.join(sizes, "group").select(F.col("id").alias("doc_id"), "keep_doc_id", F.col("id").eqNullSafe(F.col("keep_doc_id")).alias("kept"))


def members(hashes: DataFrame, shards: int, bits_each: float) -> DataFrame:
    """(shard, words): a Bloom filter, for probe(), of the hashes (column h) of each shard that has any."""

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[np.ndarray]] = {}
        for b in it:
            shard, h = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "h"))
            for k in np.unique(shard):
                own.setdefault(int(k), []).append(h[shard == k])
        for k, parts in own.items():
            h = np.unique(np.concatenate(parts))
            bloom = Bloom(len(h), bits_each)
            bloom.add(h)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bloom.words.view(np.int64)], pa.list_(pa.int64()))], ["shard", "words"])

    return hashes.select(F.expr(_shard("h", shards)).alias("shard"), "h").repartition(shards, "shard").mapInArrow(f, "shard int, words array<long>")


def _shard(h: str, shards: int) -> str:
    return f"cast(shiftrightunsigned({h}, 20) % {shards} as int)"


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_part: int = 500_000, bits_each: int = 12, max_filter_mb: int = 256) -> DataFrame:
    """One row of docs, with all its columns, of each group of near duplicates, and all rows that have none.

    The row that stays has the least id, nulls last (ties: the other plain columns, in order). See groups() for the rest.

    Texts are shuffled only where a Bloom filter of the groups' hashes has theirs; other rows pass straight through. The
    filters take max_filter_mb together at most: the more hashes, the fewer bits each, and the more other rows are shuffled along.
    """
    need(docs, id_col, text_col)
    group, rank, h1, h2, shard, words = (unused(docs, x) for x in ("group__", "rank__", "h1__", "h2__", "shard__", "words__"))
    labelled = _labelled(docs, id_col, text_col, rows_a_part)
    sizes = labelled.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    more = labelled.join(sizes, "group").select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("group").alias(group)).distinct()
    more = written(more)
    hashed = docs.withColumns({h1: F.when(F.col(f"`{text_col}`").isNotNull(), _hashes(text_col)[0]), h2: _hashes(text_col)[1]})
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = affordable(more.count(), bits_each, max_filter_mb)
    made = members(more.select(F.col(h1).alias("h")), shards, bits).select(F.col("shard").alias(shard), F.col("words").alias(words))
    columns = [f"`{c}`" for c in docs.columns]
    probed = hashed.withColumn(shard, F.expr(_shard(h1, shards))).join(F.broadcast(made), shard, "left")
    hit = F.coalesce(F.expr(probe(h1, words, bits)), F.lit(False))
    out = [probed.filter(~hit).select(*columns)]
    hashed = probed.filter(hit).drop(words, shard)
    flagged = hashed.join(more, [h1, h2], "left")
    out.append(flagged.filter(F.col(group).isNull()).select(*columns))
    first = F.row_number().over(Window.partitionBy(group).orderBy(*_ordered(docs, id_col)))
    kept = flagged.filter(F.col(group).isNotNull()).withColumn(rank, first).filter(F.col(rank) == 1)
    out.append(kept.select(*columns))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole

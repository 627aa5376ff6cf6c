"""Best-fit packing to bins that hold no two pieces of one source or of one cluster of duplicates."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklake.llm.common import need, written
from ranklake.llm.simhash import components, labelled

#: Bins in a block of the residual order at most.
BLOCK = 96


def words(text: str | Column) -> Column:
    """The number of a text's words, its length here; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def content_key(text: str | Column) -> Column:
    """What copies share that differ in case, white space and punctuation alone."""
    c = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""))


def _size(text: str, lower: list[str]) -> int:
    """words() of a text that is in Python already."""
    return len(text.encode().split())  # at the white space of ASCII, as regexp_count has it


def _key(text: str, lower: list[str]) -> int:
    """Like content_key() the same for the same letters and digits, from a text's words in lower case; another number."""
    return int.from_bytes(xxhash.xxh64_digest("".join(lower).replace("_", "")), "big", signed=True)


class Bins:
    """Open bins in the order of residual and number, in blocks that carry what all their bins hold."""

    def __init__(self):
        self.blocks: list[list[tuple[int, int]]] = []
        self.firsts: list[tuple[int, int]] = []
        self.shared: list[tuple[int, int]] = []
        self.held: list[tuple[int, int]] = []  # source and cluster bitmaps of each bin

    def _refresh(self, i: int) -> None:
        block = self.blocks[i]
        sources, clusters = self.held[block[0][1]]
        for _, b in block[1:]:
            s, c = self.held[b]
            sources &= s
            clusters &= c
            if not sources | clusters:
                break
        self.firsts[i], self.shared[i] = block[0], (sources, clusters)

    def _block_of(self, item: tuple[int, int]) -> int:
        i = bisect_left(self.firsts, item)
        return i if i < len(self.firsts) and self.firsts[i] == item else max(0, i - 1)

    def find(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """The compatible bin of the least residual of size or more, the oldest of those; (residual, bin)."""
        if not self.blocks:
            return None
        low = (size, -1)
        held = self.held
        for i in range(self._block_of(low), len(self.blocks)):
            s, c = self.shared[i]
            if s & source or c & cluster:  # all its bins have it
                continue
            block = self.blocks[i]
            for k in range(bisect_left(block, low), len(block)):
                s, c = held[block[k][1]]
                if not (s & source or c & cluster):
                    return block[k]
        return None

    def put(self, item: tuple[int, int]) -> None:
        if not self.blocks:
            self.blocks, self.firsts, self.shared = [[item]], [item], [self.held[item[1]]]
            return
        i = self._block_of(item)
        insort(self.blocks[i], item)
        if len(self.blocks[i]) > BLOCK:
            half = BLOCK // 2
            self.blocks.insert(i + 1, self.blocks[i][half:])
            del self.blocks[i][half:]
            self.firsts.insert(i + 1, item)
            self.shared.insert(i + 1, (0, 0))
            self._refresh(i + 1)
            self._refresh(i)
        else:
            s, c = self.shared[i]
            own = self.held[item[1]]
            self.firsts[i], self.shared[i] = self.blocks[i][0], (s & own[0], c & own[1])

    def take(self, item: tuple[int, int]) -> None:
        i = self._block_of(item)
        block = self.blocks[i]
        del block[bisect_left(block, item)]
        if block:
            self._refresh(i)
        else:
            del self.blocks[i], self.firsts[i], self.shared[i]


def pack(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece (size, source, cluster), in their order: sizes shall fall and not pass capacity.

    Source and cluster are numbers; those that come up once take no bit. A piece goes to the compatible bin that it fills
    best, or opens one.
    """
    bins, out = Bins(), []
    often = [{x: 1 << i for i, x in enumerate(x for x, n in Counter(p[k] for p in pieces).items() if n > 1)} for k in (1, 2)]
    for size, source, cluster in pieces:
        s, c = often[0].get(source, 0), often[1].get(cluster, 0)
        found = bins.find(size, s, c)
        if found:
            bins.take(found)
            residual, b = found
            held = bins.held[b]
            bins.held[b] = held[0] | s, held[1] | c
        else:
            residual, b = capacity, len(bins.held)
            bins.held.append((s, c))
        out.append((b, capacity - residual))
        if residual > size:
            bins.put((residual - size, b))
    return out


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, cluster) of each row of docs, for best_fit(): near duplicates by simhash and texts of the same
    content_key() are in one cluster, and so are those that a chain of such pairs connects. Null texts are one cluster."""
    need(docs, id_col, text_col, source_col)
    facts = {"size": (T.IntegerType(), _size), "key": (T.LongType(), _key)}
    rows = labelled(docs, {"doc_id": F.col(id_col), "source": F.col(source_col)}, text_col, facts=facts)
    near = written(rows.select("doc_id", F.coalesce("size", F.lit(0)).alias("size"), "source", "key", F.coalesce("group", F.encode(F.lit("no text"), "utf-8")).alias("near")))
    least = near.groupBy("key").agg(F.min("near").alias("least"), F.max("near").alias("most")).filter("least <> most").select("key", "least")
    roots = components(near.join(least, "key").select(F.col("near").alias("a"), F.col("least").alias("b")))
    return written(near.join(roots.withColumnRenamed("node", "near"), "near", "left").select("doc_id", "size", "source", F.coalesce("root", "near").alias("cluster")))


def best_fit(docs: DataFrame, capacity: int = 2048, docs_a_group: int = 20_000, size: Column | None = None, cluster: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, piece, size, start, group, bin, offset): where each piece of each document goes.

    A document's size is its number of words, or size (op1's n_tokens, say), 0 for null or below. Ids are of any type that isn't nested. One above capacity is cut to full pieces and a rest; start is where a
    piece begins in its document. Pieces are taken from the longest down (ties by id, nulls last, then by source, cluster
    and piece). No bin holds two pieces of one source or of one cluster: copies but for case, white space and punctuation,
    or cluster. A null source is one source like another. Null and empty texts have size 0: one piece, to which a full bin
    is as good as any, so they open none of their own but share bins of other sources and clusters, if there is room.

    Documents are spread over groups of about docs_a_group by a hash of id and content, and each group is packed on its own:
    bins, (group, bin), don't depend on partitions. Repeated rows are packed each. Other columns are ignored.
    """
    need(docs, id_col, text_col, source_col)
    if capacity < 1 or docs_a_group < 1:
        raise ValueError("capacity and docs_a_group must be positive")
    if isinstance(docs.schema[id_col].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise ValueError("ids must not be nested")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.greatest(size if size is not None else words(text_col), F.lit(0)).cast("int").alias("size"), F.col(source_col).cast("string").alias("source"), (cluster if cluster is not None else content_key(text_col)).alias("cluster"))
    groups = max(1, -(-docs.count() // docs_a_group))
    kind = dict(rows.dtypes)["doc_id"]
    grouped = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster", F.lit(7)), F.lit(groups)).cast("int"))

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups_here: dict[int, list] = {}
        id_type = pa.null()
        for b in it:
            id_type = b.column("doc_id").type
            for g, *row in zip(*(b.column(c).to_pylist() for c in ("group", "doc_id", "size", "source", "cluster"))):
                groups_here.setdefault(g, []).append(row)
        for g, own in groups_here.items():
            pieces = []
            for doc, n, source, cluster_ in own:
                for k in range(max(1, -(-n // capacity))):
                    pieces.append((min(capacity, n - k * capacity), doc, source, cluster_, k))
            pieces.sort(key=lambda p: (-p[0], p[1] is None, p[1] if p[1] is not None else 0, p[2] is not None, p[2] or "", p[3] is not None, p[3] or 0, p[4]))
            placed = pack([(p[0], p[2], p[3]) for p in pieces], capacity)
            columns = [[p[1] for p in pieces], [p[4] for p in pieces], [p[0] for p in pieces], [p[4] * capacity for p in pieces], [g] * len(pieces), [x[0] for x in placed], [x[1] for x in placed]]
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int32()) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "size", "start", "group", "bin", "offset"])

    return grouped.repartitionById(groups, F.col("group")).mapInArrow(f, f"doc_id {kind}, piece int, size int, start int, `group` int, bin int, offset int")

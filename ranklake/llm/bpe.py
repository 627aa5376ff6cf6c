"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched where their boundaries meet, then encoded."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklake.llm.common import need, unused

#: Where a vocabulary of ranks is; every executor needs the file.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: What splits text ahead of the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters ahead of a chunk's end from which a cut-off match can't reach back; longer than any contraction.
MARGIN = 4
#: Pieces that a worker remembers before it starts over; texts in one batch of results.
MEMORY, TEXTS = 100_000, 200


@lru_cache(2)
def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks by token bytes."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes pre-tokens, remembering those it has seen."""

    def __init__(self, path: str):
        ranks = vocabulary(path)
        self.core = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes = {b: a for a, b in ranks.items()}
        self.split = regex.compile(SPLIT)
        self.seen: dict[str, tuple[int, ...]] = {}

    def pieces(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        seen, one = self.seen, self.core.encode_single_piece
        if len(seen) > MEMORY:
            seen.clear()
        for p in pieces:
            ids = seen.get(p)
            if ids is None:
                ids = seen[p] = tuple(one(p.encode()))
            out += ids
        return out

    def text(self, text: str) -> list[int]:
        return self.pieces(self.split.findall(text))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, one after another; they need not be whole characters."""
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def _lists(ids: list[list[int] | None]) -> pa.Array:
    counts = [len(x) if x is not None else 0 for x in ids]
    flat = np.concatenate([np.array(x, np.int32) for x in ids if x] or [np.zeros(0, np.int32)])
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    mask = pa.array([x is None for x in ids], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask)


def encode(docs: DataFrame, ranks: str = RANKS, chunk_chars: int = 16_384, overlap: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids, n_tokens, lossless) of each row of docs, whatever its length.

    A text of up to chunk_chars + overlap characters is one chunk. A longer one is cut to chunks that overlap; each is
    pre-tokenised on its own, wherever there is room, and two neighbours are joined at the first position in their
    overlap where both begin a pre-token: from there on both would go on alike. If some neighbours share no such
    position (a run longer than the overlap), that text is encoded as one.

    lossless says that decoding gives the text's bytes again. A null text has null in all columns but doc_id; an empty
    one has no tokens. Rows are never merged: repeated rows and null ids come out as often as they go in. Other columns
    are ignored, whatever their names.
    """
    need(docs, id_col, text_col)
    if not 2 * MARGIN < overlap < chunk_chars:
        raise ValueError("the overlap must be shorter than a chunk and longer than the margin")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, token_ids array<int>, n_tokens int, lossless boolean"
    is_long = F.coalesce(F.length("text") > chunk_chars + overlap, F.lit(False))

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks)
        for b in it:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                texts = part.column("text").to_pylist()
                ids = [None if t is None else e.text(t) for t in texts]
                ok = [None if t is None else e.decode(x) == t.encode() for t, x in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids), pa.array([None if x is None else len(x) for x in ids], pa.int32()), pa.array(ok, pa.bool_())], ["doc_id", "token_ids", "n_tokens", "lossless"])

    long = rows.filter(is_long).withColumn("key", F.sha2(F.encode("text", "UTF-8"), 256))
    stitched = _encode_long(long, ranks, chunk_chars, overlap).select("doc_id", "token_ids", "n_tokens", "lossless")
    return rows.filter(~is_long).mapInArrow(whole, schema).unionByName(stitched)


def _pack(lengths: np.ndarray) -> bytes:
    """Positive lengths as bytes: 255 as often as it fits, then the rest."""
    full = lengths // 255
    out = np.full(int((full + 1).sum()), 255, np.uint8)
    out[np.cumsum(full + 1) - 1] = lengths % 255
    return out.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    """Where each piece ends, counted from the start of the first."""
    steps = np.frombuffer(packed, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps < 255]


def _encode_long(long: DataFrame, ranks: str, size: int, overlap: int) -> DataFrame:
    """(doc_id, token_ids, n_tokens, lossless) of each row of long; a text is encoded once, however often it is there."""

    def chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                at = range(0, max(1, len(text) - overlap), size)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at)), pa.array(at, pa.int32()), pa.array([len(text)] * len(at), pa.int32()), pa.array([text[i : i + size + overlap] for i in at], pa.string())], ["key", "at", "size", "chunk"])

    def boundaries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = regex.compile(SPLIT), set()
        for b in it:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                key, at, chunk = row.column("key")[0].as_py(), row.column("at")[0].as_py(), row.column("chunk")[0].as_py()
                if (key, at) in seen:  # another row has the same text
                    continue
                seen.add((key, at))
                starts = np.array([m.start() for m in split.finditer(chunk)], np.int32) + at
                end = at + len(chunk)
                head = starts[starts < at + overlap]
                tail = starts[(starts >= at + size) & (starts <= end - MARGIN)]
                yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array([x], pa.list_(pa.int32())) for x in (head, tail)), pa.array([_pack(np.diff(np.append(starts, end)))], pa.binary())], ["key", "at", "size", "chunk", "head", "tail", "pieces"])

    schema = "key string, at int, size int, chunk string"
    found = long.select("key", "text").mapInArrow(chunks, schema).repartition("key", "at").mapInArrow(boundaries, schema + ", head array<int>, tail array<int>, pieces binary")
    by = Window.partitionBy("key").orderBy("at")
    cut = F.array_min(F.array_intersect("tail", F.lead("head").over(by)))
    last = F.col("at") + F.length("chunk") >= F.col("size")
    cuts = found.withColumn("hi", F.when(last, F.col("size")).otherwise(cut)).withColumn("lo", F.when(F.col("at") == 0, 0).otherwise(F.lag("hi").over(by)))

    def encode_part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks)
        for b in it:
            for i in range(b.num_rows):
                key, at, chunk, lo, hi, odd, packed = (b.column(c)[i].as_py() for c in ("key", "at", "chunk", "lo", "hi", "odd", "pieces"))
                ids, ok = None, None
                if not odd:
                    ends = _unpack(packed)
                    starts = [lo - at, *ends[(ends > lo - at) & (ends <= hi - at)].tolist()]
                    ids = e.pieces([chunk[a:z] for a, z in zip(starts, starts[1:])])
                    ok = e.decode(ids) == chunk[lo - at : hi - at].encode()
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([at], pa.int32()), pa.array([ids], pa.list_(pa.int32())), pa.array([ok], pa.bool_()), pa.array([chunk if odd else None], pa.string())], ["key", "at", "ids", "ok", "chunk"])

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks)
        for b in it:
            for i in range(b.num_rows):
                ids, ok, chunks = (b.column(c)[i] for c in ("ids", "ok", "chunks"))
                if len(chunks):  # not joined everywhere: one scan of the whole text
                    chunks = chunks.as_py()
                    text = "".join([c[:size] for c in chunks[:-1]] + chunks[-1:])
                    ids = pa.scalar(e.text(text), pa.list_(pa.int32()))
                    ok = pa.scalar(e.decode(ids.as_py()) == text.encode())
                yield pa.RecordBatch.from_arrays([b.column("rows").slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.values), pa.array([len(ids)], pa.int32()), pa.array([ok.as_py()], pa.bool_())], ["rows", "token_ids", "n_tokens", "lossless"])

    odd = F.max(F.col("hi").isNull()).over(Window.partitionBy("key"))
    parts = cuts.withColumn("odd", odd).select("key", "at", "chunk", "lo", "hi", "odd", "pieces").mapInArrow(encode_part, "key string, at int, ids array<int>, ok boolean, chunk string")
    # the rows' ids go along, so that one exchange does for the parts and for whose they are
    of_rows = long.select("key", F.lit(None).cast("struct<at:int,ids:array<int>,chunk:string>").alias("part"), F.lit(None).cast("boolean").alias("ok"), F.struct("doc_id").alias("row"))
    with_rows = parts.select("key", F.struct("at", "ids", "chunk").alias("part"), "ok", F.lit(None).cast(of_rows.schema["row"].dataType).alias("row")).unionByName(of_rows)
    sorted_parts = with_rows.groupBy("key").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.bool_and("ok").alias("ok"), F.collect_list("row").alias("rows"))
    some = F.filter(F.transform("parts", lambda x: x["chunk"]), lambda x: x.isNotNull())
    each = F.flatten(F.transform("parts", lambda x: F.coalesce(x["ids"], F.array().cast("array<int>"))))
    kind = dict(long.dtypes)["doc_id"]
    done = sorted_parts.select("rows", each.alias("ids"), "ok", some.alias("chunks")).mapInArrow(finish, f"rows array<struct<doc_id:{kind}>>, token_ids array<int>, n_tokens int, lossless boolean")
    return done.select(F.explode("rows").alias("row"), "token_ids", "n_tokens", "lossless").select("row.doc_id", "token_ids", "n_tokens", "lossless")


def decode(rows: DataFrame, ranks: str = RANKS, ids_col: str = "token_ids") -> DataFrame:
    """rows with the column bytes (bytes_ where that name is taken): the tokens' bytes, concatenated.

    Null for null ids, empty for none; an id that the vocabulary lacks, or a null one, raises.
    """
    need(rows, ids_col)
    name = unused(rows, "bytes")
    at = rows.columns.index(ids_col)

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks)
        for b in it:
            out = [None if x is None else e.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, name])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return rows.mapInArrow(joined, StructType([*rows.schema.fields, StructField(name, BinaryType())]))

"""Dense search: queries against encoded rows, exactly or in two stages, within allowlists if given.

Results are long tables (qid, rank, row_id, score), ordered within a query by score, highest first, then row_id; scores are
rounded to nine decimals, so that the order of summation decides no tie. Rows of the index and queries meet as packed
blocks, which are written once: a task has some blocks of queries, runs each over all of the index as matrix products, and
sends on k rows a query. Neither side is collected.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklake.config import Mode, SearchOptions, SignPolicy, check_shape, resolve_sign
from ranklake.errors import InvalidVectorError, MissingSignError, OptionError, ShapeError, UnknownIdError
from ranklake.functions import encode as E
from ranklake.shared import written

HITS = "qid long, rank int, row_id long, score double"
#: Rows of the index and queries in a block.
INDEX_BLOCK, QUERY_BLOCK = 8192, 8192
#: Queries in a block of a two-stage search, which holds many candidates of each.
STAGED_BLOCK = 2048
#: Queries that are compared at once, and candidates that are scored at once.
CHUNK, SLICE = 512, 200_000
#: Tasks for each core that blocks are dealt to.
TASKS = 8
#: Blocks of a query whose candidates are held before they are cut.
HELD = 64
DECIMALS = 9


@dataclass(frozen=True)
class Index:
    """Encoded rows (row_id, codes, sign) and their shape. dim is None until the first rows are known."""

    rows: DataFrame | None
    dim: int | None
    bits: int = 2
    policy: SignPolicy = SignPolicy.OPTIONAL

    @property
    def has_sign(self) -> bool:
        return self.dim is not None and resolve_sign(self.dim, self.bits, self.policy)

    def __len__(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    def describe(self, spark: SparkSession) -> DataFrame:
        """One row: dim, bits, vector_count, bytes_per_vector, has_sign."""
        width = self.dim * self.bits // 8 + (self.dim // 8 if self.has_sign else 0) if self.dim else None
        return spark.createDataFrame([(self.dim, self.bits, len(self), width, self.has_sign)], "dim int, bits int, vector_count long, bytes_per_vector int, has_sign boolean")


def create(spark: SparkSession, dim: int, bits: int = 2, policy: SignPolicy | str = SignPolicy.OPTIONAL) -> Index:
    """An empty index of a fixed shape."""
    check_shape(dim, bits)
    resolve_sign(dim, bits, policy)
    return Index(spark.createDataFrame([], "row_id long, codes binary, sign binary"), dim, bits, SignPolicy.of(policy))


def lazy(bits: int = 2, policy: SignPolicy | str = SignPolicy.OPTIONAL) -> Index:
    """An index that takes its dimension from the first rows."""
    from ranklake.config import required_multiple

    required_multiple(bits)
    return Index(None, None, bits, SignPolicy.of(policy))


def dim_of(vectors: DataFrame, vector_col: str = "embedding") -> int | None:
    """The length of the first vector that isn't null."""
    row = vectors.filter(F.col(vector_col).isNotNull()).select(F.size(vector_col).alias("n")).first()
    return row.n if row else None


def check_vectors(vectors: DataFrame, dim: int, id_col: str = "row_id", vector_col: str = "embedding") -> None:
    """Raise for the first vector, by id, that has a wrong length or coordinate."""
    if bad := E.first_invalid(vectors, vector_col, id_col, dim).first():
        raise (ShapeError(f"row {bad.row_id} has no vector of dim {dim}") if bad.coord < 0 else InvalidVectorError(f"row {bad.row_id}, coordinate {bad.coord} is not a finite number below the limit"))


def add(index: Index, vectors: DataFrame, id_col: str = "row_id", vector_col: str = "embedding", check: bool = True) -> Index:
    """index with the rows of vectors. All of them or none: with check they are validated first. No rows, no change."""
    dim = index.dim
    if dim is None:
        dim = dim_of(vectors, vector_col)
        if dim is None:
            return index
        check_shape(dim, index.bits)
        resolve_sign(dim, index.bits, index.policy)
    if check:
        check_vectors(vectors, dim, id_col, vector_col)
    fresh = E.encoded(vectors, dim, index.bits, resolve_sign(dim, index.bits, index.policy), id_col, vector_col)
    return Index(fresh if index.rows is None else index.rows.unionByName(fresh), dim, index.bits, index.policy)


def build(vectors: DataFrame, bits: int = 2, policy: SignPolicy | str = SignPolicy.OPTIONAL, id_col: str = "row_id", vector_col: str = "embedding", dim: int | None = None) -> Index:
    """An index of vectors; lazily validated: a wrong row raises where it is read."""
    dim = dim or dim_of(vectors, vector_col)
    if dim is None:
        return lazy(bits, policy)
    check_shape(dim, bits)
    return Index(E.encoded(vectors, dim, bits, resolve_sign(dim, bits, policy), id_col, vector_col), dim, bits, SignPolicy.of(policy))


@dataclass(frozen=True)
class _Stored:
    """Packed blocks in the shared folder (id, n, low, high, block), with their ids and numbers of rows; low to high are a block's groups."""

    table: DataFrame
    sizes: list[tuple[int, int]]

    def dealt(self, parts: int) -> DataFrame:
        """The blocks in so many partitions, in the order of their ids, with about the same number of rows each."""
        total, before, bounds = sum(n for _, n in self.sizes), 0, []
        for i, n in self.sizes:
            if before * parts >= (len(bounds) + 1) * total:
                bounds.append(i)
            before += n
        part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("id"))) if bounds else F.lit(0)
        return self.table.repartitionById(parts, part)


def _blocks(rows: DataFrame, size: int, group: str | None = None) -> _Stored:
    """Rows packed as Arrow streams, some thousands each, and written: what makes them runs once, however many they meet.

    Blocks of groups (a long) have rows in their order.
    """

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table)
            held.clear()
            groups = table.column(group) if group else [pa.scalar(0)]
            return pa.RecordBatch.from_arrays([pa.array([len(table)], pa.int32()), pa.array([groups[0].as_py()], pa.int64()), pa.array([groups[-1].as_py()], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["n", "low", "high", "block"])

        for b in it:
            while b.num_rows:
                part = b.slice(0, size - n)
                held.append(part)
                n += part.num_rows
                b = b.slice(part.num_rows)
                if n == size:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    if group:
        order = [group, rows.columns[0]]
        rows = rows.filter(F.col(group).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    table = written(rows.mapInArrow(f, "n int, low long, high long, block binary").withColumn("id", F.monotonically_increasing_id()))
    return _Stored(table, sorted((r.id, r.n) for r in table.select("id", "n").collect()))


def _read(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_all().combine_chunks().to_batches()[0]


def _pairs(rows: _Stored, queries: _Stored) -> tuple[DataFrame, int]:
    """(q, qblock, dblock): every block of queries with each of the index that may have rows of its groups, one after the
    other; and how many tasks share a query. Queries are dealt to tasks, the index only where those are few."""
    tasks = TASKS * max(queries.table.sparkSession.sparkContext.defaultParallelism, 4)
    many = max(1, min(len(queries.sizes), tasks))
    shares = max(1, min(len(rows.sizes), -(-tasks // (2 * many)))) if many < tasks // 2 else 1
    q = queries.dealt(many).select(F.col("id").alias("q"), F.col("low").alias("qlow"), F.col("high").alias("qhigh"), F.col("block").alias("qblock"))
    d = rows.dealt(shares).select(F.col("low").alias("dlow"), F.col("high").alias("dhigh"), F.col("block").alias("dblock"))
    meet = (F.col("dlow") <= F.col("qhigh")) & (F.col("dhigh") >= F.col("qlow"))
    return q.join(d.hint("shuffle_replicate_nl"), meet).select("q", "qblock", "dblock"), shares


def _met(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch | None, pa.RecordBatch]]:
    """Pairs of blocks, read; that of queries only where it isn't the last one's."""
    before = None
    for b in it:
        for at, q in enumerate(b.column("q").to_pylist()):
            yield q, _read(b.column("qblock")[at].as_py()) if q != before else None, _read(b.column("dblock")[at].as_py())
            before = q


class _Scores:
    """Scores by dot products: query and row give matrices of which exact scores are the products.

    What can't be among the best is told by products in single precision, off by less than slack.
    """

    def __init__(self, query, row):
        self.query, self.row = query, row

    def slack(self, q: np.ndarray, most: float) -> np.ndarray:
        return q.shape[1] * 2.0**-22 * np.abs(q).sum(1) * most + 1e-8

    def exact(self, q: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.round(np.einsum("ij,ij->i", q.astype(np.float64), d.astype(np.float64)), DECIMALS) + 0.0


class _Best:
    """The m best rows of some queries (a matrix), by score, ties by id, as blocks come in."""

    def __init__(self, q: np.ndarray, m: int, scores: _Scores):
        self.q, self.m, self.scores, self.thin = q, m, scores, q.astype(np.float32)
        self.low = np.full(len(q), -np.inf)  # no lower score can be among the best
        self.held: list[tuple[np.ndarray, ...]] = []
        self.fresh = 0

    def add(self, d: np.ndarray, ids: np.ndarray, own: np.ndarray, at: slice) -> None:
        """Rows d for the queries in a slice; own goes along with them."""
        if not len(ids):
            return
        most, low = float(np.abs(d).max(initial=0)), self.low[at]
        slack = self.scores.slack(self.q[at], most)
        if not np.isfinite(slack).all():
            raise InvalidVectorError("a vector has a coordinate that is not finite")
        wide = float(np.abs(self.q[at]).max(initial=0)) * most * d.shape[1] > 1e37  # beyond single precision
        s = self.q[at].astype(np.float64) @ d.T.astype(np.float64) if wide else self.thin[at] @ d.T.astype(np.float32, copy=False)
        if len(ids) > self.m and (new := np.isneginf(low)).any():
            low = low.copy()
            low[new] = np.partition(s[new], len(ids) - self.m, axis=1)[:, len(ids) - self.m] - slack[new]
        found = np.flatnonzero(s >= (low - slack)[:, None].astype(s.dtype))
        for start in range(0, len(found), SLICE):
            q, row = np.divmod(found[start : start + SLICE], len(ids))
            q += at.start
            self.held.append((q, ids[row], self.scores.exact(self.q[q], d[row]), own[row]))
            self.fresh += len(q)
            if self.fresh > len(self.q) * self.m:
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """(query, id, score, own) of the best so far, by query, best first."""
        if not self.held:
            return ()
        q, ids, score, own = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -score, q))
        first = np.searchsorted(q[order], np.arange(len(self.q)))
        order = order[np.arange(len(order)) - first[q[order]] < self.m]
        out = (q[order], ids[order], score[order], own[order])
        size = np.bincount(out[0], minlength=len(self.q))
        full = np.flatnonzero(size >= self.m)
        self.low[full] = out[2][np.cumsum(size)[full] - 1]
        self.held, self.fresh = [out], 0
        return out


def _common(q: pa.RecordBatch, d: pa.RecordBatch) -> Iterator[tuple[slice, slice]]:
    """Queries and rows of the same groups: all, where there are none."""
    if "group" not in q.schema.names:
        yield slice(0, q.num_rows), slice(0, d.num_rows)
        return
    a, b = (x.column("group").to_numpy() for x in (q, d))
    for g in np.intersect1d(a, b):
        (i, j), (k, m) = (np.searchsorted(x, [g, g + 1]) for x in (a, b))
        yield slice(int(i), int(j)), slice(int(k), int(m))


def _bests(it: Iterator[pa.RecordBatch], m: int, scores: _Scores, own: str | None = None) -> Iterator[tuple[pa.RecordBatch, _Best]]:
    """Each block of queries and its best rows, of all blocks that it meets; the column own goes along."""
    q = best = None
    for _, fresh, d in _met(it):
        if fresh is not None:
            if best is not None:
                yield q, best
            q = fresh
            best = [_Best(scores.query(q.slice(i, CHUNK)), m, scores) for i in range(0, q.num_rows, CHUNK)]
        rows, ids = scores.row(d), d.column("row_id").to_numpy()
        along = E.rows_of(d.column(own), len(d.column(own)[0].as_py())) if own else ids
        for queries, part in _common(q, d):
            for at in range(part.start, part.stop, CHUNK * 16):
                some = slice(at, min(part.stop, at + CHUNK * 16))
                for c in range(queries.start // CHUNK, -(-queries.stop // CHUNK)):
                    best[c].add(rows[some], ids[some], along[some], slice(max(0, queries.start - c * CHUNK), min(CHUNK, queries.stop - c * CHUNK)))
    if best is not None:
        yield q, best


def _codes_of(packed: np.ndarray, bits: int) -> np.ndarray:
    """Centred codes; they are exact in single precision."""
    return E.unpack(packed, bits).astype(np.float32) * 2 - ((1 << bits) - 1)


def scorer(bits: int, dim: int) -> _Scores:
    """Scores of float queries against packed codes."""
    return _Scores(lambda q: E.matrix(q.column("v"), dim), lambda d: _codes_of(E.rows_of(d.column("codes"), dim * bits // 8), bits))


class _Agreement(_Scores):
    """Scores by agreement of signs, twice: dim less the differing bits, and those again. Whole numbers, exact as they are."""

    def __init__(self, dim: int):
        words = lambda x: np.unpackbits(x, axis=1, bitorder="little").astype(np.float32) * 2 - 1
        super().__init__(lambda q: np.where(E.matrix(q.column("v"), dim) > 0, np.float32(1), np.float32(-1)), lambda d: words(E.rows_of(d.column("sign"), dim // 8)))

    def slack(self, q: np.ndarray, most: float) -> np.ndarray:
        return np.zeros(len(q))

    def exact(self, q: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", q, d)


def float_scorer(dim: int, cosine: bool = False) -> _Scores:
    """Dot products of float vectors; for cosine of vectors at length 1, where zeros stay as they are."""

    def v(b: pa.RecordBatch) -> np.ndarray:
        m = E.matrix(b.column("v"), dim, np.float64)
        if not cosine:
            return m
        length = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        return m / np.where(length > 0, length, 1.0)

    return _Scores(v, v)


def _queries(queries: DataFrame, dim: int, qid_col: str, vector_col: str, *more) -> DataFrame:
    good = F.when(E.is_valid(vector_col, dim), F.col(vector_col)).otherwise(F.raise_error(F.concat(F.lit("invalid vector of query "), F.coalesce(F.col(qid_col).cast("string"), F.lit("null")))))
    return queries.select(F.col(qid_col).cast("long").alias("qid"), good.cast("array<float>").alias("v"), *more)


def _scan(rows: DataFrame, queries: DataFrame, k: int, scores: _Scores) -> DataFrame:
    """Hits without final ranks: the best k rows for each query of every share of the index, within its group where there is one."""
    group = "group" if "group" in queries.columns else None
    pairs = _pairs(_blocks(rows, INDEX_BLOCK, group), _blocks(queries, QUERY_BLOCK, group))[0]

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, best in _bests(it, k, scores):
            qids = q.column("qid").to_numpy()
            for i, b in enumerate(best):
                if found := b.cut():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qids[i * CHUNK + found[0]], found[1], found[2])], ["qid", "row_id", "score"])

    return pairs.mapInArrow(f, "qid long, row_id long, score double")


def ranked(scored: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, rank, row_id, score) of rows (qid, row_id, score), cut at k."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "row_id"))
    out = scored.withColumn("rank", rank)
    return (out if k is None else out.filter(F.col("rank") <= k)).select("qid", "rank", "row_id", "score")


def empty_hits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], HITS)


def _check_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise OptionError(f"k must not be negative: {k!r}")


def search(index: Index, queries: DataFrame, k: int, options: SearchOptions = SearchOptions.exact(), checked: bool = True, qid_col: str = "qid", vector_col: str = "embedding", n: int | None = None) -> DataFrame:
    """The k best rows of index for each query.

    Auto is in two stages if the index has sign bits, and exact if not. Two stages without sign bits are an error if
    checked, else exact. k = 0 and an index without rows find nothing. n, the number of rows, is counted only where no
    candidates are asked for, which is an error unless there are no rows.
    """
    _check_k(k)
    spark = queries.sparkSession
    if index.rows is None or index.dim is None or k == 0:
        return empty_hits(spark)
    two = options.mode is not Mode.EXACT and index.has_sign
    if options.mode is Mode.TWO_STAGE and not index.has_sign and checked:
        raise MissingSignError("two-stage search needs sign bits")
    q = _queries(queries, index.dim, qid_col, vector_col)
    if not two:
        return ranked(_scan(index.rows.select("row_id", "codes"), q, k, scorer(index.bits, index.dim)), k)
    m = options.two_stage.candidates(k, 1 << 62)
    if m == 0:
        if n == 0 or index.rows.isEmpty():
            return empty_hits(spark)
        raise OptionError("two-stage search must keep candidates")
    return _two_stages(index, q, k, m)


def _two_stages(index: Index, queries: DataFrame, k: int, m: int) -> DataFrame:
    """The k best by codes of the m best by signs, for each query.

    A task keeps the m best by signs of its share of the index and scores those by codes. Where it is the whole index, they
    are cut to k in place; where not, they go on in one row a query, and a query's rows meet once.
    """
    dim, bits, agreement = index.dim, index.bits, _Agreement(index.dim)
    pairs, shares = _pairs(_blocks(index.rows.select("row_id", "codes", "sign"), INDEX_BLOCK), _blocks(queries, min(QUERY_BLOCK, STAGED_BLOCK)))

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """(qid of each query, query, id, agreement, score), by query."""
        for q, best in _bests(it, m, agreement, "codes"):
            v, qids = E.matrix(q.column("v"), dim, np.float64), q.column("qid").to_numpy()
            for i, b in enumerate(best):
                if found := b.cut():
                    at, ids, signs, codes = found
                    score = np.concatenate([np.einsum("ij,ij->i", v[i * CHUNK + at[x : x + SLICE]], _codes_of(codes[x : x + SLICE], bits).astype(np.float64)) for x in range(0, len(at), SLICE)])
                    yield qids[i * CHUNK : i * CHUNK + len(b.q)], at, ids, signs, np.round(score, DECIMALS) + 0.0

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qids, at, ids, _, score in parts(it):
            order = np.lexsort((ids, -score, at))
            order = order[np.arange(len(order)) - np.searchsorted(at, np.arange(len(qids)))[at[order]] < k]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qids[at[order]], ids[order], score[order])], ["qid", "row_id", "score"])

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qids, at, ids, signs, score in parts(it):
            each = pa.array(np.searchsorted(at, np.arange(len(qids) + 1)), pa.int32())
            lists = [ids, ((signs - dim) / 2).astype(np.int32), score]
            yield pa.RecordBatch.from_arrays([pa.array(qids), *(pa.ListArray.from_arrays(each, pa.array(x)) for x in lists)], ["qid", "ids", "signs", "scores"])

    if shares == 1:
        return ranked(pairs.mapInArrow(whole, "qid long, row_id long, score double"), k)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        before = None

        def hits() -> pa.RecordBatch:
            ids, signs, scores = (np.concatenate(x) for x in zip(*held))
            at = np.lexsort((ids, -signs))[:m]
            at = at[np.lexsort((ids[at], -scores[at]))[:k]]
            return pa.RecordBatch.from_arrays([pa.array([before] * len(at), pa.int64()), pa.array(np.arange(1, len(at) + 1), pa.int32()), pa.array(ids[at]), pa.array(scores[at])], ["qid", "rank", "row_id", "score"])

        for b in it:
            out = []
            lists = [b.column(c) for c in ("ids", "signs", "scores")]
            for i, qid in enumerate(b.column("qid").to_pylist()):
                if held and qid != before:
                    out.append(hits())
                    held.clear()
                before = qid
                held.append(tuple(x[i].values.to_numpy() for x in lists))
                if len(held) > HELD:  # what is below m already stays below
                    ids, signs, scores = (np.concatenate(x) for x in zip(*held))
                    at = np.lexsort((ids, -signs))[:m]
                    held[:] = [(ids[at], signs[at], scores[at])]
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if held:
            yield hits()

    return pairs.mapInArrow(f, "qid long, ids array<long>, signs array<int>, scores array<double>").repartition("qid").sortWithinPartitions("qid").mapInArrow(cut, HITS)


def within(index: Index, queries: DataFrame, allowed: DataFrame, k: int, qid_col: str = "qid", vector_col: str = "embedding") -> DataFrame:
    """The k best rows for each query among its own: allowed has pairs (qid, row_id); repeated ones count once.

    Always exact. A query without allowed rows has no hits; rows that the index lacks are left out.
    """
    _check_k(k)
    if index.rows is None or index.dim is None or k == 0:
        return empty_hits(queries.sparkSession)
    dim, bits = index.dim, index.bits
    q = _queries(queries, dim, qid_col, vector_col) if (qid_col, vector_col) != ("qid", "v") else queries
    pairs = allowed.select(F.col("qid").cast("long").alias("qid"), F.col("row_id").cast("long").alias("row_id")).distinct()
    joined = pairs.join(index.rows.select("row_id", "codes"), "row_id").join(q, "qid")

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                centred = 2.0 * E.unpack(E.rows_of(b.column("codes"), dim * bits // 8), bits) - ((1 << bits) - 1)
                s = np.round((E.matrix(b.column("v"), dim, np.float64) * centred).sum(1), DECIMALS) + 0.0
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("row_id"), pa.array(s)], ["qid", "row_id", "score"])

    return ranked(joined.mapInArrow(f, "qid long, row_id long, score double"), k)


def check_known(index: Index, ids: DataFrame, id_col: str = "row_id") -> None:
    """Raise for the least id that the index lacks."""
    missing = ids.select(F.col(id_col).cast("long").alias("row_id")).distinct()
    if index.rows is not None:
        missing = missing.join(index.rows.select("row_id"), "row_id", "left_anti")
    if row := missing.agg(F.min("row_id").alias("id"), F.count("*").alias("n")).filter("n > 0").first():
        raise UnknownIdError(f"the index has no row {row.id}")


def search_allowed(index: Index, queries: DataFrame, k: int, allowed: DataFrame, check: bool = True, qid_col: str = "qid", vector_col: str = "embedding") -> DataFrame:
    """The k best of the rows whose ids are in allowed (row_id), for every query alike; exact, never in two stages.

    With check an id that the index lacks is an error. No ids, no hits.
    """
    _check_k(k)
    if check:
        check_known(index, allowed)
    if index.rows is None or index.dim is None or k == 0:
        return empty_hits(queries.sparkSession)
    rows = index.rows.join(allowed.select(F.col("row_id").cast("long").alias("row_id")), "row_id", "left_semi")
    return ranked(_scan(rows.select("row_id", "codes"), _queries(queries, index.dim, qid_col, vector_col), k, scorer(index.bits, index.dim)), k)


def search_mask(index: Index, queries: DataFrame, k: int, mask: DataFrame, **columns) -> DataFrame:
    """search_allowed() by a mask (row_id, allowed): it must have each row of the index once."""
    if mask.count() != len(index) or (index.rows is not None and not index.rows.join(mask, "row_id", "left_anti").isEmpty()):
        raise ShapeError("the mask must have each row of the index once")
    return search_allowed(index, queries, k, mask.filter("allowed").select("row_id"), check=False, **columns)


def search_per_query(index: Index, queries: DataFrame, k: int, allowed: DataFrame, check: bool = True, qid_col: str = "qid", vector_col: str = "embedding") -> DataFrame:
    """The k best rows for each query within its own allowlist (qid, row_id); with check, each query must be known and so
    must each id."""
    if check:
        if not allowed.join(queries.select(F.col(qid_col).alias("qid")), "qid", "left_anti").isEmpty():
            raise OptionError("an allowlist has no query")
        check_known(index, allowed)
    return within(index, queries, allowed, k, qid_col, vector_col)


def search_in_groups(index: Index, queries: DataFrame, k: int, groups: DataFrame) -> DataFrame:
    """The k best rows for each query (qid, embedding, group) among the rows of its group: groups has them as (row_id, group).

    The same as search_per_query() by all pairs of a group, without listing them. Groups are whole numbers, null is none;
    a row may be in several, a query in one. Rows that the index lacks are left out.
    """
    _check_k(k)
    if index.rows is None or index.dim is None or k == 0:
        return empty_hits(queries.sparkSession)
    own = groups.select(F.col("row_id").cast("long").alias("row_id"), F.col("group").cast("long").alias("group")).filter("group is not null").distinct()
    q = _queries(queries.filter("group is not null"), index.dim, "qid", "embedding", F.col("group").cast("long").alias("group"))
    return ranked(_scan(index.rows.select("row_id", "codes").join(own, "row_id"), q, k, scorer(index.bits, index.dim)), k)


def float_search(vectors: DataFrame, queries: DataFrame, k: int, cosine: bool = True, id_col: str = "row_id", qid_col: str = "qid", vector_col: str = "embedding") -> DataFrame:
    """The baseline: the k best rows by the float dot product, of vectors at length 1 for cosine (0 for zeros)."""
    _check_k(k)
    dim = dim_of(vectors, vector_col)
    if dim is None or k == 0:
        return empty_hits(queries.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("row_id"), F.col(vector_col).alias("v"))
    return ranked(_scan(rows, queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(vector_col).alias("v")), k, float_scorer(dim, cosine)), k)


@dataclass
class Report:
    """How a search was planned, and how long its parts took."""

    execution: str
    dim: int | None
    queries: int
    requested_k: int
    effective_k: int
    search_space: int
    candidates: int | None
    seconds: dict[str, float]

    def as_row(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.execution, self.dim, self.queries, self.requested_k, self.effective_k, self.search_space, self.candidates)], "execution string, dim int, nq long, requested_k int, effective_k int, search_space long, candidate_count int")


def search_with_report(index: Index, queries: DataFrame, k: int, options: SearchOptions = SearchOptions(), **columns) -> tuple[DataFrame, Report]:
    """search() carried out, to a table in the shared folder, with its plan and timings."""
    start = time.perf_counter()
    n, nq = len(index), queries.count()
    two = options.mode is not Mode.EXACT and index.has_sign
    m = options.two_stage.candidates(k, n) if two else None
    counted = time.perf_counter()
    hits = written(search(index, queries, k, options, n=n, **columns))
    done = time.perf_counter()
    report = Report("sign_two_stage" if two else "exact_rank", index.dim, nq, k, min(k, n, m if two else n), n, m, {"plan": counted - start, "search": done - counted})
    return hits, report

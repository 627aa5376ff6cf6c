"""Capture index: locally sorted runs are merged by loser trees to histories in one global order."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklake.llm.common import arrow_schema, forget, need, written

#: Captures in one block of a run, and in a run.
BLOCK, RUN = 4096, 262_144
COLUMNS = ["urlkey", "captured_at", "page_id", "digest", "length"]
LEADING = COLUMNS[:3]


def url_key(url: str | Column) -> Column:
    """The key that captures are ordered by: reversed host, then path and sorted parameters, all in lower case.

    Scheme, user, fragment, standard port, a leading www and slashes at the path's end don't count. Null for null.
    """
    u = F.regexp_replace(F.lower(F.trim(F.col(url) if isinstance(url, str) else url)), "#.*$", "")
    rest = F.regexp_replace(u, "^[a-z][a-z0-9+.-]*://", "")
    place = F.regexp_extract(rest, "^([^/?]*)", 1)
    tail = F.regexp_replace(rest, "^[^/?]*", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(place, "^.*@", ""), ":(80|443)$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_replace(F.regexp_extract(tail, "^([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_replace(tail, "^[^?]*[?]?", ""), "&")), "&")
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step replays one path to the root."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come waits for its opponent
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def below(self, bound=None) -> Iterator:
        """What comes before bound, in order; all that is left if there is none."""
        while self.k and (head := self.heads[self.losers[0]]) is not None and (bound is None or head < bound):
            yield head
            winner = self.losers[0]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)

    def __iter__(self) -> Iterator:
        return self.below()

    def rest(self) -> list[Iterator]:
        """The iterators that aren't used up, each with its head."""
        return [chain([head], run) for head, run in zip(self.heads, self.runs) if head is not None]


def sort_key(row: tuple) -> tuple:
    """Nulls first, then by value, column by column."""
    return tuple((v is not None, v if v is not None else 0) for v in row)


def histories(pages: DataFrame, time: Column, ranges: int | None = None, sample_a_range: int = 20, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", run_rows: int = RUN) -> DataFrame:
    """(seq, urlkey, captured_at, page_id, digest, length, capture_no, changed) of every row of pages.

    seq counts all captures from 0 in the order of key, time and id, nulls first; digest and length, in bytes, settle what
    is left. capture_no counts those of the same key from 1; changed says that the body differs from that of the capture
    before (true for the first). A null url has a null key, and such captures are one history; a null body has a null digest
    and length, which differs from all but null. Ids are of any type that isn't nested. Repeated rows stay. Other columns are ignored.

    The merge is external. Tasks sort run_rows captures at a time to runs, cut at the splitters, and send them as blocks;
    Spark sorts a range's blocks by their first captures, to disk if need be; and the loser tree takes in a block when its first
    capture is due, so that a task holds one open block of each run. A history longer than a range goes on in the next, so none is too
    long; what crosses a border (a row a range) goes through the driver.
    """
    need(pages, id_col, url_col, body_col)
    if isinstance(pages.schema[id_col].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise ValueError("ids must not be nested")
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    captures = written(pages.select(url_key(F.col(url_col)).alias("urlkey"), F.unix_micros(time.cast("timestamp")).alias("captured_at"), F.col(id_col).alias("page_id"), F.md5(F.encode(F.col(body_col), "UTF-8")).alias("digest"), F.octet_length(F.col(body_col)).cast("long").alias("length")))
    kind = dict(captures.dtypes)["page_id"]
    types = dict(zip(COLUMNS, arrow_schema(captures.schema).types))
    n = captures.count()
    sample = captures.select(*LEADING)
    if n > ranges * sample_a_range:
        sample = sample.filter(F.pmod(F.xxhash64(*sample.columns), F.lit(n // (ranges * sample_a_range))) == 0)
    # captures that are there often come once, with their number
    drawn = sample.groupBy(*sample.columns).agg(F.count("*").alias("n")).toArrow()
    seen = sorted(zip(map(sort_key, zip(*(drawn.column(c).to_pylist() for c in LEADING))), drawn.column("n").to_pylist()))
    ends = list(accumulate(m for _, m in seen))
    splitters = sorted({seen[bisect_right(ends, ends[-1] * i // ranges)][0] for i in range(1, ranges)}) if seen else []

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        number = TaskContext.get().partitionId() << 32

        def run() -> Iterator[pa.RecordBatch]:
            rows.sort(key=sort_key)
            own = [sort_key(r[:3]) for r in rows]
            ends, at = [bisect_right(own, s) for s in splitters] + [len(rows)], 0
            for k, end in enumerate(ends):
                for start in range(at, end, BLOCK):
                    part = rows[start : min(end, start + BLOCK)]
                    block = pa.RecordBatch.from_arrays([pa.array(c, types[name]) for c, name in zip(zip(*part), COLUMNS)], COLUMNS)
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, block.schema) as writer:
                        writer.write_batch(block)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(block.column(c).slice(0, 1) for c in LEADING), pa.array([number + start], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["range", *LEADING, "nth", "block"])
                at = end

        for b in it:
            rows += zip(*(b.column(c).to_pylist() for c in COLUMNS))
            if len(rows) >= run_rows:
                yield from run()
                number += len(rows)
                rows.clear()
        yield from run()

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come by range and first capture."""
        tree, here = LoserTree([]), None
        out: list[tuple] = []
        nth, pos, before = 0, 0, None

        def take(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal nth, pos, before, out
            for row in rows:
                values = tuple(v if there else None for there, v in row)
                same = before is not None and before[0] == values[0]
                nth = nth + 1 if same else 1
                out.append((here, pos, *values, nth, not same or before[3] != values[3]))
                before, pos = values, pos + 1
                if len(out) == BLOCK:
                    yield _rows(out, types)
                    out = []

        for b in it:
            for i in range(b.num_rows):
                k = b.column("range")[i].as_py()
                if k != here:
                    yield from take(tree.below())
                    tree, here, nth, pos, before = LoserTree([]), k, 0, 0, None
                yield from take(tree.below(sort_key(tuple(b.column(c)[i].as_py() for c in LEADING))))
                block = pa.ipc.open_stream(b.column("block")[i].as_buffer()).read_all()
                tree = LoserTree([*tree.rest(), map(sort_key, zip(*(c.to_pylist() for c in block.columns)))])
        yield from take(tree.below())
        if out:
            yield _rows(out, types)

    blocks = captures.mapInArrow(runs, f"range int, urlkey string, captured_at long, page_id {kind}, nth long, block binary")
    in_order = blocks.repartitionById(len(splitters) + 1, F.col("range")).sortWithinPartitions("range", *(F.col(c).asc_nulls_first() for c in LEADING), "nth")
    merged = written(in_order.mapInArrow(merge, f"range int, pos long, urlkey string, captured_at long, page_id {kind}, digest string, length long, nth long, changed boolean"))
    forget(captures)
    first, last = F.col("pos") == 0, F.struct("pos", "urlkey", "digest", "nth")
    borders = merged.groupBy("range").agg(F.count("*").alias("n"), F.max(F.when(first, F.struct("urlkey", "digest"))).alias("first"), F.max(last).alias("last")).orderBy("range").collect()
    carried, offset, before = [], 0, None
    for r in borders:
        goes_on = before is not None and r.first.urlkey == before[0]
        nth = before[2] if goes_on else 0
        carried.append((r.range, offset, goes_on, r.first.urlkey, nth, goes_on and r.first.digest == before[1]))
        whole = goes_on and r.last.urlkey == r.first.urlkey
        before = (r.last.urlkey, r.last.digest, r.last.nth + (nth if whole else 0))
        offset += r.n
    over = spark.createDataFrame(carried, "range int, offset long, goes_on boolean, first string, carried long, same boolean")
    in_first = F.col("goes_on") & F.col("urlkey").eqNullSafe(F.col("first"))
    return merged.join(F.broadcast(over), "range").select(
        (F.col("offset") + F.col("pos")).alias("seq"),
        "urlkey",
        F.timestamp_micros("captured_at").alias("captured_at"),
        "page_id",
        "digest",
        "length",
        (F.col("nth") + F.when(in_first, F.col("carried")).otherwise(0)).alias("capture_no"),
        F.when(in_first & (F.col("pos") == 0), ~F.col("same")).otherwise(F.col("changed")).alias("changed"),
    )


def _rows(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), *types.values(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["range", "pos", *COLUMNS, "nth", "changed"])

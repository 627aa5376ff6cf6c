"""Masked pseudo-likelihood: a window network predicts every token from both sides, and the log-probabilities are summed.

Texts are tokenised once, to a table of blocks; counting, training and scoring read that.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.llm.common import need, written

#: Tokens to each side that a prediction sees.
SIDE = 2
OFFSETS = (*range(-SIDE, 0), *range(1, SIDE + 1))
#: Tokens, at most, whose share of their class goes to every task, with 12 bytes each; shares of rarer ones are joined.
NEAR = 1 << 20
#: Characters in a block, and in a piece of a longer text.
BLOCK_CHARS, PIECE_CHARS = 1_000_000, 1_000_000
#: Tokens that training shuffles together, in one step of it, and in one step of scoring.
SHUFFLED, BATCH, STEP = 500_000, 4096, 8192
#: Texts, blocks, and rows of counts that a task has at a time; MB of blocks or pieces in a row group.
TEXTS, BLOCKS, ROW_GROUP_MB = 500, 4, 16
COUNTED = 400_000
TOKEN = re.compile(r"\w+|[^\w\s]")
NOT_WORD = re.compile(r"\W")


# Tokens


def cut(text: str, size: int = PIECE_CHARS) -> Iterator[list[str]]:
    """The tokens of a text, in lower case, of about size characters at a time; no token is cut."""
    text, at = text.lower(), 0
    while at < len(text):
        found = NOT_WORD.search(text, at + size)
        end = found.start() if found else len(text)
        yield TOKEN.findall(text, at, end)
        at = end


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Blocks of the texts of docs, not yet written: (rows, doc_ids, keys, sizes, lefts, rights, ids, tokens, counts).

    ids are the tokens' places in the block's own list tokens, of 16 bits each if that does, of 32 if not; counts is how often each is there. A text
    longer than piece_chars is in several pieces; lefts and rights say how many tokens of the neighbours stand around a piece, so that
    each token is with what it is predicted from. sizes don't count these; -1 is a null text. rows numbers the rows of
    docs, keys is the hash of id and text.
    """
    need(docs, id_col, text_col)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col).cast("string"), text).alias("key"), text.alias("text"))

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        block = _Block()
        for b in it:
            doc_ids, keys = b.column("doc_id"), _told_apart(b.column("key").to_numpy(zero_copy_only=False))
            for i, text in enumerate(x for at in range(0, b.num_rows, TEXTS) for x in b.column("text").slice(at, TEXTS).to_pylist()):
                if block.chars and block.chars + len(text or "") > BLOCK_CHARS:
                    yield block.batch()
                    block = _Block()
                own = row, doc_ids.slice(i, 1), keys[i]
                row += 1
                if not text:
                    block.add(*own, -1 if text is None else 0, 0, 0, [])
                    continue
                before, now = [], []
                for tokens in cut(text, piece_chars):
                    if len(now) >= SIDE and len(tokens) >= SIDE:
                        block.add(*own, len(now), len(before), SIDE, before + now + tokens[:SIDE])
                        yield block.batch()
                        block = _Block()
                        before, now = now[-SIDE:], tokens
                    else:
                        now = now + tokens
                block.add(*own, len(now), len(before), 0, before + now)
                block.chars += min(len(text), piece_chars)
        if block.rows:
            yield block.batch()

    return rows.mapInArrow(f, f"rows array<long>, doc_ids array<{dict(rows.dtypes)['doc_id']}>, keys array<long>, sizes array<int>, lefts array<int>, rights array<int>, ids binary, tokens array<string>, counts array<long>")


def _told_apart(keys: np.ndarray) -> np.ndarray:
    """The keys, of which a repeated one differs from the one before, so that copies of a row are spread."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    nth = np.arange(len(keys)) - np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    out = keys.copy()
    out[order] += nth * 0x1E3779B97F4A7C15
    return out


class _Block:
    def __init__(self):
        self.rows: list[int] = []
        self.doc_ids, self.keys, self.sizes, self.lefts, self.rights, self.ids = [], [], [], [], [], []
        self.places: defaultdict[str, int] = defaultdict(count().__next__)
        self.chars = 0

    def add(self, row: int, doc_id: pa.Array, key: int, size: int, left: int, right: int, tokens: list[str]) -> None:
        for held, x in zip((self.rows, self.doc_ids, self.keys, self.sizes, self.lefts, self.rights), (row, doc_id, key, size, left, right)):
            held.append(x)
        self.ids.append(np.fromiter(map(self.places.__getitem__, tokens), np.int32, len(tokens)))

    def batch(self) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        left, right = np.array(self.lefts), np.array(self.rights)
        lengths = np.maximum(self.sizes, 0) + left + right
        counts = np.bincount(ids, minlength=len(self.places))
        for own, ends in ((left, np.cumsum(lengths) - lengths + left), (right, np.cumsum(lengths))):  # neighbours count in their own piece
            for k in np.flatnonzero(own):
                np.subtract.at(counts, ids[ends[k] - own[k] : ends[k]], 1)
        one = lambda x, t: pa.array([x], pa.list_(t))
        doc_ids = pa.concat_arrays(self.doc_ids)
        columns = [one(self.rows, pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), one(self.keys, pa.int64()), *(one(x, pa.int32()) for x in (self.sizes, self.lefts, self.rights)), pa.array([(ids.astype(np.uint16) if len(self.places) <= 1 << 16 else ids).tobytes()], pa.binary()), one(list(self.places), pa.string()), one(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["rows", "doc_ids", "keys", "sizes", "lefts", "rights", "ids", "tokens", "counts"])


def count_tokens(blocks: DataFrame) -> DataFrame:
    """(token, n) over all texts."""

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> list[pa.RecordBatch]:
            sums = pa.concat_tables(held).group_by("token").aggregate([("n", "sum")]).select(["token", "n_sum"]).rename_columns(["token", "n"])
            held.clear()
            pa.default_memory_pool().release_unused()
            return sums.combine_chunks().to_batches()

        for b in it:
            held.append(pa.table([b.column("tokens").flatten(), b.column("counts").flatten()], ["token", "n"]))
            rows += held[-1].num_rows
            if rows > COUNTED:
                yield from flush()
                rows = 0
        if held:
            yield from flush()

    return blocks.select("tokens", "counts").mapInArrow(f, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 0")


# Classes


def sizes(distinct: int) -> tuple[int, int]:
    """Words and buckets for so many different tokens; both grow with them, by their cube root."""
    words = ceil(8 * distinct ** (1 / 3))
    return words, words // 4 + 1


class Vocabulary:
    """Classes of tokens: the most frequent ones have their own, the others share buckets by their hash.

    Classes are numbered by falling frequency and cut to groups, of which each holds about the same sum of the roots of
    frequencies: p(class) is p(group) p(class | group).
    """

    def __init__(self, words: list[str], bucket_totals: list[float], word_counts: list[int]):
        self.words, self.buckets = words, len(bucket_totals)
        totals = np.array([*word_counts, *bucket_totals], np.float64)
        order = np.argsort(-totals, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.at = dict(zip(words, number.tolist()))
        self.bucket_at = number[len(words) :].tolist()
        self.totals = totals[order]
        mass = np.sqrt(self.totals)
        groups = ceil(len(order) ** 0.5 / 2)
        _, self.group = np.unique(((np.cumsum(mass) - mass / 2) * groups / mass.sum()).astype(np.int64), return_inverse=True)
        self.starts = np.searchsorted(self.group, np.arange(self.group[-1] + 2)).tolist()

    @property
    def size(self) -> int:
        return len(self.totals)

    def classes(self, tokens: list[str]) -> np.ndarray:
        at, buckets = self.at, self.bucket_at
        return np.fromiter((k if (k := at.get(w)) is not None else buckets[zlib.crc32(w.encode()) % len(buckets)] for w in tokens), np.int32, len(tokens))


def vocabulary(counts: DataFrame, words: int | None = None, buckets: int | None = None) -> Vocabulary:
    """From the counts of all tokens; where words or buckets are None, they follow the number of different tokens."""
    usual = sizes(counts.count())
    words, buckets = usual[0] if words is None else words, usual[1] if buckets is None else buckets
    top = counts.orderBy(F.desc("n"), "token").limit(words).collect()
    totals = [0.5] * buckets
    for r in _rest(counts, [r.token for r in top], buckets).groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        totals[r.bucket] = r.n + (r.kinds + 1) / 2
    return Vocabulary([r.token for r in top], totals, [r.n for r in top])


def _words(counts: DataFrame, words: list[str]) -> DataFrame:
    return counts.sparkSession.createDataFrame([(w,) for w in words], "token string")


def _rest(counts: DataFrame, words: list[str], buckets: int) -> DataFrame:
    """(token, n, bucket) of the tokens without a class of their own."""
    return counts.join(F.broadcast(_words(counts, words)), "token", "left_anti").withColumn("bucket", _bucket("token", buckets))


def _bucket(col: str, buckets: int) -> F.Column:
    return (F.crc32(F.encode(col, "utf-8")) % buckets).cast("int")


def shares(counts: DataFrame, v: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """(token, share) of the tokens of counts, the log-probability of each within its class; (bucket, unseen), that of any other.

    A token counts as often as it came up, one that never did for half a time, and a bucket is taken to have one more of
    these than of the others. A word has its class to itself.
    """
    totals = counts.sparkSession.createDataFrame([(i, float(v.totals[k])) for i, k in enumerate(v.bucket_at)], "bucket int, total double")
    rest = _rest(counts, v.words, v.buckets).join(F.broadcast(totals), "bucket").select("token", F.log(F.col("n") / F.col("total")).alias("share"))
    return _words(counts, v.words).withColumn("share", F.lit(0.0)).unionByName(rest), totals.select("bucket", F.log(0.5 / F.col("total")).alias("unseen"))


# The network


class Network:
    """p(class | SIDE tokens before and after): position-wise embeddings are summed, squashed and mapped to groups, and to
    the classes of a group. At the start it gives every class its frequency, whatever the context."""

    def __init__(self, v: Vocabulary, hidden: int = 16, seed: int = 1):
        r = np.random.default_rng(seed)
        self.vocabulary, self.width = v, v.size + 1  # the last embedding stands for no token
        share = v.totals / v.totals.sum()
        of_group = np.bincount(v.group, share)
        groups, classes = np.zeros((hidden + 1, len(of_group)), np.float32), np.zeros((v.size, hidden + 1), np.float32)
        groups[-1], classes[:, -1] = np.log(of_group), np.log(share / of_group[v.group])
        # embeddings of all positions, hidden biases, groups' weights with biases last, classes' weights with biases last
        self.params = [(r.normal(size=(len(OFFSETS) * self.width, hidden)) * 0.3).astype(np.float32), np.zeros(hidden, np.float32), groups, classes]
        #: Sums of squared gradients: an embedding has one, of the mean square, other weights one each.
        self.squares = [np.full(len(p) if i == 0 else p.shape, 1e-6, np.float32) for i, p in enumerate(self.params)]

    def copy(self) -> Network:
        return pickle.loads(pickle.dumps(self))

    @staticmethod
    def pad(v: Vocabulary, classes: np.ndarray, sizes: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces one after another, each with SIDE places to both sides, filled up by no token; and where each begins."""
        sizes = np.maximum(sizes, 0)
        lengths = sizes + lefts + rights
        begins = np.cumsum(sizes + 2 * SIDE) - sizes - 2 * SIDE
        out = np.full(int((sizes + 2 * SIDE).sum()), v.size, np.int32)
        out[np.repeat(begins + SIDE - lefts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(classes))] = classes
        return out, begins

    @staticmethod
    def targets(sizes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where the tokens to be predicted are in what pad() gives."""
        sizes = np.maximum(sizes, 0)
        return np.arange(int(sizes.sum())) + np.repeat(begins + SIDE - (np.cumsum(sizes) - sizes), sizes)

    def _hidden(self, padded: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Embeddings' rows that are summed; the hidden values go to out."""
        rows = np.stack([padded[at + o] + k * self.width for k, o in enumerate(OFFSETS)], 1)
        e, bias = self.params[:2]
        sums = e.take(rows[:, 0], 0)
        sums += bias
        for k in range(1, len(OFFSETS)):
            sums += e.take(rows[:, k], 0)
        np.tanh(sums, out=out[:, :-1])
        return rows

    def _safe(self) -> bool:
        """Whether no exponential overflows, as no hidden value is above 1."""
        groups, classes = self.params[2:]
        return max(float(np.abs(groups).sum(0).max()), float(np.abs(classes).sum(1).max())) < 60

    def log_probs(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each of the tokens at those places."""
        v, (groups, classes) = self.vocabulary, self.params[2:]
        safe, edges, group = self._safe(), np.arange(len(v.starts)), v.group.astype(np.int16)
        out, h = np.empty(len(at), np.float64), np.ones((STEP, groups.shape[0]), groups.dtype)

        def normalised(z: np.ndarray, own: np.ndarray) -> np.ndarray:
            if not safe:
                z -= z.max(1, keepdims=True)
            mine = z[np.arange(len(z)), own]
            return mine - np.log(np.exp(z, out=z).sum(1))

        for i in range(0, len(at), STEP):
            part = at[i : i + STEP]
            g = group[padded[part]]
            order = np.argsort(g, kind="stable")
            part, g = part[order], g[order]
            own, hidden = padded[part], h[: len(part)]
            self._hidden(padded, part, hidden)
            logs = normalised(hidden @ groups, g).astype(np.float64)
            bounds = np.searchsorted(g, edges)
            for a, z, low, high in zip(bounds, bounds[1:], v.starts, v.starts[1:]):
                if a < z and high - low > 1:
                    logs[a:z] += normalised(hidden[a:z] @ classes[low:high].T, own[a:z] - low)
            out[i : i + STEP][order] = logs
        return out

    def step(self, padded: np.ndarray, at: np.ndarray, rate: float = 0.2) -> None:
        """One step of Adagrad by the mean negative log-probability of the tokens at those places."""
        hit, sums, rest = self.gradients(padded, at)
        e, s = self.params[0], self.squares[0]
        own = s[hit] + np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
        s[hit] = own
        sums *= (rate / np.sqrt(own))[:, None]
        e[hit] -= sums
        for p, s, g in zip(self.params[1:], self.squares[1:], rest):
            square = g * g
            s += square
            g /= np.sqrt(s, out=square)
            g *= rate
            p -= g

    def gradients(self, padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Those of the embeddings that aren't 0, by row, and of the other parameters."""
        v, (groups, classes) = self.vocabulary, self.params[2:]
        safe, n = self._safe(), len(at)
        g = v.group.astype(np.int16)[padded[at]]
        order = np.argsort(g, kind="stable")
        at, g = at[order], g[order]
        own, h = padded[at], np.ones((n, groups.shape[0]), groups.dtype)
        rows = self._hidden(padded, at, h)

        def errors(z: np.ndarray, right: np.ndarray) -> np.ndarray:
            if not safe:
                z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            z *= (1 / (z.sum(1) * n))[:, None]
            z[np.arange(len(z)), right] -= z.dtype.type(1 / n)
            return z

        z = errors(h @ groups, g)
        dh, dgroups, dclasses = z @ groups[:-1].T, h.T @ z, np.zeros_like(classes)
        bounds = np.searchsorted(g, np.arange(len(v.starts)))
        for a, b, low, high in zip(bounds, bounds[1:], v.starts, v.starts[1:]):
            if a < b and high - low > 1:
                z = errors(h[a:b] @ classes[low:high].T, own[a:b] - low)
                dh[a:b] += z @ classes[low:high, :-1]
                np.matmul(z.T, h[a:b], out=dclasses[low:high])
        hidden = h[:, :-1]
        dh *= 1 - hidden * hidden
        hit, sums = _summed(rows, dh)
        return hit, sums, [dh.sum(0), dgroups, dclasses]

    def fit(self, padded: np.ndarray, at: np.ndarray, seed: int) -> None:
        """One pass over the tokens at those places, in random order."""
        at = at[np.random.default_rng(seed).permutation(len(at))]
        for i in range(0, len(at), BATCH):
            self.step(padded, at[i : i + BATCH])

    def score(self, texts: list[str]) -> np.ndarray:
        """Summed log-probabilities of the classes of each text's tokens."""
        found = [[w for part in cut(t) for w in part] for t in texts]
        n = np.array([len(x) for x in found])
        none = np.zeros(len(n), np.int64)
        padded, begins = self.pad(self.vocabulary, self.vocabulary.classes([w for x in found for w in x]), n, none, none)
        return np.bincount(np.repeat(np.arange(len(n)), n), self.log_probs(padded, self.targets(n, begins)), len(n))


def _summed(rows: np.ndarray, values: np.ndarray, ladder: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in rows and, for each, the sum of the values whose rows have it, once for each time."""
    flat = rows.ravel()
    order = np.argsort(flat.astype(np.int16) if flat.max() < 1 << 15 else flat, kind="stable")
    flat, v = flat[order], values.take(order // rows.shape[1], 0)
    starts = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1])
    often = np.diff(np.append(starts, len(flat)))
    sums, live, k = v.take(starts, 0), np.flatnonzero(often > 1), 1
    while len(live) and k < ladder:  # the k-th of all that have one
        sums[live] += v.take(starts[live] + k, 0)
        k += 1
        live = live[often[live] > k]
    for i in live.tolist():
        sums[i] += v[starts[i] + k : starts[i] + often[i]].sum(0)
    return flat[starts], sums


# Over tables


def deal(blocks: DataFrame, counts: DataFrame, v: Vocabulary, near: int = NEAR) -> DataFrame:
    """A written table of the pieces of texts, for train() and score(): (row, doc, key, nth, n, share, rest, piece).

    piece has the tokens' classes, with SIDE places to both sides; share sums the log-shares of tokens of their classes, without
    those of rest, whose are still to be added. The shares of the most frequent tokens, up to near of them, are sent to all
    tasks by their hashes.
    """
    cut_at = _least(counts, near)
    table = shares(counts.filter(F.col("n") >= cut_at), v)[0].select(F.xxhash64("token").alias("h"), F.col("share").cast("float").alias("s")).toArrow()
    hashes, values = (table.column(c).to_numpy() for c in ("h", "s"))
    order = np.argsort(hashes)
    shared = blocks.sparkSession.sparkContext.broadcast((v, hashes[order], values[order]))
    kind = np.uint16 if v.size < 1 << 16 else np.int32

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, hashes, values = shared.value
        for b in it:
            for i in range(b.num_rows):
                rows, keys = (b.column(c)[i].values for c in ("rows", "keys"))
                n, left, right = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("sizes", "lefts", "rights"))
                names = b.column("tokens")[i].values
                tokens, targets = names.to_pylist(), np.maximum(n, 0)
                lengths = targets + left + right
                data = b.column("ids")[i].as_buffer()
                ids = np.frombuffer(data, np.uint16 if data.size == 2 * int(lengths.sum()) else np.int32)
                padded, begins = Network.pad(v, v.classes(tokens)[ids], n, left, right)
                # shares of tokens, where they are known
                own = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in tokens), np.uint64, len(tokens)).view(np.int64)
                at = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
                there = hashes[at] == own if len(hashes) else np.zeros(len(own), bool)
                share = np.where(there, values[at], 0) if len(hashes) else np.zeros(len(own))
                if left.any() or right.any():
                    ids = ids[np.arange(int(targets.sum())) + np.repeat(np.cumsum(lengths) - lengths + left - (np.cumsum(targets) - targets), targets)]
                piece = np.repeat(np.arange(len(n)), targets)
                far = np.flatnonzero(~there[ids]) if len(ids) else np.zeros(0, np.int64)
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(piece[far], np.arange(len(n) + 1)), pa.int32()), names.take(pa.array(ids[far].astype(np.int64))))
                classes = padded.astype(kind)
                offsets = np.append(begins, len(padded)).astype(np.int32) * classes.itemsize
                pieces = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(classes.tobytes())])
                docs = pa.StructArray.from_arrays([b.column("doc_ids")[i].values], ["doc_id"])
                columns = [rows, docs, keys, pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n, pa.int32(), mask=n < 0), pa.array(np.bincount(piece, share[ids], len(n)), pa.float64()), rest, pieces]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc", "key", "nth", "n", "share", "rest", "piece"])

    id_kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return written(blocks.drop("counts").mapInArrow(f, f"row long, doc struct<doc_id:{id_kind}>, key long, nth int, n int, share double, rest array<string>, piece binary"), ROW_GROUP_MB, BLOCKS)


def _least(counts: DataFrame, near: int) -> int:
    """The least n that no more than near tokens have or pass."""
    total, least = 0, 1 << 62
    for r in counts.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).toLocalIterator():
        total += r.tokens
        if total > near:
            break
        least = r.n
    return least


def _classes(v: Vocabulary, pieces: pa.Array) -> list[np.ndarray]:
    kind = np.uint16 if v.size < 1 << 16 else np.int32
    return [np.frombuffer(x.as_buffer(), kind) for x in pieces]


def train(pieces: DataFrame, counts: DataFrame, v: Vocabulary, hidden: int = 16, rounds: int = 2, lane_tokens: int = 4_000_000) -> Network:
    """A network for the texts of pieces, of deal(); counts are those of count_tokens().

    Pieces of text are dealt to lanes and rounds by their keys, about lane_tokens to each lane; every token is
    predicted in one round. In a round every lane goes on from the same weights, its pieces in the order of their keys; then
    weights are averaged over lanes, each as much as the lane has squared gradients for it, and squares by tokens. So neither
    partitions nor executors change the result; only rows that are equal in id and text (rows without id: in text) are
    dealt by their order in a partition. A task takes several lanes where there are many, and adds them up, so that what is sent
    grows with the root of the lanes.
    """
    network = Network(v, hidden)
    sc = pieces.sparkSession.sparkContext
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    lanes = max(1, -(-total // lane_tokens))
    tasks = min(lanes, 8 * ceil(lanes**0.5))
    width = ceil(tasks**0.5)

    def local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        sums, tokens, net, lane, seen = None, 0, None, None, 0
        held: list[np.ndarray] = []
        size = 0

        def learn() -> None:
            nonlocal size, seen
            n = np.array([len(x) - 2 * SIDE for x in held])
            padded = np.concatenate(held).astype(np.int32)
            net.fit(padded, net.targets(n, np.cumsum(n + 2 * SIDE) - n - 2 * SIDE), lane + seen)
            seen += int(n.sum())
            held.clear()
            size = 0

        def close() -> None:
            nonlocal sums, tokens
            if held:
                learn()
            if net is not None:
                sums = _added(sums, [w for p, s in zip(net.params, net.squares) for w in _weighed(p, s)] + [s.astype(np.float64) * seen for s in net.squares])
                tokens += seen

        for b in it:
            for k, piece in zip(b.column("lane").to_pylist(), _classes(start.vocabulary, b.column("piece"))):
                if k != lane:
                    close()
                    net, lane, seen = start.copy(), k, 0
                held.append(piece)
                size += len(piece)
                if size > SHUFFLED:
                    learn()
        close()
        if tokens:
            yield _sent(TaskContext.get().partitionId(), tokens, sums)

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, tokens = None, 0
        for b in it:
            for n, w in zip(b.column("n").to_pylist(), b.column("weights")):
                sums, tokens = _added(sums, pickle.loads(w.as_py())), tokens + n
        if tokens:
            yield _sent(0, tokens, sums)

    dealt = pieces.filter("n > 0").select(F.pmod("key", F.lit(rounds)).alias("round"), F.pmod(F.xxhash64("key"), F.lit(lanes)).alias("lane"), "key", "nth", "piece")
    for k in range(rounds):
        shared = sc.broadcast(network)
        own = dealt.filter(F.col("round") == k).repartitionById(tasks, (F.col("lane") % tasks).cast("int")).sortWithinPartitions("lane", "key", "nth", "piece")
        parts = own.select("lane", "piece").mapInArrow(local, "task int, n long, weights binary")
        sums, tokens = None, 0
        for r in parts.repartitionById(width, F.col("task") % width).sortWithinPartitions("task").mapInArrow(add, "task int, n long, weights binary").toLocalIterator():
            sums, tokens = _added(sums, pickle.loads(bytes(r.weights))), tokens + r.n
        if tokens:
            m = len(network.params)
            network.params = [(sums[2 * i] / sums[2 * i + 1]).astype(np.float32) for i in range(m)]
            network.squares = [(s / tokens).astype(np.float32) for s in sums[2 * m :]]
    return network


def _weighed(p: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = s.astype(np.float64).reshape(s.shape + (1,) * (p.ndim - s.ndim))
    return p * s, s


def _added(sums: list[np.ndarray] | None, more: list[np.ndarray]) -> list[np.ndarray]:
    return more if sums is None else [x + y for x, y in zip(sums, more)]


def _sent(task: int, n: int, sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([n], pa.int64()), pa.array([pickle.dumps(sums)], pa.binary())], ["task", "n", "weights"])


def score(pieces: DataFrame, network: Network, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_prob, log_prob_per_token) of each row that pieces were made of, by deal() with the same counts.

    Tokens are words and marks in lower case. Every token of the whole text counts, at the text's ends with fewer neighbours:
    log_prob sums log p(class | context) + log p(token | class), the second by shares() of counts. A text without tokens has
    a log_prob of 0 and none a token; a null text has nulls. Rows are never merged; other columns don't matter.
    """
    v = network.vocabulary
    every, unseen = shares(counts, v)
    shared = pieces.sparkSession.sparkContext.broadcast(network)

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in it:
            held = _classes(net.vocabulary, b.column("piece"))
            sums = b.column("share").to_numpy().copy()
            first = 0
            while first < len(held):  # some pieces at a time
                last, size = first, 0
                while last < len(held) and (last == first or size + len(held[last]) <= SHUFFLED):
                    size += len(held[last])
                    last += 1
                n = np.array([len(x) - 2 * SIDE for x in held[first:last]])
                at = net.targets(n, np.cumsum(n + 2 * SIDE) - n - 2 * SIDE)
                sums[first:last] += np.bincount(np.repeat(np.arange(len(n)), n), net.log_probs(np.concatenate(held[first:last]).astype(np.int32), at), len(n))
                first = last
            n = b.column("n")
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc"), n, pa.array(sums, mask=n.is_null().to_numpy(zero_copy_only=False))], ["row", "doc", "n", "log_prob"])

    kind = pieces.schema["doc"].dataType.simpleString()
    own = pieces.select("row", "doc", "n", "share", "piece").mapInArrow(f, f"row long, doc {kind}, n int, log_prob double")
    far = pieces.select("row", F.explode("rest").alias("token")).join(every, "token", "left").withColumn("bucket", _bucket("token", v.buckets)).join(F.broadcast(unseen), "bucket")
    added = far.select("row", F.lit(None).cast(kind).alias("doc"), F.lit(None).cast("int").alias("n"), F.coalesce("share", "unseen").alias("log_prob"))
    whole = own.unionByName(added).groupBy("row").agg(F.first("doc", ignorenulls=True).alias("doc"), F.sum("n").cast("int").alias("n_tokens"), F.sum("log_prob").alias("log_prob"))
    return whole.select("doc.doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("log_prob_per_token"))

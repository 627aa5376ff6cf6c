"""Quality rules: a linear-chain conditional random field marks each line content or boilerplate, and the share decides.

Labels are of documents; line_labels() makes those of lines, so that steps between content and boilerplate are learnt.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklake.llm.common import batches, need

BOILERPLATE, CONTENT = 0, 1
#: Log-odds from which a line of a bad text counts as content in training.
SURE = 2.0
LETTER, UPPER, DIGIT, SPACE, STOP, MARK, BAR = range(7)
FEATURES = ["bias", "length", "short", "marks", "upper", "digits", "bars", "stops", "end", "word_length", "double_marks", "repeated", "one_word", "lower_start", "echo", "first", "alone"]


def _kinds() -> np.ndarray:
    out = np.full(65_536, MARK, np.uint8)
    for i in range(65_536):
        c = chr(i)
        if 0xD800 <= i < 0xE000:
            continue
        if c.isspace():
            out[i] = SPACE
        elif c.isdigit():
            out[i] = DIGIT
        elif c.isupper():
            out[i] = UPPER
        elif c.isalpha() or c.isalnum():
            out[i] = LETTER
        elif c in ".,;:'\"?-()«»’“”¿¡…–—":
            out[i] = STOP
        elif c == "|":
            out[i] = BAR
    return out


KIND = _kinds()


def lines_of(text: str) -> list[str]:
    """The lines of a text that aren't blank."""
    return [x for x in text.split("\n") if x and not x.isspace()]


def _echo(lines: list[str]) -> np.ndarray:
    """The share of each line's words that are the word before them."""
    words = [x.split() for x in lines]
    return np.fromiter((sum(map(eq, w, w[1:])) / len(w) for w in words), np.float64, len(lines))


def features(lines: list[str], repeated: np.ndarray, first: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """A row for each line; repeated: how often its text has the line besides; whether it is the first of several, or the only one."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.minimum(np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32), 65_535)
    kind = KIND[codes]
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    count = lambda mask: np.add.reduceat(mask.astype(np.int32), starts)
    letter, upper, digit, space, stop, mark, bar = (count(kind == k) for k in range(7))
    ends = starts + n - 1
    begins = kind != SPACE
    begins[1:] &= (kind[:-1] == SPACE) | False
    begins[starts] = kind[starts] != SPACE
    words = np.maximum(1, count(begins))
    double = np.zeros(len(kind), bool)
    double[1:] = (kind[1:] == MARK) & (codes[1:] == codes[:-1])
    double[starts] = False
    x = np.empty((len(lines), len(FEATURES)), np.float64)
    letters = np.maximum(1, letter + upper)
    for k, v in enumerate((1, np.log1p(n) / 6, n < 40, np.minimum(1, 4 * mark / n), upper / letters, digit / n, np.minimum(1, 8 * bar / n), np.minimum(1, 8 * stop / n), (kind[ends] == STOP), np.minimum(2, (n - space) / words / 8), np.minimum(1, 4 * count(double) / words), np.minimum(3, repeated), words == 1, kind[starts] == LETTER, np.minimum(1, 2 * _echo(lines)), first, alone)):
        x[:, k] = v
    return x


def describe(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, how many each text has, and their lengths."""
    lines, counts, again, first, alone = [], [], [], [], []
    for t in texts:
        own = lines_of(t)
        often = Counter(own)
        lines += own
        again += [often[x] - 1 for x in own]
        first += [len(own) > 1 and i == 0 for i in range(len(own))]
        alone += [len(own) == 1] * len(own)
        counts.append(len(own))
    x = features(lines, np.array(again), np.array(first), np.array(alone)) if lines else np.zeros((0, len(FEATURES)))
    return x, np.array(counts, np.int64), np.fromiter(map(len, lines), np.int64, len(lines))


class Crf:
    """Weights of two labels and of the steps between them."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.weights = np.zeros((len(FEATURES), 2)) if weights is None else weights
        self.steps = np.zeros((2, 2)) if steps is None else steps

    def objective(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood of the labels y, and its gradients, by forward and backward sums."""
        emit, n = x @ self.weights, len(x)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        order = np.argsort(-counts, kind="stable")
        active = [order[: np.searchsorted(-counts[order], -i)] for i in range(counts.max())]
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        log = lambda z: np.logaddexp(z[..., 0], z[..., 1])
        for i, docs in enumerate(active):
            at = starts[docs] + i
            ahead[at] = emit[at] + (0 if i == 0 else log((ahead[at - 1][:, None, :] + self.steps.T[None])))
        for i in range(len(active) - 2, -1, -1):
            at = starts[active[i + 1]] + i
            behind[at] = log(self.steps[None] + (emit[at + 1] + behind[at + 1])[:, None, :])
        total = np.zeros(len(counts))
        there = counts > 0
        total[there] = log(ahead[starts[there] + counts[there] - 1])
        whole = np.repeat(total, counts)
        p = np.exp(ahead + behind - whole[:, None])
        inner = np.ones(n, bool)
        inner[starts[there]] = False
        at = np.flatnonzero(inner)
        pair = np.exp(ahead[at - 1][:, :, None] + self.steps[None] + (emit[at] + behind[at])[:, None, :] - whole[at][:, None, None])
        gold = np.eye(2)[y]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1], y[at]), 1)
        loss = total.sum() - (emit * gold).sum() - (self.steps * seen).sum()
        return loss / n + decay * ((self.weights**2).sum() + (self.steps**2).sum()), x.T @ (p - gold) / n + 2 * decay * self.weights, (pair.sum(0) - seen) / n + 2 * decay * self.steps

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, decay: float = 1e-4) -> Crf:
        """Adam over all lines at once; the same input gives the same weights."""
        params, first, second = [self.weights, self.steps], [0, 0], [0, 0]
        for t in range(1, rounds + 1):
            for i, g in enumerate(self.objective(x, counts, y, decay)[1:]):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                params[i] -= rate * first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-9)
        return self

    def viterbi(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The likeliest labels of the lines of each text; all texts go one line ahead at a time. A tie is content."""
        emit = x @ self.weights
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
        order = np.argsort(-counts, kind="stable")
        best, back = emit.copy(), np.zeros((len(x), 2), np.int8)
        out = np.zeros(len(x), np.int8)
        sizes = -counts[order]
        top = int(counts.max()) if len(counts) else 0
        for i in range(1, top):
            at = starts[order[: np.searchsorted(sizes, -i)]] + i
            to = best[at - 1][:, :, None] + self.steps[None]
            content = to[:, 1] >= to[:, 0]
            back[at] = content
            best[at] = emit[at] + np.where(content, to[:, 1], to[:, 0])
        there = np.flatnonzero(counts)
        last = starts[there] + counts[there] - 1
        out[last] = best[last, 1] >= best[last, 0]
        for i in range(top - 1, 0, -1):
            at = starts[order[: np.searchsorted(sizes, -i)]] + i
            out[at - 1] = back[at, out[at]]
        return out


def content_shares(crf: Crf | None, texts: list[str | None]) -> list[float | None]:
    """The share of each text's characters that lie in content lines; blank lines don't count. 0 if it has no others."""
    out: list[float | None] = [None] * len(texts)
    there = [i for i, t in enumerate(texts) if t is not None]
    own = [texts[i] for i in there]
    for a, z in batches(own):
        x, counts, sizes = describe(own[a:z])
        labels = crf.viterbi(x, counts) if crf else np.ones(len(x), np.int8)
        text = np.repeat(np.arange(len(counts)), counts)
        good, total = np.bincount(text, sizes * labels, len(counts)), np.bincount(text, sizes, len(counts))
        for i, g, t in zip(there[a:z], good, total):
            out[i] = float(g / t) if t else 0.0
    return out


def train(docs: DataFrame, labels: DataFrame, most_docs: int = 1500, most_chars: int = 30_000, id_col: str = "doc_id", text_col: str = "text") -> Crf | None:
    """A random field from a bounded sample of labelled rows: of each quality most_docs documents of at most most_chars.

    Lines get labels of their own, by line_labels(). The sample is that of the least hashed ids, whatever the
    partitions. None, and then nothing but blank texts is rejected, unless both kinds of line are there.
    """
    need(docs, id_col, text_col)
    need(labels, id_col, "quality")
    marks = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality")).filter("id is not null and quality in (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text").between(1, most_chars))
    order = Window.partitionBy("quality").orderBy(F.xxhash64("id"), "id")
    # ids first, at twice the bound: some of them may have no text here
    ids = marks.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 2 * most_docs).drop("r")
    picked = rows.join(F.broadcast(ids), "id").dropDuplicates(["id"]).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most_docs).orderBy("quality", "r").collect()
    return learn([r.text for r in picked], [r.quality for r in picked])


def learn(texts: list[str], good: list[int]) -> Crf | None:
    """A random field from texts and whether each is good, 1 or 0."""
    x, counts, _ = describe(texts)
    y = line_labels(texts, np.array(good, np.int64), x, counts)
    return None if len(np.unique(y)) < 2 else Crf().fit(x, counts, y)


def line_labels(texts: list[str], good: np.ndarray, x: np.ndarray, counts: np.ndarray, often: int = 5, least: int = 24) -> np.ndarray:
    """Labels of all lines, from those of their texts.

    Lines of good texts are content: what many of them share may well be a passage worth keeping. Those of bad texts are
    boilerplate if often different bad texts have them, and they have least characters or more, as shorter ones come up by
    chance; of the others, those are content that a model of single lines, fitted to the labels of their texts, is sure of.
    What is bad about such a text is in its other lines, so that its likeliest boilerplate stays so in any case.
    """
    lines = [x for t in texts for x in lines_of(t)]
    spread = Counter(x for t in dict.fromkeys(t for t, g in zip(texts, good) if not g) for x in set(lines_of(t)))
    text = np.repeat(np.arange(len(counts)), counts)
    y = good[text]
    if len(np.unique(y)) < 2:
        return y
    single = Crf().fit(x, np.ones(len(x), np.int64), y)  # texts of a line each: no steps
    margin = (x @ single.weights) @ np.array([-1.0, 1.0])
    shared = np.fromiter((len(x) >= least and spread[x] >= often for x in lines), bool, len(lines))
    y[(good[text] == 0) & ~shared & (margin > SURE)] = CONTENT
    for i in np.flatnonzero((good == 0) & (counts > 0)):
        at = np.flatnonzero(text == i)
        if y[at].all():
            y[at[margin[at].argmin()]] = BOILERPLATE
    return y


def judge(docs: DataFrame, crf: Crf | None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content_share, kept) of each row of docs: kept if the share is least or more.

    Null, empty and blank texts are not kept; a null text's share is null. Rows are never merged; other columns are ignored.
    """
    need(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            shares = content_shares(shared.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shares, pa.float64()), pa.array([_good(s, least) for s in shares], pa.bool_())], ["doc_id", "content_share", "kept"])

    return rows.mapInArrow(f, f"doc_id {dict(rows.dtypes)['doc_id']}, content_share double, kept boolean")


def _good(share: float | None, least: float) -> bool:
    return bool(share) and share >= least


def kept(docs: DataFrame, crf: Crf | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps."""
    need(docs, text_col)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array([_good(s, least) for s in content_shares(shared.value, b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(f, docs.schema)

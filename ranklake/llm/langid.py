"""Language identification by interpolated Kneser-Ney character models, one a language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklake.llm.common import batches, need

ORDER = 4
#: Stands for what precedes a text.
START = 2


def _fold() -> np.ndarray:
    """Code point to class: lower case, digits alike, all white space a blank, one class beyond the first plane."""
    out = np.arange(65_536, dtype=np.uint64)
    for i in range(65_535):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        low = c.lower()
        out[i] = 48 if c.isdigit() else 32 if c.isspace() else ord(low) if len(low) == 1 else i
    return out


FOLD = _fold()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash of packed characters."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed ORDER-gram that ends at each character of the texts, and where each text starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = ORDER - 1
    starts = np.concatenate([[0], np.cumsum(sizes + pad)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    lead = chr(START) * pad
    codes = np.frombuffer((lead + lead.join(texts)).encode("utf-32-le", "replace"), np.uint32)
    c = FOLD[np.minimum(codes, 65_535)]
    packed = c[pad:].copy()
    for k in range(1, ORDER):
        packed |= c[pad - k : len(c) - k] << np.uint64(16 * k)
    keep = np.ones(len(packed), bool)
    inner = starts[1:] - pad
    for k in range(pad):
        keep[inner + k] = False
    return packed[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else starts


@dataclass
class Sorted:
    """Hashes in order, with a first-bits index into them, and a row of values for each."""

    hashes: np.ndarray
    values: np.ndarray
    first: np.ndarray
    shift: int
    steps: int

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Sorted:
        h = mix(keys)
        order = np.argsort(h)
        h = h[order]
        bits = min(22, max(1, int(len(h)).bit_length() + 1))
        shift = 64 - bits
        first = np.searchsorted(h >> np.uint64(shift), np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        steps = int(np.bincount((h >> np.uint64(shift)).astype(np.int64)).max()) if len(h) else 0
        return Sorted(np.append(h, np.uint64(2**64 - 1)), np.append(values[order], np.zeros_like(values[:1]), 0) if len(values) else np.zeros((1, values.shape[1]), values.dtype), first, shift, steps)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each key, and whether it is there."""
        q = mix(keys)
        at = self.first[(q >> np.uint64(self.shift)).astype(np.int64)]
        for _ in range(self.steps):
            at = at + (self.hashes[at] < q)
        hit = self.hashes[at] == q
        hit &= at < len(self.hashes) - 1
        return at, hit


def _suffix(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << 16 * n) - 1)


class One:
    """The counts of one language and their Kneser-Ney probabilities."""

    def __init__(self, packed: np.ndarray):
        self.grams, self.counts, self.discount = {}, {}, {}
        keys, counts = np.unique(packed, return_counts=True)
        for n in range(ORDER, 0, -1):
            if n < ORDER:  # in how many ways a shorter one continues on the left
                keys, counts = np.unique(_suffix(keys, n), return_counts=True)
            self.grams[n], self.counts[n] = keys, counts.astype(np.float64)
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            self.discount[n] = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
        self.context = {}
        for n in range(1, ORDER + 1):
            ctx, at = np.unique(self.grams[n] >> np.uint64(16), return_inverse=True)
            self.context[n] = ctx, np.bincount(at, self.counts[n]), np.bincount(at)
        self.alphabet = len(FOLD)

    @staticmethod
    def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def back_off(self, contexts: np.ndarray, n: int) -> np.ndarray:
        """The share of the shorter order after each context of n-1 characters; 1 where it was not seen."""
        ctx, total, kinds = self.context[n]
        at, hit = self._at(ctx, contexts)
        return np.where(hit, self.discount[n] * kinds[at] / total[at], 1.0)

    def prob(self, keys: np.ndarray, n: int) -> np.ndarray:
        """The probability of the last of n characters after the others."""
        below = self.prob(_suffix(keys, n - 1), n - 1) if n > 1 else np.full(len(keys), 1 / self.alphabet)
        ctx, total, _ = self.context[n]
        at, hit = self._at(self.grams[n], keys)
        count = np.where(hit, self.counts[n][at] - self.discount[n], 0.0)
        c, seen = self._at(ctx, keys >> np.uint64(16))
        return np.where(seen, np.maximum(count, 0) / total[c], 0.0) + self.back_off(keys >> np.uint64(16), n) * below


class Model:
    """All languages' models in shared arrays: a look-up finds the n-gram's log-probability in every language."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        ones = [One(grams(texts[lang])[0]) for lang in self.langs]
        self.tables: dict[int, Sorted] = {}
        self.back: dict[int, Sorted] = {}
        for n in range(ORDER, 0, -1):
            keys = np.unique(np.concatenate([o.grams[n] for o in ones]))
            self.tables[n] = Sorted.of(keys, np.log(np.stack([o.prob(keys, n) for o in ones], 1)).astype(np.float32))
            ctx = np.unique(np.concatenate([o.context[n][0] for o in ones]))
            self.back[n] = Sorted.of(ctx, np.log(np.stack([o.back_off(ctx, n) for o in ones], 1)).astype(np.float32))
        self.unseen = np.log(np.array([1 / o.alphabet for o in ones])).astype(np.float32)
        self.centre = np.zeros(len(ones))
        self.limit = np.inf

    def log_probs(self, packed: np.ndarray) -> np.ndarray:
        """The log-probability of each character in each language."""
        at, hit = self.tables[ORDER].find(packed)
        out = self.tables[ORDER].values[at]
        left = np.flatnonzero(~hit)
        out[left] = 0
        keys = packed[left]
        for n in range(ORDER, 0, -1):
            if not len(left):
                break
            at, hit = self.back[n].find(keys >> np.uint64(16))
            out[left] += np.where(hit[:, None], self.back[n].values[at], 0)
            if n == 1:
                out[left] += self.unseen
                break
            keys = _suffix(keys, n - 1)
            at, hit = self.tables[n - 1].find(keys)
            out[left[hit]] += self.tables[n - 1].values[at[hit]]
            left, keys = left[~hit], keys[~hit]
        return out

    def cross_entropy(self, texts: list[str]) -> np.ndarray:
        """Nats a character of each text (none empty) in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for a, z in batches(texts):
            packed, starts = grams(texts[a:z])
            sizes = np.diff(np.append(starts, len(packed)))
            out[a:z] = -np.add.reduceat(self.log_probs(packed).astype(np.float64), starts, axis=0) / sizes[:, None]
        return out

    def calibrate(self, held_out: list[tuple[int, float, int]], reject: float, slack: float) -> None:
        """Set what each language's own texts reach, and from which distance on a text is rejected.

        held_out: (language, cross-entropy, characters) of texts that were not trained on. The distance is what a text
        is above the median of its language, less the shorter it is; the limit is slack times the held-out quantile
        1 - reject, and at least half a nat.
        """
        lang, xent, size = map(np.array, zip(*held_out))
        for k in range(len(self.langs)):
            if (lang == k).any():
                self.centre[k] = np.median(xent[lang == k])
        self.limit = max(0.5, slack * float(np.quantile(self.distance(lang, xent, size), 1 - reject)))

    def distance(self, lang: np.ndarray, xent: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (xent - self.centre[lang]) / (1 + 5 / np.sqrt(size))

    def decide(self, texts: list[str | None]) -> tuple[list[str | None], list[float | None], list[bool]]:
        """Language, its cross-entropy, and whether the text is rejected."""
        lang: list[str | None] = [None] * len(texts)
        xent: list[float | None] = [None] * len(texts)
        rejected = [True] * len(texts)
        if there := [i for i, t in enumerate(texts) if t]:
            scores = self.cross_entropy([texts[i] for i in there])
            best = scores.argmin(1)
            least = scores[np.arange(len(best)), best]
            far = self.distance(best, least, np.array([len(texts[i]) for i in there])) > self.limit
            for i, b, x, r in zip(there, best, least, far):
                lang[i], xent[i], rejected[i] = self.langs[b], float(x), bool(r)
        return lang, xent, rejected


def train(docs: DataFrame, docs_per_lang: int = 300, most_chars: int = 50_000, least_docs: int = 4, reject: float = 0.01, slack: float = 1.25, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from a bounded sample of labelled rows: of each language docs_per_lang different texts of at most most_chars.

    The sample is the texts with the least hashes, so it doesn't depend on how docs is partitioned. Languages with fewer
    than least_docs such texts are left out; None if none is left. Rejection is calibrated by two-fold cross-validation.
    Null and empty labels and texts are not trained on.
    """
    need(docs, text_col, lang_col)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang <> '' and text <> ''").filter(F.length("text") <= most_chars)
    hashed = rows.withColumn("h", F.xxhash64("text"))
    ranked = hashed.select("lang", "h").withColumn("r", F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= docs_per_lang).select("lang", "h").distinct()
    chosen = [(r.lang, r.h) for r in ranked.collect()]
    if not chosen:
        return None
    spark = docs.sparkSession
    picked = hashed.join(F.broadcast(spark.createDataFrame(chosen, "lang string, h long")), ["lang", "h"]).dropDuplicates(["lang", "h"]).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r.lang, r.h)):
        texts.setdefault(r.lang, []).append(r.text)
    texts = {k: v for k, v in texts.items() if len(v) >= least_docs}
    if not texts:
        return None
    model = Model(texts)
    held_out = []
    for fold in (0, 1):
        half = Model({k: v[fold::2] for k, v in texts.items()})
        for k, lang in enumerate(half.langs):
            out = texts[lang][1 - fold :: 2]
            held_out += [(k, float(x), len(t)) for x, t in zip(half.cross_entropy(out)[:, k], out)]
    model.calibrate(held_out, reject, slack)
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, predicted_lang, cross_entropy, rejected) of each row of docs.

    The language is that of the lowest cross-entropy a character over the whole text (the first by name in a tie). A null or
    empty text has a null language and is rejected, as is any text if there is no model. Rows are never merged; other
    columns are ignored.
    """
    need(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lang, xent, rejected = _decide(shared.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(xent, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "predicted_lang", "cross_entropy", "rejected"])

    return rows.mapInArrow(f, f"doc_id {dict(rows.dtypes)['doc_id']}, predicted_lang string, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that identify() doesn't reject."""
    need(docs, text_col)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rejected = _decide(shared.value, b.column(at).to_pylist())[2]
            yield b.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(f, docs.schema)


def _decide(model: Model | None, texts: list[str | None]) -> tuple[list, list, list]:
    return model.decide(texts) if model else ([None] * len(texts), [None] * len(texts), [True] * len(texts))

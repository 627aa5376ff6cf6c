from itertools import product

import numpy as np
import pytest

from ranklake.llm import quality as Q


def some(seed):
    r = np.random.default_rng(seed)
    counts = np.array([3, 0, 1, 5, 2])
    x = r.normal(size=(counts.sum(), len(Q.FEATURES)))
    return Q.Crf(r.normal(size=(len(Q.FEATURES), 2)), r.normal(size=(2, 2))), x, counts, r.integers(0, 2, counts.sum())


def score(crf, x, y):
    return sum((x[i] @ crf.weights)[k] for i, k in enumerate(y)) + sum(crf.steps[a, b] for a, b in zip(y, y[1:]))


def test_viterbi_and_likelihood_equal_enumeration():
    for seed in range(5):
        crf, x, counts, y = some(seed)
        labels, at, loss = crf.viterbi(x, counts), 0, 0.0
        for n in counts:
            own, gold = x[at : at + n], y[at : at + n]
            if n:
                every = {p: score(crf, own, p) for p in product((0, 1), repeat=int(n))}
                assert tuple(labels[at : at + n]) == max(every, key=every.get)
                loss += np.log(sum(np.exp(list(every.values())))) - every[tuple(gold)]
            at += n
        assert crf.objective(x, counts, y, 0)[0] == pytest.approx(loss / len(x))


def test_gradients():
    crf, x, counts, y = some(9)
    _, dw, ds = crf.objective(x, counts, y, 0.01)
    for array, gradient in ((crf.weights, dw), (crf.steps, ds)):
        for at in [(0, 0), (1, 1)]:
            kept = array[at]
            array[at] = kept + 1e-5
            up = crf.objective(x, counts, y, 0.01)[0]
            array[at] = kept - 1e-5
            down = crf.objective(x, counts, y, 0.01)[0]
            array[at] = kept
            assert gradient[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01/"
    docs, labels = spark.read.parquet(d + "documents.parquet"), spark.read.parquet(d + "labels.parquet")
    crf = Q.train(docs.filter("doc_id % 2 = 0"), labels)
    rows = {r.doc_id: r.kept for r in Q.judge(docs.filter("doc_id % 2 = 1"), crf).collect()}
    gold = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in rows}
    assert np.mean([rows[i] == bool(q) for i, q in gold.items()]) > 0.9
    assert np.mean([rows[i] for i, q in gold.items() if q]) > 0.97


def test_odd_rows(spark):
    rows = [(1, "fine words here.", "k"), (1, "fine words here.", "k"), (None, "x", None), (2, None, "k"), (3, "", "k"), (4, " \n\n ", "k"), (5, "long line. " * 100_000 + "\n" * 10, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = Q.judge(docs, None).collect()
    assert sorted((r.doc_id or 0, r.content_share, r.kept) for r in out if r.doc_id != 2) == [(0, 1.0, True), (1, 1.0, True), (1, 1.0, True), (3, 0.0, False), (4, 0.0, False), (5, 1.0, True)]
    assert [(r.content_share, r.kept) for r in out if r.doc_id == 2] == [(None, False)]
    got = Q.kept(docs, None)
    assert got.columns == docs.columns and got.count() == 4
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.train(docs, none) is None and Q.judge(docs.limit(0), None).count() == 0


def test_mixed_documents_have_shares_between(spark):
    d = "/root/testdata/sf0.1/"
    docs, labels = spark.read.parquet(d + "documents.parquet"), spark.read.parquet(d + "labels.parquet")
    crf = Q.train(docs.filter("doc_id % 2 = 0"), labels)
    rows = docs.filter("doc_id % 2 = 1 and length(text) < 30000").join(labels.select("doc_id", "quality"), "doc_id").orderBy("doc_id").collect()
    good = [x for x in (Q.lines_of(r.text)[1:] for r in rows if r.quality) if len(x) >= 3][:100]
    bad = [x for x in (Q.lines_of(r.text)[1:] for r in rows if not r.quality) if len(x) >= 3][:100]
    assert len(good) == len(bad) == 100
    right = total = 0
    for a, b in zip(good, bad):
        text, truth = a[:6] + b[:6] + a[6:9], [1] * len(a[:6]) + [0] * len(b[:6]) + [1] * len(a[6:9])
        x, counts, sizes = Q.describe(["\n".join(text)])
        got = crf.viterbi(x, counts)
        right += (got == truth).sum()
        total += len(truth)
        share = Q.content_shares(crf, ["\n".join(text)])[0]
        assert share == pytest.approx((sizes * got).sum() / sizes.sum())
    assert right / total > 0.9
    between = [0 < s < 1 for s in Q.content_shares(crf, ["\n".join(a[:6] + b[:6]) for a, b in zip(good, bad)])]
    assert np.mean(between) > 0.9


def test_line_labels():
    shared = "This very line is on every page of the site."
    good = [f"{shared}\nSome {w} sentence that is fine, as it has words.\nAnd {w} more of them, in another line." for w in ("old", "new", "odd", "red", "dry", "wet")]
    bad = [f"{shared}\n{w} | {w} | {w} | {w}\n{w}!!! $$$ {w} ### {w} %%% &&&\nSome {w} sentence that is fine, as it has words." for w in ("buy", "win", "top", "now", "hot", "big")]
    texts, quality = good + bad, np.array([1] * len(good) + [0] * len(bad))
    x, counts, _ = Q.describe(texts)
    y = Q.line_labels(texts, quality, x, counts)
    lines = [x for t in texts for x in Q.lines_of(t)]
    assert y[: 3 * len(good)].all()
    assert not any(k for k, x in zip(y[3 * len(good) :], lines[3 * len(good) :]) if x == shared or "|" in x or "$" in x)
    assert Q.learn(good[:1], [1]) is None and Q.learn([], []) is None


def test_passages_that_good_texts_share_are_kept():
    passage = "A passage of some length that many documents quote, word by word, and rightly so."
    good = [f"{passage}\nSome {i} sentence that is fine, as it has words." for i in range(40)] + [passage + f"\nShort {i}." for i in range(20)]
    bad = [f"{i} | {i} | x{i} | y{i}\n!!! $$$ {i} ### %%% &&&" for i in range(30)]
    crf = Q.learn(good + bad, [1] * len(good) + [0] * len(bad))
    assert min(Q.content_shares(crf, good)) == 1.0 and max(Q.content_shares(crf, bad)) == 0.0

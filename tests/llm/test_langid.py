import math
import random
from collections import Counter

import numpy as np
import pytest

from ranklake.llm import langid


def slow_prob(texts, alphabet):
    """Kneser-Ney by its definition, with dictionaries."""
    full = Counter()
    for t in texts:
        t = "\x02" * (langid.ORDER - 1) + t
        full.update(t[i : i + langid.ORDER] for i in range(len(t) - langid.ORDER + 1))
    counts = {langid.ORDER: full}
    for n in range(langid.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def prob(g):
        n = len(g)
        below = prob(g[1:]) if n > 1 else 1 / alphabet
        c = counts[n]
        same = [v for k, v in c.items() if k[:-1] == g[:-1]]
        if not same:
            return below
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
        return max(c.get(g, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * below if g in c else d * len(same) / sum(same) * below

    return prob


def test_equals_the_definition():
    r = random.Random(2)
    texts = {k: ["".join(r.choice(a) for _ in range(r.randint(1, 60))) for _ in range(12)] for k, a in (("x", "abc "), ("y", "bcdé\n7"))}
    model = langid.Model(texts)
    probe = ["abcab cab", "ddé7éé", "zzz", "a\U0001f642b", "ABC 9"]
    got = model.cross_entropy(probe)
    fold = lambda s: "".join(chr(int(langid.FOLD[min(ord(c), 65535)])) for c in s)
    for k, lang in enumerate(model.langs):
        folded = [fold(t) for t in texts[lang]]
        prob = slow_prob(folded, len(langid.FOLD))
        for i, t in enumerate(map(fold, probe)):
            t = "\x02" * 3 + t
            want = -sum(math.log(prob(t[j : j + 4])) for j in range(len(t) - 3)) / (len(t) - 3)
            assert got[i, k] == pytest.approx(want, rel=1e-4)


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, docs_per_lang=40)
    rows = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    labels = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(labels) == 1000
    assert np.mean([rows[i].predicted_lang == lang for i, lang in labels.items()]) > 0.95
    assert np.mean([r.rejected for r in rows.values()]) < 0.01
    odd = ["Привет, как дела? " * 30, "漢字仮名交じり文です。" * 30]
    assert model.decide(odd)[2] == [True] * 2


def test_odd_rows(spark):
    text = "the and of that is " * 20
    rows = [(1, "en", text, "c"), (1, "en", text, "c"), (None, None, text, "c"), (2, "en", None, "c"), (3, "fr", "", "c"), (4, "", text + "more", "c"), (5, "en", text * 4000, "c"), *[(9, "en", text + str(i) + "or this", None) for i in range(8)]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, rejected string")
    model = langid.train(docs)
    out = langid.identify(docs, model).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.predicted_lang, r.rejected) for r in out if r.doc_id in (2, 3)} == {2: (None, True), 3: (None, True)}
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    assert langid.train(docs.limit(0)) is None
    assert [r.rejected for r in langid.identify(docs.limit(1), None).collect()] == [True]
    assert langid.identify(docs.limit(0), model).count() == 0

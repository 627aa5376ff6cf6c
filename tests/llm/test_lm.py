import math
from collections import Counter

import numpy as np
import pytest

from ranklake.llm import lm

SF = "/root/testdata/sf0.01"


def net():
    n = lm.Network(lm.Vocabulary(["the", "a", "."], [3.5, 0.5, 9.0, 2.0], [7, 5, 2]), hidden=5, seed=3)
    r = np.random.default_rng(5)
    for p in n.params[1:]:
        p += r.normal(size=p.shape).astype(np.float32) * 0.3
    return n


def slow(n, text):
    """By the definition, one token at a time."""
    v = n.vocabulary
    ids = v.classes(lm.TOKEN.findall(text.lower())).tolist()
    e, b, groups, classes = (p.astype(float) for p in n.params)
    total = 0.0
    for i, t in enumerate(ids):
        h = b.copy()
        for k, d in enumerate((-2, -1, 1, 2)):
            j = i + d
            h += e[k * n.width + (ids[j] if 0 <= j < len(ids) else v.size)]
        h = np.append(np.tanh(h), 1)
        z, own = h @ groups, [c for c in range(v.size) if v.group[c] == v.group[t]]
        total += z[v.group[t]] - math.log(np.exp(z).sum()) + h @ classes[t] - math.log(sum(math.exp(h @ classes[c]) for c in own))
    return total, len(ids)


def made(docs, words=None, buckets=None, **kw):
    """Blocks, counts and pieces."""
    blocks = lm.tokenise(docs, **kw)
    counts = lm.written(lm.count_tokens(blocks))
    v = lm.vocabulary(counts, words, buckets)
    return lm.deal(blocks, counts, v), counts, v


def mean_score(n, held, counts):
    out = [r for r in lm.score(lm.deal(lm.tokenise(held), counts, n.vocabulary), n, counts).collect() if r.n_tokens]
    return sum(r.log_prob for r in out) / sum(r.n_tokens for r in out)


def unigram(counts, held):
    seen = {r.token: r.n for r in counts.collect()}
    total = sum(seen.values()) + (len(seen) + 1) / 2
    tokens = [w for r in held.collect() if r.text for w in lm.TOKEN.findall(r.text.lower())]
    return sum(math.log(seen.get(w, 0.5) / total) for w in tokens) / len(tokens)


def test_equals_the_definition():
    texts = ["The cat.", "", "a", "the a the a . x y z été", "?!"]
    n = net()
    assert len(set(n.vocabulary.group)) > 1 and max(np.bincount(n.vocabulary.group)) > 1
    for s, t in zip(n.score(texts), texts):
        assert s == pytest.approx(slow(n, t)[0], rel=1e-4, abs=1e-6)


def test_an_untrained_network_gives_frequencies():
    n = lm.Network(lm.Vocabulary(["the", "a"], [2.0], [6, 2]))
    assert n.score(["the a zebra the"])[0] == pytest.approx(2 * math.log(0.6) + 2 * math.log(0.2), rel=1e-5)


def test_gradients():
    n = net()
    n.params = [p.astype(np.float64) for p in n.params]
    zero, text = np.zeros(2, np.int64), ["the a . x y the cat the", "a a ."]
    sizes = np.array([8, 3])
    padded, begins = n.pad(n.vocabulary, n.vocabulary.classes(" ".join(text).split()), sizes, zero, zero)
    at = n.targets(sizes, begins)
    hit, sums, rest = n.gradients(padded, at)
    dense = np.zeros_like(n.params[0])
    dense[hit] = sums
    loss = lambda: -n.log_probs(padded, at).mean()
    for p, g in zip(n.params, [dense, *rest]):
        spot = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = p[spot]
        p[spot] = kept + 1e-5
        up = loss()
        p[spot] = kept - 1e-5
        down = loss()
        p[spot] = kept
        assert g[spot] == pytest.approx((up - down) / 2e-5, rel=1e-3)


def test_sums_by_row():
    r = np.random.default_rng(0)
    rows, values = r.zipf(1.3, size=(500, 4)) % 40, r.normal(size=(500, 3))
    hit, sums = lm._summed(rows, values)
    want = np.zeros((40, 3))
    for k in range(4):
        np.add.at(want, rows[:, k], values)
    assert hit.tolist() == sorted(set(rows.ravel().tolist())) and sums == pytest.approx(want[hit])


def test_long_texts_are_cut_without_a_trace(spark):
    text = "The cat, " + "x" * 300 + " saw a dog!  \n\n and then Ünder " * 40
    assert [w for part in lm.cut(text, 50) for w in part] == lm.TOKEN.findall(text.lower())
    docs = spark.createDataFrame([(1, text), (2, "a b"), (3, "a" * 500), (4, " " * 500 + "b")], "doc_id long, text string")
    (a, n, v), (b, m, _) = made(docs, words=4, buckets=3), made(docs, words=4, buckets=3, piece_chars=60)
    assert b.count() > 8 and sorted(n.collect()) == sorted(m.collect())
    network = lm.train(a, n, v)
    want = {r.doc_id: (r.n_tokens, r.log_prob) for r in lm.score(a, network, n).collect()}
    for pieces in (b, lm.deal(lm.tokenise(docs, piece_chars=60), n, v, near=2)):
        for r in lm.score(pieces, network, n).collect():
            assert (r.n_tokens, r.log_prob) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1], rel=1e-6))


def test_odd_rows(spark):
    rows = [(1, "a b. A", 1), (1, "a b. A", 1), (None, "b", 2), (None, "b", 2), (2, None, 2), (3, "", None), (4, "word " * 200_000, 3), (5, "  ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumnRenamed("n", "tokens").repartition(3)
    pieces, counts, v = made(docs)
    assert {r.token: r.n for r in counts.collect()} == {"a": 4, "b": 4, ".": 2, "word": 200_000}
    out = lm.score(pieces, lm.train(pieces, counts, v), counts).collect()
    assert len(out) == 8
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter([(1, 4), (1, 4), (None, 1), (None, 1), (2, None), (3, 0), (4, 200_000), (5, 0)])
    assert [(r.log_prob, r.log_prob_per_token) for r in out if r.doc_id in (3, 5)] == [(0.0, None)] * 2
    assert [(r.log_prob, r.log_prob_per_token) for r in out if r.doc_id == 2] == [(None, None)]
    for part, n in ((docs.limit(0), 0), (docs.filter("doc_id = 2 or doc_id = 3").withColumn("doc_id", docs.doc_id.cast("string")), 2)):
        pieces, counts, v = made(part)
        assert lm.score(pieces, lm.train(pieces, counts, v), counts).count() == n


def test_more_than_16_bits_of_tokens_in_a_block(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(70_000))), (2, "w1 w69999 w1")], "doc_id long, text string").coalesce(1)
    pieces, counts, v = made(docs)
    assert {r.token: r.n for r in counts.filter("n > 1").collect()} == {"w1": 3, "w69999": 2} and counts.count() == 70_000
    got = {r.doc_id: r for r in lm.score(pieces, lm.Network(v), counts).collect()}
    assert got[2].log_prob == pytest.approx(sum(math.log(n / v.totals.sum()) for n in (3, 2, 3)), rel=1e-4)


def test_log_prob_is_of_tokens(spark):
    rows = [(1, "the cat the dog the zebra ."), (2, "the the cat cat cat ."), (3, "unheard été the"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    own, counts, v = made(docs.filter("doc_id <> 3"), words=2, buckets=2)
    n = lm.train(own, counts, v)
    seen = {r.token: r.n for r in counts.collect()}
    class_of = lambda w: v.classes([w])[0]

    def share(w):
        if w in v.words:
            return 0.0
        mates = [k for k in seen if k not in v.words and class_of(k) == class_of(w)]
        return math.log(seen.get(w, 0.5) / (sum(seen[k] for k in mates) + (len(mates) + 1) / 2))

    for near in (0, 3, 1000):
        pieces = lm.deal(lm.tokenise(docs), counts, v, near=near)
        got = {r.doc_id: r for r in lm.score(pieces, n, counts).collect()}
        for doc, text in rows[:3]:
            tokens = lm.TOKEN.findall(text)
            want = slow(n, text)[0] + sum(map(share, tokens))
            assert got[doc].log_prob == pytest.approx(want, rel=1e-4)
            assert got[doc].log_prob_per_token == pytest.approx(want / len(tokens), rel=1e-4)
        assert got[4].log_prob is None and got[5].log_prob == 0 and got[5].log_prob_per_token is None
    assert share("unheard") < min(share(w) for w in seen if class_of(w) == class_of("unheard"))


def test_partitions_do_not_matter_and_unigrams_are_beaten(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own, held = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    means, nets = [], []
    for parts in (1, 16):
        pieces, counts, v = made(own.repartition(parts))
        nets.append(lm.train(pieces, counts, v))
        means.append(mean_score(nets[-1], held, counts))
    assert all((p == q).all() for p, q in zip(nets[0].params, nets[1].params))
    assert means[0] == pytest.approx(means[1], rel=1e-9)
    assert means[0] > unigram(counts, held) + 0.7


def test_many_lanes_lose_little(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own, held = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    pieces, counts, v = made(own)
    floor, one = unigram(counts, held), mean_score(lm.train(pieces, counts, v), held, counts)
    many = mean_score(lm.train(pieces, counts, v, lane_tokens=40_000), held, counts)
    assert many > floor + 0.5 * (one - floor)


def test_classes_follow_the_counts():
    assert lm.sizes(0) < lm.sizes(1000) < lm.sizes(1_000_000)

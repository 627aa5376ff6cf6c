import random
import time

import numpy as np
import pytest
import xxhash

from ranklake.llm import simhash as S


def connected(n, edges):
    label = list(range(n))
    for a, b in edges:
        x, y = label[a], label[b]
        if x != y:
            label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def brute(texts, most):
    f = S.Fingerprints()
    bits = np.array([np.unpackbits(np.frombuffer(f.of(t), np.uint8)) for t in texts]).reshape(-1, 128)
    near = (bits[:, None] != bits[None]).sum(2) <= most
    return connected(len(texts), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])


def sample(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 9))) for _ in range(900)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(1, 120))) for _ in range(n)]
    for _ in range(n):
        words = r.choice(texts).split()
        for _ in range(r.randint(0, max(1, len(words) // 25))):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    return texts


def flips(n, most):
    """n patterns of that many bits, which fall as they like or keep to few blocks."""
    r = np.random.default_rng(80)
    chance = r.random((n, 128))
    chance[n // 2 :] += np.repeat(r.random((n - n // 2, 32)) > 0.6, 4, axis=1)
    out = np.zeros((n, 128), np.uint8)
    out[np.arange(n)[:, None], chance.argsort(1)[:, :most]] = 1
    return np.packbits(out, axis=1)


@pytest.mark.parametrize("n", [0, 1, 2, 254, 255, 256, 510, 1000])
def test_fingerprints_count_every_word(n):
    words = [f"w{i}" for i in range(n)] or ["!?"]
    bits = [np.unpackbits(np.frombuffer(xxhash.xxh128_digest(w), np.uint8)).astype(int) * 2 - 1 for w in words]
    want = np.packbits(np.sum(bits, 0) > 0).tobytes()
    text = " ".join([*words, *(w.upper() for w in words)]) if n else "!?"
    assert S.Fingerprints().of(text) == want == S.Fingerprints().of(text, text.lower().split() if n else [])


def test_any_near_pair_shares_a_key():
    clean = S.blocks_of(flips(20_000, S.BITS)) == 0
    shares = np.zeros(len(clean), bool)
    for which in S.KEYS:
        shares |= clean[:, list(which)].all(1)
    assert shares.all() and len(S.KEYS) == 280
    # the worst case: a bit in each of 19 blocks, spread over the groups
    for seed in range(200):
        dirty = np.random.default_rng(seed).choice(32, S.BITS, replace=False)
        assert any(not set(which) & set(dirty) for which in S.KEYS)


def test_any_near_pair_of_a_key_shares_a_finer_one():
    r = np.random.default_rng(2)
    for _ in range(300):
        which = S.KEYS[r.integers(len(S.KEYS))]
        dirty = set(r.choice([i for i in range(32) if i not in which], S.BITS, replace=False).tolist())
        assert any(not set(more) & dirty for more in S.finer(which))


@pytest.mark.parametrize("many", [S.MANY, 3])
def test_spanning_edges_connect_what_all_edges_do(monkeypatch, many):
    monkeypatch.setattr(S, "MANY", many)
    r = np.random.default_rng(9)
    base = r.integers(0, 256, (30, 16), dtype=np.uint8)
    rows = base[r.integers(0, 30, 400)].copy()
    for row in rows:
        for b in r.integers(0, 128, r.integers(0, 15)):
            row[b // 8] ^= 1 << (b % 8)
    which = (1, 3, 4, 6)
    bits, blocks = np.unpackbits(rows, axis=1), S.blocks_of(rows)
    near = (bits[:, None] != bits[None]).sum(2) <= S.BITS
    for i in which:
        near &= blocks[:, None, i] == blocks[None, :, i]
    a, b = S.spanning(rows, which)
    assert all(near[x, y] for x, y in zip(a, b)) and 50 < len(a) < 400
    assert connected(400, zip(a, b)) == connected(400, [p for p in zip(*np.nonzero(near)) if p[0] < p[1]])


def test_full_buckets_cost_little_a_pair():
    r = np.random.default_rng(3)
    rows = r.integers(0, 256, (100_000, 16), dtype=np.uint8)
    rows[:, :2] = 0
    rows[:, 1] = r.integers(0, 200, len(rows))  # buckets of about 500
    pairs = len(rows) ** 2 / 400
    taken = []
    for _ in range(3):
        start = time.process_time()
        a, _ = S.spanning(rows, (0, 1, 2, 3))
        taken.append(time.process_time() - start)
    assert len(a) == 0 and min(taken) < 25e-9 * pairs


@pytest.mark.parametrize("rows_a_part", [500_000, 40])
def test_equals_brute_force(spark, rows_a_part):
    texts = [*sample(10, 120), "", "", "!!", "!!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.keep_doc_id for r in S.groups(docs, rows_a_part=rows_a_part).collect()}
    got = [found.get(i, i) for i in range(len(texts))]
    assert got == brute(texts, S.BITS) and len(set(got)) < 200
    for most in (64, 0):  # with filters, and without
        assert sorted(r.doc_id for r in S.dedup(docs, max_filter_mb=most).collect()) == sorted(set(got))


def test_components(spark):
    r = random.Random(11)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 600)]
    want = connected(601, edges)
    got = {x.node: x.root for x in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: k for i, k in enumerate(want) if i != k}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (None, "A, b: c!", "x", 1), (None, None, "y", 2), (2, None, "y", 2), (3, long, None, 3), (4, long + " more", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group__ string, h1 int")
    got = S.groups(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 1, True), (1, 1, True), (None, 1, False), (3, 3, True), (4, 3, False)]))
    out = S.dedup(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [rows[0], rows[3], rows[4], rows[5]]))
    assert S.dedup(docs.limit(0)).count() == 0 and S.groups(docs.limit(0)).count() == 0

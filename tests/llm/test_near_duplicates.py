"""Operator 9 against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from postmill.llm import near_duplicates as nd
from postmill.llm.components import components

LOW = {i: i + 32 for i in range(65, 91)}


def plain_set(text, width=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def plain(rows, width=2):
    """{doc_id: (set size, component)} by all pairs."""
    ids, sets = [d for d, _ in rows], [plain_set(t, width) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, d in enumerate(ids)}


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["é", "Ω"]
    passage = rng.choices(vocab, k=60)
    texts = ["", None, " \t\n", "One", "one", "ONE two", "one  two", "one\x0btwo", "one\xa0two", "é É"]
    for _ in range(n):
        base = rng.choices(vocab, k=rng.choice([4, 12, 40, 120]))
        if rng.random() < 0.3:
            base = passage + base
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 8))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    hub = rng.choices(vocab, k=100)
    for _ in range(120):
        copy = list(hub)
        for _ in range(rng.randint(3, 6)):
            copy[rng.randrange(100)] = rng.choice(vocab)
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def test_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, -1, True) for d, t in rows], "doc_id long, text string, node int, kept boolean").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in plain(rows).items()}


def test_links_that_hubs_miss(spark, monkeypatch):
    """Chunks of a few members: buckets that span components are compared in parts, and nothing is lost."""
    monkeypatch.setattr(nd, "CHUNK", 3)
    monkeypatch.setattr(nd, "ROUNDS", 0)
    rows = corpus(7, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(df).collect()}
    assert got == {d: c for d, (_, c) in plain(rows).items()}


def test_odd_tables(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (9, None), (5, "A B C")], "doc_id long, text string")
    got = sorted(map(tuple, nd.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (7, 2, 5, False), (7, 2, 5, False), (9, 0, 9, True), (5, 2, 5, True)], key=str)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(12):
            n = 300
            both = int(round(2 * n * share / (1 + share)))
            x = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            sets, at = np.concatenate([np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n : 2 * n - both]]))]), np.array([0, n, 2 * n])
            sig = nd.super_minhash(sets, at)
            errors.append((sig[0] == sig[1]).mean() - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (share * (1 - share) / nd.SLOTS) ** 0.5 * 1.6
    assert (nd.super_minhash(np.array([5], np.uint64), np.array([0, 1, 1]))[1] == ~np.uint64(0)).all()


@pytest.mark.parametrize("common, more, pairs", [(4, 1, 20_000), (8, 2, 4_000)])
def test_short_texts_share_a_band(common, more, pairs):
    """Sets of similarity 0.8: with bands of consecutive slots some 4 of 10,000 pairs of 4 and 5 elements shared none."""
    rng = np.random.default_rng(11)
    n, missed = common + more, 0
    for _ in range(0, pairs, 4000):
        x = rng.integers(0, 1 << 63, (4000, n)).astype(np.uint64)
        less = np.sort(x[:, :common], axis=1)
        a, b = (nd.band_hashes(nd.super_minhash(s.ravel(), np.arange(4001) * s.shape[1])) for s in (np.sort(x, axis=1), less))
        missed += int((a != b).all(axis=1).sum())
    assert missed <= 1


def test_small_similar_sets_always_share_a_bucket():
    """Every pair of sets of up to 9 shingles and similarity 0.8 or more; sets of one or two shingles have no short hash."""
    rng = np.random.default_rng(2)
    pairs = [(common, a, b) for a in range(10) for b in range(a, 10) for common in range(a + 1) if a and 100 * common >= 80 * (a + b - common)]
    assert {(4, 4, 5), (8, 8, 9), (8, 9, 9)} <= set(pairs)
    for common, a, b in pairs:
        x = rng.integers(0, 1 << 63, a + b - common).astype(np.uint64)
        sets = [np.sort(x[:a]), np.sort(np.concatenate((x[:common], x[a:])))]
        hashed, at = nd.short_hashes(np.concatenate(sets), np.array([0, a, a + b]))
        assert np.array_equal(*sets) or set(hashed[: at[1]]) & set(hashed[at[1] :]), (common, a, b)
        listed = nd.buckets(np.concatenate(sets), np.array([0, a, a + b])).to_pylist()
        assert [len(set(r)) for r in listed] == [nd.BANDS + n for n in np.diff(at)] and [r[nd.BANDS :] for r in listed] == [hashed[: at[1]].tolist(), hashed[at[1] :].tolist()]
    none, at = nd.short_hashes(np.arange(1, 13, dtype=np.uint64), np.array([0, 1, 2, 2, 12]))
    assert len(none) == 0 and at.tolist() == [0, 0, 0, 0, 0]


def test_signature_is_the_minimum_over_all_ranks():
    """Early stopping leaves out only what can't be a minimum."""
    sets = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 9).astype(np.uint64))
    m = nd.SLOTS
    want = np.full(m, ~np.uint64(0))
    for e in sets:
        e = np.array([e])
        a = int(nd.mix64(e ^ np.uint64(0xA0761D6478BD642F))[0] % np.uint64(m - 1)) + 1
        b = int(nd.mix64(e ^ np.uint64(0xE7037ED1A0B428DB))[0] % np.uint64(m))
        for j in range(m):
            with np.errstate(over="ignore"):
                v = nd.mix64(e + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))[0] >> np.uint64(16) | np.uint64(j) << np.uint64(48)
            want[(a * j + b) % m] = min(want[(a * j + b) % m], v)
    assert (nd.super_minhash(sets, np.array([0, 9]))[0] == want).all()


@pytest.mark.parametrize("width", [1, 2, 5])
def test_shingle_sets(width):
    texts = [t for _, t in corpus(5, 20)]
    sets, at = nd.shingle_sets(pa.array(texts, pa.string()), width)
    assert np.diff(at).tolist() == [len(plain_set(t, width)) for t in texts]


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    star = [(5000, 5001 + i) for i in range(300)]
    wild = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    links = chain + star + wild
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        u, v = find(u), find(v)
        if u != v:
            root[max(u, v)] = min(u, v)
    df = spark.createDataFrame(links, "u long, v long").repartition(6)
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}


def test_most_in_common():
    rng = np.random.default_rng(5)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype("<u4") for _ in range(n)] for n in (7, 5))
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert nd.most_in_common(a, b).tolist() == want == nd.most_in_common(a, b, 7).tolist()
    assert nd.most_in_common([np.array([3, 3], "<u4")], [np.array([3], "<u4")]).tolist() == [[2]]

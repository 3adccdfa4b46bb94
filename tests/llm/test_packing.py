"""Operator 5 against a plain best-fit, and its rules on tables."""

import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import packing


def plain(lengths, sources, clusters, capacity):
    bins, where, offsets, clock = [], [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [b for b in bins if b[0] >= lengths[i] and (sources[i] < 0 or sources[i] not in b[1]) and (clusters[i] < 0 or clusters[i] not in b[2])]
        b = min(fits, key=lambda b: (b[0], b[4]), default=None)  # the tightest; of equal rooms the one that has it longest
        if b is None:
            b = [capacity, set(), set(), len(bins), 0]
            bins.append(b)
        where[i], offsets[i] = b[3], capacity - b[0]
        b[0] -= lengths[i]
        b[1].add(sources[i])
        b[2].add(clusters[i])
        clock += 1
        b[4] = clock
    return where, offsets, len(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(-1, 4), st.integers(-1, 9)), max_size=60), st.integers(50, 90))
def test_against_plain_best_fit(items, capacity):
    lengths, sources, clusters = (np.array([x[k] for x in items], np.int64) for k in range(3))
    bins, offsets, n = packing.best_fit(lengths, sources, clusters, capacity)
    check(bins, offsets, lengths, sources, clusters, capacity)
    assert (bins.tolist(), offsets.tolist(), n) == plain(lengths.tolist(), sources.tolist(), clusters.tolist(), capacity)


def check(bins, offsets, lengths, sources, clusters, capacity):
    for b in set(bins.tolist()):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == (np.cumsum(lengths[own]) - lengths[own]).tolist() and lengths[own].sum() <= capacity
        for x in (sources[own], clusters[own]):
            x = x[x >= 0]
            assert len(set(x.tolist())) == len(x)


def test_tightest_compatible_bin():
    # rooms 10 (source 0), 20 (source 1), 30 (source 2): a piece of 10 from source 0 goes to the room of 20
    bins, _, n = packing.best_fit(np.array([90, 80, 70, 10]), np.array([0, 1, 2, 0]), np.array([-1] * 4), 100)
    assert bins.tolist() == [0, 1, 2, 1] and n == 3
    bins, _, n = packing.best_fit(np.array([90, 80, 70, 10]), np.array([0, 1, 2, 0]), np.array([5, 6, 7, 6]), 100)
    assert bins.tolist() == [0, 1, 2, 2]
    many = packing.best_fit(np.full(300, 1), np.arange(300) % 150, np.arange(300) % 140, 1000)
    assert many[2] == 3 or many[2] == 2


def test_tables(spark):
    rng = random.Random(1)
    rows = [(i if i % 50 else None, rng.choice([1, 5, 300, 900, 4096, 4097, 13_000]), "hot" if i % 3 == 0 else f"s{i % 40}", rng.randrange(200)) for i in range(1500)]
    rows += [(7, 0, "x", 1), (8, None, "x", 1), (9, 10, None, None), (9, 10, None, None)]
    df = spark.createDataFrame([(*r, "bin") for r in rows], "doc_id long, length int, source string, cluster int, bin string")
    got = packing.pack(df, shard_pieces=300).toPandas()
    total = Counter()
    for d, n, _, _ in rows:
        total[d] += n or 0
    assert {d: n for d, n in got.fillna({"doc_id": -1}).groupby("doc_id")["length"].sum().items()} == {(-1 if d is None else d): n for d, n in total.items() if n}
    per = defaultdict(list)
    for r in got.itertuples():
        per[r.bin].append(r)
    assert len(set(b >> 32 for b in per)) > 3
    for own in per.values():
        assert sum(r.length for r in own) <= 4096
        for key in ("source", "cluster"):
            x = [getattr(r, key) for r in own if getattr(r, key) is not None and getattr(r, key) == getattr(r, key)]
            assert len(set(x)) == len(x)
    assert packing.pack(df.limit(0)).count() == 0
    again = packing.pack(df.repartition(7, "length"), shard_pieces=300).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in packing.pack(df.coalesce(1), shard_pieces=300).collect())


def test_long_texts_and_missing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000, 7), (2, None, 8), (None, "", 9), (3, "a", 1)], "doc_id long, text string, bin int")
    got = packing.pack_documents(docs).toPandas()
    assert got.groupby("doc_id", dropna=False)["length"].sum().fillna(0).tolist() == [200_001, 1, 2, 1] and got["source"].isna().all() and got["length"].max() == 4096


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from postmill.llm.token_counts import count_tokens

    want = {r["doc_id"]: r["n_tokens"] + 1 for r in count_tokens(docs).collect()}
    got = packing.pack_documents(docs).toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == want
    assert got.groupby("bin")["length"].sum().mean() > 0.6 * 4096


def test_texts_without_words(spark):
    """Empty texts of many sources share bins; copies of a text with words don't."""
    docs = spark.createDataFrame([(i, (None, "", " \n", "copy")[i % 4], f"s{i}") for i in range(40)], "doc_id long, text string, source string")
    got = packing.pack_documents(docs).toPandas()
    copies = got[got["doc_id"] % 4 == 3]
    assert len(got) == 40 and got["bin"].nunique() == 10 == copies["bin"].nunique()
    assert packing.sized(docs).filter("cluster is null").count() == 30

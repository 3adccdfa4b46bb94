"""Operator 12 against runs by their definition."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import periodic_runs as P

SF = "/root/testdata/sf0.001/documents.parquet"


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def smallest_period(words):
    border = [0] * len(words)
    k = 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = border[k - 1]
        k += words[i] == words[k]
        border[i] = k
    return len(words) - border[-1]


def plain_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q) and smallest_period(words[s : i + q]) == q:
                out.append((s, i + q - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab", min_size=1, max_size=7), st.integers(1, 40)), max_size=5), min_size=1, max_size=4), st.integers(1, 9))
def test_scan(docs, split):
    words = [[ord(c) for part, times in d for c in part * times] for d in docs]
    codes, at = np.array([w for d in words for w in d], np.int64), np.cumsum([0, *map(len, words)])
    want = sorted((i, *r) for i, d in enumerate(words) for r in plain_runs(d))
    assert sorted(P.scan_lags(codes, at)) == want
    parts = [r for first in range(1, max(map(len, words)) // 3 + 1, split) for r in P.scan_lags(codes, at, first, first + split - 1)]
    least = {}
    for d, s, n, q in parts:
        least[d, s, n] = min(q, least.get((d, s, n), q))
    assert sorted((*k, q) for k, q in least.items()) == want


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (None, "a b " * 40), (None, None), (5, "x " * 30), (5, "x " * 30), (6, "a b c " * 9 + "d " + "a b c " * 9),
    (7, "é\xa0ü " * 50 + "\x0bz"), (8, "p q r s t u v " * 3), (9, "one two three"), (10, "a a b " * 60 + "a b a b b " * 60), (11, ("w%d " * 400) % tuple(range(400)) * 3),
    *((i, f"k{i} l m n o " * 13 + "end " * 25) for i in range(20, 60)),
]


@pytest.mark.parametrize(("long_bytes", "lags", "ranges"), [(P.LONG_BYTES, P.LAGS, P.RANGES), (40, 3, 4), (-1, 7, 1000)])
def test_rows(spark, long_bytes, lags, ranges):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ODD], "doc_id int, text string, n int, row string")
    assert rows(P.periodic_runs(docs, long_bytes=long_bytes, lags=lags, ranges=ranges)) == sorted((plain_row(i, t) for i, t in ODD), key=str)


def test_empty(spark):
    assert P.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet(SF)
    want = sorted((plain_row(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 30_000), key=str)
    assert rows(P.periodic_runs(docs.filter("coalesce(length(text), 0) < 30000"), long_bytes=2000, lags=50)) == want
    assert sum(r[1] > 0 for r in want) > 5

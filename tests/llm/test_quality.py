"""Operator 3 against a plain interpolated modified Kneser-Ney model, and against labels."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postmill.llm import quality
from postmill.llm.common import stored

N = quality.ORDER


def sequences(text):
    """Symbol strings of the words of a text: '_' for a space, '^' for a repeat, '0' for digits."""
    last = None
    for w in "".join("0" if c in "0123456789" else c for c in text).split():
        yield "_" + ("^" if w == last else "") + w + "_"
        last = w


def plain_model(texts):
    top = Counter(s[max(0, i + 1 - N) : i + 1] for t in texts for s in sequences(t) for i in range(1, len(s)))
    a = {N: {g: c for g, c in top.items() if len(g) == N}}
    for k in range(N - 1, 0, -1):
        a[k] = Counter({g: c for g, c in top.items() if len(g) == k})
        for g in a[k + 1]:
            a[k][g[1:]] += 1
    unknown, p, gamma = 1 / (len(a[1]) + 1), {0: {}}, {}
    for k in range(1, N + 1):
        d = quality.discounts(Counter(a[k].values()))
        cut = lambda c, d=d: d[min(c, 3) - 1]
        total, left = defaultdict(int), defaultdict(float)
        for g, c in a[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += cut(c)
        gamma |= {c: left[c] / total[c] for c in total}
        p[k] = {g: (c - cut(c)) / total[g[:-1]] + gamma[g[:-1]] * (p[k - 1][g[1:]] if k > 1 else unknown) for g, c in a[k].items()}

    def prob(g):
        if not g:
            return unknown
        return p[len(g)][g] if g in p[len(g)] else gamma.get(g[:-1], 1.0) * prob(g[1:])

    return prob


def plain_nll(prob, text):
    gs = [s[max(0, i + 1 - N) : i + 1] for s in sequences(text or "") for i in range(1, len(s))]
    return -sum(math.log(prob(g)) for g in gs), len(gs)


@pytest.mark.parametrize("hot", [100_000, 900, 0])
def test_against_plain_model(spark, hot):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    odd = [(900, None), (901, ""), (902, " \n "), (903, "x x x x 12 345 Ünknown ☃ ☃"), (904, "the the"), (905, "漢字かな交じり文 漢字 नमस्ते"), (906, "long" * 40 + " " + "z" * 31 + " " + "z" * 32 + " " + "z" * 33 + " " + "z" * 33)]
    docs += [(700, "漢字かな漢字 漢文 漢文"), (701, "longlong " + "the" * 30)]
    rows = [(i, t, True) for i, t in docs] + [(i, t, False) for i, t in odd]
    counts = stored(quality.corpus_grams(spark.createDataFrame(rows, "row long, text string, counted boolean").withColumn("text", F.coalesce("text", F.lit(""))).repartition(3)), "forms")
    scores = quality.gram_scores(counts, *quality.train(counts))
    rows = spark.createDataFrame(docs[:5] + odd, "row long, text string").withColumn("lang", F.lit("en")).withColumn("trusted", F.lit(False)).withColumn("text", F.coalesce("text", F.lit("")))
    got = {r["row"]: (r["nll"], r["symbols"]) for r in quality.perplexities(rows, scores, hot).collect()}
    prob = plain_model([t for _, t in docs])
    for i, t in docs[:5] + odd:
        want = plain_nll(prob, t)
        assert got[i][1] == want[1] and abs(got[i][0] - want[0]) < 1e-4 * max(1, want[0]), (i, got[i], want)


@pytest.mark.parametrize("width", [12, 3])
def test_grams_of_forms(monkeypatch, width):
    """As the plain definition, whether or not a slice's symbols fit the numbers."""
    import pyarrow as pa

    monkeypatch.setattr(quality, "WIDTH", width)
    listed = quality.pieces(pa.array(["the the cat 12", None, "", "漢字かな " + "é😀z" * 40, "a"]))[2]
    found, which, at = quality.grams(listed)
    names = found.to_pylist()
    for i, form in enumerate(listed):
        first = 1 if form[0] == " " else quality.ORDER - 1
        assert [names[k] for k in which[at[i] : at[i + 1]]] == [form[max(0, p + 1 - N) : p + 1] for p in range(first, len(form))]


def test_probabilities_sum_to_one():
    texts = ["abc abd ab ab", "bcd a", "dcb abc abc"]
    prob = plain_model(texts)
    for context in ("", "_", "_a", "b", "zz"):
        seen = {c for t in texts for s in sequences(t) for c in s[1:]}
        assert abs(sum(prob(context + c) for c in seen) + prob(context + "?") - 1) < 1e-9


def test_thresholds_and_kept_against_a_plain_version(spark):
    """The whole of judge(): model, held documents, medians and quantiles by language, shrunk to those of all."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    rows = {r["doc_id"]: r for r in docs.withColumn("hold", F.pmod(F.xxhash64("doc_id"), F.lit(quality.HOLD)) == 0).collect()}
    prob = plain_model([r["text"] for d, r in rows.items() if d in good and not r["hold"]])
    sums = {d: plain_nll(prob, r["text"]) for d, r in rows.items()}
    held = [d for d, r in rows.items() if d in good and r["hold"] and sums[d][1]]

    def quantiles(value, at):
        one = lambda ids: sorted(value[d] for d in ids)[max(0, math.ceil(at * len(ids)) - 1)]
        of = {lang: [d for d in held if rows[d]["lang"] == lang] for lang in {rows[d]["lang"] for d in held}}
        return {k: (len(v) * one(v) + quality.LEAST * one(held)) / (len(v) + quality.LEAST) for k, v in of.items()} | {None: one(held)}

    m = quantiles({d: sums[d][0] / sums[d][1] for d in held}, 0.5)
    x = {d: (n + quality.PRIOR * m.get(rows[d]["lang"], m[None])) / (k + quality.PRIOR) for d, (n, k) in sums.items()}
    u = quantiles(x, quality.UPPER)
    for r in quality.judge(docs, labels).collect():
        limit = m.get(r["lang"], m[None]) + quality.SLACK * (u.get(r["lang"], u[None]) - m.get(r["lang"], m[None]))
        assert abs(r["threshold"] - math.exp(limit)) < 1e-4 * math.exp(limit) and abs(r["perplexity"] - math.exp(x[r["doc_id"]])) < 1e-4 * r["perplexity"]
        assert abs(x[r["doc_id"]] - limit) < 1e-6 or r["kept"] == (x[r["doc_id"]] <= limit)


def test_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality.judge(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    rate = {r["quality"]: r["k"] for r in kept}
    assert rate[1] >= 0.985 and rate[0] <= 0.15
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and 700 < good.count() < 1000


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "ab", None, 1), (1, None, "en", 2), (1, "ab ab", "en", 3), (2, "", None, 4)], "doc_id long, text string, lang string, quality int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.judge(docs, labels).count() == 4
    assert {r["kept"] for r in quality.judge(docs, labels.limit(0)).collect()} == {True}
    assert quality.judge(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("sf, junk", [("sf0.001", 0.2), ("sf0.01", 0.02)])
def test_little_junk_stays(spark, sf, junk):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.judge(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    rate = {r["quality"]: r["k"] for r in kept}
    assert rate[1] >= 0.985 and rate[0] <= junk

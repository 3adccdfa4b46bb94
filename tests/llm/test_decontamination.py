"""Operator 8 against a plain search for every window in every document."""

import hashlib
import random
import re

import pytest

from postmill.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOW))


def plain(docs, items):
    out = {}
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        where = {}
        for i, x in enumerate(w):
            where.setdefault(x, []).append(i)
        for name, text in items:
            v = words(text)
            n = min(13, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for i in where.get(v[k], []):
                    if w[i : i + n] == v[k : k + n]:
                        hit |= set(range(i, i + n))
                        names.add(str(name))
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def data(seed=2):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "a"] * 8 + [f"w{i}" for i in range(60)] + ["é1", "Ω"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 12, 13, 14, 30, 50])))) for i in range(60)] + [(100, None), (101, "Same, same; SAME")]
    docs = []
    for d in range(150):
        w = rng.choices(vocab, k=rng.choice([0, 3, 30, 300]))
        for _ in range(rng.choice([0, 1, 2])):
            v = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(v) - 13))
            at = rng.randint(0, len(w))
            w[at:at] = v[a : a + rng.choice([12, 13, 20, 60])]
        docs.append((d * 7, rng.choice([" ", ", ", "\n", " - "]).join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in w)))
    return [*docs, (-1, None), (-2, ""), (-3, "same same same same the")], items


@pytest.mark.parametrize("limits", [{}, {"pass_words": 90}, {"most": 7}, {"windows": 5}])
def test_against_plain_search(spark, monkeypatch, limits):
    monkeypatch.setattr(dc.build_index, "__defaults__", (400, *dc.build_index.__defaults__[1:]))
    monkeypatch.setattr(dc.phrase_hits, "__defaults__", (limits.get("most", 1 << 20), limits.get("windows", 1 << 16)))
    limits = {k: v for k, v in limits.items() if k == "pass_words"}
    docs, items = data()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in dc.contamination(df, bench, **limits).collect()}
    assert got == plain(docs, items)
    kept = {r["doc_id"] for r in dc.decontaminate(df, bench, **limits).collect()}
    assert kept == {d for d, v in got.items() if not v[4]} and dc.decontaminate(df, bench).columns == df.columns


def test_near_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    w = item.split()
    docs = [(1, "x " + item), (2, "x y " + " ".join([*w[:4], "odd", *w[5:]])), (3, " ".join([*w[:6], "two", "more", *w[6:]])), (4, " ".join(reversed(w))), (5, " ".join(w[:7])), (6, "nothing at all")]
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_items"], r["near_items"]) for r in dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: (1, ""), 2: (0, "9"), 3: (0, "9"), 4: (0, ""), 5: (0, ""), 6: (0, "")}


def plain_near(docs, items):
    """{doc_id: ids of items with a near window and no exact one}, trying every window at every place of every document."""
    exact = {d: {str(i) for i, t in items if plain([(d, text)], [(i, t)])[d][2]} for d, text in docs}
    out = {}
    for d, text in docs:
        where = {}
        for p, x in enumerate(words(text)):
            where.setdefault(x, []).append(p)
        near = set()
        for name, t in items:
            v = words(t)
            n = min(13, len(v))
            stands = {}  # (word of the item, place of the item's first word): within the slop
            for j, x in enumerate(v):
                for p in where.get(x, []):
                    for s in range(-3, 4):
                        stands.setdefault(p - j + s, set()).add(j)
            if n and any(5 * len(js & set(range(w, w + n))) >= 4 * n for js in stands.values() for w in range(len(v) - n + 1)):
                near.add(str(name))
        out[d] = ",".join(sorted(near - exact[d]))
    return out


@pytest.mark.parametrize("limits", [{}, {"pass_words": 90}])
def test_near_against_plain_search(spark, monkeypatch, limits):
    """Quotes of 13 words and fewer at every offset of an item of 40 words, with changed and moved words; short items; short documents."""
    monkeypatch.setattr(dc.build_index, "__defaults__", (300, *dc.build_index.__defaults__[1:]))
    rng = random.Random(4)
    vocab = ["the", "of", "and"] * 6 + [f"w{i}" for i in range(50)]
    long_, short, other = [f"q{i}" for i in range(40)], ["s1", "s2", "of", "s4", "s5", "s6"], rng.choices(vocab, k=150)
    items = [(1, " ".join(long_)), (2, " ".join(short)), (3, "the w1"), (4, " ".join(other)), (5, ""), (6, "w7")]
    texts = []
    for a in range(28):
        for source in (long_, other):
            quote = source[a : a + 13]
            for k in rng.sample(range(13), rng.choice([1, 1, 2, 2, 3])):
                quote[k] = f"x{k}"
            if rng.random() < 0.4:
                at = rng.randrange(13)
                quote[at:at] = ["x"] * rng.randint(1, 3)
            texts.append(rng.choices(vocab, k=rng.choice([0, 3, 20])) + quote + rng.choices(vocab, k=rng.choice([0, 0, 9])))
    texts += [["s1", "s2", "x", "s4", "s5", "s6"], ["s2", "s1", "s4", "s6"], ["w1", "the"], ["w1", "x", "x", "the"], ["s1", "s2"], ["of", "s4", "s5", "s6"], other[60:80] + ["x"] + other[81:90], []]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["near_items"] for r in dc.contamination(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"), **limits).collect()}
    want = plain_near(docs, items)
    assert got == want and sum("1" in v.split(",") for v in want.values()) > 15


def test_near_match_whose_rarest_words_are_changed(spark):
    w = [f"q{i}" for i in range(40)]
    quote = [*w[3:8], "x", *w[9:13], "y", *w[14:16]]  # words 3..15 without 8 and 13, the rarest
    docs = [(1, " ".join(quote)), (2, " ".join(reversed(w))), (3, "q8 q13")] + [(10 + i, " ".join(v for v in reversed(w) if v not in ("q8", "q13"))) for i in range(3)]
    got = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([(9, " ".join(w))], "item_id long, text string"))
    assert {r["doc_id"] for r in got.filter("near_items <> ''").collect()} == {1}


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b"), (2, "b"), (2, "a")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in dc.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(None, 2, 2, 2, True), (3, 2, 2, 2, True), (3, 2, 2, 2, True), (4, 0, 0, 0, False)], key=str)
    assert dc.contamination(docs.limit(0), bench).count() == 0
    assert [r["n_hit"] for r in dc.contamination(docs, bench.limit(0)).collect()] == [0] * 4


def test_real_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in dc.contamination(docs, bench).collect()}
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert any(v[4] for v in got.values())


def test_query_with_near_matches(spark, tmp_path):
    """op8's rows, exact and near, are those of its SQL."""
    import duckdb

    import __spark_entry__ as entry

    item, rng = [f"q{i}" for i in range(20)], random.Random(6)
    docs = [(1, " ".join(item)), (2, " ".join([*item[3:9], "x", *item[10:16]])), (3, "no"), (4, None), (5, "s1 x s3 s4 s5")]
    docs += [(10 + i, " ".join(rng.choices(item, k=3) + [w for w in item[rng.randrange(8) :] if rng.random() < 0.9])) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, " ".join(item)), (7, "s1 s2 s3 s4 s5"), (8, ""), (6, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op8_positional_index", "near_passages"):
        got = entry.queries()[name](spark, str(tmp_path))
        want = duck.sql(entry.oracle_sql()[name])
        assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall()), name
    got = {r["doc_id"]: r["near_items"] for r in entry.queries()["op8_positional_index"](spark, str(tmp_path)).collect()}
    assert got[1] == got[3] == got[4] == "" and got[2] == "9" and got[5] == "7" and len([v for v in got.values() if v]) > 10


def test_one_index_for_two_benchmarks(spark):
    """The index has every word's positions, and knows no benchmark."""
    docs, items = data(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = dc.build_index(df, block_words=500)
    for own in (items[:30], items[30:], [(1, "no such words")]):
        bench = spark.createDataFrame(own, "item_id long, text string")
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in dc.contamination_by(index, bench).collect()}
        assert got == plain(docs, own)
    held = {}
    for r in index.filter("term <> ''").collect():
        held[r["term"]] = held.get(r["term"], 0) + len(r["positions"]) // 4
    want = {}
    for _, t in docs:
        for w in words(t):
            want[w] = want.get(w, 0) + 1
    assert held == want


def test_index_with_too_small_gaps(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    with pytest.raises(Exception, match="gaps of 13 words"):
        dc.contamination_by(dc.build_index(docs, gap=13), bench).collect()
    assert dc.contamination_by(dc.build_index(docs, gap=13), bench, near=None).first()["n_hit"] == 2

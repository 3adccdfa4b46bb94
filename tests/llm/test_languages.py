"""Operator 2: accuracy on documents that training didn't see."""

import math
import zlib

import numpy as np
import pytest
import pyarrow as pa

from postmill.llm import languages


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = languages.identify(docs).toPandas().merge(docs.select("doc_id", "lang", "text").toPandas(), on="doc_id")
    assert len(got) == 1000 and ((got["score"] >= 0) & (got["score"] <= 1)).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98
    assert (held[held["accepted"]]["lang_pred"] == held[held["accepted"]]["lang"]).mean() > 0.985 and held["accepted"].mean() > 0.8


def plain_features(text):
    """Bucket numbers of a text's subwords, one byte after the other."""
    x, last = [], None
    for b in text.lower().encode():
        letter = b >= 128 or 97 <= b <= 122
        if letter or last:
            x.append(b if letter else 32)
        last = letter
    pad, out = x + [32] * (max(languages.GRAMS) - 1), []
    for i in range(len(x)):
        for g in languages.GRAMS:
            code = g * 0x1F123BB5 & 0xFFFFFFFF
            for k in range(g):
                code = (code ^ pad[i + k]) * 0x01000193 & 0xFFFFFFFF
            out.append(((code ^ code >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 19)
    return out


def test_features_and_probabilities_against_plain_ones():
    texts = ["The cat, the CAT.", "", None, " 12 é😀 ", "straße", "x", "a b", "ß" * 50]
    codes, at = languages.features(pa.array(texts, pa.string()))
    assert [codes[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain_features(t or "") for t in texts]
    rng = np.random.default_rng(2)
    model = languages.Model(["a", "b", "c"], rng.normal(size=(languages.BUCKETS, 3)).astype(np.float32), rng.normal(size=3), 0.7, 0.5)
    for t, got in zip(texts, model.probabilities(pa.array(texts, pa.string())), strict=True):
        own = plain_features(t or "")
        z = [(sum(float(model.scores[c, k]) for c in own) / max(1, len(own)) + model.bias[k]) / 0.7 for k in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        assert np.allclose(got, [v / sum(e) for v in e], atol=1e-5)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "this is a long english text " * 60_000, "en", 1.0), (2, "kurz", "de", 2.0), (3, None, None, 3.0)], "doc_id long, text string, lang string, score double")
    assert languages.identify(docs).count() == 3


def test_only_training_folds_and_text_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {r["doc_id"]: r for r in languages.identify(docs).collect()}
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(languages.fold() == 1, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("y"))
    b = {r["doc_id"]: r for r in languages.identify(changed.repartition(3)).collect()}
    assert a.keys() == b.keys() and all(a[d][:3] == b[d][:3] and abs(a[d]["score"] - b[d]["score"]) < 1e-4 for d in a)


def test_odd_rows(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_001, None, "en"), (10_002, "", "en"), (10_003, " 12 ... !", None), (None, "the and of", None), (10_004, "ﾊﾛｰ", None), (10_005, "the " * 50_000, None), (10_005, "é", None)], "doc_id long, text string, lang string")
    got = languages.identify(real.unionByName(odd)).filter("doc_id is null or doc_id > 10000").collect()
    assert len(got) == 7
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 10_005}
    assert [by[d]["lang_pred"] for d in (10_001, 10_002, 10_003)] == ["und"] * 3 and by[10_001]["score"] == 0
    assert by[None]["lang_pred"] == "en" and by[None]["held_out"] is False and by[10_004]["lang_pred"] != "und"
    empty = real.limit(0)
    assert languages.identify(empty).count() == 0
    bare = odd.withColumn("lang", odd["doc_id"].cast("string").substr(0, 0))
    assert {tuple(r)[1:] for r in languages.predict(bare, languages.fit(bare.limit(0))).collect()} == {("und", 0.0, False)}
    with pytest.raises(ValueError, match="different values"):
        languages.fit(spark.range(2000).selectExpr("id doc_id", "'a' text", "cast(id as string) lang"))


def test_temperature_and_threshold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    m = languages.fit(docs, per_language=60)
    assert 0.05 <= m.temperature <= 20 and 0 < m.threshold <= 1 and m.langs == ["de", "en", "es", "fr"]
    assert np.isfinite(m.scores).all()

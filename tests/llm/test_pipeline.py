"""The pipeline's stages by brute force on the smallest table."""

import corpus_pipeline as cp
from tests.llm.test_decontamination import plain as plain_contamination
from tests.llm.test_near_duplicates import plain as plain_groups
from tests.llm.test_tokens import plain as plain_secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from postmill.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES[:4]:
        if name == "secrets":
            docs = docs.unionByName(spark.createDataFrame([(10_000, "so token = abcdefgh1 it is", "en", "s", 26), (10_001, None, None, None, None)], docs.schema))
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        seen[name] = (before, after)
    before, after = seen["quality"]
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert len(good & after.keys()) >= 0.98 * len(good) and len(bad & after.keys()) <= 0.2 * len(bad)
    before, after = seen["near_duplicates"]
    groups = plain_groups([(d, r["text"]) for d, r in before.items()], 5)
    assert after.keys() == {d for d, (_, c) in groups.items() if c == d} and all(after[d] == before[d] for d in after)
    before, after = seen["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = plain_contamination([(d, r["text"]) for d, r in before.items()], items)
    assert after.keys() == {d for d, v in hit.items() if not v[4]}
    before, after = seen["secrets"]
    assert after.keys() == before.keys() and any(plain_secrets(r["text"] or "") for r in before.values())
    assert not any(plain_secrets(r["text"] or "") for r in after.values()) and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in after.values())
    assert all(after[d] == before[d] for d in after if not plain_secrets(before[d]["text"] or ""))
    packed = cp.packing(spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == after.keys()


def small(spark, where, docs, labels=(), items=()):
    extra = "row long, gram string, node string, bin int, cluster string, shard int, `component_id` string, hits int, at int, kept boolean, good string, item_id int"
    names = [c.split()[0].strip("`") for c in extra.split(", ")]
    rows = [(*d, *([None] * len(names) if i % 2 else [i, "g", "n", i, "c", i, "k", i, i, False, "x", i])) for i, d in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + extra).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, other columns of the operators' own names."""
    phrase = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "plain words here and there", "en", "s", 26), (1, "plain words here and there", "en", "s", 26), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id at all", "en", None, 12), (4, "long text of words " * 60_000, "en", "s", 5)]
    docs += [(5, phrase, "en", "s", 9), (6, "token = abcdefgh1 so", "de", "s", 9), (7, "so much the same text as the one that follows it in all but one", "en", "s", 1), (8, "so much the same text as the one that follows it in all but one", "en", "t", 1)]
    sf = small(spark, tmp_path, docs, [(1, 1, 0), (7, 1, None), (None, None, None)], [(1, phrase), (None, None)])
    from postmill.llm.common import stored

    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = now.columns, {}
    for name, stage in cp.STAGES[:4]:
        now = stored(stage(spark, now, sf), name)
        assert now.columns == columns
        ids[name] = sorted(r["doc_id"] for r in now.filter("doc_id is not null").collect())
        assert now.filter("doc_id is null").count() == 1
        assert name == "quality" or len(ids[name]) == len(set(ids[name]))
    assert set(ids["near_duplicates"]) == set(ids["quality"]) - {8} and set(ids["decontamination"]) == set(ids["near_duplicates"]) - {5} and ids["secrets"] == ids["decontamination"]
    kept = {r["doc_id"]: r for r in now.collect()}
    assert 6 not in kept or kept[6]["text"] == "[secret] so"
    packed = cp.packing(spark, now, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept.keys()
    assert cp.run(spark, sf).count() == packed.count()


def test_null_and_repeated_ids_are_judged(spark, tmp_path):
    """A contaminated row without an id goes, a clean one of a bad one's id stays; copies go whatever their ids."""
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(None, item, "en", "s", 9), (5, item, "en", "s", 9), (5, "a clean text of the same id", "en", "s", 27), (None, "a text without any id at all", "en", "s", 1), (None, "a text without any id at all", "de", None, 1), (9, "one more text that has copies", "en", "s", 1), (7, "one more text that has copies", "en", "s", 1), (None, "one more text that has copies", "en", "s", 1), (None, None, None, None, None), (None, None, None, None, None)]
    sf = small(spark, tmp_path, docs, [(5, 1, 0)], [(1, item)])
    now = spark.read.parquet(f"{sf}/documents.parquet")
    said = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    pairs = [(d, t) for d, t, *_ in docs]
    assert said(cp.decontamination(spark, now, sf)) == sorted(((d, t) for d, t in pairs if t != item), key=str)
    once = said(cp.near_duplicates(spark, now, sf))
    assert once == sorted([(5, item), (5, pairs[2][1]), (None, pairs[3][1]), (7, pairs[6][1]), (None, None), (None, None)], key=str)
    assert said(cp.quality(spark, now, sf)) == sorted(pairs, key=str)


def test_empty_tables(spark, tmp_path):
    sf = small(spark, tmp_path, [])
    assert cp.run(spark, sf).count() == 0
    (tmp_path / "no_labels").mkdir()
    some = small(spark, tmp_path / "no_labels", [(i, f"text {i}", "en", "s", 6) for i in range(4)])
    assert {r["doc_id"] for r in cp.run(spark, some).collect()} == {0, 1, 2, 3}


def test_run(spark):
    assert cp.run(spark, SF).count() > 100

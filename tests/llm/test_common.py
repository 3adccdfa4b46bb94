"""Helpers that all operators lean on."""

from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.llm import common


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\xa0éZ", max_size=8)), max_size=6))
def test_split_words(texts):
    codes, at, words = common.split_words(pa.array(texts, pa.string()), common.LOWER)
    listed = words.to_pylist()
    low = {i: i + 32 for i in range(65, 91)}
    want = [[w for w in (t or "").translate(low).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if w] for t in texts]
    assert [[listed[c] for c in codes[i:j]] for i, j in zip(at[:-1], at[1:], strict=True)] == want


def test_slices_hold_bytes_and_rows():
    batch = pa.record_batch([pa.array(range(9)), pa.array(["x" * n for n in (1, 1, 50, 1, 1, 1, 1, 1, 1)])], names=["i", "text"])
    got = [s.column(0).to_pylist() for s in common.slices(iter([batch]), "text", 10, 4)]
    assert got == [[0, 1], [2], [3, 4, 5, 6], [7, 8]]
    sliced = list(common.slices(iter([batch.slice(3, 3)]), "text", 2))
    assert [s.column(0).to_pylist() for s in sliced] == [[3, 4], [5]]


def test_arrays():
    assert common.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert common.sums_by_row(np.array([1, 2, 3]), np.array([0, 2, 2, 3])).tolist() == [3, 0, 3]
    data, at = common.utf8(pa.array(["é", None, "a"]).slice(1))
    assert bytes(data) == b"a" and at.tolist() == [0, 0, 1]


def test_forget_and_shared_dir(spark, monkeypatch):
    kept, gone = (common.stored(spark.range(3), "t") for _ in range(2))
    common.forget(gone, spark.range(1))
    assert kept.count() == 3
    with pytest.raises(Exception, match="."):
        gone.count()

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d: None)})()
        sparkContext = MagicMock(master="local-cluster[3,2,1000]")
        sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster())


def test_stored_and_cleared(spark):
    df = common.stored(spark.createDataFrame([(1,), (None,)], "a int"), "t")
    assert sorted(map(tuple, df.collect()), key=str) == [(1,), (None,)]
    docs = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (None, "c", 0), (None, "d", 0)], "doc_id int, text string, Row int")
    rows, row = common.numbered(docs, "t")
    assert row == "row_" and rows.select(row).distinct().count() == 4
    left = common.without(rows, row, rows.filter("text in ('a', 'c')").select(F.col(row).alias("doc_id")))
    assert left.columns == docs.columns and sorted(r["text"] for r in left.collect()) == ["b", "d"]
    common.clear_stored(spark)
    with pytest.raises(Exception, match="."):
        df.count()

"""Joins on messages of tables that are bucketed alike: no exchange below them."""

import re

import pytest

from postmill.operators import classify, clusters
from postmill.operators.colocated import KEYS, colocated
from postmill.sources import mailbox as box

SF = "/root/testdata/sf0.001"
MOVED = re.compile(r"Exchange hashpartitioning\(account_id#\d+, provider_msg_id#\d+")


@pytest.fixture(scope="module")
def plain(spark):
    return {"messages": box.messages(spark, SF), "members": box.members(spark, SF), "embeddings": box.embeddings(spark, SF)}


@pytest.fixture(scope="module")
def bucketed(plain, tmp_path_factory):
    return colocated(plain, 6, f"file://{tmp_path_factory.mktemp('b')}")


@pytest.fixture
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


JOINS = {
    "embedded": lambda t: t["messages"].join(t["embeddings"].select(*KEYS, "embedding"), KEYS),
    "missing": lambda t: clusters.missing_embeddings(t["messages"], t["embeddings"]),
    "members": lambda t: t["members"].join(t["messages"], KEYS).join(t["embeddings"].select(*KEYS), KEYS),
    "summaries": lambda t: clusters.summaries(t["members"], t["messages"]),
    "newest": lambda t: clusters.expand(t["members"], t["messages"]),
    "representatives": lambda t: classify.representatives(t["members"], t["messages"]),
}


@pytest.mark.parametrize("name", JOINS)
def test_no_exchange_below_the_join(plain, bucketed, no_broadcast, name):
    join = JOINS[name]
    a, b = join(bucketed), join(plain)
    assert MOVED.search(plan(b)) and not MOVED.search(plan(a)) and "SortMergeJoin" in plan(a)
    if name in ("embedded", "missing", "members"):
        assert "Exchange" not in plan(a)
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def test_one_file_for_each_bucket(bucketed):
    assert len(bucketed["messages"].inputFiles()) <= 6

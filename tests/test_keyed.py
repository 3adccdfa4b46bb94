"""Keyed state of the change feed: pages in turn, restarts, stalled walks, folds."""

import json
import time

import pytest
from pyspark.sql import functions as F

from postmill.schema import FEED, LANDED, TABLES
from postmill.streaming import keyed


def page(account, n, added=(), deleted=()):
    ref = lambda ids: [{"message": {"id": i}} for i in ids]
    return (account, "gmail_history", n, json.dumps({"history": [{"id": "1", "messagesAdded": ref(added), "messagesDeleted": ref(deleted)}], "historyId": str(n)}))


def body(account, n, m, subject, history="1"):
    return (account, n, json.dumps({"id": m, "threadId": "t", "historyId": history, "labelIds": ["L"], "payload": {"headers": [{"name": "Subject", "value": subject}]}}))


def land(spark, where, rows):
    spark.createDataFrame(rows, LANDED).coalesce(1).write.json(f"{where}/landed", mode="append")


@pytest.fixture
def known(spark):
    m = spark.createDataFrame([("a", "old", "was", 5), ("a", "gone", "was", 5), ("a", "idle", "was", 5)], "account_id string, provider_msg_id string, subject string, history_id long")
    return spark.createDataFrame([], TABLES["messages"]).unionByName(m, allowMissingColumns=True)


def test_feed_with_restarts(spark, known, tmp_path):
    """Pages that come late are waited for, repeated ones are left out, and each run goes on where the last ended."""
    bodies = spark.createDataFrame([body("a", 0, "new", "first"), body("a", 1, "old", "changed"), body("a", 3, "gone", "back"), body("a", 2, "new", "second"), body("b", 0, "x", "y")], "account_id string, page long, body string")

    def run():
        keyed.feed(spark, f"{tmp_path}/landed", known, bodies, f"{tmp_path}/log", f"{tmp_path}/c")
        log = spark.read.schema(keyed.CHANGED).parquet(f"{tmp_path}/log")
        return {(r["account_id"], r["provider_msg_id"]): (r["subject"], r["kept"]) for r in keyed.after_feed(known, log).collect()}, log.count()

    land(spark, tmp_path, [page("a", 3, ["gone"]), page("a", 1, ["old"], ["gone"]), page("b", 0, ["x"]), page("b", 0, ["x"])])
    before = {("a", m): ("was", True) for m in ("old", "gone", "idle")}
    assert run()[0] == before | {("b", "x"): ("y", False)}  # a's page 0 isn't there
    land(spark, tmp_path, [page("a", 0, ["new"]), page("a", 1, ["old"], ["gone"])])
    got = run()[0]
    assert ("a", "gone") not in got and got["a", "old"] == ("changed", True) and got["a", "new"] == ("first", False)
    land(spark, tmp_path, [page("a", 2, ["new"]), page("a", 4, [], ["idle", "never"]), page("a", 1, [], ["old"])])
    got, n = run()
    assert got == {("a", "old"): ("changed", True), ("a", "gone"): ("back", False), ("a", "new"): ("second", False), ("b", "x"): ("y", False)}
    assert run() == (got, n)  # nothing new


def test_stalled_walks_are_told_and_go_on(spark, tmp_path):
    def run(rows):
        land(spark, tmp_path, rows)
        with keyed.state_store(spark):
            df = keyed.in_turn(spark.readStream.schema(LANDED).json(f"{tmp_path}/landed"), 1)
            df.writeStream.format("parquet").option("path", f"{tmp_path}/t").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        time.sleep(0.05)
        return sorted(tuple(r) for r in spark.read.schema(keyed.TURNS).parquet(f"{tmp_path}/t").select("account_id", "kind", "page", F.coalesce("waiting", F.lit(0))).collect())

    assert run([page("a", 2), page("a", 1), page("b", 0)]) == [("b", "gmail_history", 0, 0)]
    told = [("a", "stalled", 0, 2), ("b", "gmail_history", 0, 0), ("b", "gmail_history", 1, 0)]
    assert run([page("b", 1)]) == told
    assert run([page("a", 0)]) == sorted([*told, *(("a", "gmail_history", n, 0) for n in range(3))])


def test_no_message_is_handed_to_python(spark, known):
    """Only pages in turn are keyed state in Python; the fold by message isn't, and null history ids don't replace one."""
    rows = [(0, 0, "upsert", "a", "old", "s0", None), (1, 0, "delete", "a", "gone", None, None), (2, 0, "upsert", "a", "gone", "s2", None), (3, 0, "upsert", "a", "new", "s3", 8), (4, 0, "upsert", "a", "new", "s4", None)]
    feed = spark.createDataFrame([], FEED).unionByName(spark.createDataFrame(rows, "page long, seq long, op string, account_id string, provider_msg_id string, subject string, history_id long"), allowMissingColumns=True)
    folded = keyed.folded_stream(feed).withColumn("version", F.lit(1).cast("long"))
    got = {r["provider_msg_id"]: (r["subject"], r["history_id"], r["kept"]) for r in keyed.after_feed(known, folded).collect()}
    assert got == {"old": ("s0", 5, True), "gone": ("s2", None, False), "new": ("s4", 8, False), "idle": ("was", 5, True)}
    assert "InPandas" not in folded._jdf.queryExecution().toString()

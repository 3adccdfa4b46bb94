"""What only tables beyond some size show: exports without an end, groups that joins would split, long pages."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from postmill.operators import audit, classify, store
from postmill.schema import TABLES
from postmill.streaming import sync


def test_exports_have_all_rows(spark):
    """More rows than the export took at most before, numbered newest first by more than one task."""
    n = 100_003
    own = {"id": F.col("id"), "account_id": F.when(F.col("id") % n == 7, "b").otherwise("a"), "executed_at": F.timestamp_seconds(F.col("id") % 1000), "outcome": F.lit("success"), "error_message": F.lit("x,y")}
    log = spark.range(n, numPartitions=4).select(*[own.get(c, F.lit(None).cast(t)).alias(c) for c, t in (x.split() for x in TABLES["actions_log"].split(", "))])
    out = audit.export_csv(log.withColumn("executed_at", F.date_format("executed_at", "mm:ss")), account="a")
    assert out.count() == out.select("n").distinct().count() == n
    lines = {r["n"]: r["line"] for r in out.filter(f"n <= 2 or n = {n - 1}").collect()}
    assert lines == {0: ",".join(audit.CSV_COLUMNS), 1: '99999,16:39,success,,,,,"x,y"', 2: '98999,16:39,success,,,,,"x,y"', n - 1: '0,00:00,success,,,,,"x,y"'}
    few = audit.export_json(log.select("id", "executed_at", "account_id"), 2).select("n", F.regexp_replace("line", '"executed_at":"[^"]*",', "").alias("line"))
    assert sorted((r["n"], r["line"]) for r in few.collect()) == [(0, "["), (1, '{"id":99999,"account_id":"a"},'), (2, '{"id":98999,"account_id":"a"}'), (1 << 62, "]")]
    every = audit.export_json(log.select("id", "executed_at"))
    assert every.count() == n + 2 and every.filter("line like '%}'").count() == 1


def test_clusters_that_a_join_splits(spark, tmp_path):
    """A cluster is one row also where Spark splits its partition in the join before."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    before = {k: spark.conf.get(k) for k in conf}
    members = spark.range(40_000, numPartitions=8).selectExpr("'a' account_id", "concat('m', lpad(id, 6, '0')) provider_msg_id", "if(id % 50 = 0, concat('c', id % 500), 'big') cluster_key", "cast(1 as float) centroid_cosine")
    members.write.parquet(str(tmp_path / "m"))
    members = spark.read.parquet(str(tmp_path / "m"))
    messages = members.select("account_id", "provider_msg_id", F.lit("s").alias("sender"), F.lit("t").alias("subject"), F.lit("x").alias("snippet"), F.lit(1).cast("long").alias("internal_date"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r["cluster_key"]: r for r in classify.to_classify(members, messages, store.empty(spark, "cluster_classifications"), "m", "p", most=25).collect()}
        n = classify.to_classify(members, messages, store.empty(spark, "cluster_classifications"), "m", "p", most=25).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert n == len(got) == 11 and got["big"]["member_count"] == 39_200
    assert got["big"]["cluster_signature"] == hashlib.sha256(("big|" + "".join(f"m{i:06}," for i in range(40_000) if i % 50)).encode()).hexdigest()


def test_long_pages_are_not_lost(spark, tmp_path):
    """A history page of more than 20 million characters is applied; a landed line that isn't JSON ends the run."""
    body = json.dumps({"history": [{"id": "1", "labelsAdded": [{"message": {"id": "m1"}}]}], "historyId": "9", "more": "x" * 20_500_000})
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed/1.json").write_text(json.dumps({"account_id": "a", "kind": "gmail_history", "page": 0, "body": body}) + "\n")
    own = json.dumps({"id": "m1", "threadId": "t", "historyId": "3", "payload": {"headers": [{"name": "Subject", "value": "s"}]}})
    fetch = lambda ids: ids.select("account_id", F.lit(own).alias("body"))
    run = lambda: sync.run(spark, f"{tmp_path}/landed", f"{tmp_path}/tables", f"{tmp_path}/c", fetch, buckets=2)
    run()
    tables = store.Tables(spark, f"{tmp_path}/tables", 2)
    assert [(r["provider_msg_id"], r["subject"]) for r in tables.read("messages").collect()] == [("m1", "s")]
    assert tables.read("sync_state").first()["last_history_id"] == 9
    (tmp_path / "landed/2.json").write_text('{"account_id": "a", "kind"\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST"):
        run()

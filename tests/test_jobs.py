"""Mutations by tasks, each call once, and the interruption of running jobs."""

import glob
import json
import threading
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.operators import actions, classify, jobs, store
from postmill.plans import work
from postmill.schema import TABLES
from postmill.sources import mutations
from tests.test_rest import server  # noqa: F401

AT = "2024-03-01 00:00:00"


@pytest.fixture
def mail(spark):
    """Two clusters; m1 is named by two staged rows, and one staged row can't be carried out."""
    members = [("a", f"m{i}", "k" if i < 25 else "l", 1.0) for i in range(30)]
    clusters = spark.createDataFrame(members, "account_id string, provider_msg_id string, cluster_key string, centroid_cosine double")
    messages = clusters.select("account_id", "provider_msg_id", F.array(F.lit("INBOX")).alias("label_ids"))
    rows = [(1, "k", None, "archive", 0), (2, "k", "m1", "trash", 1), (3, "l", None, "mark_read", 2), (4, "l", "m29", "unsubscribe", 3), (5, "none", None, "trash", 4)]
    staged = spark.createDataFrame(rows, "id long, cluster_key string, provider_msg_id string, action_type string, s long").withColumns({"account_id": F.lit("a"), "staged_at": F.timestamp_seconds("s")}).drop("s")
    return staged, clusters, messages, store.empty(spark, "actions_log")


def modified(seen):
    return [(tuple(b["ids"]), tuple(b["addLabelIds"]), tuple(b["removeLabelIds"])) for _, path, _, b, _ in seen if path.endswith("batchModify")]


def test_tasks_make_each_call_once(spark, server, mail, tmp_path):  # noqa: F811
    url, seen, _ = server
    options, journal, at = {"provider": "gmail", "base_url": url, "token": "T"}, f"file://{tmp_path}/j", F.lit(AT).cast("timestamp")
    run = lambda: actions.execute_in_tasks(*mail, options, at, journal, chunk=10, tasks=3)
    new, left = run()
    calls = modified(seen)
    assert len(calls) == len(set(calls)) == 5 and sorted(len(c[0]) for c in calls) == [1, 5, 5, 10, 10]
    trash = calls.index((("m1",), ("TRASH",), ("INBOX",)))
    assert trash == 4 and any("m1" in c[0] for c in calls[:trash])  # staged later, called later
    log = {(r["cluster_key"], r["provider_msg_id"], r["action_type"]): r for r in new.collect()}
    assert len(log) == 32 and sum(r["outcome"] == "success" for r in log.values()) == 31
    assert log["l", "m29", "unsubscribe"]["outcome"] == "failure" and "can't be executed" in log["l", "m29", "unsubscribe"]["error_message"]
    assert log["k", "m1", "trash"]["reversal_kind"] == "untrash" and log["k", "m1", "trash"]["prior_label_ids"] == ["INBOX"] and left.count() == 0
    again, _ = run()
    assert again.count() == 32 and modified(seen) == calls
    assert json.loads(open(f"{tmp_path}/j/committed").readlines()[-1]) == {"repeated": 2}


def test_failing_tasks(spark, server, mail, tmp_path):  # noqa: F811
    """A job that dies on the way, then a second one: every call is made, none twice; one without an answer isn't repeated."""
    url, seen, _ = server
    rows = [(i, 0, 0, "archive", [f"m{i}"]) for i in range(40)]
    calls = spark.createDataFrame(rows, mutations.CALLS)
    options = {"provider": "gmail", "base_url": url, "token": "T", "journal": f"file://{tmp_path}/j"}
    writer = mutations.Writer(options)
    table = calls.toArrow()

    def dying():
        yield table.to_batches()[0].slice(0, 7)
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dying())
    assert len(modified(seen)) == 7
    lost = glob.glob(f"{tmp_path}/j/calls/*/*.json")[0]
    (tmp_path / lost).unlink()  # asked, and lost before its answer was noted
    broken = calls.repartition(2, "staged_action_id").withColumn("action_type", F.when(F.col("staged_action_id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.col("action_type")))
    with pytest.raises(Exception, match="broken"):
        broken.write.format("mail_mutations").mode("append").options(**options).save()
    assert (tmp_path / "j/aborted").exists() and not (tmp_path / "j/committed").exists()
    mutations.write_calls(calls, options, 4)
    made = modified(seen)
    assert len(made) == len(set(made)) == 40
    out = mutations.outcomes(spark, options["journal"]).groupBy("outcome", "error_message").count().collect()
    assert sorted((r["outcome"], r["error_message"], r["count"]) for r in out) == [("failure", mutations.UNANSWERED, 1), ("success", None, 39)]


def test_no_plan(spark, server, mail, tmp_path):  # noqa: F811
    staged, *rest = mail
    new, left = actions.execute_in_tasks(staged.limit(0), *rest, {"provider": "gmail", "base_url": server[0]}, F.lit(AT).cast("timestamp"), f"file://{tmp_path}/j")
    assert new.count() == left.count() == 0


def test_interrupted_job(spark, tmp_path):
    """Embedding is stopped while its tasks wait for a model: the table has nothing of it, and the next call does all."""
    rows = spark.range(8).select(F.lit("a").alias("account_id"), F.col("id").cast("string").alias("provider_msg_id"), F.lit("s").alias("subject"))
    messages = spark.createDataFrame([], TABLES["messages"]).unionByName(rows, allowMissingColumns=True)
    path, at, begun = f"file://{tmp_path}/e", F.lit(AT).cast("timestamp"), tmp_path / "begun"
    running, errors = jobs.Running(spark), []

    def slow():
        begun.touch()
        time.sleep(60)

    def work():
        try:
            with running.work("a", "embed"):
                classify.embed_pending(messages, path, slow, "v", 1, at)
        except jobs.Interrupted as e:
            errors.append(e)

    from pyspark import InheritableThread

    t = InheritableThread(target=work)
    t.start()
    until = time.time() + 40
    while not begun.exists() and time.time() < until:
        time.sleep(0.05)
    assert running.listed() == [("a", "embed")] and running.cancel("b") == running.cancel("a", "sync") == 0
    began = time.time()
    assert running.cancel("a") == 1 and time.time() - began < 30
    t.join(10)
    assert len(errors) == 1 and running.listed() == [] and not store.exists(spark, path)
    with running.work("a", "embed"):
        assert classify.embed_pending(messages, path, lambda: lambda texts: [[1.0]] * len(texts), "v", 1, at) == 8


def test_stopped_without_jobs(spark):
    running, calls = jobs.Running(spark), []
    with pytest.raises(jobs.Interrupted), running.work("a", "sync", lambda: calls.append(1)) as asked:
        t = threading.Thread(target=running.cancel, args=("a",))
        t.start()
        assert asked.wait(5)
    t.join(5)
    assert calls == [1] and not t.is_alive()
    with pytest.raises(ZeroDivisionError), running.work("a", "sync"):
        1 / 0


def test_calls_of_ones_own_by_tasks(spark, mail, tmp_path, monkeypatch):
    """No message goes through the driver: calls are made where the plan's rows are, with a provider made there."""

    def make(options):
        def call(action, ids):
            with open(f"{options['told']}/{action}-{ids[0]}", "x") as f:
                f.write(str(len(ids)))
            if action == "trash":
                raise RuntimeError("http 500")

        return call

    def refused(*_, **__):
        raise AssertionError("rows for the driver")

    monkeypatch.setattr(type(mail[0]), "toLocalIterator", refused)
    journal, at = f"file://{tmp_path}/j", F.lit(AT).cast("timestamp")
    new, left = actions.execute_in_tasks(*mail, {"told": str(tmp_path)}, at, journal, chunk=10, tasks=3, keep_failed=True, make=make)
    got = {r["action_type"]: (r["outcome"], r["error_message"], r["n"]) for r in new.groupBy("action_type", "outcome", "error_message").agg(F.count("*").alias("n")).collect()}
    assert got == {"archive": ("success", None, 25), "trash": ("failure", "http 500", 1), "mark_read": ("success", None, 5), "unsubscribe": ("failure", "unsubscribe can't be executed", 1)}
    assert sorted(r["id"] for r in left.collect()) == [2, 4] and sorted(int(p.read_text()) for p in tmp_path.glob("*-m*")) == [1, 5, 5, 10, 10]
    assert work.execution(spark, "/root/testdata/sf0.001").count() > 0

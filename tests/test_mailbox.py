"""Operators that SQL can't check: folds, models, side effects, streams, and text rules at their edges."""

import json
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.functions import numbers, text
from postmill.operators import actions, audit, classify, clusters, review, store
from postmill.schema import FEED, TABLES, DimensionError, ProviderError
from postmill.sources import pages
from postmill.streaming import sync

AT = None


@pytest.fixture(scope="module", autouse=True)
def moment(spark):
    global AT
    AT = F.timestamp_millis(F.lit(1_709_251_200_000))


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw,want", [('"N" <A.B@X.ORG>', "a.b@x.org"), ("bare@x.org ", "bare@x.org"), ("no address", None), ("", None), ("  ", None), ("x <y> z@q", "x <y> z@q"), (None, None), ("< a@b >", "a@b"), ("É@X <c@d> <e@f>", "c@d")])
def test_sender_email(spark, raw, want):
    assert one(spark, text.sender_email, raw) == want


def test_embedding_text(spark):
    df = spark.createDataFrame([(None, None, None), (" s ", " f ", " " + "ä" * 800)], "a string, b string, c string")
    got = [r[0] for r in df.select(text.embedding_text(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["\n\n", "s\nf\n" + "ä" * 500]


@pytest.mark.parametrize("raw,want", [('{"category": "Work", "confidence": 2}', ("work", 1.0, True)), ('```json\n{"category": "social", "confidence": 0.42}\n```', ("unknown", 0.42, True)), ('{"category": "zebra", "confidence": 0.9}', ("unknown", 0.9, True)), ("nothing", ("unknown", 0.0, False)), ('{"category": "work"}', ("unknown", 0.0, False)), ('{"category": "work", "confidence": 0.9} x', ("unknown", 0.0, False)), (None, ("unknown", 0.0, False)), ('{"category": "work", "confidence": -1}', ("unknown", 0.0, True))])
def test_model_output(spark, raw, want):
    out = lambda c: F.struct(*[text.model_output(c)[k] for k in ("category", "confidence", "valid")])
    got = one(spark, out, raw)
    assert (got[0], round(got[1], 6), got[2]) == want


def test_small_expressions(spark):
    assert one(spark, text.csv_field, 'a,"b"') == '"a,""b"""' and one(spark, text.csv_field, None) == "" and one(spark, text.csv_field, "plain") == "plain"
    assert one(spark, numbers.received_ms, "2026-01-01T00:00:00.9Z") == 1767225600000 and one(spark, numbers.received_ms, "x") == 0 and one(spark, numbers.received_ms, "2026-05-01") == 0 and one(spark, numbers.received_ms, "2026-01-01t02:00:00+02:00") == 1767225600000
    assert one(spark, text.number_or_zero, "17") == 17 and one(spark, text.number_or_zero, "x") == 0
    assert one(spark, lambda c: text.shortened(c, 3), "abcd") == "abc…" and one(spark, lambda c: text.shortened(c, 4), "abcd") == "abcd"
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 5.0]), ([0.0], [1.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in df.select(numbers.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.7071]
    assert one(spark, lambda c: numbers.age_days(100, c), 100 + 86_400_000 * 2 - 1, "long") == -1


def plain_fold(vectors, threshold):
    centroids, counts, out = [], [], []
    for v in np.asarray(vectors, np.float32):
        sims = [float(c @ v / (np.linalg.norm(c) * np.linalg.norm(v))) for c in centroids]
        best = int(np.argmax(sims)) if sims else -1
        if sims and sims[best] >= threshold:
            counts[best] += 1
            centroids[best] = (centroids[best] * (counts[best] - 1) + v) / counts[best]
            out.append((best, sims[best]))
        else:
            centroids.append(v)
            counts.append(1)
            out.append((len(counts) - 1, 1.0))
    return out


def test_greedy_clusters(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for b, n in (("big@x", 90), ("small@x", 3), (None, 7), ("four@x", 4)):
        vectors = rng.normal(size=(n, 6)).round(3) + (rng.integers(0, 3, (n, 1)) == np.arange(6) % 3) * 3
        for i, v in enumerate(vectors):
            rows.append(("a", f"{b}{i:03}", b, 1000 - 0 + i, v.tolist()))
        folded = plain_fold(vectors, 0.85) if n >= 4 else [(0, 1.0)] * n
        for i, f in enumerate(folded):
            want[f"{b}{i:03}"] = (b, *f)
    df = spark.createDataFrame(rows, "account_id string, provider_msg_id string, sender_email string, internal_date long, embedding array<float>").repartition(5)
    got = {r["provider_msg_id"]: r for r in clusters.greedy_clusters(df.drop("embedding"), df.select("account_id", "provider_msg_id", "embedding")).collect()}
    assert got.keys() == want.keys()
    for k, (b, part, score) in want.items():
        base = f"sender::{b}" if b else "unknown::"
        assert got[k]["cluster_key"].startswith(base) and abs(got[k]["centroid_cosine"] - score) < 1e-4
        assert got[k]["cluster_key"].endswith(f"#{part}") if part else "#" not in got[k]["cluster_key"]
    again = clusters.greedy_clusters(df.drop("embedding").repartition(2), df.select("account_id", "provider_msg_id", "embedding"))
    assert {r["provider_msg_id"]: r for r in again.collect()} == got


def mail(spark, n=6, account="a"):
    rows = [(account, f"m{i}", f"t{i}", "S <s@x>", "s@x", f"subject {i}", "snip", 1000 + i, ["INBOX", "UNREAD"], i, None, None, None, None) for i in range(n)]
    return spark.createDataFrame(rows, TABLES["messages"])


def test_embedding_and_classifying_with_stand_ins(spark):
    messages = mail(spark)
    embed = lambda: lambda texts: [[float(t.count(c)) for c in "aeiou"] for t in texts]
    new = classify.embed_missing(messages, store.empty(spark, "embeddings"), embed, "v1", 5, AT)
    have = spark.createDataFrame(new.collect(), TABLES["embeddings"])
    assert have.count() == 6 and classify.embed_missing(messages, have, embed, "v1", 5, AT).count() == 0
    assert classify.embed_missing(messages, have, embed, "v2", 5, AT, by_model=True).count() == 6
    with pytest.raises(Exception, match="expected 4"):
        classify.embed_missing(messages, store.empty(spark, "embeddings"), embed, "v1", 4, AT).count()
    assert issubclass(DimensionError, Exception)
    members = spark.createDataFrame([("a", f"m{i}", "sender::s@x" if i < 4 else "sender::bad", 1.0, None) for i in range(6)], TABLES["message_clusters"])

    def client():
        def ask(prompt):
            if "sender::bad" in prompt:
                raise RuntimeError("down")
            return json.dumps({"category": "work", "confidence": 0.8})

        return ask

    todo = classify.to_classify(members, messages, store.empty(spark, "cluster_classifications"), "m", "p")
    assert "Message 3" in todo.filter("cluster_key like '%s@x'").first()["prompt"]
    rows = spark.createDataFrame(classify.classify(todo, client, "m", "p", AT).collect(), TABLES["cluster_classifications"])
    by = {r["cluster_key"]: r for r in rows.collect()}
    assert by["sender::s@x"]["category"] == "work" and by["sender::bad"]["reason"] == "error: down" and by["sender::bad"]["confidence"] == 0
    table, marked = classify.classified(messages, members, store.empty(spark, "cluster_classifications"), rows, AT)
    assert {r["category"] for r in marked.collect()} == {"work", "unknown"}
    assert classify.to_classify(members, messages, table, "m", "p").count() == 0 and classify.to_classify(members, messages, table, "m", "p2").count() == 2


@pytest.mark.parametrize("facts,want", [(("promotional", 0.95, 10, 120, True), ["archive", "unsubscribe"]), (("promotional", 0.95, 10, 89, False), []), (("promotional", 0.55, 10, 400, True), []), (("notification", 0.9, 50, 1, False), ["trash"]), (("notification", 0.9, 49, 1, False), []), (("newsletter", 0.6, 1, None, True), ["unsubscribe"]), (("social", 0.9, 60, 1, True), ["archive"]), (("transactional", 0.9, 1, 365, True), ["archive"]), (("security", 0.99, 1000, 10_000, True), []), (("unknown", 0.99, 1000, None, True), [])])
def test_rules(spark, facts, want):
    df = spark.createDataFrame([facts], "c string, f float, n long, age long, u boolean")
    got = df.select(review.proposals(*[F.col(x) for x in ("c", "f", "n", "age", "u")])).first()[0]
    assert [p["action"] for p in got] == want and all(p["reason"] for p in got)


def staged_rows(spark, rows):
    return spark.createDataFrame([(i, "a", c, m, t, {}, None, None) for i, c, m, t in rows], TABLES["staged_actions"]).withColumn("staged_at", AT)


def test_staging_with_null_keys(spark):
    old = staged_rows(spark, [(1, "c", None, "archive"), (2, "c", "m1", "archive")])
    new = staged_rows(spark, [(3, "c", None, "archive"), (4, "c", "m2", "archive")]).withColumn("proposed_reason", F.lit("again"))
    got = sorted((r["id"], r["provider_msg_id"], r["proposed_reason"]) for r in review.stage(old, new).collect())
    assert got == [(1, None, "again"), (2, "m1", None), (4, "m2", "again")]
    assert [[r["id"] for r in x.collect()] for x in review.unstage_cluster(old, "a", "c", "archive")] == [[2], [1]] and [r["id"] for r in review.listing(old, "a").collect()] == [1, 2]


def test_execution(spark, tmp_path):
    messages = mail(spark, 25)
    members = spark.createDataFrame([("a", f"m{i}", "c", 1.0, None) for i in range(25)], TABLES["message_clusters"])
    staged = staged_rows(spark, [(1, "c", None, "archive"), (2, "c", "m3", "add_label"), (3, "c", "m4", "trash"), (4, "nobody", None, "archive")])
    log, calls, told = store.empty(spark, "actions_log"), [], []

    def call(action, ids):
        calls.append((action, len(ids)))
        if action == "trash":
            raise RuntimeError("http 500")

    new, left = actions.execute(staged, members, messages, log, call, AT, str(tmp_path / "1"), chunk=10, on_progress=told.append)
    rows = sorted(new.collect(), key=lambda r: r["id"])
    assert calls == [("archive", 10), ("archive", 10), ("archive", 5), ("trash", 1)] and [t["messages_done"] for t in told] == [10, 20, 25, 25, 25] and told[-1]["failures"] == 2
    assert [r["id"] for r in rows] == list(range(1, 28)) and left.count() == 0 and all(r["staged_action_id"] is None for r in rows)
    assert [r["outcome"] for r in rows] == ["success"] * 25 + ["failure"] * 2 and rows[0]["reversal_kind"] == "restore_labels" and rows[0]["prior_label_ids"] == ["INBOX", "UNREAD"]
    assert rows[-1]["reversal_kind"] is None and rows[-1]["error_message"] == "http 500" and rows[-1]["prior_label_ids"] is None
    kept = actions.execute(staged, members, messages, log, call, AT, str(tmp_path / "2"), chunk=10, keep_failed=True)[1]
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]
    running = actions.Executors()
    stop = running.register("a")
    assert running.cancel("b") is False
    new, left = actions.execute(staged, members, messages, log, lambda a, ids: running.cancel("a"), AT, str(tmp_path / "3"), chunk=10, stop=stop)
    assert sorted(r["outcome"] for r in new.collect()) == ["cancelled"] * 10 + ["success"] * 10 and left.count() == 4 and all(r["staged_action_id"] == 1 for r in new.collect())
    running.clear("a")
    assert running.cancel("a") is False
    full = spark.createDataFrame(rows, TABLES["actions_log"])
    added = []
    status, after = actions.undo(full, 1, lambda m, labels: added.append((m, labels)), lambda m: None, AT)
    assert status == "ok" and added == [("m0", ["INBOX"])] and after.filter("reversed_at is not null").count() == 1
    assert actions.undo(after, 1, None, None, AT)[0] == "already reversed" and actions.undo(full, 27, None, None, AT)[0] == "not reversible" and actions.undo(full, 99, None, None, AT)[0] == "not found"
    assert audit.outcome_counts(full).first()[1:] == (25, 2, 0, 0)


def test_execution_goes_on_behind_what_was_called(spark, tmp_path):
    """2,500 messages in chunks of 1,000; the driver is lost in the second call and begins again."""
    messages, members = mail(spark, 2500), spark.createDataFrame([("a", f"m{i}", "c", 1.0, None) for i in range(2500)], TABLES["message_clusters"])
    staged, calls = staged_rows(spark, [(1, "c", None, "archive")]), []

    class Lost(BaseException):
        pass

    def call(action, ids):
        if len(calls) == 1:
            calls.append(0)
            raise Lost
        calls.append(len(ids))

    go = lambda: actions.execute(staged, members, messages, store.empty(spark, "actions_log"), call, AT, str(tmp_path / "j"))
    with pytest.raises(Lost):
        go()
    new, left = go()
    assert calls == [1000, 0, 1000, 500] and left.count() == 0
    assert new.count() == new.select("provider_msg_id").distinct().count() == 2500 and new.agg(F.max("id")).first()[0] == 2500


def test_label_effects(spark):
    df = spark.createDataFrame([("archive",), ("trash",), ("mark_read",), ("add_label",)], "a string").withColumn("l", F.array(F.lit("INBOX"), F.lit("UNREAD")))
    assert [r[0] for r in df.select(actions.label_effect(F.col("a"), F.col("l"))).collect()] == [["UNREAD"], ["UNREAD", "TRASH"], ["INBOX"], ["INBOX", "UNREAD"]]
    assert [r[0] for r in df.select(actions.inverse_labels(F.col("a"), F.col("l"))).collect()] == [["INBOX"], [], ["UNREAD"], ["INBOX", "UNREAD"]]


def test_pages(spark):
    history = json.dumps({"history": [{"id": "1", "messagesAdded": [{"message": {"id": "m2"}}], "messagesDeleted": [{"message": {"id": "m1"}}]}, {"id": "2", "labelsAdded": [{"message": {"id": "m2"}}], "labelsRemoved": [{"message": {"id": "m3"}}]}], "historyId": "9"})
    gone, changed = pages.gmail_changes(spark.createDataFrame([("a", history)], "account_id string, body string"))
    assert [r[1] for r in gone.collect()] == ["m1"] and sorted(r[1] for r in changed.collect()) == ["m2", "m3"]
    lists = spark.createDataFrame([("a", '{"messages": [{"id": "x", "threadId": "y"}]}'), ("a", '{"resultSizeEstimate": 0}')], "account_id string, body string")
    assert [tuple(r) for r in pages.listed(lists).collect()] == [("a", "x", "y")]
    empty = json.dumps({"id": "m", "payload": {"headers": [{"name": "from", "value": ""}]}})
    row = pages.gmail_messages(spark.createDataFrame([("a", empty)], "account_id string, body string")).first()
    assert row["sender"] is None and row["sender_email"] is None and row["label_ids"] == [] and row["history_id"] == 0
    removed, _ = pages.graph_messages(spark.createDataFrame([("a", '{"id": "q", "@removed": {"reason": "deleted"}}')], "account_id string, body string"))
    assert [r[1] for r in removed.collect()] == ["q"]


def test_retry():
    waits, left = [], [ProviderError(429), OSError("net"), ProviderError(503), None]

    def call():
        e = left.pop(0)
        if e:
            raise e
        return 7

    assert pages.with_retry(call, sleep=waits.append) == 7 and waits == [0.5, 1.0, 2.0]
    for error, tries in ((ProviderError(404), 1), (ProviderError(403), 1), (ProviderError(403, "rateLimitExceeded"), 4), (ProviderError(500), 4)):
        n = []

        def fail(error=error, n=n):
            n.append(1)
            raise error

        with pytest.raises(ProviderError):
            pages.with_retry(fail, sleep=lambda s: None)
        assert len(n) == tries
    waits = []
    with pytest.raises(ProviderError):
        pages.with_retry(lambda: (_ for _ in ()).throw(ProviderError(500)), (8, 1.0, 32.0), waits.append)
    assert waits == [1, 2, 4, 8, 16, 32, 32]


def land(path, rows):
    path.parent.mkdir(exist_ok=True)
    with open(path, "w") as f:
        f.writelines(json.dumps(dict(zip(("account_id", "kind", "page", "body"), (*r[:3], json.dumps(r[3])), strict=True))) + "\n" for r in rows)


def metadata(spark, asked=None):
    """Stands for the provider: m9 is gone."""

    def fetch(ids):
        rows = [(r["account_id"], json.dumps({"id": r["provider_msg_id"], "threadId": "t", "snippet": "s", "internalDate": "1700000000000", "historyId": "10", "labelIds": ["INBOX"], "payload": {"headers": [{"name": "From", "value": f'"Sender" <{r["provider_msg_id"]}@example.com>'}]}})) for r in ids.collect() if r["provider_msg_id"] != "m9"]
        if asked is not None:
            asked.extend(sorted(r["provider_msg_id"] for r in ids.collect()))
        return spark.createDataFrame(rows, "account_id string, body string")

    return fetch


def synced(spark, tmp_path, asked=None):
    sync.run(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), metadata(spark, asked), lambda: AT, 2)
    tables = store.Tables(spark, str(tmp_path / "t"), 2)
    state = {r["account_id"]: (r["phase"], r["cursor_token"], r["last_history_id"], r["initial_completed_at"] is not None) for r in tables.read("sync_state").collect()}
    return {(r["account_id"], r["provider_msg_id"]): r for r in tables.read("messages").collect()}, state


def test_sync_of_landed_pages(spark, tmp_path):
    ref = lambda m: {"id": m, "threadId": "t"}
    land(tmp_path / "in" / "1.json", [("a", "gmail_list", 0, {"messages": [ref("m1"), ref("m2")], "nextPageToken": "P2"}), ("e", "gmail_list", 0, {"resultSizeEstimate": 0})])
    got, state = synced(spark, tmp_path)
    assert sorted(got) == [("a", "m1"), ("a", "m2")] and got["a", "m1"]["sender_email"] == "m1@example.com"
    assert state == {"a": ("initial", "P2", 10, False), "e": ("incremental", None, 1, True)}
    land(tmp_path / "in" / "2.json", [("a", "gmail_list", 1, {"messages": [ref("m3"), ref("m9")]}), ("g", "graph_delta", 0, {"value": [{"id": "q1", "receivedDateTime": "2026-05-01T12:00:00Z", "parentFolderId": "inbox", "categories": ["red"]}, {"id": "q2", "isRead": True}], "@odata.nextLink": "n"})])
    got, state = synced(spark, tmp_path)
    assert sorted(got) == [("a", "m1"), ("a", "m2"), ("a", "m3"), ("g", "q1"), ("g", "q2")] and got["g", "q1"]["label_ids"] == ["red", "FOLDER:inbox", "UNREAD"] and got["g", "q1"]["internal_date"] == 1777636800000
    assert state["a"] == ("incremental", None, 10, True) and "g" not in state
    history = {"history": [{"id": "1", "messagesAdded": [{"message": ref("m4")}], "messagesDeleted": [{"message": ref("m1")}]}, {"id": "2", "labelsAdded": [{"message": ref("m4")}]}], "historyId": "20"}
    land(tmp_path / "in" / "3.json", [("a", "gmail_history", 0, history), ("g", "graph_delta", 1, {"value": [{"id": "q1", "@removed": {"reason": "deleted"}}], "@odata.deltaLink": "d1"})])
    asked = []
    got, state = synced(spark, tmp_path, asked)
    assert sorted(got) == [("a", "m2"), ("a", "m3"), ("a", "m4"), ("g", "q2")] and asked == ["m4"]
    assert state["a"] == ("incremental", None, 20, True) and state["g"] == ("incremental", "d1", None, False)
    again = synced(spark, tmp_path, asked)
    assert again[1] == state and again[0] == got and asked == ["m4"]
    tables = store.Tables(spark, str(tmp_path / "t"), 2)
    assert tables.vacuum() > 0 and tables.read("messages").count() == 4 and tables.vacuum() == 0


def test_a_batch_without_commit_is_not_read(spark, tmp_path, monkeypatch):
    tables = store.Tables(spark, str(tmp_path / "t"), 2)
    touched = tables.bucketed("messages", mail(spark, 3)).select("account_id", "bucket").distinct()
    tables.write(0, {"messages": (mail(spark, 3), touched)})
    import shutil

    tables.write(1, {"messages": (mail(spark, 1), touched)})
    assert tables.read("messages").count() == 1
    shutil.rmtree(tmp_path / "t" / "_commits" / "batch-1")  # as if the driver had been lost before it
    assert tables.read("messages").count() == 3
    tables.write(1, {"messages": (mail(spark, 2), touched)})
    assert tables.read("messages").count() == 2


CHANGE = "page long, seq long, op string, account_id string, provider_msg_id string, subject string, history_id long"


def changes(spark, rows):
    wide = spark.createDataFrame(rows, CHANGE).withColumns({"thread_id": F.lit("t"), "sender": F.lit(None).cast("string"), "sender_email": F.lit(None).cast("string"), "snippet": F.lit(None).cast("string"), "internal_date": F.lit(0).cast("long"), "label_ids": F.array(F.lit("INBOX"))})
    return wide.select(*[c.split()[0] for c in FEED.split(", ")])


def test_changes_page_by_page(spark):
    """A null history id never replaces one; a delete takes what was before its page, and what hangs on it."""
    tables = {"messages": mail(spark, 4).withColumn("category", F.lit("work")), "embeddings": store.empty(spark, "embeddings"), "message_clusters": spark.createDataFrame([("a", f"m{i}", "c", 1.0, None) for i in range(4)], TABLES["message_clusters"])}
    up = lambda p, s, m, subject, h=None: (p, s, "upsert", "a", m, subject, h)
    rows = [up(0, 1, "m9", "old", 5), up(0, 2, "m9", "new"), up(0, 3, "m1", "one"), (0, 4, "delete", "a", "m0", None, None), up(1, 0, "m2", "gone later", 8), (2, 0, "delete", "a", "m2", None, None), (2, 1, "delete", "a", "m3", None, None), up(2, 2, "m3", "back")]
    once = sync.apply_changes(tables, changes(spark, rows))
    got = {r["provider_msg_id"]: (r["subject"], r["history_id"], r["category"]) for r in once["messages"].collect()}
    assert got == {"m9": ("new", 5, None), "m1": ("one", 1, "work"), "m3": ("back", None, None)}
    assert [r["provider_msg_id"] for r in once["message_clusters"].collect()] == ["m1"]
    twice = sync.apply_changes(once, changes(spark, rows))
    assert {r["provider_msg_id"]: (r["subject"], r["history_id"], r["category"]) for r in twice["messages"].collect()} == got
    assert {r["account_id"]: r["last_history_id"] for r in sync.baseline(once["messages"]).collect()} == {"a": 5}


def test_phases_and_accounts(spark):
    rows = [("a", None, None, None), ("b", "initial", "P2", None), ("c", "incremental", None, 7), ("d", "incremental", None, None)]
    state = spark.createDataFrame(rows, "account_id string, phase string, cursor_token string, last_history_id long")
    assert {r[0]: r[1] for r in sync.next_phase(state).collect()} == {"a": "full", "b": "resume", "c": "incremental", "d": "reset"}
    two = {"messages": mail(spark, 2).unionByName(mail(spark, 1, "b"))}
    once = store.delete_account(two, "a")
    assert once["messages"].count() == store.delete_account(once, "a")["messages"].count() == 1
    messages, kept = store.upsert_embeddings(mail(spark, 2), store.empty(spark, "embeddings"), spark.createDataFrame([("a", "m1", "v", None, [1.0, 2.0], None)], TABLES["embeddings"]), AT)
    assert kept.first()["dim"] == 2 and messages.filter("embedded_at is not null").count() == 1


def test_progress(spark, tmp_path):
    from postmill.streaming.progress import Progress, counted

    df, seen = counted(mail(spark, 5), late=F.col("internal_date") >= 1003)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 5, "late": 2}
    told = []
    listener = Progress(told.append)
    spark.streams.addListener(listener)
    land(tmp_path / "in" / "1.json", [("a", "gmail_list", 0, {"messages": [{"id": "m1", "threadId": "t"}]})])
    synced(spark, tmp_path)
    import time

    for _ in range(50):
        if any(t["stage"] == "done" for t in told):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert any(t.get("rows", 0) >= 1 for t in told) and told[-1] == {"stage": "done", "error": None}


def test_vectors_as_bytes(spark):
    """Whole arrays and slices of them, nulls, ragged lengths and a broken tail; the sum is that of a plain loop."""
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 7 == 3 else [float(x) for x in rng.standard_normal(i % 5 * 100).astype("f4")]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, v array<float>").repartition(3)
    got = {r["i"]: r for r in df.select("i", "v", numbers.to_bytes("v").alias("raw")).select("*", numbers.from_bytes("raw").alias("back"), numbers.from_bytes(F.concat("raw", F.lit(b"xyz"))).alias("tail")).collect()}
    for i, v in rows:
        raw = None if v is None else np.asarray(v, "<f4").tobytes()
        assert (got[i]["raw"] and bytes(got[i]["raw"])) == (raw and bytearray(raw)) and got[i]["back"] == v == got[i]["tail"]
    pairs = df.alias("a").join(df.alias("b"), F.expr("a.i + 5 = b.i or a.i + 1 = b.i")).select(F.col("a.v").alias("a"), F.col("b.v").alias("b")).select("a", "b", numbers.cosine32("a", "b").alias("c")).collect()
    for r in pairs:
        if r["a"] is None or r["b"] is None:
            assert r["c"] is None
            continue
        dot = aa = bb = np.float32(0)
        for x, y in zip(np.asarray(r["a"], "f4"), np.asarray(r["b"], "f4")):
            dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
        norm = np.sqrt(aa) * np.sqrt(bb)
        assert np.float32(r["c"]) == (0 if norm < 1e-9 else dot / norm)
    assert df.limit(0).select(numbers.to_bytes("v")).collect() == []


def test_digest_holds_no_cluster():
    """Half a million ids of one cluster in batches: what is held stays small; clusters go on over batches."""
    import hashlib
    import tracemalloc

    want = hashlib.sha256(b"k|")

    def batches():
        for at in range(0, 500_000, 5000):
            ids = [f"{i:09}" for i in range(at, at + 5000)]
            want.update("".join(f"{x}," for x in ids).encode())
            yield pa.record_batch([pa.array(["a"] * 5000), pa.array(["k"] * 5000), pa.array(ids)], names=["a", "k", "i"])
        yield pa.record_batch([pa.array(["a", "a", "b"]), pa.array(["l", None, None]), pa.array([None, "x", "y"])], names=["a", "k", "i"])

    tracemalloc.start()
    out = [r for b in classify._digest(batches()) for r in b.to_pylist()]
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    assert [(r["member_count"], r["cluster_signature"]) for r in out] == [(500_000, want.hexdigest()), (1, hashlib.sha256(b"l|").hexdigest()), (1, None), (1, None)]

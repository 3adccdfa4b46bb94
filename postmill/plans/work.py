"""Queries of embedding, classifying, staging, executing and undoing over derived tables, each with SQL for the same rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from postmill.functions.text import cluster_key
from postmill.operators import actions, audit, classify, review, store
from postmill.schema import CATEGORIES, TABLES
from postmill.sources import mailbox as box

KEYS = ["account_id", "provider_msg_id"]
CLUSTER = ["account_id", "cluster_key"]
SQL: dict[str, str] = {}


def moment():
    return F.timestamp_millis(F.lit(box.ORDERS_AS_OF_MS))


def order_staged(spark, d):
    empty = {"payload": F.lit(None).cast("map<string,string>"), "proposed_reason": F.lit(None).cast("string")}
    return box.order_staged(spark, d).withColumns(empty)


def action_chunks(spark, d):
    """Calls of at most 1000 messages: how many messages each has, and its first and last."""
    planned = actions.plan(box.order_staged(spark, d), box.order_members(spark, d))
    return planned.groupBy("staged_action_id", "chunk").agg(F.count("*").alias("n"), F.min("provider_msg_id").alias("first_id"), F.max("provider_msg_id").alias("last_id"))


_PLAN = """(SELECT s.id AS staged_action_id, s.account_id, s.cluster_key, s.action_type, s.staged_n, m.provider_msg_id, m.labels, CAST(floor((row_number() OVER (PARTITION BY s.id ORDER BY m.provider_msg_id) - 1) / 1000) AS BIGINT) AS chunk
  FROM x_ostaged s JOIN x_omail m ON m.account_id = s.account_id AND m.cluster_key = s.cluster_key AND (s.provider_msg_id IS NULL OR s.provider_msg_id = m.provider_msg_id))"""
SQL["mail_action_chunks"] = f"SELECT staged_action_id, chunk, count(*) AS n, min(provider_msg_id) AS first_id, max(provider_msg_id) AS last_id FROM {_PLAN} p GROUP BY 1, 2"


def planned_messages(spark, d):
    return actions.planned_messages(actions.plan(box.order_staged(spark, d), box.order_members(spark, d)))


SQL["mail_planned_messages"] = f"SELECT account_id, count(*) AS messages FROM {_PLAN} p GROUP BY 1"


def _provider(options):
    """A provider that has no bin."""

    def call(action, ids):
        if action == "trash":
            raise RuntimeError("http 500")

    return call


def execution(spark, d):
    """All staged actions executed against a provider that refuses to trash: the new log rows."""
    staged, log = order_staged(spark, d), store.empty(spark, "actions_log")
    new, _ = actions.execute_in_tasks(staged, box.order_members(spark, d), box.order_messages(spark, d), log, {}, moment(), store.scratch(spark, "journal"), make=_provider)
    return new.select("id", "staged_action_id", "cluster_key", "provider_msg_id", "action_type", "outcome", "error_message", F.concat_ws(",", "prior_label_ids").alias("prior"), "reversal_kind")


SQL["mail_execution"] = f"""
SELECT row_number() OVER (ORDER BY staged_n, staged_action_id, provider_msg_id) AS id, CAST(NULL AS BIGINT) AS staged_action_id, cluster_key, provider_msg_id, action_type, CASE WHEN action_type = 'archive' THEN 'success' ELSE 'failure' END AS outcome,
  CASE action_type WHEN 'trash' THEN 'http 500' WHEN 'unsubscribe' THEN 'unsubscribe can''t be executed' END AS error_message, CASE WHEN action_type = 'archive' THEN labels ELSE '' END AS prior, CASE WHEN action_type = 'archive' THEN 'restore_labels' END AS reversal_kind
FROM {_PLAN} p"""


def left_staged(spark, d):
    """What stays staged if failures are kept: executed for single messages only."""
    staged = order_staged(spark, d).filter("provider_msg_id is not null or cluster_key like '%few%'")
    _, left = actions.execute_in_tasks(staged, box.order_members(spark, d), box.order_messages(spark, d), store.empty(spark, "actions_log"), {}, moment(), store.scratch(spark, "journal"), keep_failed=True, make=_provider)
    return left.select("id", *CLUSTER, "provider_msg_id", "action_type")


SQL["mail_left_staged"] = "SELECT id, account_id, cluster_key, provider_msg_id, action_type FROM x_ostaged WHERE action_type <> 'archive'"


def staged_listing(spark, d):
    """An account's staged rows, numbered in the order of the listing."""
    rows = review.listing(box.order_staged(spark, d), "a1").withColumn("place", F.monotonically_increasing_id())
    return store.settled(rows.coalesce(1), "listing").select("id", "cluster_key", "action_type", (F.rank().over(_window("place"))).cast("long").alias("place"))


def _window(c):
    from pyspark.sql.window import Window

    return Window.orderBy(c)


SQL["mail_staged_listing"] = "SELECT id, cluster_key, action_type, row_number() OVER (ORDER BY staged_n, id) AS place FROM x_ostaged WHERE account_id = 'a1'"


def unstaged(spark, d):
    """Archiving unstaged for one whole cluster: how many rows went and how many stayed."""
    left, gone = review.unstage_cluster(box.order_staged(spark, d), "a1", "sender::bulk@all.example.com", "archive")
    return left.agg(F.count("*").alias("stayed")).join(gone.agg(F.count("*").alias("went")))


SQL["mail_unstaged"] = "SELECT count(*) FILTER (NOT hit) AS stayed, count(*) FILTER (hit) AS went FROM (SELECT account_id = 'a1' AND cluster_key = 'sender::bulk@all.example.com' AND action_type = 'archive' AND provider_msg_id IS NULL AS hit FROM x_ostaged) z"


def table_counts(spark, d):
    return audit.table_counts(box.embeddings(spark, d), box.order_classes(spark, d), box.order_staged(spark, d))


SQL["mail_table_counts"] = """
SELECT account_id, sum(e) AS embeddings, sum(c) AS classifications, sum(s) AS staged FROM (SELECT account_id, 1 AS e, 0 AS c, 0 AS s FROM x_members UNION ALL SELECT account_id, 0, 1, 0 FROM x_oclasses UNION ALL SELECT account_id, 0, 0, 1 FROM x_ostaged) z GROUP BY 1"""


def _todo(spark, d, most=None):
    """Clusters to classify: those of personal or work mail were classified with the members that they have now."""
    members, messages = box.order_members(spark, d), box.order_messages(spark, d)
    known = box.order_classes(spark, d).filter("category in ('personal', 'work')").select(*CLUSTER, "category")
    done = classify.signatures(members).join(known, CLUSTER).select(*CLUSTER, "cluster_signature", F.lit("m").alias("model_version"), F.when(F.col("category") == "work", "p").otherwise("old").alias("prompt_version"))
    return classify.to_classify(members, messages, done, "m", "p", most=most)


def prompts(spark, d):
    """Prompts for the first 25 clusters of each account that need a class."""
    return _todo(spark, d, 25).select(*CLUSTER, "member_count", "prompt")


_TODO = """(SELECT o.account_id, o.cluster_key, count(*) AS member_count, dense_rank() OVER (PARTITION BY o.account_id ORDER BY o.cluster_key) AS k FROM x_omail o GROUP BY 1, 2)"""
_NEEDS = "NOT EXISTS (SELECT 1 FROM x_oclasses c WHERE c.account_id = t.account_id AND c.cluster_key = t.cluster_key AND category = 'work')"
SQL["mail_prompts"] = f"""
SELECT t.account_id, t.cluster_key, member_count, 'Name the one category that fits this group of messages. Categories: {", ".join(CATEGORIES)}.' || chr(10) || 'Group: ' || t.cluster_key || chr(10) || 'Size: ' || member_count || chr(10)
  || string_agg('Message ' || rank || chr(10) || '  sender: ' || sender || chr(10) || '  subject: ' || subject || chr(10) || '  snippet: ' || snippet, chr(10) ORDER BY rank) AS prompt
FROM {_TODO} t JOIN (SELECT *, row_number() OVER (PARTITION BY account_id, cluster_key ORDER BY centroid_cosine DESC, internal_date DESC, provider_msg_id) AS rank FROM x_omail) r ON r.account_id = t.account_id AND r.cluster_key = t.cluster_key AND rank <= 3
WHERE k <= 25 AND {_NEEDS} GROUP BY 1, 2, 3"""


def document_prompts(spark, d):
    """Prompts for all clusters of the documents' mail, whose snippets are whole texts, shortened where they are long."""
    todo = classify.to_classify(box.members(spark, d), box.messages(spark, d), store.empty(spark, "cluster_classifications"), "m", "p")
    return todo.select(*CLUSTER, "member_count", "prompt")


_PART = "CASE WHEN length(coalesce({c}, '')) > {n} THEN left({c}, {n}) || '…' ELSE coalesce({c}, '') END"
SQL["mail_document_prompts"] = f"""
SELECT t.account_id, t.cluster_key, member_count, 'Name the one category that fits this group of messages. Categories: {", ".join(CATEGORIES)}.' || chr(10) || 'Group: ' || t.cluster_key || chr(10) || 'Size: ' || member_count || chr(10)
  || string_agg('Message ' || rank || chr(10) || '  sender: ' || {_PART.format(c="sender", n=200)} || chr(10) || '  subject: ' || {_PART.format(c="subject", n=200)} || chr(10) || '  snippet: ' || {_PART.format(c="snippet", n=400)}, chr(10) ORDER BY rank) AS prompt
FROM (SELECT account_id, cluster_key, count(*) AS member_count FROM x_members GROUP BY 1, 2) t
JOIN (SELECT m.account_id, m.cluster_key, sender, subject, snippet, row_number() OVER (PARTITION BY m.account_id, m.cluster_key ORDER BY centroid_cosine DESC, m.doc_id DESC) AS rank
  FROM x_members m JOIN x_messages g ON g.account_id = m.account_id AND g.provider_msg_id = m.provider_msg_id) r ON r.account_id = t.account_id AND r.cluster_key = t.cluster_key AND rank <= 3
GROUP BY 1, 2, 3"""


def _client():
    def ask(prompt):
        if "few" in prompt:
            raise RuntimeError("down")
        return "no idea" if "Group: sender::p1" in prompt else json.dumps({"category": "Work", "confidence": 0.5 if "Group: sender::p2" in prompt else 0.75, "reason": "r"})

    return ask


def _classified(spark, d):
    return classify.classify(_todo(spark, d), _client, "m", "p", moment())


def classification(spark, d):
    """Classes by a stand-in model that fails for some clusters and answers others with nonsense."""
    return _classified(spark, d).select(*CLUSTER, "category", F.col("confidence").cast("double").alias("confidence"), "reason")


_CLASS = "CASE WHEN t.cluster_key LIKE '%few%' OR t.cluster_key LIKE 'sender::p1%' OR t.cluster_key LIKE 'sender::p2%' THEN 'unknown' ELSE 'work' END"
SQL["mail_classification"] = f"""
SELECT account_id, cluster_key, {_CLASS} AS category, CASE WHEN cluster_key LIKE '%few%' OR cluster_key LIKE 'sender::p1%' THEN 0.0 WHEN cluster_key LIKE 'sender::p2%' THEN 0.5 ELSE 0.75 END AS confidence,
  CASE WHEN cluster_key LIKE '%few%' THEN 'error: down' WHEN cluster_key LIKE 'sender::p1%' THEN 'parse: not a complete answer' ELSE 'r' END AS reason FROM {_TODO} t WHERE {_NEEDS}"""


def propagated(spark, d):
    """The new classes put into the table and onto the messages."""
    blank = {"category": F.lit(None).cast("string"), "classified_confidence": F.lit(None).cast("float"), "classified_at": F.lit(None).cast("timestamp")}
    old = box.order_classes(spark, d).withColumns({c: F.lit(None).cast(t) for c, t in (x.split() for x in TABLES["cluster_classifications"].split(", ")) if c not in ("account_id", "cluster_key", "category", "confidence")})
    new = store.settled(_classified(spark, d), "classes")
    table, messages = classify.classified(box.order_messages(spark, d).withColumns(blank), box.order_members(spark, d), old, new, moment())
    one = table.groupBy("account_id", "category").agg(F.count("*").alias("n")).withColumn("name", F.lit("table"))
    return one.unionByName(messages.groupBy("account_id", F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("n")).withColumn("name", F.lit("messages")))


SQL["mail_propagated"] = f"""
SELECT account_id, category, count(*) AS n, 'table' AS name FROM (SELECT t.account_id, CASE WHEN {_NEEDS} THEN {_CLASS} ELSE 'work' END AS category FROM {_TODO} t) z GROUP BY 1, 2
UNION ALL SELECT account_id, category, sum(member_count), 'messages' FROM (SELECT t.account_id, member_count, CASE WHEN {_NEEDS} THEN {_CLASS} ELSE 'none' END AS category FROM {_TODO} t) z GROUP BY 1, 2"""


def _embed():
    return lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]


def embedded(spark, d):
    """Messages without an embedding given one by a stand-in model, put into the table and stamped."""
    messages = box.messages(spark, d).withColumns({"embedded_at": F.lit(None).cast("timestamp")})
    have = box.embeddings(spark, d).withColumn("created_at", F.lit(None).cast("timestamp"))
    new = store.settled(classify.embed_missing(messages, have, _embed, "v2", 2, moment()), "vectors")
    stamped, table = store.upsert_embeddings(messages, have, new, moment())
    return stamped.join(table.select(*KEYS, "model_version", "dim", F.when(F.col("dim") == 2, F.col("embedding")[0]).cast("double").alias("chars"), F.when(F.col("dim") == 2, F.col("embedding")[1]).cast("double").alias("es")), KEYS).select(*KEYS, "model_version", "dim", "chars", "es", F.col("embedded_at").isNotNull().alias("stamped"))


_INPUT = r"(trim(subject) || chr(10) || coalesce(trim(sender), '') || chr(10) || left(regexp_replace(coalesce(snippet, ''), '^\s+|\s+$', '', 'g'), 500))"
SQL["mail_embedded"] = f"""
SELECT account_id, provider_msg_id, CASE WHEN old THEN 'v1' ELSE 'v2' END AS model_version, CASE WHEN old THEN 64 ELSE 2 END AS dim, CASE WHEN NOT old THEN CAST(length(t) AS DOUBLE) END AS chars, CASE WHEN NOT old THEN CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) END AS es, NOT old AS stamped
FROM (SELECT *, EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = doc_id) AS old, {_INPUT} AS t FROM x_messages) z"""


def upsert_members(spark, d):
    """Memberships put over others: the cluster and similarity change, new messages are added."""
    old = box.members(spark, d)
    new = box.messages(spark, d).filter("internal_date % 7 = 0").select(*KEYS, F.lit("new").alias("cluster_key"), F.lit(0.5).alias("centroid_cosine"))
    return store.upsert(old, new, KEYS)


SQL["mail_upsert_members"] = """
SELECT g.account_id, g.provider_msg_id, CASE WHEN internal_date % 7 = 0 THEN 'new' ELSE cluster_key END AS cluster_key, CASE WHEN internal_date % 7 = 0 THEN 0.5 ELSE centroid_cosine END AS centroid_cosine
FROM x_messages g LEFT JOIN x_members m ON m.account_id = g.account_id AND m.provider_msg_id = g.provider_msg_id WHERE internal_date % 7 = 0 OR cluster_key IS NOT NULL"""


def undone(spark, d):
    """The newest archiving undone: its stamp, and the labels that the provider was asked to add."""
    log, asked = box.log(spark, d), []
    newest = log.filter("action_type = 'archive' and outcome = 'success'").agg(F.max("id")).first()[0]
    status, after = actions.undo(log, newest, lambda m, labels: asked.append((m, labels)), lambda m: None, F.lit(box.UNDO_AS_OF).cast("timestamp"))
    again = actions.undo(after, newest, None, None, F.lit(box.UNDO_AS_OF).cast("timestamp"))[0]
    row = after.filter("reversed_at is not null").select("id", "provider_msg_id")
    return row.withColumns({"status": F.lit(status), "again": F.lit(again), "asked": F.lit(";".join(f"{m}:{','.join(x)}" for m, x in asked))})


SQL["mail_undone"] = """
SELECT id, provider_msg_id, 'ok' AS status, 'already reversed' AS again, CASE WHEN prior LIKE 'INBOX%' THEN provider_msg_id || ':INBOX' ELSE '' END AS asked
FROM x_log WHERE id = (SELECT max(id) FROM x_log WHERE action_type = 'archive' AND outcome = 'success')"""


def label_effects(spark, d):
    """What each logged action does to the labels, and what undoing it adds."""
    log = box.log(spark, d)
    after, back = actions.label_effect(F.col("action_type"), F.col("prior_label_ids")), actions.inverse_labels(F.col("action_type"), F.col("prior_label_ids"))
    return log.select("id", F.concat_ws(",", after).alias("after"), F.concat_ws(",", back).alias("back"))


SQL["mail_label_effects"] = """
SELECT id, CASE action_type WHEN 'archive' THEN CASE prior WHEN 'INBOX,UNREAD' THEN 'UNREAD' ELSE prior END WHEN 'trash' THEN CASE prior WHEN 'INBOX,UNREAD' THEN 'UNREAD,TRASH' ELSE prior || ',TRASH' END WHEN 'mark_read' THEN CASE prior WHEN 'INBOX,UNREAD' THEN 'INBOX' ELSE 'x' END ELSE prior END AS after,
  CASE action_type WHEN 'archive' THEN CASE prior WHEN 'INBOX,UNREAD' THEN 'INBOX' ELSE '' END WHEN 'mark_read' THEN 'UNREAD' WHEN 'add_label' THEN prior ELSE '' END AS back FROM x_log"""


def cluster_keys(spark, d):
    """Keys of the first parts of every sender's bucket, and of unknown senders."""
    m = box.messages(spark, d).select("account_id", "sender_email").distinct().withColumn("part", F.explode(F.array(F.lit(0), F.lit(1), F.lit(12))))
    return m.select("account_id", "sender_email", "part", cluster_key(F.col("account_id"), F.col("sender_email"), F.col("part")).alias("cluster_key"))


SQL["mail_cluster_keys"] = """
SELECT DISTINCT account_id, sender_email, part, CASE WHEN sender_email IS NULL THEN 'unknown::' || left(sha256(account_id), 16) ELSE 'sender::' || sender_email END || CASE WHEN part > 0 THEN '#' || part ELSE '' END AS cluster_key
FROM x_messages, (SELECT unnest([0, 1, 12]) AS part) p"""


def point_lookups(spark, d):
    """Rows of some keys, among them keys that aren't there."""
    keys = spark.sql("select 'a' || cast(id % 3 as string) account_id, 'm' || lpad(cast(id * 37 as string), 8, '0') provider_msg_id from range(60)")
    return store.lookup(box.messages(spark, d), keys).select(*KEYS, "subject")


SQL["mail_point_lookups"] = "SELECT account_id, provider_msg_id, subject FROM x_messages WHERE doc_id % 37 = 0 AND doc_id < 60 * 37 AND (doc_id / 37) % 3 = doc_id % 3"


def queries():
    named = (action_chunks, planned_messages, execution, left_staged, staged_listing, unstaged, table_counts, prompts, document_prompts, classification, propagated, embedded, upsert_members, undone, label_effects, cluster_keys, point_lookups)
    return {f"mail_{f.__name__}": f for f in named}

"""Queries of the mailbox engine over derived tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions.numbers import cosine, cosine32, from_bytes, to_bytes
from postmill.functions.text import embedding_text, model_output, sender_email
from postmill.operators import actions, audit, classify, clusters, review, review_facts, store
from postmill.operators.colocated import colocated
from postmill.plans import sync as sync_plans
from postmill.plans import work as work_plans
from postmill.plans.sync import gmail_body
from postmill.sources import mailbox as box
from postmill.sources import pages
from postmill.streaming import sync

KEYS = ["account_id", "provider_msg_id"]
SQL: dict[str, str] = {}


def review_queue(spark, d):
    q = review.review_queue(box.order_members(spark, d), box.order_messages(spark, d), box.order_classes(spark, d), box.order_staged(spark, d), box.ORDERS_AS_OF_MS)
    proposed = F.concat_ws("+", F.transform("proposed", lambda p: F.concat(p["action"], F.lit(": "), p["reason"])))
    return q.withColumns({"confidence": F.col("confidence").cast("double"), "proposed": proposed, "staged_types": F.concat_ws("+", "staged_types")})


SQL["mail_review_queue"] = f"""
SELECT f.account_id, f.cluster_key, coalesce(c.category, 'unknown') AS category, coalesce(c.confidence, 0.0) AS confidence, member_count, CAST(age AS BIGINT) AS oldest_age_days, has_unsubscribe, sample_sender, sample_subject,
  CASE WHEN coalesce(c.confidence, 0.0) < 0.6 THEN '' WHEN category = 'promotional' THEN concat_ws('+', CASE WHEN age >= 90 THEN 'archive: promotional and 90 days old' END, CASE WHEN has_unsubscribe THEN 'unsubscribe: promotional, with a way to unsubscribe' END)
    WHEN category = 'notification' AND member_count >= 50 THEN 'trash: 50 notifications and more' WHEN category = 'newsletter' AND has_unsubscribe THEN 'unsubscribe: newsletter, with a way to unsubscribe' WHEN category = 'social' AND member_count >= 50 THEN 'archive: 50 social messages and more'
    WHEN category = 'transactional' AND age >= 365 THEN 'archive: transactional and 365 days old' ELSE '' END AS proposed,
  coalesce(s.types, '') AS staged_types, coalesce(t.n, 0) AS staged_total
FROM (SELECT account_id, cluster_key, count(*) AS member_count, trunc(({box.ORDERS_AS_OF_MS} - min(internal_date)) / 86400000) AS age, bool_or(contains(lower(labels), 'list-unsubscribe')) AS has_unsubscribe,
    arg_min(sender, internal_date) AS sample_sender, arg_min(subject, internal_date) AS sample_subject FROM x_omail GROUP BY 1, 2) f
LEFT JOIN x_oclasses c ON c.account_id = f.account_id AND c.cluster_key = f.cluster_key
LEFT JOIN (SELECT account_id, count(*) AS n FROM x_ostaged GROUP BY 1) t ON t.account_id = f.account_id
LEFT JOIN (SELECT account_id, cluster_key, string_agg(DISTINCT action_type, '+') AS types FROM x_ostaged WHERE provider_msg_id IS NULL GROUP BY 1, 2) s ON s.account_id = f.account_id AND s.cluster_key = f.cluster_key"""


def colocated_review(spark, d):
    """The review queue over members and messages that are bucketed alike."""
    t = colocated({"members": box.order_members(spark, d), "messages": box.order_messages(spark, d)}, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q = review.review_queue(t["members"], t["messages"], box.order_classes(spark, d), box.order_staged(spark, d), box.ORDERS_AS_OF_MS)
    return q.select("account_id", "cluster_key", "category", "member_count", "oldest_age_days", "has_unsubscribe", "sample_subject", "staged_total")


SQL["mail_colocated_review"] = f"SELECT account_id, cluster_key, category, member_count, oldest_age_days, has_unsubscribe, sample_subject, staged_total FROM ({SQL['mail_review_queue']}) q"


#: Mail that goes: some of every sender's, and all old mail of some senders; mail that is dated again.
_PURGED = f"(history_id % 7 = 3 OR (sender_email LIKE 'p1%' AND internal_date < {1995 * 365 * 86_400_000}))"
_REDATED = "history_id % 11 = 5"


def review_increments(spark, d):
    """The review queue after changes, from the facts before them and the changed messages."""
    members, messages = box.order_members(spark, d), box.order_messages(spark, d)
    facts = store.settled(review_facts.facts_of(review_facts.member_rows(members, messages)), "review-facts")
    later = messages.filter(f"NOT {_PURGED}").withColumn("internal_date", F.when(F.expr(_REDATED), F.col("internal_date") + 40 * 86_400_000).otherwise(F.col("internal_date")))
    moved = f"{_PURGED} OR {_REDATED}"
    before = review_facts.member_rows(members, messages.filter(moved))
    after = review_facts.member_rows(members, later.filter(_REDATED))
    facts = review_facts.changed(facts, review_facts.deltas(before, after), members, later)
    q = review.queue(review_facts.for_queue(facts), box.order_classes(spark, d), box.order_staged(spark, d), box.ORDERS_AS_OF_MS)
    return q.select("account_id", "cluster_key", "category", "member_count", "oldest_age_days", "has_unsubscribe", "sample_sender", "sample_subject", "staged_total")


_LATER = f"(SELECT * REPLACE (internal_date + CASE WHEN {_REDATED} THEN {40 * 86_400_000} ELSE 0 END AS internal_date) FROM x_omail WHERE NOT {_PURGED}) o"
SQL["mail_review_increments"] = f"SELECT account_id, cluster_key, category, member_count, oldest_age_days, has_unsubscribe, sample_sender, sample_subject, staged_total FROM ({SQL['mail_review_queue'].replace('FROM x_omail', 'FROM ' + _LATER)}) q"


def cluster_summaries(spark, d):
    return clusters.summaries(box.members(spark, d), box.messages(spark, d))


SQL["mail_cluster_summaries"] = """
SELECT m.account_id, m.cluster_key, count(*) AS member_count, max(internal_date) AS newest, nullif(arg_max(coalesce(sender, chr(0)), internal_date), chr(0)) AS sample_sender, arg_max(subject, internal_date) AS sample_subject
FROM x_members m JOIN x_messages g ON g.account_id = m.account_id AND g.provider_msg_id = m.provider_msg_id GROUP BY 1, 2"""


def cluster_top_messages(spark, d):
    return clusters.expand(box.members(spark, d), box.messages(spark, d))


SQL["mail_cluster_top_messages"] = """
SELECT account_id, cluster_key, CAST(rank AS INTEGER) AS rank, provider_msg_id, subject, internal_date FROM (
  SELECT m.account_id, m.cluster_key, m.provider_msg_id, subject, internal_date, row_number() OVER (PARTITION BY m.account_id, m.cluster_key ORDER BY internal_date DESC, m.provider_msg_id) AS rank
  FROM x_members m JOIN x_messages g ON g.account_id = m.account_id AND g.provider_msg_id = m.provider_msg_id) z WHERE rank <= 5"""


def message_counts(spark, d):
    return box.messages(spark, d).groupBy("account_id").agg(F.count("*").alias("messages"), F.countDistinct("thread_id").alias("threads"), F.max("history_id").alias("history"))


SQL["mail_message_counts"] = "SELECT account_id, count(*) AS messages, count(DISTINCT thread_id) AS threads, max(history_id) AS history FROM x_messages GROUP BY 1"


def account_summaries(spark, d):
    accounts, messages = box.derived(spark, d, box.ACCOUNTS), box.messages(spark, d)
    state = sync.baseline(messages).withColumn("phase", F.lit("incremental"))
    return audit.account_summaries(accounts, messages, state)


SQL["mail_account_summaries"] = """
SELECT a.account_id, provider, email, coalesce(n, 0) AS message_count, CASE WHEN n IS NULL THEN NULL ELSE 'incremental' END AS phase, h AS last_history_id
FROM x_accounts a LEFT JOIN (SELECT account_id, count(*) AS n, greatest(max(history_id), 1) AS h FROM x_messages GROUP BY 1) m ON m.account_id = a.account_id"""


def embedding_status(spark, d):
    return audit.embedding_status(box.messages(spark, d), box.embeddings(spark, d), box.members(spark, d))


SQL["mail_embedding_status"] = """
SELECT g.account_id, count(*) AS total, count(m.provider_msg_id) AS embedded, count(DISTINCT m.cluster_key) AS clusters
FROM x_messages g LEFT JOIN x_members m ON g.account_id = m.account_id AND g.provider_msg_id = m.provider_msg_id GROUP BY 1"""


def category_histogram(spark, d):
    empty = box.messages(spark, d).withColumns({"category": F.lit(None).cast("string"), "classified_confidence": F.lit(None).cast("float"), "classified_at": F.lit(None).cast("timestamp")})
    return classify.histogram(classify.propagate(empty, box.members(spark, d), box.classes(spark, d), F.timestamp_millis(F.lit(box.AS_OF_MS))))


SQL["mail_category_histogram"] = """
SELECT g.account_id, coalesce(category, 'unclassified') AS category, count(*) AS n FROM x_messages g
LEFT JOIN x_members m ON g.account_id = m.account_id AND g.provider_msg_id = m.provider_msg_id LEFT JOIN x_classes c ON c.account_id = m.account_id AND c.cluster_key = m.cluster_key GROUP BY 1, 2"""


def missing_embeddings(spark, d):
    return clusters.missing_embeddings(box.messages(spark, d), box.embeddings(spark, d)).select(*KEYS, "subject")


SQL["mail_missing_embeddings"] = "SELECT account_id, provider_msg_id, subject FROM x_messages g WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = g.doc_id)"


def embedding_texts(spark, d):
    return box.messages(spark, d).select(*KEYS, embedding_text(F.col("subject"), F.col("sender"), F.col("snippet")).alias("input"))


SQL["mail_embedding_texts"] = r"""
SELECT account_id, provider_msg_id, trim(subject) || chr(10) || coalesce(trim(sender), '') || chr(10) || left(regexp_replace(coalesce(snippet, ''), '^\s+|\s+$', '', 'g'), 500) AS input FROM x_messages"""


def sender_addresses(spark, d):
    return box.messages(spark, d).select(*KEYS, sender_email(F.col("sender")).alias("address"))


SQL["mail_sender_addresses"] = "SELECT account_id, provider_msg_id, sender_email AS address FROM x_messages"


def gmail_projection(spark, d):
    """Messages through the provider's JSON and back."""
    m = box.messages(spark, d)
    body = gmail_body(F.col("sender"), F.col("subject"), F.col("label_ids"), F.col("snippet"), F.col("internal_date"), F.lit("x"))
    out = pages.gmail_messages(m.select("account_id", body.alias("body")))
    return out.withColumn("label_ids", F.concat_ws(",", "label_ids"))


SQL["mail_gmail_projection"] = "SELECT account_id, provider_msg_id, thread_id, sender, sender_email, subject, snippet, internal_date, labels AS label_ids, CAST(0 AS BIGINT) AS history_id FROM x_messages"


def representatives(spark, d):
    return classify.representatives(box.members(spark, d), box.messages(spark, d)).select("account_id", "cluster_key", "rank", "provider_msg_id")


SQL["mail_representatives"] = """
SELECT account_id, cluster_key, CAST(rank AS INTEGER) AS rank, provider_msg_id FROM (SELECT account_id, cluster_key, provider_msg_id,
  row_number() OVER (PARTITION BY account_id, cluster_key ORDER BY centroid_cosine DESC, doc_id DESC) AS rank FROM x_members) z WHERE rank <= 3"""


def signatures(spark, d):
    return classify.signatures(box.members(spark, d))


SQL["mail_signatures"] = "SELECT account_id, cluster_key, count(*) AS member_count, sha256(cluster_key || '|' || string_agg(provider_msg_id, ',' ORDER BY provider_msg_id) || ',') AS cluster_signature FROM x_members GROUP BY 1, 2"


#: Answers of several shapes, with %c and %f for category and confidence, and what each is: g good, u good but of no
#: known category, 1 good and beyond 1, b bad.
ANSWERS = (
    ('{"category": "%c", "confidence": %f, "reason": "r", "more": 1}', "g"), ('```json\n{"category": "%c", "confidence": %f}\n```', "g"), ('{"category": "%c", "confidence": %f} and so on', "b"), ('{"category": "%c"}', "b"), ("none", "b"),
    ('{"category": "%c", "confidence": %f, "reason": "{project} } {", "n": {"a": [1, {"b": 2}], "category": "x"}}', "g"), ("{'category': '%c', 'confidence': %f}", "b"), ('{"category": "%c", "category": "%c", "confidence": %f}', "b"),
    (' ```json```json``` {"category": "%c", "confidence": %f, "reason": null} `````` ', "g"), ('``````{"confidence": %f, "category": "%C"}', "g"), ('{"category": " %c", "confidence": %f}', "u"), ('{"category": "%c", "confidence": "%f"}', "b"),
    ('{"category": "%c", "confidence": 7}', "1"), ('{"category": "%c", "confidence": %f} {"category": "%c", "confidence": %f}', "b"), ('[{"category": "%c", "confidence": %f}]', "b"), ('{"category": "%c", "confidence": %f}]', "b"), ('{"category": "%c", "confidence": %f, "reason": 5}', "b"),
    ('{"category": 5, "confidence": %f}', "b"), ('{"category": "%c", "confidence": true}', "b"), ('{"category": "%c", "confidence": 1e999}', "b"), ("", "b"), ('{"category": "zebra", "confidence": %f}', "u"), ('{"category": "%c", "confidence": null}', "b"), ('{"category": "%c", "confidence": %f}, "end": "x"}', "b"),
    ('{"x": 1, "category": "%c", "x": {"y": 1, "y": [2]}, "confidence": %f, "x": null}', "g"), ('{"category": "%c", "confidence": %f, "confidence": %f}', "b"), ('{"category": "%c", "confidence": %f, "reason": "a", "reason": "a"}', "b"),
    ('{"category": "%c", "confidence": NaN}', "b"), ('{category: "%c", "confidence": %f}', "b"), ('{"category": "%c", "confidence": %f, "n": {"category": 1, "confidence": 2}}', "g"),
)


def model_outputs(spark, d):
    """Answers of several shapes to each classified cluster, read strictly."""
    c = box.classes(spark, d)

    def filled(raw):
        for mark, value in (("%c", F.col("category")), ("%C", F.upper("category")), ("%f", F.col("confidence").cast("string"))):
            raw = F.replace(raw, F.lit(mark), value)
        return raw

    rows = c.select("account_id", "cluster_key", F.posexplode(F.array(*[filled(F.lit(a)) for a, _ in ANSWERS])).alias("shape", "raw"))
    out = model_output(F.col("raw"))
    return rows.select("account_id", "cluster_key", "shape", out["category"].alias("category"), out["confidence"].cast("double").alias("confidence"), out["valid"].alias("valid"))


SQL["mail_model_outputs"] = f"""
SELECT account_id, cluster_key, CAST(shape AS INTEGER) AS shape, CASE WHEN what = 'g' AND confidence >= 0.6 OR what = '1' THEN category ELSE 'unknown' END AS category, CASE what WHEN 'b' THEN 0.0 WHEN '1' THEN 1.0 ELSE confidence END AS confidence, what <> 'b' AS valid
FROM x_classes, (SELECT unnest(range({len(ANSWERS)})) AS shape, unnest(string_split('{",".join(w for _, w in ANSWERS)}', ',')) AS what) a"""


def action_plan(spark, d):
    return actions.with_labels(actions.plan(box.staged(spark, d), box.members(spark, d), 2), box.messages(spark, d)).select("staged_action_id", *KEYS, "cluster_key", "action_type", "chunk", F.concat_ws(",", "prior_label_ids").alias("prior"))


SQL["mail_action_plan"] = """
SELECT s.id AS staged_action_id, s.account_id, m.provider_msg_id, s.cluster_key, s.action_type, CAST(floor((row_number() OVER (PARTITION BY s.id ORDER BY m.provider_msg_id) - 1) / 2) AS BIGINT) AS chunk, g.labels AS prior
FROM x_staged s JOIN x_members m ON m.account_id = s.account_id AND m.cluster_key = s.cluster_key AND (s.provider_msg_id IS NULL OR s.provider_msg_id = m.provider_msg_id)
JOIN x_messages g ON g.account_id = m.account_id AND g.provider_msg_id = m.provider_msg_id"""


def outcome_counts(spark, d):
    return audit.outcome_counts(box.log(spark, d))


SQL["mail_outcome_counts"] = "SELECT account_id, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'failure') AS failure, count(*) FILTER (outcome = 'cancelled') AS cancelled, CAST(0 AS BIGINT) AS skipped FROM x_log GROUP BY 1"


def recent_log(spark, d):
    return audit.recent(box.log(spark, d), 100).select("id", "account_id", "action_type", "outcome")


SQL["mail_recent_log"] = "SELECT id, account_id, action_type, outcome FROM x_log ORDER BY executed_at DESC, id DESC LIMIT 100"


def reversible_log(spark, d):
    return audit.reversible(box.log(spark, d)).select("id", "account_id", "action_type", "reversal_kind")


_KIND = "CASE WHEN outcome = 'success' THEN CASE WHEN action_type = 'trash' THEN 'untrash' WHEN action_type <> 'unsubscribe' THEN 'restore_labels' END END"
SQL["mail_reversible_log"] = f"SELECT id, account_id, action_type, {_KIND} AS reversal_kind FROM x_log WHERE {_KIND} IS NOT NULL ORDER BY executed_at DESC, id DESC LIMIT 100"


def undo_status(spark, d):
    return actions.undo_status(box.log(spark, d), F.lit(box.UNDO_AS_OF).cast("timestamp")).select("id", "undo_status", F.concat_ws(",", "undo_labels").alias("undo_labels"), "no_op")


_ADD = "CASE action_type WHEN 'archive' THEN CASE WHEN prior LIKE 'INBOX%' THEN 'INBOX' ELSE '' END WHEN 'mark_read' THEN 'UNREAD' WHEN 'add_label' THEN prior ELSE '' END"
SQL["mail_undo_status"] = f"""
SELECT id, CASE WHEN kind IS NULL THEN 'not reversible' WHEN kind = 'untrash' AND trunc((epoch(TIMESTAMP '{box.UNDO_AS_OF}') - epoch(executed_at)) / 86400) > 30 THEN 'too old' ELSE 'ok' END AS undo_status, labels AS undo_labels,
  coalesce(kind = 'restore_labels', false) AND labels = '' AS no_op FROM (SELECT *, {_KIND} AS kind, {_ADD} AS labels FROM x_log) z"""


def dated_log(spark, d):
    return box.log(spark, d).withColumns({"executed_at": F.date_format("executed_at", "yyyy-MM-dd"), "reversed_at": F.date_format("reversed_at", "yyyy-MM-dd")})


def export_csv(spark, d):
    return audit.export_csv(dated_log(spark, d), account="a1")


_ROW = "row_number() OVER (ORDER BY executed_at DESC, id DESC)"
SQL["mail_export_csv"] = f"""
SELECT CAST(0 AS BIGINT) AS n, 'id,executed_at,outcome,action_type,cluster_key,provider_msg_id,reversed_at,error_message' AS line UNION ALL
SELECT {_ROW} AS n, id || ',' || strftime(executed_at, '%Y-%m-%d') || ',' || outcome || ',' || action_type || ',' || cluster_key || ',' || provider_msg_id || ',,' || CASE WHEN error_message IS NULL THEN '' ELSE '"' || replace(error_message, '"', '""') || '"' END AS line
FROM x_log WHERE account_id = 'a1'"""


def export_json(spark, d):
    return audit.export_json(dated_log(spark, d).select("id", "account_id", "outcome", "error_message", "executed_at"), 500)


SQL["mail_export_json"] = """
SELECT CAST(0 AS BIGINT) AS n, '[' AS line UNION ALL SELECT CAST(4611686018427387904 AS BIGINT), ']' UNION ALL
SELECT n, '{"id":' || id || ',"account_id":"' || account_id || '","outcome":"' || outcome || '","error_message":' || CASE WHEN error_message IS NULL THEN 'null' ELSE '"' || replace(error_message, '"', chr(92) || '"') || '"' END || ',"executed_at":"' || strftime(executed_at, '%Y-%m-%d') || '"}' || CASE WHEN n < 500 THEN ',' ELSE '' END
FROM (SELECT *, row_number() OVER (ORDER BY executed_at DESC, id DESC) AS n FROM x_log) z WHERE n <= 500"""


def upsert_messages(spark, d):
    """The changes of each message put into the table one after the other: nulls replace, but for the history id."""
    base = box.messages(spark, d).select(*KEYS, "thread_id", "subject", "sender", "internal_date", "history_id")
    changes = box.derived(spark, d, box.CHANGES).filter("op = 'upsert'").withColumn("sender", F.lit(None).cast("string"))
    delta = store.folded(changes.drop("op"), KEYS, ["seq"], coalesced=("history_id",))
    return store.upsert(base, delta, KEYS, coalesced=("history_id",))


_LAST = "(SELECT * REPLACE (kept AS history_id) FROM (SELECT *, row_number() OVER (PARTITION BY account_id, provider_msg_id ORDER BY seq DESC) AS n, arg_max(history_id, seq) FILTER (history_id IS NOT NULL) OVER (PARTITION BY account_id, provider_msg_id) AS kept FROM x_changes WHERE op = 'upsert') z WHERE n = 1)"
SQL["mail_upsert_messages"] = f"""
SELECT coalesce(u.account_id, g.account_id) AS account_id, coalesce(u.provider_msg_id, g.provider_msg_id) AS provider_msg_id, coalesce(u.thread_id, g.thread_id) AS thread_id, coalesce(u.subject, g.subject) AS subject,
  CASE WHEN u.account_id IS NULL THEN g.sender END AS sender, coalesce(u.internal_date, g.internal_date) AS internal_date, coalesce(u.history_id, g.history_id) AS history_id
FROM x_messages g FULL JOIN {_LAST} u ON u.account_id = g.account_id AND u.provider_msg_id = g.provider_msg_id"""


def delete_cascade(spark, d):
    """What is left of each table when messages are deleted."""
    gone = box.derived(spark, d, box.CHANGES).filter("op = 'delete'")
    tables = {"messages": box.messages(spark, d), "embeddings": box.embeddings(spark, d), "message_clusters": box.members(spark, d), "cluster_classifications": box.classes(spark, d)}
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in store.delete_messages(tables, gone).items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


_GONE = "(SELECT account_id || provider_msg_id FROM x_changes WHERE op = 'delete')"
SQL["mail_delete_cascade"] = f"""
SELECT 'messages' AS name, count(*) AS n FROM x_messages WHERE account_id || provider_msg_id NOT IN {_GONE} UNION ALL SELECT 'embeddings', count(*) FROM x_members WHERE account_id || provider_msg_id NOT IN {_GONE}
UNION ALL SELECT 'message_clusters', count(*) FROM x_members WHERE account_id || provider_msg_id NOT IN {_GONE} UNION ALL SELECT 'cluster_classifications', count(*) FROM x_classes"""


def stage_actions(spark, d):
    """Archiving staged for every classified cluster: rows that are there keep their ids."""
    old = box.staged(spark, d).withColumns({"payload": F.lit("{}"), "proposed_reason": F.lit("old")})
    new = box.classes(spark, d).select((F.length("cluster_key") + 10_000_000).cast("long").alias("id"), "account_id", "cluster_key", F.lit(None).cast("string").alias("provider_msg_id"), F.lit("archive").alias("action_type"), F.timestamp_millis(F.lit(box.AS_OF_MS)).alias("staged_at"), F.lit("{}").alias("payload"), F.lit("new").alias("proposed_reason"))
    return review.stage(old, new).drop("staged_at", "payload")


SQL["mail_stage_actions"] = """
SELECT coalesce(s.id, length(c.cluster_key) + 10000000) AS id, c.account_id, c.cluster_key, CAST(NULL AS VARCHAR) AS provider_msg_id, 'archive' AS action_type, 'new' AS proposed_reason
FROM x_classes c LEFT JOIN x_staged s ON s.account_id = c.account_id AND s.cluster_key = c.cluster_key AND s.provider_msg_id IS NULL
UNION ALL SELECT id, account_id, cluster_key, provider_msg_id, action_type, 'old' FROM x_staged WHERE provider_msg_id IS NOT NULL"""


def delete_account(spark, d):
    left = store.delete_account({"messages": box.messages(spark, d), "members": box.members(spark, d)}, "a1")
    return left["messages"].groupBy("account_id").agg(F.count("*").alias("messages")).join(left["members"].groupBy("account_id").agg(F.count("*").alias("members")), "account_id", "left")


SQL["mail_delete_account"] = "SELECT g.account_id, count(*) AS messages, count(m.provider_msg_id) AS members FROM x_messages g LEFT JOIN x_members m ON g.account_id = m.account_id AND g.provider_msg_id = m.provider_msg_id WHERE g.account_id <> 'a1' GROUP BY 1"


def apply_changes(spark, d):
    """The whole change feed as one page: deletes first, then the upserts of each message."""
    blank = {c: F.lit(None).cast(t) for c, t in (("embedded_at", "timestamp"), ("classified_at", "timestamp"), ("category", "string"), ("classified_confidence", "float"))}
    tables = {"messages": box.messages(spark, d).withColumns(blank), "embeddings": box.embeddings(spark, d), "message_clusters": box.members(spark, d)}
    changes = box.derived(spark, d, box.CHANGES).withColumns({"page": F.lit(0).cast("long"), "sender": F.lit(None).cast("string"), "sender_email": F.lit(None).cast("string"), "snippet": F.lit(None).cast("string"), "label_ids": F.array(F.lit("INBOX"))})
    return sync.apply_changes(tables, changes)["messages"].select(*KEYS, "subject", "history_id", F.concat_ws(",", "label_ids").alias("labels"))


SQL["mail_apply_changes"] = f"""
SELECT coalesce(u.account_id, g.account_id) AS account_id, coalesce(u.provider_msg_id, g.provider_msg_id) AS provider_msg_id, coalesce(u.subject, g.subject) AS subject, coalesce(u.history_id, g.history_id) AS history_id, CASE WHEN u.account_id IS NULL THEN g.labels ELSE 'INBOX' END AS labels
FROM (SELECT * FROM x_messages WHERE account_id || provider_msg_id NOT IN {_GONE}) g FULL JOIN {_LAST} u ON u.account_id = g.account_id AND u.provider_msg_id = g.provider_msg_id"""


def first_member_cosine(spark, d):
    """Each embedded message's similarity to its cluster's first one."""
    m = box.members(spark, d).join(box.embeddings(spark, d).select(*KEYS, "embedding"), KEYS)
    first = m.groupBy("account_id", "cluster_key").agg(F.min_by("embedding", "provider_msg_id").alias("first"))
    return m.join(first, ["account_id", "cluster_key"]).select(*KEYS, F.round(cosine(F.col("embedding"), F.col("first")), 4).alias("similarity"))


SQL["mail_first_member_cosine"] = """
SELECT m.account_id, m.provider_msg_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 4) AS similarity FROM x_members m JOIN embeddings e ON e.vec_id = m.doc_id
JOIN (SELECT account_id, cluster_key, min(doc_id) AS first_id FROM x_members GROUP BY 1, 2) c ON c.account_id = m.account_id AND c.cluster_key = m.cluster_key JOIN embeddings f ON f.vec_id = c.first_id"""


def stored_cosine(spark, d):
    """first_member_cosine on vectors as bytes, in single precision."""
    stored = box.embeddings(spark, d).select(*KEYS, to_bytes("embedding").alias("raw"))
    m = box.members(spark, d).join(stored, KEYS)
    first = m.groupBy("account_id", "cluster_key").agg(F.min_by("raw", "provider_msg_id").alias("first"))
    return m.join(first, ["account_id", "cluster_key"]).select(*KEYS, F.octet_length("raw").alias("n_bytes"), F.round(cosine32(from_bytes("raw"), from_bytes("first")).cast("double"), 3).alias("similarity"))


SQL["mail_stored_cosine"] = SQL["mail_first_member_cosine"].replace(", 4) AS", ", 3) AS").replace("round(", "CAST(4 * len(e.embedding) AS INTEGER) AS n_bytes, round(")


def _folded(df):
    return df.withColumn("centroid_cosine", F.round(F.col("centroid_cosine").cast("double"), 3))


def greedy_clusters(spark, d):
    return _folded(clusters.greedy_clusters(box.messages(spark, d), box.embeddings(spark, d)))


def merging_clusters(spark, d):
    """As greedy_clusters, at a similarity at which messages do join."""
    return _folded(clusters.greedy_clusters(box.messages(spark, d), box.embeddings(spark, d), 0.3))


_FOLD = """
, own AS (SELECT account_id, provider_msg_id, coalesce(sender_email, '') AS bucket, CAST(e.embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY account_id, coalesce(sender_email, '') ORDER BY internal_date) AS i,
  count(*) OVER (PARTITION BY account_id, coalesce(sender_email, '')) AS n FROM x_messages g JOIN embeddings e ON e.vec_id = g.doc_id),
fold AS (
  SELECT account_id, bucket, CAST(1 AS BIGINT) AS i, [v] AS means, [1.0::DOUBLE] AS sizes, CAST(1 AS BIGINT) AS part, 1.0::DOUBLE AS score FROM own WHERE i = 1 AND n >= 4
  UNION ALL
  SELECT account_id, bucket, i, CASE WHEN score >= {at} THEN list_transform(means, lambda m, k: CASE WHEN k = best THEN list_transform(m, lambda x, j: (x * sizes[best] + v[j]) / (sizes[best] + 1)) ELSE m END) ELSE list_append(means, v) END,
    CASE WHEN score >= {at} THEN list_transform(sizes, lambda x, k: CASE WHEN k = best THEN x + 1 ELSE x END) ELSE list_append(sizes, 1.0) END, CASE WHEN score >= {at} THEN best ELSE len(means) + 1 END, CASE WHEN score >= {at} THEN score ELSE 1.0 END
  FROM (SELECT *, list_position(sims, list_max(sims)) AS best, list_max(sims) AS score FROM (SELECT f.account_id, f.bucket, o.i, means, sizes, v, list_transform(means, lambda m: list_cosine_similarity(m, v)) AS sims FROM fold f JOIN own o ON o.account_id = f.account_id AND o.bucket = f.bucket AND o.i = f.i + 1) y) z)
SELECT o.account_id, provider_msg_id, CASE WHEN o.bucket = '' THEN 'unknown::' || left(sha256(o.account_id), 16) ELSE 'sender::' || o.bucket END || CASE WHEN coalesce(part, 1) > 1 THEN '#' || (part - 1) ELSE '' END AS cluster_key, round(coalesce(score, 1.0), 3) AS centroid_cosine
FROM own o LEFT JOIN fold f ON f.account_id = o.account_id AND f.bucket = o.bucket AND f.i = o.i"""
SQL["mail_greedy_clusters"], SQL["mail_merging_clusters"] = (_FOLD.replace("{at}", x) for x in ("0.85", "0.3"))


def queries():
    named = (review_queue, colocated_review, review_increments, cluster_summaries, cluster_top_messages, message_counts, account_summaries, embedding_status, category_histogram, missing_embeddings, embedding_texts, sender_addresses, gmail_projection, representatives, signatures, model_outputs, action_plan, outcome_counts, recent_log, reversible_log, undo_status, export_csv, export_json, upsert_messages, delete_cascade, stage_actions, delete_account, apply_changes, first_member_cosine, stored_cosine, greedy_clusters, merging_clusters)
    return {f"mail_{f.__name__}": f for f in named} | sync_plans.queries() | work_plans.queries()


def oracle_sql():
    return {k: box.with_tables(v) for k, v in (SQL | sync_plans.SQL | work_plans.SQL).items()}

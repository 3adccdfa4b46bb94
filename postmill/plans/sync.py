"""Queries of pages, change feeds and sync state over derived tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.numbers import received_ms
from postmill.operators import store
from postmill.schema import CASCADES, TABLES
from postmill.sources import mailbox as box
from postmill.sources import pages
from postmill.streaming import keyed, sync
from postmill.streaming.progress import counted

KEYS = ["account_id", "provider_msg_id"]
SQL: dict[str, str] = {}
#: Changes of one history page.
PAGE = 200


def moment():
    return F.timestamp_millis(F.lit(box.AS_OF_MS))


def gmail_body(sender, subject, labels, snippet, date, history):
    """One message's metadata as the provider gives it: header names in any case, an absent sender as an empty header."""
    headers = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("X-Other", F.lit("no")), ("FROM", F.coalesce(sender, F.lit(""))), ("subject", subject))])
    return F.to_json(F.struct(F.col("provider_msg_id").alias("id"), F.col("thread_id").alias("threadId"), labels.alias("labelIds"), snippet.alias("snippet"), date.cast("string").alias("internalDate"), history.alias("historyId"), F.struct(headers.alias("headers")).alias("payload")))


def message_bodies(spark, d) -> DataFrame:
    """(account_id, provider_msg_id, page, history_id, body) of every message, some 50 a page."""
    m = box.derived(spark, d, box.MESSAGES).withColumn("label_ids", F.split("labels", ","))
    body = gmail_body(F.col("sender"), F.col("subject"), F.col("label_ids"), F.lit("s"), F.col("internal_date"), F.col("history_id").cast("string"))
    return m.select(*KEYS, F.floor(F.col("doc_id") / 150).alias("page"), "history_id", "thread_id", body.alias("body"))


def list_pages(spark, d) -> DataFrame:
    """LANDED list pages of all accounts; the last has no token."""
    m = message_bodies(spark, d)
    last = m.groupBy("account_id").agg(F.max("page").alias("last"))
    refs = F.collect_list(F.struct(F.col("provider_msg_id").alias("id"), F.col("thread_id").alias("threadId"))).alias("messages")
    token = F.when(F.col("page") < F.col("last"), F.concat(F.lit("P"), (F.col("page") + 1).cast("string"))).alias("nextPageToken")
    return m.groupBy("account_id", "page").agg(refs).join(last, "account_id").select("account_id", F.lit("gmail_list").alias("kind"), "page", F.to_json(F.struct("messages", token)).alias("body"))


def events(spark, d) -> DataFrame:
    return box.derived(spark, d, box.CHANGES).withColumn("page", F.floor(F.col("seq") / PAGE))


def history_pages(spark, d) -> DataFrame:
    """LANDED history pages of the change feed; every seventh page's own history id isn't a number."""
    e = events(spark, d)
    kind = {"messagesDeleted": "error", "labelsAdded": "view", "labelsRemoved": "click"}
    ref = F.array(F.struct(F.struct(F.col("provider_msg_id").alias("id")).alias("message")))
    fields = [F.when(F.col("subject") == v, ref).alias(k) for k, v in kind.items()] + [F.when(~F.col("subject").isin(*kind.values()), ref).alias("messagesAdded")]
    last = e.groupBy("account_id").agg(F.max("page").alias("last"))
    per = e.groupBy("account_id", "page").agg(F.collect_list(F.struct(F.col("seq").cast("string").alias("id"), *fields)).alias("history"), F.max("seq").alias("top")).join(last, "account_id")
    token = F.when(F.col("page") < F.col("last"), F.lit("next")).alias("nextPageToken")
    own = F.when(F.col("page") % 7 == 3, "x").otherwise(F.col("top").cast("string")).alias("historyId")
    return per.select("account_id", F.lit("gmail_history").alias("kind"), "page", F.to_json(F.struct("history", token, own)).alias("body"))


def history_bodies(spark, d) -> DataFrame:
    """Metadata of what each history page names, as of that page."""
    last = events(spark, d).filter("op = 'upsert'").groupBy(*KEYS, "page").agg(F.max_by(F.struct("thread_id", "subject", "internal_date", "history_id"), "seq").alias("e")).select(*KEYS, "page", "e.*")
    none = F.lit(None).cast("string")
    return last.select("account_id", "page", gmail_body(none, F.col("subject"), F.array(F.lit("INBOX")), F.lit("s"), F.col("internal_date"), F.col("history_id").cast("string")).alias("body"))


def gmail_list(spark, d):
    return pages.listed(list_pages(spark, d).drop("kind"))


SQL["mail_gmail_list"] = "SELECT account_id, CAST(floor(doc_id / 150) AS BIGINT) AS page, provider_msg_id AS id, thread_id FROM x_messages"


def history_ids(spark, d):
    return pages.history_ids(history_pages(spark, d))


SQL["mail_history_ids"] = f"SELECT DISTINCT account_id, CAST(floor(seq / {PAGE}) AS BIGINT) AS page, CASE op WHEN 'upsert' THEN 'fetch' ELSE op END AS op, provider_msg_id FROM x_changes"


def base_tables(spark, d) -> dict[str, DataFrame]:
    """Messages that were classified as work, and what hangs on them."""
    marks = {"embedded_at": F.lit(None).cast("timestamp"), "classified_at": F.lit(None).cast("timestamp"), "category": F.lit("work"), "classified_confidence": F.lit(None).cast("float")}
    return {"messages": box.messages(spark, d).withColumns(marks), "embeddings": box.embeddings(spark, d), "message_clusters": box.members(spark, d)}


def incremental(spark, d):
    """The change feed's pages, one after the other: messages after the last, and which still have their class."""
    changes = sync.changes_of(history_pages(spark, d), history_bodies(spark, d))
    out = sync.apply_changes(base_tables(spark, d), changes)
    return out["messages"].select(*KEYS, "subject", "history_id", F.concat_ws(",", "label_ids").alias("labels"), "category")


_PAGED = f"(SELECT *, CAST(floor(seq / {PAGE}) AS BIGINT) AS page FROM x_changes)"
_DEAD = f"(SELECT account_id, provider_msg_id, max(page) AS dead FROM {_PAGED} p WHERE op = 'delete' GROUP BY 1, 2)"
SQL["mail_incremental"] = f"""
SELECT coalesce(u.account_id, g.account_id) AS account_id, coalesce(u.provider_msg_id, g.provider_msg_id) AS provider_msg_id, coalesce(u.subject, g.subject) AS subject, coalesce(u.history, g.history_id) AS history_id,
  CASE WHEN u.account_id IS NULL THEN g.labels ELSE 'INBOX' END AS labels, CASE WHEN g.account_id IS NOT NULL THEN 'work' END AS category
FROM (SELECT m.* FROM x_messages m LEFT JOIN {_DEAD} x ON x.account_id = m.account_id AND x.provider_msg_id = m.provider_msg_id WHERE dead IS NULL) g
FULL JOIN (SELECT * FROM (SELECT p.account_id, p.provider_msg_id, subject, coalesce(history_id, 0) AS history, row_number() OVER (PARTITION BY p.account_id, p.provider_msg_id ORDER BY seq DESC) AS k
  FROM {_PAGED} p LEFT JOIN {_DEAD} x ON x.account_id = p.account_id AND x.provider_msg_id = p.provider_msg_id WHERE op = 'upsert' AND (dead IS NULL OR page >= dead)) z WHERE k = 1) u
  ON u.account_id = g.account_id AND u.provider_msg_id = g.provider_msg_id"""


def cascades(spark, d):
    """What hangs on the messages after the feed: gone with every message that was deleted, come back or not."""
    out = sync.apply_changes(base_tables(spark, d), sync.changes_of(history_pages(spark, d), history_bodies(spark, d)))
    one, two = (out[n].groupBy("account_id").agg(F.count("*").alias("n")).withColumn("name", F.lit(n)) for n in CASCADES)
    return one.unionByName(two)


SQL["mail_cascades"] = """
SELECT account_id, count(*) AS n, name FROM x_members m, (SELECT 'embeddings' AS name UNION ALL SELECT 'message_clusters') t
WHERE NOT EXISTS (SELECT 1 FROM x_changes c WHERE op = 'delete' AND c.account_id = m.account_id AND c.provider_msg_id = m.provider_msg_id) GROUP BY 1, 3"""


def graph_pages(spark, d) -> DataFrame:
    """LANDED delta pages: a first pass over all messages, then a second that removes some and changes others."""
    m = box.derived(spark, d, box.MESSAGES).select(*KEYS, "doc_id", "subject", "sender_email", "internal_date")
    at = F.date_format(F.timestamp_millis(F.col("internal_date")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    n = F.col("doc_id")
    removed = F.struct(F.lit("deleted").alias("reason"))
    who = F.struct(F.struct(F.when(n % 5 == 1, "").when(n % 5 > 1, "N").alias("name"), F.concat(F.upper("sender_email"), F.when(n % 4 == 1, " ").otherwise("")).alias("address")).alias("emailAddress"))
    first = F.struct(
        F.col("provider_msg_id").alias("id"), F.when(n % 7 == 0, F.lit("c1")).alias("conversationId"), "subject", F.lit("p").alias("bodyPreview"), F.when(F.col("sender_email").isNotNull(), who).alias("from"),
        F.when(n % 6 == 0, F.date_format(F.timestamp_millis(F.col("internal_date")), "yyyy-MM-dd")).otherwise(at).alias("receivedDateTime"), F.when(n % 3 > 0, "f1").alias("parentFolderId"),
        F.when(n % 4 == 1, F.lit(True)).when(n % 4 == 2, F.lit(False)).alias("isRead"), F.when(n % 2 == 0, F.array(F.lit("red"), F.lit("blue"))).alias("categories"), F.when(n % 11 == 0, removed).alias("@removed"),
    )
    second = F.struct(F.col("provider_msg_id").alias("id"), F.lit(True).alias("isRead"), F.lit("again").alias("subject"), F.when(n % 13 == 0, removed).alias("@removed"))
    rows = m.select("account_id", F.floor(n / 100).alias("page"), n.alias("k"), F.to_json(first).alias("v")).unionByName(m.filter((n % 13 == 0) | (n % 17 == 0)).select("account_id", (F.floor(n / 300) + 100_000).alias("page"), n.alias("k"), F.to_json(second).alias("v")))
    per = rows.groupBy("account_id", "page").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("l"))
    last = per.groupBy("account_id").agg(F.max("page").alias("last"))
    link = F.when(F.col("page") < F.col("last"), F.lit(', "@odata.nextLink": "http://n"}')).otherwise(F.concat(F.lit(', "@odata.deltaLink": "http://d/'), "account_id", F.lit('"}')))
    body = F.concat(F.lit('{"value": ['), F.concat_ws(",", F.transform("l", lambda x: x["v"])), F.lit("]"), link)
    return per.join(last, "account_id").select("account_id", F.lit("graph_delta").alias("kind"), "page", body.alias("body"))


def graph_sync(spark, d):
    """All delta pages over a table that knows some messages already, with history ids that a null must not replace."""
    tables = base_tables(spark, d)
    known = F.regexp_extract("provider_msg_id", r"(\d+)", 1).cast("long") % 5 == 0
    tables["messages"] = tables["messages"].filter(known).withColumn("history_id", F.lit(5).cast("long"))
    out = sync.apply_changes(tables, pages.graph_changes(graph_pages(spark, d)))["messages"]
    return out.select(*KEYS, "thread_id", "sender", "sender_email", "subject", "snippet", "internal_date", F.concat_ws(",", "label_ids").alias("labels"), "history_id")


_ADDRESS = "upper(sender_email) || CASE WHEN doc_id % 4 = 1 THEN ' ' ELSE '' END"
SQL["mail_graph_sync"] = f"""
SELECT account_id, provider_msg_id, CASE WHEN again THEN provider_msg_id WHEN doc_id % 7 = 0 THEN 'c1' ELSE provider_msg_id END AS thread_id,
  CASE WHEN again THEN NULL WHEN doc_id % 5 = 0 THEN {_ADDRESS} ELSE CASE WHEN doc_id % 5 = 1 THEN '' ELSE 'N' END || ' <' || {_ADDRESS} || '>' END AS sender, CASE WHEN NOT again THEN lower({_ADDRESS}) END AS sender_email,
  CASE WHEN again THEN 'again' ELSE subject END AS subject, CASE WHEN NOT again THEN 'p' END AS snippet, CASE WHEN again OR doc_id % 6 = 0 THEN 0 ELSE internal_date END AS internal_date,
  CASE WHEN again THEN '' ELSE concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'red,blue' END, CASE WHEN doc_id % 3 > 0 THEN 'FOLDER:f1' END, CASE WHEN doc_id % 4 <> 1 THEN 'UNREAD' END) END AS labels,
  CASE WHEN doc_id % 5 = 0 AND doc_id % 11 <> 0 THEN CAST(5 AS BIGINT) END AS history_id
FROM (SELECT *, doc_id % 17 = 0 AS again FROM x_messages) m WHERE doc_id % 13 <> 0 AND (again OR doc_id % 11 <> 0)"""


def graph_projection(spark, d):
    """Delta messages of the first pass one by one, removals left out."""
    first = graph_pages(spark, d).filter("page < 100000").select("account_id", F.explode(F.from_json("body", "value array<string>")["value"]).alias("body"))
    rows = pages.graph_messages(first)[1]
    return rows.withColumn("label_ids", F.concat_ws(",", "label_ids")).drop("history_id")


SQL["mail_graph_projection"] = f"""
SELECT account_id, provider_msg_id, CASE WHEN doc_id % 7 = 0 THEN 'c1' ELSE provider_msg_id END AS thread_id, CASE WHEN doc_id % 5 = 0 THEN {_ADDRESS} ELSE CASE WHEN doc_id % 5 = 1 THEN '' ELSE 'N' END || ' <' || {_ADDRESS} || '>' END AS sender,
  lower({_ADDRESS}) AS sender_email, subject, 'p' AS snippet, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE internal_date END AS internal_date,
  concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'red,blue' END, CASE WHEN doc_id % 3 > 0 THEN 'FOLDER:f1' END, CASE WHEN doc_id % 4 <> 1 THEN 'UNREAD' END) AS label_ids
FROM x_messages WHERE doc_id % 11 <> 0"""


def removed(spark, d):
    """Ids that the first pass of the delta names as removed."""
    first = graph_pages(spark, d).filter("page < 100000").select("account_id", F.explode(F.from_json("body", "value array<string>")["value"]).alias("body"))
    return pages.graph_messages(first)[0]


SQL["mail_removed"] = "SELECT account_id, provider_msg_id FROM x_messages WHERE doc_id % 11 = 0"


def state_of(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, "account_id string, phase string, cursor_token string, last_history_id long").selectExpr("*", "cast(null as timestamp) last_sync_at", "cast(null as timestamp) initial_started_at", "cast(null as timestamp) initial_completed_at")


def _told(state: DataFrame) -> DataFrame:
    return state.select("account_id", "phase", "cursor_token", "last_history_id", *[F.col(c).isNotNull().alias(c.rpartition("_")[0]) for c in ("last_sync_at", "initial_started_at", "initial_completed_at")])


def sync_state(spark, d):
    """State after a run in which a0 follows its history, a1 ends a walk that an earlier run began, a2 a delta, a5 is
    stopped in its first walk, a9 is empty, and a7 isn't synced."""
    lists = list_pages(spark, d)
    bodies = message_bodies(spark, d).select("account_id", "page", "body")
    cut = lists.filter("account_id = 'a0'").withColumn("body", F.expr("""replace(body, '}]}', '}],"nextPageToken":"more"}')"""))
    empty = spark.createDataFrame([("a9", "gmail_list", 0, '{"resultSizeEstimate": 0}')], lists.schema)
    own = bodies.filter("account_id = 'a0'").withColumn("account_id", F.lit("a5"))
    landed = history_pages(spark, d).filter("account_id = 'a0'").unionByName(lists.filter("account_id = 'a1' and page > 0")).unionByName(graph_pages(spark, d).filter("account_id = 'a2'")).unionByName(cut.withColumn("account_id", F.lit("a5"))).unionByName(empty)
    fetched = history_bodies(spark, d).filter("account_id = 'a0'").unionByName(bodies.filter("account_id = 'a1' and page > 0")).unionByName(own)
    before = state_of(spark, [("a0", "incremental", None, 7), ("a1", "initial", "P1", 1_000_000_000), ("a2", "incremental", "d0", None), ("a7", "incremental", None, 3)])
    return _told(sync.advanced(before, landed, fetched, moment()))


SQL["mail_sync_state"] = f"""
SELECT 'a0' AS account_id, 'incremental' AS phase, CAST(NULL AS VARCHAR) AS cursor_token, (SELECT greatest(7, max(CASE WHEN floor(seq / {PAGE}) % 7 <> 3 THEN top END), max(h)) FROM (SELECT seq, max(seq) OVER (PARTITION BY floor(seq / {PAGE})) AS top, CASE WHEN op = 'upsert' AND seq = max(seq) FILTER (op = 'upsert') OVER (PARTITION BY floor(seq / {PAGE}), provider_msg_id) THEN history_id END AS h FROM x_changes WHERE account_id = 'a0') z) AS last_history_id, true AS last_sync, false AS initial_started, false AS initial_completed
UNION ALL SELECT 'a1', 'incremental', NULL, CAST(1000000000 AS BIGINT), true, true, true UNION ALL SELECT 'a2', 'incremental', 'http://d/a2', NULL, true, false, false
UNION ALL SELECT 'a5', 'initial', 'more', max(history_id), false, true, false FROM x_messages WHERE account_id = 'a0' UNION ALL SELECT 'a7', 'incremental', NULL, 3, false, false, false UNION ALL SELECT 'a9', 'incremental', NULL, 1, true, true, true"""


def phases(spark, d):
    """How each account's next sync begins, and accounts without a state among them."""
    have = state_of(spark, [("a0", "initial", "P2", None), ("a1", "incremental", None, 4), ("a2", "incremental", None, None)])
    accounts = box.derived(spark, d, box.ACCOUNTS)
    return sync.next_phase(accounts.select("account_id").join(have, "account_id", "left"))


SQL["mail_phases"] = "SELECT account_id, CASE account_id WHEN 'a0' THEN 'resume' WHEN 'a1' THEN 'incremental' WHEN 'a2' THEN 'reset' ELSE 'full' END AS mode FROM x_accounts"


def state_marks(spark, d):
    """First walks begun for all accounts, then ended for those with messages."""
    before = state_of(spark, [("a0", "incremental", "c", 9), ("b", "incremental", None, 2)])
    begun = sync.mark_started(before, box.derived(spark, d, box.ACCOUNTS), moment())
    return _told(sync.mark_complete(begun, sync.baseline(box.messages(spark, d).filter("account_id <> 'a2'")), moment()))


SQL["mail_state_marks"] = """
SELECT a.account_id, CASE WHEN h IS NULL THEN 'initial' ELSE 'incremental' END AS phase, CAST(NULL AS VARCHAR) AS cursor_token, h AS last_history_id, h IS NOT NULL AS last_sync, true AS initial_started, h IS NOT NULL AS initial_completed
FROM x_accounts a LEFT JOIN (SELECT account_id, greatest(max(history_id), 1) AS h FROM x_messages WHERE account_id <> 'a2' GROUP BY 1) m ON m.account_id = a.account_id
UNION ALL SELECT 'b', 'incremental', NULL, 2, false, false, false"""


def state_records(spark, d):
    """Checkpoints put over each other: what a walk sets changes, the moments of the first walk stay."""
    begun = sync.mark_started(store.empty(spark, "sync_state"), box.derived(spark, d, box.ACCOUNTS), moment())
    new = box.messages(spark, d).groupBy("account_id").agg(F.max("history_id").alias("last_history_id")).select("account_id", F.lit("initial").alias("phase"), F.lit("P9").alias("cursor_token"), "last_history_id", F.lit(None).cast("timestamp").alias("last_sync_at"))
    return _told(sync.record_state(begun, new))


SQL["mail_state_records"] = """
SELECT a.account_id, 'initial' AS phase, CASE WHEN h IS NOT NULL THEN 'P9' END AS cursor_token, h AS last_history_id, false AS last_sync, true AS initial_started, false AS initial_completed
FROM x_accounts a LEFT JOIN (SELECT account_id, max(history_id) AS h FROM x_messages GROUP BY 1) m ON m.account_id = a.account_id"""


def mirror_accounts(spark, d):
    known = box.derived(spark, d, box.ACCOUNTS)
    old = known.filter("account_id < 'a2'").select("account_id", F.lit("graph").alias("provider"), F.lit("old@x").alias("email"), F.lit(None).cast("timestamp").alias("created_at"))
    return store.mirror_accounts(old, known, moment()).drop("created_at")


SQL["mail_mirror_accounts"] = "SELECT account_id, CASE WHEN account_id < 'a2' THEN 'graph' ELSE provider END AS provider, email FROM x_accounts"


def stream_sync(spark, d):
    """Landed pages through the stream into stored tables: a first walk, then the whole feed as one step of each account,
    its deletes before all else: history pages of deletes first, then those of upserts."""
    where = store.scratch(spark, "stream")
    known = message_bodies(spark, d).select(*KEYS, "body")
    changed = known.withColumn("body", F.regexp_replace("body", '"value":"[^"]* (en|de|fr|es) ', '"value":"changed '))
    list_pages(spark, d).write.json(f"{where}/landed", mode="append")
    sync.run(spark, f"{where}/landed", f"{where}/tables", f"{where}/checkpoint", lambda ids: ids.join(known, KEYS).select("account_id", "body"), moment, 4)
    one = events(spark, d).withColumn("page", F.col("page") + F.when(F.col("op") == "upsert", F.lit(1 << 40)).otherwise(F.lit(0)))
    ref = F.array(F.struct(F.struct(F.col("provider_msg_id").alias("id")).alias("message")))
    record = F.struct(F.when(F.col("op") == "delete", ref).alias("messagesDeleted"), F.when(F.col("op") == "upsert", ref).alias("labelsAdded"))
    page = one.groupBy("account_id", "page").agg(F.collect_list(record).alias("history")).select("account_id", F.lit("gmail_history").alias("kind"), "page", F.to_json(F.struct("history", F.lit("77").alias("historyId"))).alias("body"))
    page.write.json(f"{where}/landed", mode="append")
    for _ in range(2):  # nothing new the second time
        sync.run(spark, f"{where}/landed", f"{where}/tables", f"{where}/checkpoint", lambda ids: ids.join(changed, KEYS).select("account_id", "body"), moment, 4)
    tables = store.Tables(spark, f"{where}/tables", 4)
    state = tables.read("sync_state").select("account_id", "phase", F.col("last_history_id").alias("top"))
    return tables.read("messages").join(state, "account_id").select(*KEYS, F.regexp_replace("subject", " [0-9]+$", "").alias("subject"), "internal_date", "phase", "top")


SQL["mail_stream_sync"] = """
SELECT g.account_id, g.provider_msg_id, CASE WHEN up THEN 'changed' ELSE regexp_replace(subject, ' [0-9]+$', '') END AS subject, internal_date, 'incremental' AS phase, greatest(77, max(history_id) OVER (PARTITION BY g.account_id)) AS top
FROM x_messages g LEFT JOIN (SELECT account_id, provider_msg_id, bool_or(op = 'upsert') AS up FROM x_changes GROUP BY 1, 2) c ON c.account_id = g.account_id AND c.provider_msg_id = g.provider_msg_id
QUALIFY coalesce(up, true)"""
SQL["mail_stream_sync"] = SQL["mail_stream_sync"].replace("CASE WHEN up THEN", "CASE WHEN coalesce(up, false) THEN")


def keyed_feed(spark, d):
    """mail_incremental's feed through keyed state: pages land in a mixed order, some twice, in two runs."""
    where = store.scratch(spark, "keyed")
    landed = history_pages(spark, d).withColumn("run", F.pmod(F.xxhash64("account_id", "page"), F.lit(2))).persist()
    before = base_tables(spark, d)["messages"]
    bodies = history_bodies(spark, d)
    for run in range(2):
        rows = landed.filter((F.col("run") == run) | (F.col("page") % 5 == run)).drop("run")
        rows.repartition(3, F.xxhash64("page", "account_id")).write.json(f"{where}/landed", mode="append")
        keyed.feed(spark, f"{where}/landed", before, bodies, f"{where}/log", f"{where}/checkpoint")
    landed.unpersist()
    out = keyed.after_feed(before, spark.read.schema(keyed.CHANGED).parquet(f"{where}/log"))
    return out.select(*KEYS, "subject", "history_id", F.concat_ws(",", "label_ids").alias("labels"), F.when(F.col("kept"), F.lit("work")).alias("category"))


SQL["mail_keyed_feed"] = SQL["mail_incremental"]


def received(spark, d):
    """Times of several shapes: with a zone or an offset they count, without one, or as a bare date, they don't."""
    at = lambda f: F.date_format(F.col("o_orderdate").cast("timestamp"), f)
    shapes = F.array(at("yyyy-MM-dd'T'HH:mm:ss'Z'"), at("yyyy-MM-dd'T'HH:mm:ss'.75z'"), at("yyyy-MM-dd'T'HH:mm:ss'+02:00'"), at("yyyy-MM-dd"), at("yyyy-MM-dd'T'HH:mm:ss"), at("yyyy-MM-dd HH:mm"), F.lit("soon"), F.lit(None))
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.posexplode(shapes).alias("shape", "t"))
    return rows.select("o_orderkey", "shape", received_ms(F.col("t")).alias("ms"))


SQL["mail_received"] = "SELECT o_orderkey, CAST(shape AS INTEGER) AS shape, CASE WHEN shape < 2 THEN epoch_ms(CAST(o_orderdate AS TIMESTAMP)) WHEN shape = 2 THEN epoch_ms(CAST(o_orderdate AS TIMESTAMP)) - 7200000 ELSE 0 END AS ms FROM orders, range(8) r(shape)"


def progress(spark, d):
    """Counters that a write yields beside its rows."""
    df, seen = counted(box.messages(spark, d), unsubscribe=F.array_contains("label_ids", "x-List-Unsubscribe"), nameless=F.col("sender").isNull())
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "rows long, unsubscribe long, nameless long")


SQL["mail_progress"] = "SELECT count(*) AS rows, count(*) FILTER (labels LIKE '%Unsubscribe') AS unsubscribe, count(*) FILTER (sender IS NULL) AS nameless FROM x_messages"


def empty_table(spark, d):
    """Tables that were never written are there, without rows."""
    tables = store.Tables(spark, store.scratch(spark, "none"))
    return spark.createDataFrame([(n, tables.read(n).count(), len(tables.read(n).columns)) for n in sorted(TABLES)], "name string, n long, columns int")


SQL["mail_empty_table"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST(0 AS BIGINT), {len(t.split(', '))})" for n, t in sorted(TABLES.items())) + ") t(name, n, columns)"


def queries():
    named = (gmail_list, history_ids, incremental, cascades, graph_sync, graph_projection, removed, sync_state, phases, state_marks, state_records, mirror_accounts, stream_sync, keyed_feed, received, progress, empty_table)
    return {f"mail_{f.__name__}": f for f in named}

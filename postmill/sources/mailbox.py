"""Mailbox tables derived from the test tables, as SQL that both Spark and other engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-03-01, for ages, and a moment for the undo window.
AS_OF_MS, UNDO_AS_OF = 1_709_251_200_000, "1998-06-30 00:00:00"

MESSAGES = """
SELECT 'a' || CAST(doc_id % 3 AS VARCHAR(20)) AS account_id, 'm' || lpad(CAST(doc_id AS VARCHAR(20)), 8, '0') AS provider_msg_id,
  't' || CAST(CAST(floor(doc_id / 5) AS BIGINT) AS VARCHAR(20)) AS thread_id,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE '  "Sender ' || source || '" <' || upper(source || '@' || lang || '.example.com') || '> ' END AS sender,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lower(source || '@' || lang || '.example.com') END AS sender_email,
  source || ' ' || lang || ' ' || CAST(doc_id AS VARCHAR(20)) AS subject, text AS snippet,
  CAST(1704067200000 AS BIGINT) + doc_id * 3600000 AS internal_date,
  'INBOX,UNREAD' || CASE WHEN doc_id % 7 = 0 THEN ',x-List-Unsubscribe' ELSE '' END AS labels, doc_id + 1 AS history_id, doc_id
FROM {documents}"""

MEMBERS = f"""
SELECT account_id, provider_msg_id, CASE WHEN sender_email IS NULL THEN 'unknown::' || account_id ELSE 'sender::' || sender_email END AS cluster_key,
  round(CAST(doc_id % 97 AS DOUBLE) / 97, 4) AS centroid_cosine, doc_id
FROM ({MESSAGES}) m JOIN {{embeddings}} e ON e.vec_id = m.doc_id"""

CLASSES = f"""
SELECT account_id, cluster_key, CASE k % 9 WHEN 0 THEN 'transactional' WHEN 1 THEN 'newsletter' WHEN 2 THEN 'social' WHEN 3 THEN 'personal' WHEN 4 THEN 'work'
  WHEN 5 THEN 'security' WHEN 6 THEN 'promotional' WHEN 7 THEN 'notification' ELSE 'unknown' END AS category,
  CAST(CASE k % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.625 WHEN 2 THEN 0.75 ELSE 0.875 END AS DOUBLE) AS confidence, k, first_id
FROM (SELECT account_id, cluster_key, sum(doc_id) AS k, min(doc_id) AS first_id FROM ({MEMBERS}) x WHERE cluster_key LIKE 'sender::%' GROUP BY account_id, cluster_key) y"""

STAGED = f"""
SELECT first_id * 2 + 2 AS id, account_id, cluster_key, CAST(NULL AS VARCHAR(20)) AS provider_msg_id, 'archive' AS action_type FROM ({CLASSES}) c WHERE category IN ('promotional', 'notification', 'newsletter')
UNION ALL
SELECT first_id * 2 + 3 AS id, account_id, cluster_key, 'm' || lpad(CAST(first_id AS VARCHAR(20)), 8, '0') AS provider_msg_id, 'trash' AS action_type FROM ({CLASSES}) c WHERE category IN ('work', 'newsletter')"""

#: A moment for the mail made of orders, whose days are counted by months of 30 days.
ORDERS_AS_OF_MS = 2002 * 365 * 86_400_000

ORDER_MAIL = f"""
SELECT account_id, provider_msg_id, 'sender::' || sender_email AS cluster_key, sender_email, upper(sender_email) AS sender, 'order ' || CAST(n AS VARCHAR(20)) AS subject, 'x' AS snippet, 't' || CAST(n AS VARCHAR(20)) AS thread_id, labels, internal_date, n, n + 1 AS history_id, CAST(n % 100 AS DOUBLE) / 128 AS centroid_cosine
FROM (SELECT 'a' || CAST(o_custkey % 3 AS VARCHAR(20)) AS account_id, 'o' || lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0') AS provider_msg_id, o_orderkey AS n,
  CASE WHEN o_custkey % 10 = 0 THEN 'few' || CAST(o_custkey % 40 AS VARCHAR(20)) || '@' || lower(o_orderstatus) WHEN o_orderpriority >= '4' THEN 'bulk@all' ELSE 'p' || substr(o_orderpriority, 1, 1) || CAST(o_orderkey % 2 AS VARCHAR(20)) || '@' || lower(o_orderstatus) END || '.example.com' AS sender_email,
  'INBOX' || CASE WHEN o_orderkey % 211 = 0 THEN ',x-List-Unsubscribe' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN ',UNREAD' ELSE '' END AS labels,
  CASE WHEN o_custkey % 20 = 0 THEN {ORDERS_AS_OF_MS} - (o_orderkey % 80 + CASE WHEN o_custkey % 40 = 0 THEN 250 ELSE 0 END) * 86400000 - o_orderkey
    ELSE (CAST(year(o_orderdate) AS BIGINT) * 365 + month(o_orderdate) * 30 + day(o_orderdate)) * 86400000 + o_orderkey END AS internal_date FROM {{orders}}) o"""

ORDER_CLASSES = f"""
SELECT account_id, cluster_key, CASE k % 9 WHEN 0 THEN 'transactional' WHEN 1 THEN 'newsletter' WHEN 2 THEN 'social' WHEN 3 THEN 'personal' WHEN 4 THEN 'work'
  WHEN 5 THEN 'security' WHEN 6 THEN 'promotional' WHEN 7 THEN 'notification' ELSE 'unknown' END AS category,
  CAST(CASE k % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.625 WHEN 2 THEN 0.75 ELSE 0.875 END AS DOUBLE) AS confidence, first_n
FROM (SELECT account_id, cluster_key, min(n) + count(*) AS k, min(n) AS first_n FROM ({ORDER_MAIL}) x GROUP BY account_id, cluster_key) y"""

ORDER_STAGED = f"""
SELECT first_n * 2 + 2 AS id, account_id, cluster_key, CAST(NULL AS VARCHAR(20)) AS provider_msg_id, 'archive' AS action_type, first_n % 5 AS staged_n FROM ({ORDER_CLASSES}) c WHERE category IN ('promotional', 'notification', 'newsletter') OR cluster_key LIKE '%bulk%'
UNION ALL
SELECT first_n * 2 + 3 AS id, account_id, cluster_key, 'o' || lpad(CAST(first_n AS VARCHAR(20)), 9, '0') AS provider_msg_id, CASE WHEN category = 'work' THEN 'trash' ELSE 'unsubscribe' END AS action_type, first_n % 3 AS staged_n FROM ({ORDER_CLASSES}) c WHERE category IN ('work', 'newsletter', 'social')"""

LOG = """
SELECT o_orderkey AS id, 'a' || CAST(o_custkey % 3 AS VARCHAR(20)) AS account_id, 'sender::' || o_orderpriority AS cluster_key, 'm' || CAST(o_custkey AS VARCHAR(20)) AS provider_msg_id,
  CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'O' THEN 'success' ELSE 'cancelled' END AS outcome,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'archive' WHEN o_orderpriority LIKE '2%' THEN 'trash' WHEN o_orderpriority LIKE '3%' THEN 'mark_read' WHEN o_orderpriority LIKE '4%' THEN 'add_label' ELSE 'unsubscribe' END AS action_type,
  CASE o_orderstatus WHEN 'F' THEN 'http 500, "busy"' END AS error_message, o_orderdate AS executed_at,
  CASE WHEN o_orderkey % 2 = 0 THEN 'INBOX,UNREAD' ELSE 'UNREAD,x' END AS prior
FROM {orders}"""

CHANGES = """
SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, 'a' || CAST(user_id % 3 AS VARCHAR(20)) AS account_id,
  'm' || lpad(CAST(user_id AS VARCHAR(20)), 8, '0') AS provider_msg_id, 't' || CAST(user_id AS VARCHAR(20)) AS thread_id, event_type AS subject,
  CASE WHEN event_type = 'view' THEN NULL ELSE event_id END AS history_id, event_id AS internal_date
FROM {events}"""

ACCOUNTS = """
SELECT account_id, CASE WHEN account_id = 'a2' THEN 'graph' ELSE 'gmail' END AS provider, account_id || '@example.com' AS email
FROM (SELECT 'a0' AS account_id UNION ALL SELECT 'a1' UNION ALL SELECT 'a2' UNION ALL SELECT 'a9') x"""


def with_tables(text: str) -> str:
    """SQL with the derived tables that it names (x_messages, ...) as common table expressions; text that begins with a
    comma brings its own, recursive ones among them."""
    parts = {"messages": MESSAGES, "members": MEMBERS, "classes": CLASSES, "staged": STAGED, "log": LOG, "changes": CHANGES, "accounts": ACCOUNTS, "omail": ORDER_MAIL, "oclasses": ORDER_CLASSES, "ostaged": ORDER_STAGED}
    tables = {n: n for n in ("documents", "embeddings", "orders", "events")}
    used = [f"x_{k} AS ({v.format(**tables)})" for k, v in parts.items() if f"x_{k}" in text]
    text = text.lstrip()
    return (f"WITH RECURSIVE {', '.join(used)}{'' if text.startswith(',') else ' '}" if used else "") + text


def order_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ORDER_MAIL).withColumn("label_ids", F.split("labels", ",")).drop("labels", "n")


def order_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_mail(spark, sf_dir).select("account_id", "provider_msg_id", "cluster_key", "centroid_cosine")


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_mail(spark, sf_dir).drop("cluster_key", "centroid_cosine")


def order_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ORDER_CLASSES).withColumn("confidence", F.col("confidence").cast("float")).drop("first_n")


def order_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ORDER_STAGED).withColumn("staged_at", F.timestamp_millis(F.lit(ORDERS_AS_OF_MS) + F.col("staged_n") * 1000)).drop("staged_n")


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    import string

    names = {f for _, f, _, _ in string.Formatter().parse(text) if f}
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, MESSAGES).withColumn("label_ids", F.split("labels", ",")).drop("labels", "doc_id")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, MEMBERS).drop("doc_id")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CLASSES).withColumn("confidence", F.col("confidence").cast("float")).drop("k", "first_id")


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, STAGED).withColumn("staged_at", F.timestamp_millis(F.lit(AS_OF_MS)))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postmill.operators.actions import reversal_kind

    df = derived(spark, sf_dir, LOG).withColumn("prior_label_ids", F.split("prior", ",")).withColumn("executed_at", F.col("executed_at").cast("timestamp")).drop("prior")
    return df.withColumn("reversal_kind", reversal_kind(F.col("action_type"), F.col("outcome"))).withColumn("reversed_at", F.lit(None).cast("timestamp"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the messages that have one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    own = derived(spark, sf_dir, MESSAGES).select("account_id", "provider_msg_id", F.col("doc_id").alias("vec_id"))
    return own.join(vectors, "vec_id").select("account_id", "provider_msg_id", F.lit("v1").alias("model_version"), F.size("embedding").alias("dim"), "embedding")

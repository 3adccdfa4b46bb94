"""What the log and the tables say: counts, listings, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import csv_field
from postmill.operators.store import placed

# Columns of the CSV export, in order.
CSV_COLUMNS = ("id", "executed_at", "outcome", "action_type", "cluster_key", "provider_msg_id", "reversed_at", "error_message")


def outcome_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("account_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "failure", "cancelled", "skipped")])


def recent(log: DataFrame, limit: int, account: str | None = None) -> DataFrame:
    own = log if account is None else log.filter(F.col("account_id") == account)
    return own.orderBy(F.desc("executed_at"), F.desc("id")).limit(limit)


def reversible(log: DataFrame, limit: int = 100, account: str | None = None) -> DataFrame:
    return recent(log.filter("reversal_kind is not null and reversed_at is null and outcome = 'success'"), limit, account)


def _lines(log: DataFrame, limit: int | None, account: str | None, head: str, line, tail: str | None = None) -> DataFrame:
    """(n, line): the head, then a line for each row, newest first, then the tail. line takes whether a row is the last;
    the lines are numbered by ranges of the order, so that there may be any number of them."""
    spark = log.sparkSession
    own = log if account is None else log.filter(F.col("account_id") == account)
    rows, n = placed(own if limit is None else recent(own, limit), [F.desc("executed_at"), F.desc("id")])
    place = F.col("__place") + 1
    out = spark.createDataFrame([(0, head)], "n long, line string").unionByName(rows.select(place.alias("n"), line(place == n).alias("line")))
    return out if tail is None else out.unionByName(spark.createDataFrame([((1 << 62), tail)], "n long, line string"))


def export_json(log: DataFrame, limit: int | None = None, account: str | None = None) -> DataFrame:
    """(n, line) of one JSON array, an object a line, newest first; nulls are written. All rows, or the newest `limit`."""
    value = F.to_json(F.struct(*log.columns), {"ignoreNullFields": "false"})
    return _lines(log, limit, account, "[", lambda last: F.concat(value, F.when(last, F.lit("")).otherwise(F.lit(","))), "]")


def export_csv(log: DataFrame, limit: int | None = None, account: str | None = None) -> DataFrame:
    """(n, line) of a CSV file: its header, then a row a line, newest first. All rows, or the newest `limit`."""
    return _lines(log, limit, account, ",".join(CSV_COLUMNS), lambda last: F.concat_ws(",", *[csv_field(F.col(c)) for c in CSV_COLUMNS]))


def table_counts(embeddings: DataFrame, classes: DataFrame, staged: DataFrame) -> DataFrame:
    """(account_id, embeddings, classifications, staged) of accounts that have any; classifications count without members."""
    every = None
    for name, df in (("embeddings", embeddings), ("classifications", classes), ("staged", staged)):
        own = df.select("account_id", F.lit(name).alias("name"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("account_id").agg(*[F.count_if(F.col("name") == n).alias(n) for n in ("embeddings", "classifications", "staged")])


def embedding_status(messages: DataFrame, embeddings: DataFrame, clusters: DataFrame) -> DataFrame:
    total = messages.groupBy("account_id").agg(F.count("*").alias("total"))
    embedded = embeddings.groupBy("account_id").agg(F.count("*").alias("embedded"))
    distinct = clusters.groupBy("account_id").agg(F.countDistinct("cluster_key").alias("clusters"))
    return total.join(embedded, "account_id", "left").join(distinct, "account_id", "left").fillna(0, ["embedded", "clusters"])


def account_summaries(accounts: DataFrame, messages: DataFrame, sync_state: DataFrame) -> DataFrame:
    counts = messages.groupBy("account_id").agg(F.count("*").alias("message_count"))
    out = accounts.join(counts, "account_id", "left").join(sync_state.select("account_id", "phase", "last_history_id"), "account_id", "left")
    return out.select("account_id", "provider", "email", F.coalesce("message_count", F.lit(0)).alias("message_count"), "phase", "last_history_id")

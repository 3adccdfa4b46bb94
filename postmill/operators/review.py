"""The review queue: clusters, their classes, what the rules propose and what is staged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.numbers import age_days
from postmill.operators.store import upsert

KEYS = ["account_id", "provider_msg_id"]


@dataclass(frozen=True)
class Rules:
    """The rules' thresholds."""

    min_confidence: float = 0.6
    promotional_age_days: int = 90
    volume: int = 50
    transactional_age_days: int = 365


def proposals(category: Column, confidence: Column, members: Column, age: Column, unsubscribe: Column, rules: Rules = Rules()) -> Column:
    """The actions (action, reason) that the rules propose, in their order; none below the least confidence."""
    old = lambda days: age.isNotNull() & (age >= days)
    table = (
        ("promotional", old(rules.promotional_age_days), "archive", f"promotional and {rules.promotional_age_days} days old"),
        ("promotional", unsubscribe, "unsubscribe", "promotional, with a way to unsubscribe"),
        ("notification", members >= rules.volume, "trash", f"{rules.volume} notifications and more"),
        ("newsletter", unsubscribe, "unsubscribe", "newsletter, with a way to unsubscribe"),
        ("social", members >= rules.volume, "archive", f"{rules.volume} social messages and more"),
        ("transactional", old(rules.transactional_age_days), "archive", f"transactional and {rules.transactional_age_days} days old"),
    )
    each = F.array(*[F.when((category == c) & when, F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"))) for c, when, a, r in table])
    sure = confidence >= F.lit(rules.min_confidence).cast("float")
    return F.when(sure, F.filter(each, lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<action:string,reason:string>>"))


def unsubscribable() -> Column:
    """Whether a message's labels name a way to unsubscribe."""
    return F.coalesce(F.exists("label_ids", lambda x: F.lower(x).contains("list-unsubscribe")), F.lit(False))


def review_queue(clusters: DataFrame, messages: DataFrame, classes: DataFrame, staged: DataFrame, as_of_ms: int, rules: Rules = Rules()) -> DataFrame:
    """One row for each cluster, the largest of each account first. Members are summed before anything is joined to
    them; the sample is the oldest one; staged_total counts all that is staged for the account."""
    oldest = F.min_by(F.struct("sender", "subject"), F.struct("internal_date", "provider_msg_id"))
    facts = clusters.join(messages, KEYS).groupBy("account_id", "cluster_key").agg(
        F.count("*").alias("member_count"), F.min("internal_date").alias("oldest"), F.max(unsubscribable()).alias("has_unsubscribe"), oldest.alias("s")
    )
    return queue(facts, classes, staged, as_of_ms, rules)


def queue(facts: DataFrame, classes: DataFrame, staged: DataFrame, as_of_ms: int, rules: Rules = Rules()) -> DataFrame:
    """The review queue over facts of clusters (account_id, cluster_key, member_count, oldest, has_unsubscribe, and s, the
    sample's sender and subject), however they came about."""
    kept = classes.select("account_id", "cluster_key", "category", "confidence")
    types = staged.filter("provider_msg_id is null").groupBy("account_id", "cluster_key").agg(F.array_sort(F.collect_set("action_type")).alias("staged_types"))
    total = staged.groupBy("account_id").agg(F.count("*").alias("staged_total"))
    rows = facts.join(total, "account_id", "left").join(kept, ["account_id", "cluster_key"], "left").join(types, ["account_id", "cluster_key"], "left")
    category, confidence = F.coalesce("category", F.lit("unknown")), F.coalesce("confidence", F.lit(0.0).cast("float"))
    age = age_days(as_of_ms, F.col("oldest"))
    return rows.select(
        "account_id", "cluster_key", category.alias("category"), confidence.alias("confidence"), "member_count", age.alias("oldest_age_days"), "has_unsubscribe",
        F.col("s.sender").alias("sample_sender"), F.col("s.subject").alias("sample_subject"),
        proposals(category, confidence, F.col("member_count"), age, F.col("has_unsubscribe"), rules).alias("proposed"),
        F.coalesce("staged_types", F.array().cast("array<string>")).alias("staged_types"), F.coalesce("staged_total", F.lit(0)).alias("staged_total"),
    ).orderBy("account_id", F.desc("member_count"), "cluster_key")


def stage(staged: DataFrame, new: DataFrame) -> DataFrame:
    """staged with new rows; of one that is there already (a null message stands for the whole cluster), only reason
    and time change: its id and payload stay."""
    keys = ["account_id", "cluster_key", "action_type", "provider_msg_id"]
    ids = staged.select(*keys, F.col("id").alias("__id"), F.col("payload").alias("__payload")).alias("o")
    n = new.alias("n")
    joined = n.join(ids, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "left")
    settled = joined.select(*[F.coalesce(f"o.__{c}", f"n.{c}").alias(c) if c in ("id", "payload") else F.col(f"n.{c}").alias(c) for c in staged.columns])
    return upsert(staged, settled, keys)


def unstage_cluster(staged: DataFrame, account: str, cluster: str, action: str) -> tuple[DataFrame, DataFrame]:
    """staged without that action for the whole cluster, and the rows that went; rows for single messages stay."""
    gone = (F.col("account_id") == account) & (F.col("cluster_key") == cluster) & (F.col("action_type") == action) & F.col("provider_msg_id").isNull()
    return staged.filter(~gone), staged.filter(gone)


def listing(staged: DataFrame, account: str) -> DataFrame:
    """An account's staged rows in the order of staging."""
    return staged.filter(F.col("account_id") == account).orderBy("staged_at", "id")

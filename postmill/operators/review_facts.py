"""Facts of clusters that are kept, and changed by what changed: the review queue without another scan of all messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators.review import unsubscribable
from postmill.operators.store import settled

KEYS = ["account_id", "provider_msg_id"]
#: Messages with and without a date are counted apart, so that the oldest date and the first message are both at hand.
GROUP = ["account_id", "cluster_key", "dated"]
MEMBER = ["provider_msg_id", "internal_date", "sender", "subject"]
#: So many of a group's first messages are kept: as many can go before the group is read again.
KEEP = 16


def member_rows(clusters: DataFrame, messages: DataFrame) -> DataFrame:
    """What the facts are made of: one row for each message of a cluster."""
    rows = clusters.select(*KEYS, "cluster_key").join(messages, KEYS).withColumn("dated", F.col("internal_date").isNotNull())
    return rows.select(*GROUP, *MEMBER, unsubscribable().cast("long").alias("unsubscribe"))


def _first(rows: DataFrame, keep: int) -> DataFrame:
    """Each group's first `keep` messages by date and id; a group's rows are cut down before they are shuffled."""
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy("internal_date", "provider_msg_id"))
    few = rows.select(*GROUP, *MEMBER).withColumn("place", place).filter(F.col("place") <= keep)
    entry = F.struct("internal_date", "provider_msg_id", "sender", "subject")
    return few.groupBy(*GROUP).agg(F.array_sort(F.collect_list(entry)).alias("first"))


def facts_of(rows: DataFrame, keep: int = KEEP) -> DataFrame:
    """Facts of member_rows, from nothing."""
    counts = rows.groupBy(*GROUP).agg(F.count("*").alias("member_count"), F.sum("unsubscribe").alias("unsubscribe_count"))
    return counts.join(_first(rows, keep), GROUP)


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """member_rows of the changed messages as they were and as they are: each old row goes (change -1), each new one comes (1)."""
    return before.withColumn("change", F.lit(-1)).unionByName(after.withColumn("change", F.lit(1)))


def changed(facts: DataFrame, delta: DataFrame, clusters: DataFrame, messages: DataFrame, keep: int = KEEP) -> DataFrame:
    """Facts once the changes of `delta` are in: those of other clusters as they were, read from `facts` alone.

    Counts are sums of signs. The first messages are those kept, without the ones that go, with the ones that come and
    stand before the last one kept (or any, where all of a group's messages are kept): still the first of the group. A
    group whose kept messages have all gone is read again from the tables as they are now, clusters and messages, and only
    such groups are. A delta has at most one row that goes and one that comes for a message; a row that goes must be as
    it came. A group without messages has no facts; an empty delta changes nothing.
    """
    delta = settled(delta, "review-delta")
    sums = delta.groupBy(*GROUP).agg(F.sum("change").alias("n"), F.sum(F.col("change") * F.col("unsubscribe")).alias("u"))
    old = sums.join(facts, GROUP, "left")
    kept = old.select(*GROUP, F.inline("first"))
    stay = kept.join(delta.filter("change < 0").select(*GROUP, "provider_msg_id"), [*GROUP, "provider_msg_id"], "left_anti")
    last = F.when(F.size("first") < F.col("member_count"), F.element_at("first", -1))
    come = delta.filter("change > 0").join(old.select(*GROUP, last.alias("last")), GROUP)
    key = lambda prefix: F.struct(F.col(f"{prefix}internal_date").alias("d"), F.col(f"{prefix}provider_msg_id").alias("m"))
    come = come.filter(F.col("last").isNull() | (key("") <= key("last.")))
    first = _first(stay.select(*GROUP, *MEMBER).unionByName(come.select(*GROUP, *MEMBER)), keep)
    count = lambda c, d: (F.coalesce(c, F.lit(0)) + F.col(d)).cast("long").alias(c)
    new = old.select(*GROUP, count("member_count", "n"), count("unsubscribe_count", "u")).join(first, GROUP, "left").filter("member_count > 0")
    new = settled(new, "review-facts")
    out = facts.join(sums.select(*GROUP), GROUP, "left_anti").unionByName(new.filter("first is not null"))
    dry = new.filter("first is null").select(*GROUP)
    if not dry.isEmpty():
        own = clusters.join(dry.select("account_id", "cluster_key").distinct(), ["account_id", "cluster_key"], "left_semi")
        out = out.unionByName(facts_of(member_rows(own, messages).join(dry, GROUP, "left_semi"), keep))
    return out


def for_queue(facts: DataFrame) -> DataFrame:
    """Facts as review.queue takes them."""
    head = F.col("first")[0]
    return facts.groupBy("account_id", "cluster_key").agg(
        F.sum("member_count").alias("member_count"), F.min(head["internal_date"]).alias("oldest"), F.max(F.col("unsubscribe_count") > 0).alias("has_unsubscribe"),
        F.min_by(F.struct(head["sender"].alias("sender"), head["subject"].alias("subject")), F.struct(head["internal_date"].alias("d"), head["provider_msg_id"].alias("m"))).alias("s"),
    )

"""Provider pages into the mailbox tables: first walks, change feeds, and the state that each account's sync has reached.

Pages are landed as they come (schema.LANDED) and folded set-wise: what a walk page by page would leave, whatever the
order in which Spark reads the pages.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.store import BUCKETS, Tables, delete_messages, folded, upsert, upsert_messages
from postmill.schema import CASCADES, FEED, LANDED
from postmill.sources import pages

KEYS = ["account_id", "provider_msg_id"]
#: What a checkpoint of a walk sets; the moments of the first walk stay.
STATE = ("account_id", "phase", "cursor_token", "last_history_id", "last_sync_at")


def apply_changes(tables: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """tables after FEED rows, page by page: a page's deletes first, with what hangs on the messages, then its upserts.

    The same changes twice give the same tables.
    """
    dead = changes.filter("op = 'delete'").groupBy(*KEYS).agg(F.max("page").alias("__dead"))
    alive = changes.filter("op = 'upsert'").join(dead, KEYS, "left").filter("__dead is null or page >= __dead").drop("op", "__dead")
    delta = folded(alive, KEYS, ["page", "seq"], coalesced=("history_id",))
    out = delete_messages(tables, dead)
    return out | {"messages": upsert_messages(out["messages"], delta)}


def apply_delta(tables: dict[str, DataFrame], landed: DataFrame) -> dict[str, DataFrame]:
    """tables after landed delta pages, graph_reset rows among them: of an account with one, what its walk behind the last
    of them doesn't name is gone, with what hangs on it."""
    reset = landed.filter("kind = 'graph_reset'").groupBy("account_id").agg(F.max("page").alias("__reset"))
    changes = pages.graph_changes(landed.filter("kind = 'graph_delta'")).join(reset, "account_id", "left").filter("__reset is null or page > __reset").drop("__reset")
    named = changes.filter("op = 'upsert'").select(*KEYS)
    gone = tables["messages"].join(reset, "account_id", "left_semi").select(*KEYS).join(named, KEYS, "left_anti")
    return apply_changes(delete_messages(tables, gone), changes)


def next_phase(state: DataFrame) -> DataFrame:
    """How each account's next sync begins: full, resume at the cursor, incremental, or reset for want of a history."""
    mode = F.when(F.col("phase").isNull(), "full").when(F.col("phase") == "initial", F.when(F.col("cursor_token").isNull(), "full").otherwise("resume")).when(F.col("last_history_id").isNull(), "reset").otherwise("incremental")
    return state.select("account_id", mode.alias("mode"))


def baseline(messages: DataFrame) -> DataFrame:
    """The history id that an account's first sync ends with: the largest seen, 1 at least."""
    return messages.groupBy("account_id").agg(F.greatest(F.coalesce(F.max("history_id"), F.lit(1)), F.lit(1)).alias("last_history_id"))


# ---------------------------------------------------------------- sync state


def record_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """state with each account's checkpoint (STATE); when its first walk began and ended stays."""
    return upsert(state, new.select(*STATE), ["account_id"])


def mark_started(state: DataFrame, accounts: DataFrame, at: Column) -> DataFrame:
    """state with the accounts in their first walk; one that had begun keeps its moment, and all else."""
    new = accounts.select("account_id", F.lit("initial").alias("phase"), at.alias("initial_started_at"))
    return upsert(state, new, ["account_id"], first=("initial_started_at",))


def mark_complete(state: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """state with the first walks of `done` (account_id, last_history_id) at their end; accounts without a state have none."""
    known = done.join(state.select("account_id"), "account_id", "left_semi")
    new = known.select("account_id", F.lit("incremental").alias("phase"), F.lit(None).cast("string").alias("cursor_token"), "last_history_id", at.alias("last_sync_at"), at.alias("initial_completed_at"))
    return upsert(state, new, ["account_id"])


# ---------------------------------------------------------------- folding landed pages


def _last(kind: DataFrame) -> DataFrame:
    """(account_id, next, delta, history_id) of each account's walk: the last page's token to go on with, the last delta
    link, and the largest history id."""
    delta = F.max(F.when(F.col("delta").isNotNull(), F.struct("page", "delta")))["delta"]
    return kind.groupBy("account_id").agg(F.max_by("next", "page").alias("next"), delta.alias("delta"), F.max("history_id").alias("history_id"), F.min("page").alias("from"))


def wanted(landed: DataFrame) -> DataFrame:
    """(account_id, page, provider_msg_id) whose metadata must be fetched for list and history pages."""
    lists = pages.listed(landed.filter("kind = 'gmail_list'").drop("kind")).select("account_id", "page", F.col("id").alias("provider_msg_id"))
    history = pages.history_ids(landed.filter("kind = 'gmail_history'")).filter("op = 'fetch'").select("account_id", "page", "provider_msg_id")
    return lists.unionByName(history).distinct()


def changes_of(landed: DataFrame, bodies: DataFrame) -> DataFrame:
    """FEED rows of landed pages and of the metadata fetched for them (account_id, page, body)."""
    gone = pages.history_ids(landed.filter("kind = 'gmail_history'")).filter("op = 'delete'").select("account_id", "page", "op", "provider_msg_id")
    fetched = pages.gmail_messages(bodies.select("account_id", "page", "body")).withColumn("op", F.lit("upsert"))
    graph = pages.graph_changes(landed.filter("kind = 'graph_delta'"))
    every = fetched.unionByName(gone, allowMissingColumns=True).withColumn("seq", F.lit(0).cast("long")).unionByName(graph)
    return every.select(*[c.split()[0] for c in FEED.split(", ")])


def advanced(state: DataFrame, landed: DataFrame, bodies: DataFrame, at: Column) -> DataFrame:
    """state after the landed pages of a run: one walk of one kind for each account.

    A first walk whose last page has no token is complete, with the largest history id it saw, 1 at least; else it
    can go on at that token; pages that go on from an earlier batch (the first isn't page 0) count with those before. A
    history page's own id and those of messages move the account's id up, never down. A delta walk's link becomes the
    cursor once its last page is there.
    """
    tokens = pages.links(landed)
    seen = pages.gmail_messages(bodies.select("account_id", "body")).groupBy("account_id").agg(F.max("history_id").alias("seen"))
    before = state.select("account_id", F.col("last_history_id").alias("before"))
    first = _last(tokens.filter("kind = 'gmail_list'")).join(seen, "account_id", "left").join(before, "account_id", "left")
    started = mark_started(state, first, at)
    highest = F.coalesce(F.greatest("seen", F.when(F.col("from") > 0, F.col("before"))), F.lit(0))
    walking = first.filter("next is not null").select("account_id", F.lit("initial").alias("phase"), F.col("next").alias("cursor_token"), F.when(highest > 0, highest).alias("last_history_id"), F.lit(None).cast("timestamp").alias("last_sync_at"))
    out = mark_complete(record_state(started, walking), first.filter("next is null").select("account_id", F.greatest(highest, F.lit(1)).cast("long").alias("last_history_id")), at)
    history = _last(tokens.filter("kind = 'gmail_history'")).join(seen, "account_id", "left").join(before, "account_id", "left")
    ids = F.greatest("before", "history_id", "seen")
    walked = history.select("account_id", F.lit("incremental").alias("phase"), F.col("next").alias("cursor_token"), ids.alias("last_history_id"), at.alias("last_sync_at"))
    graph = _last(tokens.filter("kind = 'graph_delta'")).filter("next is null").select("account_id", F.lit("incremental").alias("phase"), F.col("delta").alias("cursor_token"), F.lit(None).cast("long").alias("last_history_id"), at.alias("last_sync_at"))
    return record_state(out, walked.unionByName(graph))


def run(spark: SparkSession, landed: str | DataFrame, root: str, checkpoint: str, fetch: Callable[[DataFrame], DataFrame], at: Callable[[], Column] = F.current_timestamp, buckets: int = BUCKETS) -> None:
    """Applies all pages landed so far and not yet applied, and returns; Spark's checkpoint knows which.

    landed: a folder of JSON rows of LANDED, or a streaming DataFrame of them, such as rest.MailPages gives.

    fetch takes (account_id, provider_msg_id) and returns (account_id, body) of those that are still there, as
    rest.fetch_metadata does. What was fetched is kept beside the tables, so that a batch that is run again asks once.
    Only the partitions that a batch touches are read and written; messages, what hangs on them and the sync state are
    committed together, and a batch that is run again after a crash changes nothing. A new checkpoint over old tables
    begins its versions, and what it keeps of bodies, behind those of the old one.
    """
    store = Tables(spark, root, buckets)

    def batch(files: DataFrame, number: int) -> None:
        files = files.persist()
        asked = wanted(files).groupBy(*KEYS).agg(F.max("page").alias("page"))  # one body, whichever of the pages named it
        run_id = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        where = f"{store.root}/_fetched/{run_id}-batch-{number}"
        p, fs = store._files(f"{where}/_SUCCESS")
        if not fs.exists(p):
            fetch(asked.select(*KEYS)).write.mode("overwrite").parquet(where)
        kept = spark.read.schema("account_id string, body string").parquet(where)
        own = kept.withColumn("provider_msg_id", F.get_json_object("body", "$.id"))
        bodies = asked.join(own, KEYS).select("account_id", "page", "body").persist()
        changes = changes_of(files, bodies).persist()
        touched = store.bucketed("messages", changes).select("account_id", "bucket").distinct().persist()
        before = {n: store.read(n, touched) for n in ("messages", *CASCADES)}
        accounts = files.select("account_id", F.lit(0).alias("bucket")).distinct()
        state = advanced(store.read("sync_state"), files, bodies, at()).join(accounts.select("account_id"), "account_id", "left_semi")
        out = {n: (t, touched) for n, t in apply_changes(before, changes).items()}
        store.write(store.first_version(run_id) + number, out | {"sync_state": (state, accounts)})
        for df in (files, bodies, changes, touched):
            df.unpersist()

    source = spark.readStream.schema(LANDED).options(**pages.WHOLE).json(landed) if isinstance(landed, str) else landed
    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

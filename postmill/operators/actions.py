"""Staged actions to plans, journalled outcomes and their undoing. Calls are made by tasks, or one by one by the driver."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from datetime import timezone
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.functions.numbers import within_undo
from postmill.operators.store import numbered, settled
from postmill.schema import ACTIONS, JOURNAL

#: Messages of one remote call.
CHUNK = 1000
#: Actions that a provider can do; the others fail when executed.
REMOTE = ("archive", "trash", "mark_read")


def plan(staged: DataFrame, clusters: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(staged_action_id, ..., provider_msg_id, chunk): each message of each staged row, in chunks of one call each.

    A row without a message stands for all that its cluster has now. Each id counts once within its staged row; two
    staged rows may name one message. Unknown actions are passed over.
    """
    known = staged.filter(F.col("action_type").isin(*ACTIONS))
    whole = known.filter("provider_msg_id is null").drop("provider_msg_id").join(clusters.select("account_id", "cluster_key", "provider_msg_id"), ["account_id", "cluster_key"])
    rows = known.filter("provider_msg_id is not null").unionByName(whole.select(*known.columns))
    rows = rows.select(F.col("id").alias("staged_action_id"), "account_id", "cluster_key", "action_type", "staged_at", "provider_msg_id").dropDuplicates(["staged_action_id", "provider_msg_id"])
    w = Window.partitionBy("staged_action_id").orderBy("provider_msg_id")
    return rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / chunk).cast("long"))


def with_labels(planned: DataFrame, messages: DataFrame) -> DataFrame:
    """planned with each message's labels as they are now; null for a message that is gone."""
    return planned.join(messages.select("account_id", "provider_msg_id", F.col("label_ids").alias("prior_label_ids")), ["account_id", "provider_msg_id"], "left")


def reversal_kind(action: Column, outcome: Column) -> Column:
    return F.when(outcome == "success", F.when(action.isin("archive", "add_label", "remove_label", "mark_read"), "restore_labels").when(action == "trash", "untrash"))


def inverse_labels(action: Column, prior: Column) -> Column:
    """Labels to add again; nothing is ever taken away."""
    back = lambda label: F.when(F.array_contains(prior, label), F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(action == "archive", back("INBOX")).when(action == "mark_read", back("UNREAD")).when(action.isin("add_label", "remove_label"), F.array_distinct(prior)), none)


def label_effect(action: Column, labels: Column) -> Column:
    """What a mutation does to labels at the provider."""
    less = lambda *x: F.array_except(labels, F.array(*map(F.lit, x)))
    return F.when(action == "archive", less("INBOX")).when(action == "trash", F.array_union(less("INBOX"), F.array(F.lit("TRASH")))).when(action == "mark_read", less("UNREAD")).otherwise(labels)


def undo_status(log: DataFrame, as_of: Column) -> DataFrame:
    """log with why each row can't be undone, the first reason that holds, or 'ok', and the labels to add."""
    known = F.col("reversal_kind").isin("restore_labels", "untrash")
    status = (
        F.when(F.col("reversed_at").isNotNull(), "already reversed").when(F.col("reversal_kind").isNull(), "not reversible").when(F.col("outcome") != "success", "did not succeed")
        .when(~known, "unknown reversal kind").when((F.col("reversal_kind") == "untrash") & ~within_undo(F.col("executed_at"), as_of), "too old").otherwise("ok")
    )
    add = inverse_labels(F.col("action_type"), F.col("prior_label_ids"))
    return log.withColumn("undo_status", status).withColumn("undo_labels", add).withColumn("no_op", (status == "ok") & (F.col("reversal_kind") == "restore_labels") & (F.size(add) == 0))


def planned_messages(planned: DataFrame) -> DataFrame:
    """(account_id, messages): how many messages a plan touches, one for each staged row that names it."""
    return planned.groupBy("account_id").agg(F.count("*").alias("messages"))


class Executors:
    """Which accounts are being executed, and the means to stop one."""

    def __init__(self):
        self._lock, self._running = threading.Lock(), {}

    def register(self, account: str) -> threading.Event:
        """A new stop event for execute(); it takes the place of the account's last one."""
        with self._lock:
            self._running[account] = threading.Event()
            return self._running[account]

    def cancel(self, account: str) -> bool:
        """Stops the account's execution at its next call; whether there is one."""
        with self._lock:
            if account in self._running:
                self._running[account].set()
            return account in self._running

    def clear(self, account: str) -> None:
        with self._lock:
            self._running.pop(account, None)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def journal_rows(spark, journal: str) -> DataFrame:
    """What a journal has: one row for each message of each call that was made."""
    return spark.read.schema(JOURNAL).parquet(journal) if _exists(spark, journal) else spark.createDataFrame([], JOURNAL)


def _without_messages(staged: DataFrame, clusters: DataFrame, halted: int | None) -> DataFrame:
    """Staged rows of whole clusters that have no members: nothing is left to do for them, up to where a run was halted."""
    none = staged.filter(F.col("action_type").isin(*ACTIONS) & F.col("provider_msg_id").isNull()).join(clusters.select("account_id", "cluster_key").distinct(), ["account_id", "cluster_key"], "left_anti")
    if halted is None:
        return none
    until = F.broadcast(staged.filter(F.col("id") == halted).select(F.struct("staged_at", "id").alias("until")))
    return none.join(until, F.struct("staged_at", "id") < F.col("until")).drop("until")


def _logged(rows: DataFrame, todo: DataFrame, staged: DataFrame, clusters: DataFrame, log: DataFrame, at: Column, halted: int | None, keep_failed: bool) -> tuple[DataFrame, DataFrame]:
    """New log rows of the journal's, and staged without what was carried out."""
    left = todo.join(rows.filter("outcome <> 'cancelled'").select("staged_action_id", "provider_msg_id").distinct(), ["staged_action_id", "provider_msg_id"], "left_anti")
    done = rows.select("staged_action_id").distinct().join(left.select("staged_action_id").distinct(), "staged_action_id", "left_anti")
    if keep_failed:
        done = done.join(rows.filter("outcome = 'failure'").select("staged_action_id").distinct(), "staged_action_id", "left_anti")
    done = done.unionByName(_without_messages(staged, clusters, halted).select(F.col("id").alias("staged_action_id")))
    used = done.withColumn("used", F.lit(True))
    new = rows.join(used, "staged_action_id", "left").select(
        "account_id", F.when(F.col("used").isNull(), F.col("staged_action_id")).alias("staged_action_id"), "cluster_key", "provider_msg_id", "action_type", "outcome", "error_message",
        at.alias("executed_at"), "prior_label_ids", reversal_kind(F.col("action_type"), F.col("outcome")).alias("reversal_kind"), F.lit(None).cast("timestamp").alias("reversed_at"), "staged_at", F.col("staged_action_id").alias("__s"),
    )
    new = numbered(new, log, ["staged_at", "__s", "provider_msg_id"]).select(*log.columns)
    return new, staged.join(done.select(F.col("staged_action_id").alias("id")), "id", "left_anti")


def execute(staged: DataFrame, clusters: DataFrame, messages: DataFrame, log: DataFrame, call: Callable[[str, list[str]], None], at: Column, journal: str, chunk: int = CHUNK, stop: threading.Event | None = None, keep_failed: bool = False, on_progress: Callable[[dict], None] = lambda p: None) -> tuple[DataFrame, DataFrame]:
    """New log rows, and staged without what was carried out. Raises nothing for calls that fail.

    For plans that a user waits for; execute_in_tasks() is for large ones, as here all messages go through the driver. It
    takes one chunk after the other out of a single sorted pass over the plan and holds one at a time, so that no retried
    task can repeat a call. call(action, ids) raises on failure. Each call's outcome is appended to `journal`
    (a folder of this execution) before the next one is made: after a lost driver, execute() with the same journal goes
    on behind the calls that were logged. Prior labels are kept for successes. `stop` is looked at before each item
    (then nothing is logged) and each chunk (that chunk is logged as cancelled); the rest stays staged. An item whose
    chunks were all tried leaves the staged rows, unless one failed and keep_failed is set.
    """
    spark, began = staged.sparkSession, time.monotonic()
    past = journal_rows(spark, journal)
    tried = past.filter("outcome <> 'cancelled'").select("staged_action_id", "provider_msg_id").distinct()
    todo = with_labels(plan(staged, clusters, chunk), messages).join(tried, ["staged_action_id", "provider_msg_id"], "left_anti")
    todo = settled(todo, "plan")
    kinds = {"long": pa.int64(), "string": pa.string(), "timestamp": pa.timestamp("us", "UTC"), "array<string>": pa.list_(pa.string())}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in JOURNAL.split(", ")])
    told = {"batches_done": 0, "messages_done": 0, "failures": 0}

    def record(rows: list, outcome: str, error: str | None) -> None:
        same = {"outcome": [outcome] * len(rows), "error_message": [error] * len(rows)}
        if outcome != "success":
            same["prior_label_ids"] = [None] * len(rows)
        own = lambda r, c: r[c].astimezone(timezone.utc) if c == "staged_at" and r[c] else r[c]
        out = pa.table([pa.array(same[f.name] if f.name in same else [own(r, f.name) for r in rows], f.type) for f in fields], fields)
        spark.createDataFrame(out).coalesce(1).write.mode("append").parquet(journal)

    last = halted = None
    ordered = todo.orderBy("staged_at", "staged_action_id", "chunk", "provider_msg_id").toLocalIterator(prefetchPartitions=True)
    for (item, _), rows in groupby(ordered, key=lambda r: (r["staged_action_id"], r["chunk"])):
        if stop and stop.is_set():
            if item == last:
                record(list(rows), "cancelled", None)
            halted = item
            break
        last, rows = item, list(rows)
        try:
            if rows[0]["action_type"] not in REMOTE:
                raise NotImplementedError(f"{rows[0]['action_type']} can't be executed")
            call(rows[0]["action_type"], [r["provider_msg_id"] for r in rows])
            outcome, error = "success", None
        except Exception as e:  # noqa: BLE001  a failed chunk is logged, others go on
            outcome, error = "failure", str(e)
        record(rows, outcome, error)
        told["batches_done"] += 1
        told["messages_done" if error is None else "failures"] += len(rows)
        on_progress(told | {"elapsed_ms": int((time.monotonic() - began) * 1000)})
    return _logged(journal_rows(spark, journal), todo, staged, clusters, log, at, halted, keep_failed)


def execute_in_tasks(staged: DataFrame, clusters: DataFrame, messages: DataFrame, log: DataFrame, options: dict[str, str], at: Column, journal: str, chunk: int = CHUNK, tasks: int = 16, keep_failed: bool = False, make: Callable[[dict], Callable[[str, list[str]], None]] | None = None) -> tuple[DataFrame, DataFrame]:
    """execute() with the calls made by Spark tasks, `tasks` at a time, through the sink of sources.mutations.

    The plan is stored in `journal`, a folder that all machines mount, before the first call, and what a run left undone
    is taken from there: a task that is run again, or a second run with the same journal, makes no call twice. A message
    that several staged rows name has its calls in the order of staging: its first one in the first wave of calls, its
    second one in the next, and waves are made one after the other; calls of one wave have no message in common.
    options: provider, base_url and token; or make, which takes the options in a task and returns what makes a call. The
    driver gets no messages, however many there are.
    """
    from postmill.sources.mutations import outcomes, write_calls

    spark, key, stored = staged.sparkSession, ["staged_action_id", "wave", "chunk"], f"{journal}/plan"
    order = Window.partitionBy("account_id", "provider_msg_id").orderBy("staged_at", "staged_action_id")
    rows = with_labels(plan(staged, clusters, chunk), messages).withColumn("wave", F.row_number().over(order) - 1)
    place = F.row_number().over(Window.partitionBy("staged_action_id", "wave").orderBy("provider_msg_id")) - 1
    rows = rows.withColumn("chunk", F.floor(place / chunk).cast("long"))
    if not _exists(spark, f"{stored}/_SUCCESS"):
        rows.write.mode("overwrite").partitionBy("wave").parquet(stored)
    todo = spark.read.schema(rows.schema).parquet(stored)
    waves = todo.agg(F.max("wave")).first()[0]
    for wave in range(0 if waves is None else waves + 1):
        calls = todo.filter(F.col("wave") == wave).groupBy(*key, "action_type").agg(F.array_sort(F.collect_list("provider_msg_id")).alias("ids"))
        write_calls(calls, {**options, "journal": journal}, tasks, make)
    made = todo.join(outcomes(spark, journal), key)
    rows = made.withColumn("prior_label_ids", F.when(F.col("outcome") == "success", F.col("prior_label_ids")))
    return _logged(rows, todo, staged, clusters, log, at, None, keep_failed)


def undo(log: DataFrame, log_id: int, add_labels: Callable[[str, list[str]], None], untrash: Callable[[str], None], as_of: Column) -> tuple[str, DataFrame]:
    """Undoes one row and stamps it; the status tells why not, if not."""
    row = undo_status(log.filter(F.col("id") == log_id), as_of).first()
    if row is None:
        return "not found", log
    if row["undo_status"] == "ok":
        if row["reversal_kind"] == "untrash":
            untrash(row["provider_msg_id"])
        elif row["undo_labels"]:
            add_labels(row["provider_msg_id"], row["undo_labels"])
        log = log.withColumn("reversed_at", F.when(F.col("id") == log_id, as_of).otherwise(F.col("reversed_at")))
    return row["undo_status"], log

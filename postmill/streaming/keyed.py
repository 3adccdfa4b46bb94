"""The change feed as keyed state: pages of a walk taken in turn by account, changes folded by message.

Pages may land in any order, twice, and in any number of batches. State lives in Spark's state store with the checkpoint,
so a run that was stopped goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postmill.schema import FEED, LANDED, MESSAGE_FIELDS
from postmill.sources import pages

#: Milliseconds that a walk may wait for a page before it counts as stalled.
STALLED_MS = 15 * 60 * 1000
FIELDS = [c.split()[0] for c in MESSAGE_FIELDS.split(", ")]
#: What the fold hands on: a message after a change, or that it is gone; the largest version of a message holds. kept:
#: it wasn't deleted since the feed began, so what it had before holds.
CHANGED = f"account_id string, provider_msg_id string, version long, alive boolean, kept boolean, {MESSAGE_FIELDS}"
TURNS = f"{LANDED}, waiting long"
#: The store that keyed state needs; and no batches for timers alone, with which a run over what is there wouldn't end.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def state_store(spark: SparkSession):
    """Streams that are started inside keep their state where keyed state can be, and end when there is no more data."""
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class InTurn(StatefulProcessor):
    """Hands an account's pages on by number: those that come early are held, those seen before are left out.

    While pages are held a timer runs; when it ends a row of kind 'stalled' says which page is waited for, and how many
    are held. The walk goes on as soon as that page lands.
    """

    def __init__(self, stalled_ms: int = STALLED_MS):
        self.stalled_ms = stalled_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.walk = handle.getValueState("walk", "page long, held long, timer long")
        self.held = handle.getMapState("held", "page long", "kind string, body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn, held, timer = self.walk.get() if self.walk.exists() else (0, 0, -1)
        out = []
        for part in rows:
            part = part.drop_duplicates("page").sort_values("page")
            for page, kind, body in zip(part["page"].tolist(), part["kind"], part["body"], strict=True):
                if page == turn:
                    out.append((key[0], kind, page, body, None))
                    turn += 1
                elif page > turn and not self.held.containsKey((page,)):
                    self.held.updateValue((page,), (kind, body))
                    held += 1
                while held and self.held.containsKey((turn,)):
                    kind, body = self.held.getValue((turn,))
                    self.held.removeKey((turn,))
                    out.append((key[0], kind, turn, body, None))
                    turn, held = turn + 1, held - 1
        if timer >= 0 and (not held or out):
            self.handle.deleteTimer(timer)
            timer = -1
        if held and timer < 0:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.stalled_ms
            self.handle.registerTimer(timer)
        self.walk.update((turn, held, timer))
        yield self.rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turn, held, _ = self.walk.get()
        self.walk.update((turn, held, -1))
        yield self.rows([(key[0], "stalled", turn, None, held)] if held else [])

    @staticmethod
    def rows(out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["account_id", "kind", "page", "body", "waiting"])
        return frame.astype({"page": "int64", "waiting": "Int64"})

    def close(self) -> None:
        pass


def in_turn(landed: DataFrame, stalled_ms: int = STALLED_MS) -> DataFrame:
    """TURNS rows of a stream of landed pages (LANDED), one walk for each account, pages numbered from 0."""
    return landed.select(*[c.split()[0] for c in LANDED.split(", ")]).groupBy("account_id").transformWithStateInPandas(InTurn(stalled_ms), TURNS, "Append", "ProcessingTime")


def changes_in_turn(turns: DataFrame, bodies: DataFrame) -> DataFrame:
    """FEED rows of history pages; what a page names to be fetched is met with bodies (account_id, page, body), a table."""
    refs = pages.page_refs(turns.filter("kind = 'gmail_history'"))
    gone = refs.filter("op = 'delete'").select("account_id", "page", F.lit(0).cast("long").alias("seq"), "op", "provider_msg_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in MESSAGE_FIELDS.split(", ")])
    parsed = pages.gmail_messages(bodies.select("account_id", "page", "body"))
    named = refs.filter("op = 'fetch'").select("account_id", "page", "provider_msg_id")
    new = named.join(parsed, ["account_id", "page", "provider_msg_id"]).withColumns({"op": F.lit("upsert"), "seq": F.lit(0).cast("long")})
    order = [c.split()[0] for c in FEED.split(", ")]
    return gone.select(*order).unionByName(new.select(*order))


def folded_stream(changes: DataFrame) -> DataFrame:
    """CHANGED rows, but for the version, of a stream of FEED rows: each message's state after changes that come page by
    page, of a page first its deletes, then its last upsert. A null history id doesn't replace one.

    Largest pages are all that the state has to keep: the last delete's, the last upsert's and that of the last history
    id. So it is Spark's own aggregation, combined before the shuffle, and no key is handed to Python.
    """
    upsert, place = F.col("op") == "upsert", ("page", "seq")
    dead = F.max(F.when(F.col("op") == "delete", F.col("page"))).alias("dead")
    last = F.max(F.when(upsert, F.struct(*place, F.struct(*FIELDS).alias("own")))).alias("last")
    history = F.max(F.when(upsert & F.col("history_id").isNotNull(), F.struct(*place, "history_id"))).alias("history")
    rows = changes.groupBy("account_id", "provider_msg_id").agg(dead, last, history)
    since = lambda c: F.coalesce(F.col(f"{c}.page") >= F.coalesce("dead", F.lit(0)), F.lit(False))
    own = {c: F.col(f"last.own.{c}") for c in FIELDS} | {"history_id": F.when(since("history"), F.col("history.history_id"))}
    return rows.select("account_id", "provider_msg_id", since("last").alias("alive"), F.col("dead").isNull().alias("kept"), *[F.when(since("last"), v).alias(c) for c, v in own.items()])


def feed(spark: SparkSession, landed: str, messages: DataFrame, bodies: DataFrame, log: str, checkpoint: str, files: int = 1000, stalled_ms: int = STALLED_MS) -> None:
    """Appends to `log` what the pages landed so far, and not yet taken, change in the messages; returns when all are taken.

    Two streams, each with its own checkpoint: pages in turn by account, stored beside the log, then the fold by
    message. An account's pages, which are sequential by nature, meet in one task; its messages don't. The messages
    aren't read here: after_feed() puts the log over them. A batch that is run again writes the same part of the log.
    """
    turns = f"{log}-turns"

    def append(rows: DataFrame, number: int) -> None:
        run_id = json.loads(spark.read.text(f"{checkpoint}/fold/metadata").first()[0])["id"]
        out = rows.withColumn("version", F.lit(number + 1).cast("long")).select(*[c.split()[0] for c in CHANGED.split(", ")])
        out.write.mode("overwrite").parquet(f"{log}/run={run_id}/batch={number}")

    def finish(stream, name: str) -> None:
        stream.option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start().awaitTermination()

    with state_store(spark):
        source = spark.readStream.schema(LANDED).options(maxFilesPerTrigger=files, **pages.WHOLE).json(landed)
        finish(in_turn(source, stalled_ms).writeStream.format("parquet").option("path", turns).outputMode("append"), "turns")
        changes = changes_in_turn(spark.readStream.schema(TURNS).parquet(turns), bodies)
        finish(folded_stream(changes).writeStream.foreachBatch(append).outputMode("update"), "fold")


def after_feed(messages: DataFrame, log: DataFrame) -> DataFrame:
    """messages with what the log of CHANGED rows says last of each: gone, changed or new; kept tells a class that holds."""
    last = log.groupBy("account_id", "provider_msg_id").agg(F.max_by(F.struct("alive", "kept", *FIELDS), "version").alias("m"))
    both = messages.select("account_id", "provider_msg_id", F.struct(*FIELDS).alias("was")).join(last, ["account_id", "provider_msg_id"], "full_outer")
    own = {c: F.when(F.col("m").isNull(), F.col(f"was.{c}")).otherwise(F.col(f"m.{c}")) for c in FIELDS}
    own["history_id"] = F.when(F.coalesce("m.kept", F.lit(True)), F.coalesce("m.history_id", "was.history_id")).otherwise(F.col("m.history_id"))
    kept = F.col("was").isNotNull() & F.coalesce("m.kept", F.lit(True))
    return both.filter("m is null or m.alive").select("account_id", "provider_msg_id", kept.alias("kept"), *[v.alias(c) for c, v in own.items()])

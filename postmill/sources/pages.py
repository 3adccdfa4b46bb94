"""Provider pages as landed JSON: messages, change operations, and the retry rule of whoever fetches them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.numbers import received_ms
from postmill.functions.text import ascii_lower, header, number_or_zero, sender_email
from postmill.schema import GMAIL_HISTORY, GMAIL_LIST, GMAIL_MESSAGE, GRAPH_DELTA, GRAPH_MESSAGE, ProviderError

# Attempts and waits in seconds, for reads and for writes.
READ_RETRY, WRITE_RETRY = (4, 0.5, 1e9), (5, 1.0, 32.0)

#: Options for JSON with strings of any length. Without them Spark reads a row with a longer one than 20 million
#: characters, such as a large page's body, as nulls.
LONG = {"maxStringLen": str(2**31 - 1)}
#: For landed pages: a line that isn't JSON ends the run, as a page passed over would never be asked for again.
WHOLE = LONG | {"mode": "FAILFAST"}


def none() -> Column:
    return F.array().cast("array<string>")



def with_retry(call: Callable[[], object], retry: tuple[int, float, float] = READ_RETRY, sleep: Callable[[float], None] = time.sleep, rate_limited_403: bool = True):
    """call(), again after a doubling wait on 429, 5xx, a rate-limiting 403 and network errors."""
    attempts, wait, most = retry
    for i in range(attempts):
        try:
            return call()
        except (ProviderError, OSError) as e:
            again = isinstance(e, OSError) or e.status == 429 or e.status >= 500 or (rate_limited_403 and e.status == 403 and "ratelimitexceeded" in e.body.lower().replace("_", ""))
            if not again or i == attempts - 1:
                raise
            sleep(min(wait * 2**i, most))


def listed(pages: DataFrame) -> DataFrame:
    """(account_id, ..., id, thread_id) of list pages (account_id, ..., body); a page without messages gives none."""
    more = [c for c in pages.columns if c != "body"]
    page = F.from_json("body", GMAIL_LIST, LONG)
    return pages.select(*more, F.explode(page["messages"]).alias("m")).select(*more, F.col("m.id").alias("id"), F.col("m.threadId").alias("thread_id"))


def gmail_messages(bodies: DataFrame) -> DataFrame:
    """Message rows of (account_id, body, ...) with one message's metadata each; further columns stay in front."""
    more = [c for c in bodies.columns if c not in ("account_id", "body")]
    m = bodies.select("account_id", *more, F.from_json("body", GMAIL_MESSAGE, LONG).alias("m"))
    sender = header(F.col("m.payload.headers"), "From")
    return m.select(
        "account_id", *more, F.col("m.id").alias("provider_msg_id"), F.col("m.threadId").alias("thread_id"), F.when(sender != "", sender).alias("sender"), sender_email(sender).alias("sender_email"),
        header(F.col("m.payload.headers"), "Subject").alias("subject"), F.col("m.snippet").alias("snippet"), number_or_zero(F.col("m.internalDate")).alias("internal_date"),
        F.coalesce("m.labelIds", none()).alias("label_ids"), number_or_zero(F.col("m.historyId")).alias("history_id"),
    )


def page_refs(pages: DataFrame) -> DataFrame:
    """(account_id, page, op, provider_msg_id) of history pages (account_id, page, body), also of a stream: 'delete', or
    'fetch' for what was added or had labels added or removed; each id once a page and kind."""
    h = pages.select("account_id", "page", F.from_json("body", GMAIL_HISTORY, LONG)["history"].alias("h"))

    def of(name: str) -> Column:
        return F.transform("h", lambda x: F.coalesce(F.transform(x.getField(name), lambda r: r["message"]["id"]), none()))

    def ids(op: str, *names: str) -> Column:
        named = F.coalesce(F.array_distinct(F.flatten(F.concat(*map(of, names)))), none())
        return F.transform(named, lambda i: F.struct(F.lit(op).alias("op"), i.alias("id")))

    refs = F.concat(ids("delete", "messagesDeleted"), ids("fetch", "messagesAdded", "labelsAdded", "labelsRemoved"))
    return h.select("account_id", "page", F.explode(refs).alias("r")).select("account_id", "page", F.col("r.op").alias("op"), F.col("r.id").alias("provider_msg_id"))


def history_ids(pages: DataFrame) -> DataFrame:
    """page_refs() of pages that may have landed twice: each id once a page and kind."""
    return page_refs(pages).distinct()


def gmail_changes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids to delete, and ids to fetch, of history pages (account_id, body)."""
    ids = history_ids(pages.select("account_id", F.lit(0).cast("long").alias("page"), "body"))
    return tuple(ids.filter(F.col("op") == op).select("account_id", "provider_msg_id") for op in ("delete", "fetch"))


def _graph_rows(m: DataFrame, more: list[str]) -> DataFrame:
    """Message rows of (account_id, more..., m), where m isn't a removal."""
    name, address = F.col("m.from.emailAddress.name"), F.col("m.from.emailAddress.address")
    labels = F.concat(
        F.coalesce("m.categories", none()), F.when(F.col("m.parentFolderId").isNotNull(), F.array(F.concat(F.lit("FOLDER:"), "m.parentFolderId"))).otherwise(none()),
        F.when(F.coalesce("m.isRead", F.lit(False)), none()).otherwise(F.array(F.lit("UNREAD"))),
    )
    return m.select(
        "account_id", *more, F.col("m.id").alias("provider_msg_id"), F.coalesce("m.conversationId", "m.id").alias("thread_id"), F.coalesce(F.concat(name, F.lit(" <"), address, F.lit(">")), address).alias("sender"),
        ascii_lower(address).alias("sender_email"), F.col("m.subject").alias("subject"), F.col("m.bodyPreview").alias("snippet"),
        received_ms(F.col("m.receivedDateTime")).alias("internal_date"), labels.alias("label_ids"), F.lit(None).cast("long").alias("history_id"),
    )


def graph_messages(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of removed messages, and message rows of the others, of (account_id, body) with one message each."""
    m = bodies.select("account_id", F.from_json("body", GRAPH_MESSAGE).alias("m"))
    gone = F.col("m.`@removed`").isNotNull()
    return m.filter(gone).select("account_id", F.col("m.id").alias("provider_msg_id")), _graph_rows(m.filter(~gone), [])


def graph_changes(pages: DataFrame) -> DataFrame:
    """FEED rows of delta pages (account_id, page, body): deletes for removals, upserts in the page's order."""
    m = pages.select("account_id", "page", F.posexplode(F.from_json("body", GRAPH_DELTA, LONG)["value"]).alias("seq", "m")).withColumn("seq", F.col("seq").cast("long"))
    gone = F.col("m.`@removed`").isNotNull()
    rows = _graph_rows(m.filter(~gone), ["page", "seq"]).withColumn("op", F.lit("upsert"))
    return rows.unionByName(m.filter(gone).select("account_id", "page", "seq", F.col("m.id").alias("provider_msg_id"), F.lit("delete").alias("op")), allowMissingColumns=True)


def links(pages: DataFrame) -> DataFrame:
    """(account_id, kind, page, next, delta, history_id) of landed pages: tokens to go on with, and the history id of a
    history page (null if it isn't a number)."""
    page, delta = F.from_json("body", GMAIL_HISTORY, LONG), F.from_json("body", GRAPH_DELTA, LONG)
    graph = F.col("kind") == "graph_delta"
    return pages.select(
        "account_id", "kind", "page", F.when(graph, delta.getField("@odata.nextLink")).otherwise(page["nextPageToken"]).alias("next"),
        F.when(graph, delta.getField("@odata.deltaLink")).alias("delta"), F.when(F.col("kind") == "gmail_history", page["historyId"].try_cast("long")).alias("history_id"),
    )

"""Tables bucketed alike by message, so that joins of messages, memberships and embeddings move no rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from postmill.operators.store import scratch

KEYS = ["account_id", "provider_msg_id"]


def colocated(tables: dict[str, DataFrame], buckets: int, path: str | None = None) -> dict[str, DataFrame]:
    """The tables written in the same number of buckets by (account_id, provider_msg_id), a sorted file for each, and read
    as tables whose joins on these two columns have no exchange below them.

    Each row is shuffled once, when it is written, instead of for each join. Take as many buckets as make one of the
    largest table fit a task; keys are of one message, so none is hot. path: where the files go, scratch if not given;
    a table's new state is written to a new place and read under a new name, so readers of the old one aren't disturbed.
    """
    out = {}
    for name, df in tables.items():
        spark, own = df.sparkSession, f"postmill_{name}_{uuid.uuid4().hex}"
        where = f"{path.rstrip('/')}/{own}" if path else scratch(spark, own)
        df.repartition(buckets, *KEYS).write.option("path", where).bucketBy(buckets, *KEYS).sortBy(*KEYS).saveAsTable(own)
        out[name] = spark.table(own)
    return out

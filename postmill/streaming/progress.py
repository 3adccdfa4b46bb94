"""Counters of what a job or a stream has done, without another pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation that has `rows` and how many rows meet each condition once df was written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()]), seen


class Progress(StreamingQueryListener):
    """Tells a sink of each batch's number and input rows, and of the end with its error, if any."""

    def __init__(self, sink: Callable[[dict], None]):
        self.sink = sink

    def onQueryStarted(self, event):
        self.sink({"stage": "started", "name": event.name})

    def onQueryProgress(self, event):
        self.sink({"stage": "batch", "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.sink({"stage": "done", "error": event.exception})

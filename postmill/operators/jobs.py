"""Stopping data work: what is running for which account, and the interruption of its Spark jobs."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from postmill.schema import EngineError


class Interrupted(EngineError):
    """The work was stopped by cancel()."""


class Running:
    """Data work that goes on now, by account and kind; jobs that a piece of work starts carry its tag.

        with running.work("a1", "embed"):
            embed_pending(...)

    What is stopped leaves what its jobs had committed, and nothing of the job that was cut off: embed_pending() appends
    once at its end, a sync commits one batch, an execution goes on behind its journal. The next call takes up the rest.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._lock, self._works = spark, threading.Lock(), {}

    @contextmanager
    def work(self, account: str, kind: str, stop: Callable[[], None] | None = None) -> Iterator[threading.Event]:
        """Registers the block; Interrupted takes the place of the error that an interruption brings about, also where
        the block came to its end without one. `stop` is called too when the work is cancelled (a streaming query's
        stop(), as its jobs start in a thread of their own). The event that is given is set by cancel(), for loops to
        look at."""
        tag, asked, ended = f"postmill-{uuid.uuid4().hex}", threading.Event(), threading.Event()
        with self._lock:
            self._works[tag] = (account, kind, stop, asked, ended)
        context = self.spark.sparkContext
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            yield asked
        except Exception as e:
            if asked.is_set():
                raise Interrupted(f"{kind} of {account} was stopped") from e
            raise
        else:
            if asked.is_set():
                raise Interrupted(f"{kind} of {account} was stopped")
        finally:
            context.removeJobTag(tag)
            context.setInterruptOnCancel(False)
            with self._lock:
                self._works.pop(tag)
            ended.set()

    def listed(self) -> list[tuple[str, str]]:
        """(account, kind) of all that is running."""
        with self._lock:
            return sorted((account, kind) for account, kind, *_ in self._works.values())

    def cancel(self, account: str, kind: str | None = None, wait: float = 60) -> int:
        """Stops the account's work, of one kind if given, and waits for its end; how many pieces of work that were.

        Jobs are interrupted again until the work has ended, as one may begin right after another was cut off.
        EngineError if some work still goes on after `wait` seconds.
        """
        with self._lock:
            own = {t: w for t, w in self._works.items() if w[0] == account and kind in (None, w[1])}
        for _, _, stop, asked, _ in own.values():
            asked.set()
            if stop:
                stop()
        until = time.monotonic() + wait
        for tag, (_, what, _, _, ended) in own.items():
            while not ended.is_set():
                if time.monotonic() > until:
                    raise EngineError(f"{what} of {account} still goes on")
                self.spark.sparkContext.cancelJobsWithTag(tag)
                ended.wait(0.1)
        return len(own)

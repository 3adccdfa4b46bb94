"""A Spark sink of provider mutations: tasks make the calls, each once, and note what came of them in a shared journal."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from postmill.operators.actions import REMOTE
from postmill.sources.rest import GmailMutator, GraphMutator

#: A row of the sink is a call; wave and chunk number the calls of a staged row.
CALLS = "staged_action_id long, wave int, chunk long, action_type string, ids array<string>"
OUTCOMES = "staged_action_id long, wave int, chunk long, outcome string, error_message string"
UNANSWERED = "asked before, and no answer was kept"


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def provider(options: dict) -> Callable[[str, list[str]], None]:
    """The mutator that the options name."""
    return {"gmail": GmailMutator, "graph": GraphMutator}[options["provider"]](options["base_url"], options.get("token"))


@dataclass
class Told(WriterCommitMessage):
    """What a task did: calls by outcome, and those that an attempt before it had made."""

    counts: dict


class Writer(DataSourceArrowWriter):
    """One call for each row. Its key is a digest of the row; `<key>.asked` is made, exclusively, before the call and
    `<key>.json` after it, so a task that is run again passes over calls that were answered. A call that was asked but
    has no answer (its task was lost in between) isn't made again, as its effect isn't known: it counts as failed."""

    def __init__(self, options: dict, make: Callable[[dict], Callable] | None = None):
        self.options, self.journal, self.make = options, _local(options["journal"]), make or provider

    def write(self, iterator):
        mutator, counts = self.make(self.options), Counter()
        for b in iterator:
            for row in b.to_pylist():
                counts[self.once(mutator, row)] += 1
        return Told(dict(counts))

    def once(self, mutator, row: dict) -> str:
        key = hashlib.sha256(json.dumps([row[c] for c in ("staged_action_id", "wave", "chunk", "action_type", "ids")]).encode()).hexdigest()
        folder = f"{self.journal}/calls/{key[:2]}"
        os.makedirs(folder, exist_ok=True)
        try:
            os.close(os.open(f"{folder}/{key}.asked", os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            if not os.path.exists(f"{folder}/{key}.json"):
                self.note(folder, key, row, "failure", UNANSWERED, late=True)
            return "repeated"
        try:
            if row["action_type"] not in REMOTE:
                raise NotImplementedError(f"{row['action_type']} can't be executed")
            mutator(row["action_type"], row["ids"])
            outcome, error = "success", None
        except Exception as e:  # noqa: BLE001  a failed call is noted, others go on
            outcome, error = "failure", str(e)
        self.note(folder, key, row, outcome, error)
        return outcome

    def note(self, folder: str, key: str, row: dict, outcome: str, error: str | None, late: bool = False) -> None:
        """A whole file or none. A late note doesn't take the place of an answer that came meanwhile."""
        with tempfile.NamedTemporaryFile("w", dir=folder, prefix=f".{key}", delete=False) as f:
            json.dump({c: row[c] for c in ("staged_action_id", "wave", "chunk")} | {"outcome": outcome, "error_message": error}, f)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(f.name, 0o644)
        if not late:
            os.replace(f.name, f"{folder}/{key}.json")
            return
        try:
            os.link(f.name, f"{folder}/{key}.json")
        except FileExistsError:
            pass
        os.unlink(f.name)

    def _end(self, name: str, messages) -> None:
        total = sum((Counter(m.counts) for m in messages if m), Counter())
        os.makedirs(self.journal, exist_ok=True)
        with open(f"{self.journal}/{name}", "a") as f:
            f.write(json.dumps(total) + "\n")

    def commit(self, messages) -> None:
        """Adds a line of counts to the journal's file `committed`."""
        self._end("committed", messages)

    def abort(self, messages) -> None:
        """Adds a line to `aborted`. Calls can't be taken back: their notes stay, and the next write passes over them."""
        self._end("aborted", messages)


class MailMutations(DataSource):
    """Options: provider (gmail, graph), base_url, token, journal (a folder that all machines mount)."""

    @classmethod
    def name(cls):
        return "mail_mutations"

    def writer(self, schema, overwrite):
        return Writer(dict(self.options))


def _sink(make: Callable[[dict], Callable]) -> type[DataSource]:
    """MailMutations with calls of one's own."""

    class OwnMutations(MailMutations):
        @classmethod
        def name(cls):
            return "own_mutations"

        def writer(self, schema, overwrite):
            return Writer(dict(self.options), make)

    return OwnMutations


def write_calls(calls: DataFrame, options: dict[str, str], tasks: int, make: Callable[[dict], Callable] | None = None) -> None:
    """Makes the calls (CALLS) by `tasks` tasks, which bounds how many are under way. Needs tasks without twins, as two
    attempts at a time could not tell a call under way from a lost one. make takes the options in a task and returns what
    makes a call (action, ids); without it the options name a provider."""
    spark = calls.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("spark.speculation runs tasks twice; calls are made once")
    sink = _sink(make) if make else MailMutations
    spark.dataSource.register(sink)
    calls.repartition(tasks, "staged_action_id", "wave", "chunk").write.format(sink.name()).mode("append").options(**options).save()


def outcomes(spark: SparkSession, journal: str) -> DataFrame:
    """OUTCOMES: a row for each call that was made."""
    made = os.path.isdir(f"{_local(journal)}/calls")
    return spark.read.schema(OUTCOMES).json(f"file://{_local(journal)}/calls/*/*.json") if made else spark.createDataFrame([], OUTCOMES)

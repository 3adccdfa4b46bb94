"""Classes of clusters: samples, signatures, the model's answers, and what they do to messages."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.functions.text import cluster_prompt, embedding_text, model_output
from postmill.operators.clusters import missing_embeddings
from postmill.operators.store import empty, exists, gathered, settled, upsert
from postmill.schema import TABLES, DimensionError, EngineError

KEYS = ["account_id", "provider_msg_id"]
CLUSTER = ["account_id", "cluster_key"]


def representatives(clusters: DataFrame, messages: DataFrame, n: int = 3) -> DataFrame:
    """Each cluster's n members nearest its centroid, newer ones first among equals."""
    w = Window.partitionBy(*CLUSTER).orderBy(F.coalesce("centroid_cosine", F.lit(0.0)).desc(), F.desc("internal_date"), "provider_msg_id")
    return clusters.join(messages, KEYS).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(n, 1))


def _digest(batches):
    """A row for each cluster of rows that come cluster by cluster, ids in order: holds one running state and one batch."""
    types = (pa.string(), pa.string(), pa.int64(), pa.string())
    row = lambda: (*cluster, n, state.hexdigest() if state else None)
    table = lambda out: pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[*CLUSTER, "member_count", "cluster_signature"])
    cluster, state, n = None, None, 0
    for b in batches:
        out = []
        for own, rows in groupby(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True), key=lambda r: r[:2]):
            ids = [r[2] for r in rows]
            if own != cluster:
                if cluster is not None:
                    out.append(row())
                cluster, state, n = own, None if own[1] is None else hashlib.sha256(f"{own[1]}|".encode()), 0
            n += len(ids)
            if state:
                state.update("".join(f"{x}," for x in ids if x is not None).encode())
        yield table(out)
    if cluster is not None:
        yield table([row()])


def signatures(clusters: DataFrame) -> DataFrame:
    """sha256 of the key, a bar and each member id in byte order with a comma after it.

    The digest is of all ids in order, so a cluster's rows go through one task; they are sorted there, on disk where they
    don't fit, and streamed through the digest's state, which is all that is held. Null ids count as members but aren't
    digested; a null key has no digest.
    """
    dealt = gathered(clusters.select(*CLUSTER, "provider_msg_id"), CLUSTER, ["provider_msg_id"])
    return dealt.mapInArrow(_digest, "account_id string, cluster_key string, member_count long, cluster_signature string")


def to_classify(clusters: DataFrame, messages: DataFrame, classes: DataFrame, model: str, prompt: str, samples: int = 3, most: int | None = None) -> DataFrame:
    """Clusters whose members, model or prompt version changed since they were classified, with their prompts; of each
    account's clusters only the first `most` by key are looked at, if given."""
    if most is not None:
        own = clusters.select(*CLUSTER).distinct().withColumn("__k", F.row_number().over(Window.partitionBy("account_id").orderBy("cluster_key")))
        clusters = clusters.join(own.filter(F.col("__k") <= most).drop("__k"), CLUSTER, "left_semi")
    done = classes.filter((F.col("model_version") == model) & (F.col("prompt_version") == prompt)).select(*CLUSTER, "cluster_signature")
    todo = signatures(clusters).join(done, [*CLUSTER, "cluster_signature"], "left_anti")
    top = representatives(clusters, messages, samples).groupBy(*CLUSTER).agg(F.array_sort(F.collect_list(F.struct("rank", "sender", "subject", "snippet"))).alias("samples"))
    return todo.join(top, CLUSTER).withColumn("prompt", cluster_prompt(F.col("cluster_key"), F.col("member_count"), F.col("samples"))).drop("samples")


def classify(todo: DataFrame, make_client: Callable[[], Callable[[str], str]], model: str, prompt: str, at) -> DataFrame:
    """Classification rows. A failing call gives unknown, confidence 0 and its error as the reason; others go on.

    make_client is called once for each task; what it returns takes a prompt and returns the model's answer.
    """
    schema = "account_id string, cluster_key string, cluster_signature string, raw string, error string"

    def run(batches):
        ask = make_client()
        for b in batches:
            raw, error = [], []
            for p in b.column(3).to_pylist():
                try:
                    raw.append(ask(p))
                    error.append(None)
                except Exception as e:  # noqa: BLE001  one cluster's failure is a row, not the job's end
                    raw.append(None)
                    error.append(f"error: {e}")
            yield pa.record_batch([*(b.column(i) for i in range(3)), pa.array(raw, pa.string()), pa.array(error, pa.string())], names=["account_id", "cluster_key", "cluster_signature", "raw", "error"])

    answers = todo.select(*CLUSTER, "cluster_signature", "prompt").mapInArrow(run, schema)
    out = model_output(F.col("raw"))
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(~out["valid"], F.lit("parse: not a complete answer")).otherwise(out["reason"])
    return answers.select(*CLUSTER, out["category"].alias("category"), out["confidence"].alias("confidence"), reason.alias("reason"), F.lit(model).alias("model_version"), F.lit(prompt).alias("prompt_version"), "cluster_signature", at.alias("created_at"))


def propagate(messages: DataFrame, clusters: DataFrame, new: DataFrame, at) -> DataFrame:
    """messages with the class of their cluster where it is among the new ones."""
    own = clusters.join(new.select(*CLUSTER, F.col("category").alias("__c"), F.col("confidence").alias("__f")), CLUSTER).select(*KEYS, "__c", "__f")
    has = F.col("__c").isNotNull()
    out = messages.join(own, KEYS, "left").withColumns({"category": F.coalesce("__c", "category"), "classified_confidence": F.coalesce("__f", "classified_confidence"), "classified_at": F.when(has, at).otherwise(F.col("classified_at"))})
    return out.select(*messages.columns)


def classified(messages: DataFrame, clusters: DataFrame, classes: DataFrame, new: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """Classifications with the new rows, and messages that carry them."""
    return upsert(classes, new, CLUSTER), propagate(messages, clusters, new, at)


def embed_missing(messages: DataFrame, embeddings: DataFrame, make_client: Callable[[], Callable[[list[str]], Iterable[list[float]]]], model: str, dim: int, at, by_model: bool = False) -> DataFrame:
    """Embedding rows for messages without one. A vector of another length than dim ends the job with DimensionError."""
    out = _embedded(messages, embeddings, make_client, model, dim, by_model, keep=False)
    return out.select(*KEYS, F.lit(model).alias("model_version"), F.lit(dim).alias("dim"), "embedding", at.alias("created_at"))


def _embedded(messages: DataFrame, embeddings: DataFrame, make_client, model: str, dim: int, by_model: bool, keep: bool) -> DataFrame:
    """(account_id, provider_msg_id, embedding, error) of messages without an embedding. With keep, a task's first error
    becomes the row of its message and ends the task's requests; what came before stays."""
    todo = missing_embeddings(messages, embeddings, model if by_model else None)
    rows = todo.select(*KEYS, embedding_text(F.col("subject"), F.col("sender"), F.col("snippet")).alias("input"))

    def run(batches):
        embed = make_client()
        for b in batches:
            vectors, error = [], None
            try:
                for v in embed(b.column(2).to_pylist()):
                    if len(v) != dim:
                        raise DimensionError(f"expected {dim} numbers, not {len(v)}")
                    vectors.append(v)
            except Exception as e:
                if not keep:
                    raise
                error = f"{type(e).__name__}: {e}"
            n = len(vectors) + (error is not None)
            errors = pa.array([None] * len(vectors) + [error] * (n - len(vectors)), pa.string())
            vectors = pa.array(vectors + [None] * (n - len(vectors)), pa.list_(pa.float32()))
            yield pa.record_batch([b.column(0).slice(0, n), b.column(1).slice(0, n), vectors, errors], names=["account_id", "provider_msg_id", "embedding", "error"])
            if error:
                return

    return rows.mapInArrow(run, "account_id string, provider_msg_id string, embedding array<float>, error string")


def embed_pending(messages: DataFrame, path: str, make_client, model: str, dim: int, at) -> int:
    """Embeds messages that the table of embeddings at `path` doesn't have, and appends them to it; how many that were.

    Tasks write what they got; a failing call ends only its own task's requests. If there was one, EngineError is raised
    after all else is kept, and the next call goes on with what is missing.
    """
    spark = messages.sparkSession
    done = spark.read.schema(TABLES["embeddings"]).parquet(path) if exists(spark, path) else empty(spark, "embeddings")
    got = settled(_embedded(messages, done, make_client, model, dim, False, keep=True), "embedded")
    new = got.filter("error is null").select(*KEYS, F.lit(model).alias("model_version"), F.lit(dim).alias("dim"), "embedding", at.alias("created_at"))
    new.write.mode("append").parquet(path)
    failed, n = got.agg(F.count("error"), F.count("embedding")).first()
    if failed:
        raise EngineError(f"{failed} calls failed, {n} messages embedded: " + got.filter("error is not null").first()["error"])
    return n


def histogram(messages: DataFrame) -> DataFrame:
    return messages.groupBy("account_id", F.coalesce("category", F.lit("unclassified")).alias("category")).agg(F.count("*").alias("n"))

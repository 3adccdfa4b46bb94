"""Clusters of messages: sender buckets, a greedy cosine fold, summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import cluster_key
from postmill.operators.store import gathered

# A bucket below this size is one cluster; the similarity at which a message joins.
MIN_SPLIT, JOIN_AT = 4, 0.85

KEYS = ["account_id", "provider_msg_id"]


def missing_embeddings(messages: DataFrame, embeddings: DataFrame, model: str | None = None) -> DataFrame:
    """Messages without an embedding (of the model, if one is given)."""
    have = embeddings if model is None else embeddings.filter(F.col("model_version") == model)
    return messages.join(have.select(*KEYS), KEYS, "left_anti")


def _fold(threshold: float, min_split: int):
    """Streams buckets in order; holds the centroids of one bucket and its first few rows, never a whole bucket."""

    def run(batches):
        bucket, sums, counts, held = None, None, np.zeros(0, np.float32), []

        def place(v):
            nonlocal sums, counts
            norm = np.sqrt(v @ v)
            if len(counts):
                centroids = sums
                product = np.sqrt((centroids * centroids).sum(1)) * norm
                sim = np.where(product < 1e-9, 0, centroids @ v / np.maximum(product, 1e-9))
                best = int(sim.argmax())
                if sim[best] >= np.float32(threshold):
                    n = counts[best] + 1
                    sums[best] = (sums[best] * (n - 1) + v) / n
                    counts[best] = n
                    return best, float(sim[best])
            sums = v[None, :].copy() if sums is None else np.concatenate([sums, v[None, :]])
            counts = np.append(counts, np.float32(1))
            return len(counts) - 1, 1.0

        def settle():
            """A bucket that ended before it had min_split rows is one cluster."""
            return [(*k, 0, 1.0) for k, _ in held]

        def batch_of(out):
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            return pa.record_batch([pa.array(cols[i], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.float32()))], names=["account_id", "bucket", "provider_msg_id", "part", "centroid_cosine"])

        for b in batches:
            out = []
            vectors = b.column(3)
            for i, (account, key, msg) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                if (account, key) != bucket:
                    if held:
                        out += settle()
                    bucket, sums, counts, held = (account, key), None, np.zeros(0, np.float32), []
                v = np.asarray(vectors[i].values, np.float32)
                if held is not None:
                    held.append(((account, key, msg), v))
                    if len(held) < min_split:
                        continue
                    out += [(*k, *place(x)) for k, x in held]
                    held = None
                else:
                    out.append((account, key, msg, *place(v)))
            yield batch_of(out)
        if held:
            yield batch_of(settle())

    return run


def greedy_clusters(messages: DataFrame, embeddings: DataFrame, threshold: float = JOIN_AT, min_split: int = MIN_SPLIT) -> DataFrame:
    """(account_id, provider_msg_id, cluster_key, centroid_cosine): each embedded message in one cluster of its sender.

    In date order a message joins the most similar centroid (the earliest of equals) if that reaches the threshold, and
    moves it; else it founds a cluster with score 1. The fold depends on order, so one sender's messages are folded by
    one task, one after the other, which holds the sender's centroids only.
    """
    rows = messages.join(embeddings.select(*KEYS, "embedding"), KEYS).withColumn("bucket", F.coalesce("sender_email", F.lit("")))
    dealt = gathered(rows, ["account_id", "bucket"], ["internal_date", "provider_msg_id"])
    out = dealt.select("account_id", "bucket", "provider_msg_id", "embedding").mapInArrow(_fold(threshold, min_split), "account_id string, bucket string, provider_msg_id string, part int, centroid_cosine float")
    return out.select("account_id", "provider_msg_id", cluster_key(F.col("account_id"), F.col("bucket"), F.col("part")).alias("cluster_key"), "centroid_cosine")


def summaries(clusters: DataFrame, messages: DataFrame) -> DataFrame:
    """Per cluster: members, newest date, and the newest member's sender and subject; the largest of each account first."""
    newest = F.max_by(F.struct("sender", "subject"), F.struct("internal_date", "provider_msg_id"))
    out = clusters.join(messages, KEYS).groupBy("account_id", "cluster_key").agg(F.count("*").alias("member_count"), F.max("internal_date").alias("newest"), newest.alias("s"))
    return out.select("account_id", "cluster_key", "member_count", "newest", F.col("s.sender").alias("sample_sender"), F.col("s.subject").alias("sample_subject")).orderBy("account_id", F.desc("member_count"), "cluster_key")


def expand(clusters: DataFrame, messages: DataFrame, limit: int = 5) -> DataFrame:
    """The newest `limit` messages of each cluster, ranked."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("account_id", "cluster_key").orderBy(F.desc("internal_date"), "provider_msg_id")
    out = clusters.join(messages, KEYS).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return out.select("account_id", "cluster_key", "rank", "provider_msg_id", "subject", "internal_date")

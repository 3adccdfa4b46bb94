"""Operator 5: best-fit packing of documents into token sequences, under conflicts of source and duplicate cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.bpe import VOCABULARY, Counter, worker
from postmill.llm.common import slices, stored

#: Tokens of a sequence.
CAPACITY = 4096
#: Pieces that are packed together, about: enough for a tight fit, few enough for one task.
SHARD_PIECES = 4000

PACKED = "doc_id long, piece int, start long, length long, source string, cluster long, bin long, offset long"


def _bits(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Word and mask of a bitmap for each value; values that occur once, or are below 0, need no bit (mask 0)."""
    shared = counts > 1
    number = np.cumsum(shared) - 1
    has = (values >= 0) & shared[np.maximum(values, 0)] if len(shared) else np.zeros(len(values), bool)
    bit = np.where(has, number[np.maximum(values, 0)], 0) if len(shared) else np.zeros(len(values), np.int64)
    return bit >> 6, np.where(has, np.uint64(1) << (bit & 63).astype(np.uint64), np.uint64(0)), int(shared.sum() >> 6) + 1


def best_fit(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, longest first. Codes below 0 conflict with nothing.

    Open bins stand in the order of their room. The search starts at the least room that is enough and goes on to the
    next until neither of the bin's bitmaps has the piece's source or cluster; only if none is left, a bin is opened.
    """
    order = np.argsort(-lengths, kind="stable")
    count = lambda x: np.bincount(x[x >= 0], minlength=1) if (x >= 0).any() else np.zeros(0, np.int64)
    sw, sm, s_words = _bits(sources, count(sources))
    cw, cm, c_words = _bits(clusters, count(clusters))
    bins, offsets, n_bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    room, name = np.zeros(len(lengths) + 1, np.int64), np.zeros(len(lengths) + 1, np.int64)  # open bins, by room
    has_s, has_c = np.zeros((s_words, len(lengths)), np.uint64), np.zeros((c_words, len(lengths)), np.uint64)
    n_open = 0
    for i in order.tolist():
        size = int(lengths[i])
        at = int(np.searchsorted(room[:n_open], size))
        own = name[at:n_open]
        free = (has_s[sw[i], own] & sm[i] | has_c[cw[i], own] & cm[i]) == 0
        hit = int(free.argmax()) if len(own) else 0
        if len(own) and free[hit]:
            at += hit
            b, left = int(name[at]), int(room[at])
            room[at : n_open - 1], name[at : n_open - 1] = room[at + 1 : n_open].copy(), name[at + 1 : n_open].copy()
            n_open -= 1
        else:
            b, left = n_bins, capacity
            n_bins += 1
        bins[i], offsets[i] = b, capacity - left
        has_s[sw[i], b] |= sm[i]
        has_c[cw[i], b] |= cm[i]
        left -= size
        if left:
            to = int(np.searchsorted(room[:n_open], left, "right"))
            room[to + 1 : n_open + 1], name[to + 1 : n_open + 1] = room[to:n_open].copy(), name[to:n_open].copy()
            room[to], name[to] = left, b
            n_open += 1
    return bins, offsets, n_bins


def pack(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """PACKED for (doc_id, length, source, cluster): each document in pieces of at most `capacity`, each in a bin.

    No bin has two pieces of one source or of one cluster; a null source or cluster conflicts with nothing. Pieces are
    dealt over shards by a hash of their row and place, and each shard is packed for itself: the same rows give the same
    bins, however they are stored. A length of 0 or null gives no piece; equal rows are counted, then packed one by one;
    an empty table gives no rows; other columns are not read.
    """
    named = items.select("doc_id", F.col("length").cast("long").alias("total"), "source", F.col("cluster").cast("long").alias("cluster")).filter("total > 0")
    kept = stored(named.groupBy("doc_id", "total", "source", "cluster").agg(F.count("*").alias("times")), "items")
    pieces = int(kept.agg(F.sum(F.ceil(F.col("total") / capacity) * F.col("times"))).first()[0] or 0)
    shards = max(1, -(-pieces // shard_pieces))
    each = kept.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    cut = each.select("doc_id", "source", "cluster", "total", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / capacity))).alias("piece"))
    shard = F.pmod(F.xxhash64("doc_id", "total", "source", "cluster", "copy", "piece"), F.lit(shards))
    cut = cut.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * capacity).alias("length"), "source", "cluster", "copy", shard.alias("shard"))

    def run(key, t):
        t = t.sort_by([("length", "descending"), *[(c, "ascending") for c in ("doc_id", "piece", "cluster", "source", "copy")]])
        code = lambda c: np.asarray(t.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1)).astype(np.int64)
        bins, offsets, _ = best_fit(t.column("length").to_numpy(), code("source"), code("cluster"), capacity)
        t = t.append_column("bin", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))
        return t.select(["doc_id", "piece", "start", "length", "source", "cluster", "bin", "offset"])

    return cut.groupBy("shard").applyInArrow(run, PACKED)


def sized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, length, source, cluster) of documents: tokens and an end token, and a cluster for each different text.

    A null text is empty; texts of white space alone are nobody's copies and have no cluster; a table without a column
    source has null sources; other columns are not read.
    """
    cluster = F.when(F.col("text").rlike(r"\S"), F.xxhash64("text"))
    docs = docs if "source" in docs.columns else docs.withColumn("source", F.lit(None).cast("string"))
    named = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), cluster.alias("cluster")).alias("who"), "text")

    def run(batches):
        counter = worker(Counter, vocabulary)
        for part in slices(batches, "text"):
            who = part.column(0)
            yield pa.record_batch([who.field(0), pa.array(counter.of(part.column(1)) + 1), who.field(1), who.field(2)], names=["doc_id", "length", "source", "cluster"])

    return named.mapInArrow(run, "doc_id long, length long, source string, cluster long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """pack() of whole documents by their token counts; equal texts are one duplicate cluster, but for texts
    without words, which conflict with each other by their source alone. A null text is empty. Pieces of equal length are
    packed in the order of (doc_id, piece, cluster, source)."""
    return pack(sized(docs, vocabulary), capacity)

"""Operator 7: a reproducible shuffle into shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import stored

#: The rounds work modulo this prime, below 2^31, so that products fit 63 bits.
PRIME = 2_147_483_647
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three multipliers for each round, from a linear congruence over the seed."""
    out, x = [], (seed * 48_271 + 11) % PRIME
    for _ in range(rounds):
        keys = []
        for _ in range(3):
            x = (x * 48_271 + 12_345) % PRIME
            keys.append(x)
        out.append(tuple(keys))
    return out


def side(n: int) -> int:
    """Half-block size: the least m with m * m >= n."""
    m = int(np.sqrt(max(n, 1)))
    while m * m < n:
        m += 1
    while m > 1 and (m - 1) * (m - 1) >= n:
        m -= 1
    return m


def _scramble(x, keys, m):
    a, b, c = keys
    x = x % PRIME
    return ((x * x % PRIME) * a % PRIME + x * b % PRIME + c) % PRIME % m


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where each row number of 0..n-1 goes: a Feistel network on pairs below side(n), walked until below n."""
    m, keys = side(n), round_keys(seed)
    x, out = np.asarray(rows, np.int64).copy(), np.empty(len(rows), np.int64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x // m, x % m
        for k in keys:
            left, right = right, (left + _scramble(right, k, m)) % m
        x = left * m + right
        done = x < n
        out[todo[done]] = x[done]
        todo, x = todo[~done], x[~done]
    return out


def inverse(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row number that goes to each place; place = slot * shards + shard."""
    m, keys = side(n), round_keys(seed)
    x, out = np.asarray(places, np.int64).copy(), np.empty(len(places), np.int64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x // m, x % m
        for k in reversed(keys):
            left, right = (right - _scramble(left, k, m)) % m, left
        x = left * m + right
        done = x < n
        out[todo[done]] = x[done]
        todo, x = todo[~done], x[~done]
    return out


def numbered(df: DataFrame, order: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """df with a gapless global row number in the given order, and its rows' count; no task sees all rows.

    Rows are ranged, sorted within partitions and stored; the driver sees one count for each partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    kept = stored(ranged, "numbered").withColumn("__part", F.shiftright("__at", 33).cast("int")).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    base, rows = 0, []
    for r in sorted(kept.groupBy("__part").count().collect(), key=lambda r: r["__part"]):
        rows.append((r["__part"], base))
        base += r["count"]
    bases = df.sparkSession.createDataFrame(rows, "__part int, __base long")
    return kept.join(F.broadcast(bases), "__part").withColumn(name, F.col("__base") + F.col("__at")).drop("__part", "__at", "__base"), base


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row): counts of shards at most one apart.

    row numbers all documents by (doc_id, crc, size), null ids first; place = permutation(row), shard = place mod
    shards, slot = place div shards, so either can be had from the other. Rows equal in all three are exchangeable.
    A null text has size 8 and the crc of no bytes; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    rows, n = numbered(narrow, ["doc_id", "text_crc32", "size"])

    def run(batches):
        for b in batches:
            place = permute(b.column(3).to_numpy(zero_copy_only=False), n, seed)
            yield pa.record_batch([*b.columns, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], names=[*b.schema.names, "shard", "slot"])

    out = rows.select("doc_id", "size", "text_crc32", "row").mapInArrow(run, "doc_id long, size long, text_crc32 long, row long, shard int, slot long")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")

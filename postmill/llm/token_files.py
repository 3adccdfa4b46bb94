"""Operator 4: token ids in Parquet list columns, written in id order and read back selectively."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.bpe import VOCABULARY, Ids, worker
from postmill.llm.common import id_and_text, slices

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"
#: Row groups and pages: a reader of one document decodes a page of few rows, found by the page index.
LAYOUT = {"parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "512", "compression": "zstd"}
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int | None = 1, encoding: str = "dictionary", layout: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes SCHEMA to `path` in ascending id order over all files.

    part is the file's rank; part_start counts the tokens before the document in its own part. encoding:
    'dictionary' (ids as codes of a page dictionary) or 'delta' (bit-packed differences). A null text has the end id
    alone; a null id comes first; rows of equal id, or of none, are ordered by a hash of their text, then by the text, and
    may fill several files; repeated rows all stay; an empty table gives files without rows; other columns are not read.
    """

    def run(batches):
        ids, part, start = worker(Ids, vocabulary), TaskContext.get().partitionId(), 0
        for piece in slices(batches, "text"):
            tokens, at = ids.of(piece.column(1))
            n = len(at) - 1
            if end_id is not None:
                tokens = np.insert(tokens, at[1:], end_id)
                at = at + np.arange(n + 1)
            length = np.diff(at)
            yield pa.record_batch(
                [piece.column(0), pa.array(np.full(n, part, np.int32)), pa.array(start + at[:-1]), pa.array(length), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.astype(np.int32)))],
                names=["doc_id", "part", "part_start", "n_tokens", "tokens"],
            )
            start += int(at[-1])

    place = ["doc_id", "hash"]
    ordered = id_and_text(docs, id_col, text_col).withColumn("hash", F.xxhash64("text")).repartitionByRange(*place).sortWithinPartitions(*place, "text")
    ordered.drop("hash").mapInArrow(run, SCHEMA).write.options(**LAYOUT, **ENCODINGS[encoding], **(layout or {})).parquet(path)


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """The stored rows; an id range is pushed down to row groups and pages. Columns not selected are not read."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if first_id is not None:
        df = df.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        df = df.filter(F.col("doc_id") <= last_id)
    return df


def part_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): tokens before each part, from the metadata columns; one row for each file."""
    totals = sorted((r["part"], r["n"]) for r in read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, rows = 0, []
    for part, n in totals:
        rows.append((part, base))
        base += n
    return spark.createDataFrame(rows, "part int, base long")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the stored documents; start counts the ids of all documents before."""

    def run(batches):
        for b in batches:
            lists = b.column(2)
            at, data = np.asarray(lists.offsets).astype(np.int64) * 4, memoryview(np.asarray(lists.values).astype("<u4", copy=False)).cast("B")
            crc = np.fromiter((zlib.crc32(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)), np.int64, len(lists))
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), pa.array(np.diff(at) // 4), pa.array(crc)], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    read = read_tokens(spark, path).select("doc_id", "part", "tokens", "part_start").mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(part_offsets(spark, path)), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")

"""What the operators share: shared storage, Arrow views of text columns, ragged arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds at once, beside one longer document.
SLICE_BYTES = 3 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the one that its context has.

    Where neither is set, a new local folder serves a session whose executors all run in the driver (tests); on a
    cluster that would lose data, so it is an error there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("postmill.shared.dir", None)
    if not where:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = own.get() if own.isDefined() else None
    if not where:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("postmill.shared.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/postmill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*dfs: DataFrame) -> None:
    """Deletes what stored() wrote for these; nothing made of them may be read any more."""
    for df in dfs:
        if hasattr(df, "stored_at"):
            _delete(df.sparkSession, df.stored_at)


def clear_stored(spark: SparkSession) -> None:
    """Deletes what stored() and new_path() have left in the shared folder; results not yet written are lost with it."""
    _delete(spark, f"{shared_dir(spark)}/postmill")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs that run inside hand Python at most so many rows at once: for rows that hold whole sets or lists."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column can clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets, without copies; nulls are empty."""
    column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `most` bytes of `column` and `rows` rows; a longer document stands alone."""
    for batch in batches:
        at = utf8(batch.column(batch.schema.get_field_index(column)))[1]
        start, n = 0, batch.num_rows
        while start < n:
            stop = min(max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1), start + rows)
            yield batch.slice(start, min(stop, n) - start)
            start = stop


def split_words(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, once its UTF-8 bytes are mapped by `table`, between runs of ASCII white space.

    Returns the words' codes, their offsets by text, and the distinct words. The table must map bytes from 128 on to
    themselves.
    """
    data, at = utf8(texts)
    mapped = np.frombuffer(table, np.uint8)[data]
    column = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(mapped)])
    split = pc.ascii_split_whitespace(column)
    offsets = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    codes = np.asarray(coded.indices)
    empty = pc.index(coded.dictionary, pa.scalar("")).as_py()
    if empty >= 0:  # white space at an end of a text
        keep = codes != empty
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets - offsets[0]]
        codes = codes[keep]
    return codes, offsets - offsets[0], coded.dictionary


#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i; 0 for an empty run."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: Ids up to this many are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs stored with a number for each row, in a column of a name that docs doesn't have: rows of one id, or of none, are told apart."""
    column = "row"
    while column in {c.lower() for c in docs.columns}:
        column += "_"
    return stored(docs.withColumn(column, F.monotonically_increasing_id()), name), column


def without(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """numbered()'s rows but for those whose number is among the doc_id of `gone`, without the number."""
    gone = stored(gone.select(F.col("doc_id").alias(column)), "gone")
    small = gone.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if small else gone, column, "left_anti").drop(column)

"""Operator 1: FLAC media columns with seekable sample offsets."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm import flac
from postmill.llm.common import forget, id_and_text, slices, stored, utf8

MEDIA = "doc_id long, n_bytes long, media binary"
PCM = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset:long,n_samples:long,pcm:binary>>"
#: Bytes of payload that one call of the codec gets, beside one longer document: its arrays take about 60 times that,
#: for a longer document too, as the codec cuts it at frames.
AT_ONCE = flac.SPAN
#: Parts of the documents that media_features() stores one after the other.
PARTS = 3


def payload(text: bytes) -> bytes:
    """The bytes of a text and bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % flac.BLOCK or (0 if text else flac.BLOCK))


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a FLAC stream, one narrow pass.

    A null or empty text gives one frame of 255s and n_bytes 0; equal texts give equal streams; other columns are
    not read. Values of a binary column end at 2 GB, and so does what a text may have.
    """

    def run(batches):
        for part in slices(batches, "text", AT_ONCE):
            data, at = utf8(part.column(1))
            raw, cut = data.tobytes(), at.tolist()
            media = flac.encode([payload(raw[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)])
            yield pa.record_batch([part.column(0), pa.array(np.diff(at)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, MEDIA)


def _groups(batch: pa.RecordBatch, column: int):
    """Runs of rows whose media hold about AT_ONCE bytes: first row, streams."""
    start, held, size = 0, [], 0
    for i, m in enumerate(batch.column(column)):
        raw = m.as_py()
        if held and size + len(raw) > AT_ONCE:
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


def features(x: np.ndarray, most: int = 1 << 20) -> str:
    """Exact features of signed samples: extremes, sum, energy, sign changes, and sum of absolute differences."""
    least, largest, total, energy, crossings, variation = 0, 0, 0, 0, 0, 0
    for i in range(0, len(x), most):
        own = x[max(i - 1, 0) : i + most].astype(np.int32)  # the sample before, for differences
        new = own[i > 0 :]
        least, largest = (int(new.min()), int(new.max())) if i == 0 else (min(least, int(new.min())), max(largest, int(new.max())))
        total, energy = total + int(new.sum()), energy + int((new * new).sum(dtype=np.int64))
        crossings, variation = crossings + int(((own[1:] < 0) != (own[:-1] < 0)).sum()), variation + int(np.abs(np.diff(own)).sum(dtype=np.int64))
    return f"min={least};max={largest};sum={total};energy={energy};crossings={crossings};variation={variation}"


def pcm_lists(media: DataFrame) -> DataFrame:
    """PCM for each row of (doc_id, n_bytes, media): what the stream is, and a block of samples for each frame with its sample offset.

    pcm has signed samples of 8 bits, or 16 bits little-endian for deeper streams. Frame checksums and the stream's
    digest are verified. A null stream or a damaged one ends the job with flac.FlacError or TypeError: nothing is
    passed over.
    """

    def run(batches):
        for batch in batches:
            for start, streams in _groups(batch, 2):
                samples, offsets = flac.decode(streams)
                kinds = [np.dtype("<i2") if flac.Header(s).bits > 8 else np.dtype("i1") for s in streams]
                raw = b"".join(x.astype(k).tobytes() for x, k in zip(samples, kinds, strict=True))
                frames = np.array([len(at) - 1 for at in offsets])
                n = np.concatenate([np.diff(at) for at in offsets])
                cut = np.concatenate(([0], np.cumsum(n * np.repeat([k.itemsize for k in kinds], frames)))).astype(np.int32)
                pcm = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cut), pa.py_buffer(raw)])
                first = np.concatenate([at[:-1] for at in offsets])
                blocks = pa.StructArray.from_arrays([pa.array(first), pa.array(n), pcm], names=["sample_offset", "n_samples", "pcm"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(frames))).astype(np.int32)), blocks)
                rows = batch.slice(start, len(streams))
                sha = pa.array([hashlib.sha256(s).hexdigest() for s in streams], pa.string())
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array([len(s) for s in streams], pa.int64()), sha, lists], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, PCM)


def block_digests(pcm: DataFrame) -> DataFrame:
    """Describes the payloads that blocks of 8-bit samples make up; the tail is read by sample offset.

    Blocks that are missing, out of order or of another length end the job with flac.FlacError.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(4)
            at, blocks = lists.offsets.to_pylist(), lists.values
            offset, count, pcm_ = np.asarray(blocks.field("sample_offset")), np.asarray(blocks.field("n_samples")), blocks.field("pcm")
            size, sha, tail, described = [], [], [], []
            for i, j in zip(at[:-1], at[1:], strict=True):
                held, own, n = pcm_[i:j].to_pylist(), offset[i:j], count[i:j]
                if not held or (own != np.cumsum(n) - n).any() or [len(b) for b in held] != n.tolist():
                    raise flac.FlacError("blocks of samples are missing")
                x = np.frombuffer(b"".join(held), "i1")
                k = int(np.searchsorted(own, max(len(x) - 32, 0), "right")) - 1
                last = np.frombuffer(b"".join(held[k:]), "i1")[max(len(x) - 32, 0) - own[k] :]
                raw, end = ((v.view(np.uint8) ^ flac.BIAS).tobytes() for v in (x, last))
                size.append(len(raw))
                sha.append(hashlib.sha256(raw).hexdigest())
                tail.append(zlib.crc32(end))
                described.append(features(x))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64()), batch.column(2), batch.column(3), pa.array(described, pa.string())],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return pcm.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digests(media: DataFrame) -> DataFrame:
    """Decodes streams of 8-bit samples, verifying them, and describes what they hold; in one pass, without a table of blocks."""
    return block_digests(pcm_lists(media))


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, pcm): the blocks of pcm_lists, one row for each frame."""
    rows = pcm_lists(media.select("doc_id", F.lit(None).cast("long").alias("n_bytes"), "media"))
    return rows.select("doc_id", F.posexplode("blocks").alias("block", "b")).select("doc_id", F.col("block").cast("long").alias("block"), "b.sample_offset", "b.n_samples", "b.pcm")


def read_samples(media: DataFrame, first: int, count: int) -> DataFrame:
    """(doc_id, pcm): a range of samples of each stream, decoded from the seek point before it; short at its end."""

    def run(batches):
        for batch in batches:
            out = []
            for m in batch.column(1):
                x = flac.decode_range(m.as_py(), first, count)
                out.append(x.astype("<i2" if flac.Header(m.as_py()).bits > 8 else "i1").tobytes())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, pcm binary")


def media_features(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """What op1 returns: every text stored as FLAC, read back and checked, its PCM blocks stored, read back and described.

    Both tables are about twice the size of compressed text, so documents are stored in `parts`, dealt by hash: a part's
    tables go once its rows of the result are stored. To keep them, store encode_media() and pcm_lists() yourself.
    """
    docs, out = id_and_text(docs), None
    for part in range(parts):
        own = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == part)
        media = stored(encode_media(own), "media")
        pcm = stored(pcm_lists(media), "pcm")
        rows = stored(block_digests(pcm), "described")
        forget(media, pcm)
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("frames", (F.col("payload_bytes") / flac.BLOCK).cast("long"))

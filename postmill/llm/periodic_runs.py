"""Operator 12: periodic runs of words by a scan of all lags, and texts with repeated periods taken out."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import id_and_text, slices, split_words, stored

#: A run is at least so many words long, and so many of its periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Texts of more bytes have their lags dealt to several tasks, in ranges of so many lags or in so many ranges at most.
LONG_BYTES, LAGS, RANGES = 36_000, 2_000, 64
_SAME = bytes(range(256))


def plant(codes: np.ndarray, offsets: np.ndarray, ids: list[int | None]) -> np.ndarray:
    """Word codes with the tail of each document whose id's checksum ends in 0 repeated with a period that it gives.

    A null id has no checksum and leaves its document as it is.
    """
    codes = codes.copy()
    for i, doc_id in enumerate(ids):
        h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), int(offsets[i + 1] - offsets[i])
        if h % 10 == 0 and n:
            g, words = h // 10, codes[offsets[i] : offsets[i + 1]]
            a = g % n
            words[a:] = words[a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))]
    return codes


def scan_lags(codes: np.ndarray, offsets: np.ndarray, first: int = 1, last: int | None = None) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of runs that show at lags from first to last, by period.

    For each lag up to the longest document's words / 3 the array of all documents' words is compared with itself
    shifted; true stretches that are long enough are runs of this period. A stretch of s or more words holds a whole
    aligned block of (s + 1) // 2, so blocks are compared at a few of their words, then where these all agree the
    document as a whole. Documents come in order of their length, so that those long enough for a lag are a prefix;
    a word of its own stands between two, and what crosses it is shorter than the lag, thus no run. Of several
    periods with which the same stretch is seen, the smallest is the run's: the others are its multiples.
    """
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] >= LEAST_WORDS]
    if not len(order):
        return []
    size = n[order]
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    words = np.empty(int(begin[-1]), np.int32)
    for i, d in enumerate(order):
        words[begin[i] : begin[i + 1] - 1] = codes[offsets[d] : offsets[d + 1]]
        words[begin[i + 1] - 1] = -1 - i
    found: dict[tuple[int, int, int], int] = {}
    of_doc: dict[int, list[tuple[int, int, int]]] = {}
    most = int(size[0]) // LEAST_PERIODS
    for q in range(first, min(most, last or most) + 1):
        least = max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q)
        block = (least + 1) // 2
        end = int(begin[np.searchsorted(-size, -max(LEAST_WORDS, LEAST_PERIODS * q), "right")])
        at = np.flatnonzero(words[: end - q : block] == words[q:end:block]) * block
        for off in (block - 1, block // 2, block // 4, 3 * block // 4):
            if not len(at):
                break
            at = at[at + (off + q) < end]
            at = at[words[at + off] == words[at + (off + q)]]
        if not len(at):
            continue
        doc = np.searchsorted(begin, at, "right") - 1
        for d in np.unique(doc).tolist():
            a, b = int(begin[d]), int(begin[d + 1]) - 1
            places = at[doc == d] - a
            for s, e, p in of_doc.get(d, ()):  # a multiple of a known run's period sees that same run
                if q % p == 0:
                    places = places[(places < s) | (places + q >= e)]
            if not len(places):
                continue
            same = np.zeros(b - a - q + 2, np.int8)
            same[1:-1] = words[a : b - q] == words[a + q : b]
            edge = np.flatnonzero(np.diff(same))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - s >= least and (d, s, e + q) not in found:
                    found[d, s, e + q] = q
                    of_doc.setdefault(d, []).append((s, e + q, q))
    return [(int(order[d]), s, e - s, q) for (d, s, e), q in found.items()]


def _described(ids: pa.Array, codes: np.ndarray, offsets: np.ndarray, words: pa.Array, runs: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    """The operator's rows of some documents, given each one's runs (start, length, period) in any order."""
    dropped = np.zeros(len(codes) + 1, np.int64)
    best, runs_sha = [], []
    for i, found in enumerate(runs):
        found.sort(key=lambda r: (r[0], r[2]))
        top = None
        for s, n, p in found:
            dropped[offsets[i] + s + p] += 1
            dropped[offsets[i] + s + n] -= 1
            if top is None or n * top[2] > top[1] * p:  # ties stay with the smallest start, then period
                top = (s, n, p)
        best.append((None,) * 4 if top is None else (*top, 1000 * top[1] // top[2]))
        runs_sha.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest())
    keep = np.cumsum(dropped[:-1]) == 0
    at = np.concatenate(([0], np.cumsum(keep)))[offsets]
    kept = words.take(pa.array(codes[keep]))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), kept), " ").cast(pa.binary())
    collapsed = [hashlib.sha256(t).hexdigest() for t in texts.to_pylist()]
    columns = [pa.array([b[k] for b in best], pa.int64()) for k in range(4)]
    return pa.record_batch([ids, pa.array([len(r) for r in runs], pa.int64()), *columns, pa.array(runs_sha, pa.string()), pa.array(collapsed, pa.string())], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


ROWS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    codes, offsets, words = split_words(part.column(part.schema.get_field_index("text")), _SAME)
    return plant(codes, offsets, part.column(part.schema.get_field_index("doc_id")).to_pylist()), offsets, words


def _whole(batches):
    """Documents that one task scans at all lags."""
    for part in slices(batches, "text"):
        codes, offsets, words = _words(part)
        runs: list[list] = [[] for _ in range(part.num_rows)]
        for d, *run in scan_lags(codes, offsets):
            runs[d].append(tuple(run))
        yield _described(part.column(0), codes, offsets, words, runs)


def _counted(batches):
    for part in slices(batches, "text"):
        yield part.append_column("n", pa.array(np.diff(split_words(part.column(1), _SAME)[1])))


def _ranged(batches):
    """(row, start, length, period) of runs seen at a row's range of lags."""
    for part in slices(batches, "text", rows=1):
        codes, offsets, _ = _words(part)
        first, last = (part.column(part.schema.get_field_index(k))[0].as_py() for k in ("first", "last"))
        found = np.array([run[1:] for run in scan_lags(codes, offsets, first, last)], np.int64).reshape(-1, 3)
        yield pa.record_batch([pa.array(np.repeat(np.int64(part.column(0)[0].as_py()), len(found))), *(pa.array(found[:, k]) for k in range(3))], names=["row", "start", "length", "period"])


def _given(batches):
    """Documents whose runs were found elsewhere."""
    for part in slices(batches, "text"):
        codes, offsets, words = _words(part)
        runs = [[(r["start"], r["length"], r["period"]) for r in x or []] for x in part.column(2).to_pylist()]
        yield _described(part.column(0), codes, offsets, words, runs)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = LONG_BYTES, lags: int = LAGS, ranges: int = RANGES) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for each document.

    Texts of up to long_bytes are scanned where they are read. Longer ones are stored, and each is dealt out as ranges
    of `lags` lags (longer ranges where there would be more than `ranges`), the runs of which are then put together by
    text: of the same stretch the smallest period stays. A null or empty text has no words and no runs: n_runs 0, nulls,
    digests of ''. Ties in length / period go to the smallest start, then period. A null id stays null and has no
    planted tail; repeated rows are scanned one by one; other columns are not read.
    """
    texts = id_and_text(docs, id_col, text_col)
    short = texts.filter(F.octet_length("text") <= long_bytes).mapInArrow(_whole, ROWS)
    long = texts.filter(F.octet_length("text") > long_bytes).mapInArrow(_counted, "doc_id long, text string, n long")
    long = stored(long.withColumn("row", F.monotonically_increasing_id()), "long-texts")
    tasks = long.sparkSession.sparkContext.defaultParallelism * 4
    most = F.floor(F.col("n") / LEAST_PERIODS)
    step = F.greatest(F.lit(lags), F.ceil(most / ranges))
    dealt = long.filter(most > 0).select("row", "doc_id", "text", most.alias("most"), step.alias("step")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "most", "step")).alias("first"))
    dealt = dealt.select("row", "doc_id", "text", "first", (F.col("first") + F.col("step") - 1).alias("last")).repartition(tasks, "row", "first")
    runs = dealt.mapInArrow(_ranged, "row long, start long, length long, period long").groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    runs = runs.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))  # no more than a text has words
    return short.unionByName(long.join(runs, "row", "left").select("doc_id", "text", "runs").mapInArrow(_given, ROWS))

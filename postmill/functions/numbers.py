"""Vector, age and time expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

DAY_MS = 86_400_000
#: Norm products below this count as no direction.
TINY = 1e-9
UNDO_DAYS = 30


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the common length; 0 for vectors without direction."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    product = lambda p, q: total(F.zip_with(p, q, lambda x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))))
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when(norm < TINY, 0.0).otherwise(product(a, b) / norm)


def age_days(as_of_ms: int, date_ms: Column) -> Column:
    """Whole days, towards zero."""
    return ((F.lit(as_of_ms) - date_ms) / DAY_MS).cast("long")


def within_undo(executed_at: Column, as_of: Column) -> Column:
    return ((F.unix_seconds(as_of) - F.unix_seconds(executed_at)) / 86_400).cast("long") <= UNDO_DAYS


def received_ms(text: Column) -> Column:
    """Epoch milliseconds, whole seconds only, of an RFC 3339 time with its offset; 0 if it isn't one."""
    whole = F.upper(text)
    time = F.when(whole.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), whole)
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(time)) * 1000, F.lit(0).cast("long"))


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of an array of lists or bytes, a null having none, and the values that they count in."""
    at = np.frombuffer(a.buffers()[1], np.int64 if pa.types.is_large_list(a.type) or pa.types.is_large_binary(a.type) else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    listed = pa.types.is_list(a.type) or pa.types.is_large_list(a.type)
    values = a.values.fill_null(0).to_numpy(zero_copy_only=False) if listed else np.frombuffer(a.buffers()[2] or b"", np.uint8)
    null = np.asarray(a.is_null(), bool)
    return at[:-1], np.where(null, 0, np.diff(at)), values


def _gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all values of lists, one list after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _as_lists(at: np.ndarray, values: pa.Array, null: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(np.asarray(null, bool), False)), values)


@F.arrow_udf(ArrayType(FloatType()))
def from_bytes(raw: pa.Array) -> pa.Array:
    """Little-endian float vectors as stored. Bytes behind the last whole number are left out; null stays null."""
    starts, lengths, data = _lists(raw)
    lengths = lengths // 4 * 4
    values = data[_gathered(starts, lengths)].view("<f4")
    return _as_lists(np.append(0, np.cumsum(lengths // 4)), pa.array(values.astype(np.float32, copy=False)), raw.is_null())


@F.arrow_udf(BinaryType())
def to_bytes(vector: pa.Array) -> pa.Array:
    """Vectors as little-endian floats, a null number as 0; null stays null."""
    starts, lengths, values = _lists(vector)
    data = values[_gathered(starts, lengths)].astype("<f4")
    at, null = np.append(0, np.cumsum(lengths * 4)).astype(np.int32), vector.is_null()
    bits = pa.array(~np.asarray(null, bool)).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(vector), [bits, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


@F.arrow_udf(FloatType())
def cosine32(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine similarity in single precision over the common length, summed number by number as a loop would: all pairs
    of one length take each step together. 0 for vectors without direction, null where one is null."""
    (a_at, a_n, a_v), (b_at, b_n, b_v) = _lists(a), _lists(b)
    n, out = np.minimum(a_n, b_n), np.zeros(len(a), np.float32)
    a_v, b_v = a_v.astype(np.float32, copy=False), b_v.astype(np.float32, copy=False)
    for size in np.unique(n[n > 0]).tolist():
        own = np.flatnonzero(n == size)
        dot, aa, bb = (np.zeros(len(own), np.float32) for _ in range(3))
        for j in range(size):
            x, y = a_v[a_at[own] + j], b_v[b_at[own] + j]
            dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
        norm = np.sqrt(aa) * np.sqrt(bb)
        out[own] = np.where(norm < np.float32(TINY), np.float32(0), dot / np.where(norm < np.float32(TINY), np.float32(1), norm))
    return pa.array(out, pa.float32(), mask=np.asarray(a.is_null(), bool) | np.asarray(b.is_null(), bool))

"""Shared pieces: reading tables, tables stored in the shared folder, joins on nullable keys, and
numpy helpers that hash the words of many texts at once."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep.session import shared_dir

def _single(codes) -> str:
    """Characters one by one: Java tests such a class by a bit set, but ranges one after the other."""
    return "".join(f"\\x{c:02X}" for c in codes)


_MARKS = _single(c for c in range(128) if not chr(c).isalnum())
# Words between ASCII blanks, and words of letters and digits (all non-ASCII characters belong to words).
BLANK_WORD = f"[^{_single([32, 9, 10, 11, 12, 13])}]+"
CASED_WORD = f"[^{_MARKS}]+"  # before A-Z are lower-cased
NOT_ALNUM = f"[{_MARKS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, and the copy
    survives the loss of the executors that computed it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
    """Like :func:`stored`, in buckets of a column: what joins on it later does not shuffle this side."""
    spark, own = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{own}"
    df.write.bucketBy(buckets, by).option("path", path).saveAsTable(own)
    return spark.table(own)


def broadcast_if_small(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a stored table if its rows, ``row_bytes`` each, add up to at most ``limit``; beyond
    that it is returned as it is and joins on it shuffle (AQE splits their hot keys)."""
    size = df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does just that where all characters are ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match null keys; ``keys`` maps left columns to right ones."""
    on = None
    for a, b in keys.items():
        c = left[a].eqNullSafe(right[b])
        on = c if on is None else on & c
    return left.join(right, on, how)


def release() -> None:
    """Give memory that a finished pass has freed back to the system: Spark keeps Python workers, and idle ones
    count as memory of their executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# --- numpy side -----------------------------------------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
CHUNK_BYTES = 512 << 10
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below ``n`` (kept for the usual sizes)."""
    size = max(CHUNK_BYTES, n) + 1
    if size not in _POWERS:
        inverse = pow(int(BASE), -1, 1 << 64)
        both = []
        for b in (int(BASE), inverse):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if size > CHUNK_BYTES + 1:
            return both[0], both[1]
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of ``values[start:end]``: a prefix sum of value times power,
    whose differences are brought to power 0 and scrambled."""
    up, down = powers(len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def text_chunks(column, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into row ranges of about ``max_bytes`` (one row at least):
    (first row, end row, bytes, offsets of the rows in them).  Nulls count as empty texts."""
    import pyarrow as pa

    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    n = len(a)
    if not n:
        return
    _, offs, data = a.buffers()
    at = np.frombuffer(offs, np.int64)[a.offset : a.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


def blank_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII blanks: their start and end bytes, and for each text the index of its
    first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words ``data[start:end]``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return rolling((_TO_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1), starts, ends)

"""What the corpus operators share: tables in the shared folder, and vectorised hashing of words and bytes.

All kernels work on UTF-8 bytes. A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; that set is
ASCII, so splitting bytes and splitting characters give the same words.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cytolake.sources.shared import shared_dir

U64 = np.uint64
#: One piece of text that the kernels handle at a time, in bytes; arrays of eight bytes a character follow from it.
SLICE_BYTES = 1 << 20


#: Paths of stored tables while collected() is open.
_collecting: list[list[str]] = []


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when the application ends, or when the caller says so (see collected and removed). Shuffle files of the
    write go as soon as it has succeeded: what comes after reads the table. by: a column whose values get folders of
    their own, which part() reads."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        w = df.write.option("compression", "zstd")
        (w.partitionBy(by) if by else w).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    for paths in _collecting:
        paths.append(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def part(table: DataFrame, path: str, by: str, value: str) -> tuple[DataFrame, str]:
    """One value's rows of a table stored by a column, without that column, and the folder that holds them."""
    kinds = [f for f in table.schema if f.name != by]
    folder = f"{path}/{by}={value}"
    spark = table.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):  # no rows
        return spark.createDataFrame([], StructType(kinds)), folder
    return spark.read.schema(StructType(kinds)).parquet(folder), folder


@contextlib.contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables stored inside."""
    paths: list[str] = []
    _collecting.append(paths)
    try:
        yield paths
    finally:
        _collecting[:] = [p for p in _collecting if p is not paths]


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Text that one shard of a hash range serves.
SHARD_BYTES = 32 << 20


def shards_for(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> int:
    """How many shards serve the texts of docs: they grow in number with the data, not in size."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))


def dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """df in n tasks, one for each value of key (0 to n - 1); grouping by key then needs no other shuffle."""
    return df.repartitionById(n, F.col(key))


# ---------------------------------------------------------------- hashing

_rng = np.random.default_rng(20260101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE, _BASE2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_pow: dict = {}


def _inverse(odd: np.uint64) -> np.uint64:
    return U64(pow(int(odd), -1, 2**64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _pow.get(int(base))
    if have is None or len(have) < n:
        have = np.ones(max(n, SLICE_BYTES + 4096), U64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        _pow[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte stays."""
    return _LOWER[data]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_WS[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair, from one running sum."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers(base, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_inverse(base), len(data) + 1)[starts] ^ (ends - starts).astype(U64))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a byte array, in slices of bounded size cut at white space."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return starts, ends, np.zeros(0, U64)
    out, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        lo, hi = starts[at], ends[to - 1]
        out[at:to] = range_hash(data[lo:hi], starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return starts, ends, out


def ngram_hashes(words: np.ndarray, n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A 64-bit hash of words[i:i+n] for each i."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(words) - n + 1, U64)
    for j in range(n):
        out *= base
        out += words[j : j + len(out)]
    return mix(out)


def byte_gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of data[i:i+n] for each i, in slices of bounded size."""
    if len(data) < n:
        return np.zeros(0, U64)
    out = np.empty(len(data) - n + 1, U64)
    for lo in range(0, len(out), SLICE_BYTES):
        hi = min(lo + SLICE_BYTES, len(out))
        starts = np.arange(hi - lo)
        out[lo:hi] = range_hash(data[lo : hi + n - 1], starts, starts + n)
    return out


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """min(a[i:i+w]) for each i, by doubling."""
    if len(a) < w:
        return a[:0]
    have = 1
    while have < w:
        step = min(have, w - have)
        a = np.minimum(a[: len(a) - step], a[step:])
        have += step
    return a


_POS = U64((1 << 27) - 1)


def window_anchors(grams: np.ndarray, w: int) -> np.ndarray:
    """For each run of w grams, the place of its smallest (leftmost among equals); runs with equal grams agree."""
    out = []
    for lo in range(0, max(0, len(grams) - w + 1), SLICE_BYTES):
        part = grams[lo : lo + SLICE_BYTES + w - 1]
        coded = (part & ~_POS) | np.arange(len(part), dtype=U64)
        out.append((sliding_min(coded, w) & _POS).astype(np.int64) + lo)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


# ---------------------------------------------------------------- Arrow

def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray | None]:
    """Each text as a byte array without a copy; None for null."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from texts_of(chunk)
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[at[i] : at[i + 1]] if valid[i] else None


def low40(x: np.ndarray) -> bytes:
    """The low five bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(U64)


def packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers in as many bytes as they need: seven bits a byte, the high bit says that another follows."""
    numbers = numbers.astype(U64)
    size, bound = np.ones(len(numbers), np.int64), U64(128)
    while bound and (more := numbers >= bound).any():
        size += more
        bound = bound << U64(7) if bound < U64(1 << 57) else U64(0)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[has] + k] = (numbers[has] >> U64(7 * k) & U64(127)) | np.where(size[has] > k + 1, U64(128), U64(0))
    return out.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    size = ends - starts
    out = (data[starts] & 127).astype(np.int64)
    for k in range(1, int(size.max(initial=0)) + 1):
        has = size >= k
        out[has] |= (data[starts[has] + k] & 127).astype(np.int64) << 7 * k
    return out


def packed_bytes(raw: bytes | memoryview, level: int = 3) -> bytes:
    """Its size in eight bytes, then zstd."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", level).compress(raw, asbytes=True)


def unpacked_bytes(raw: bytes) -> bytes:
    return pa.decompress(memoryview(raw)[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def shard_of(x: np.ndarray, n: int) -> np.ndarray:
    """0 to n - 1 from the upper 32 bits, so that the low 40 bits still tell keys of a shard apart."""
    return ((x >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each run of equal neighbours."""
    if not len(values):
        return []
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(edges, edges[1:], strict=False))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)

"""Helpers that the training-data operators share: scratch tables, row keys, Arrow text buffers and hashing.

Everything here works on one Arrow batch at a time; nothing is kept between batches.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; small enough for the arrays to stay in the CPU's caches.
SLICE_BYTES = 1 << 18
U64 = np.uint64


# ---------------------------------------------------------------- scratch tables
def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a temporary one is set if
    everything runs on this machine; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and is read as often as needed."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that nothing will read again."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id_col, text_col) with rid unique and never null.

    rid is the id itself where ids are unique and not null. Otherwise the rows are written once
    with a generated key, so that repeated rows count as the separate rows they are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    total, known, distinct = (
        rows.groupBy(id_col).agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.when(F.col(id_col).isNotNull(), F.col("n"))), F.count(id_col)).first()
    )
    if total is None or total == known == distinct:
        return rows.select(F.col(id_col).alias("rid"), id_col, text_col)
    return written(rows.select(F.monotonically_increasing_id().alias("rid"), id_col, text_col), "keyed")


# ---------------------------------------------------------------- Arrow text
def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes; a longer document is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        k = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(k, n)
        i = min(k, n)


# ---------------------------------------------------------------- hashing
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | U64(1) for seed in (11, 12)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 19)
        out = []
        for x in (_BASE[which], pow(_BASE[which], -1, 1 << 64)):
            a = np.full(size, x, U64)
            a[0] = 1
            out.append(np.cumprod(a))
        have = _POWERS[which] = (out[0], out[1])
    return have


def prefix(units: np.ndarray, which: int = 0) -> np.ndarray:
    out = np.empty(len(units) + 1, U64)
    out[0] = 0
    np.cumsum(units * powers(len(units), which)[0][: len(units)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits; works in place."""
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of units[start:end] from prefix(units)."""
    return mix((pre[end] - pre[start]) * powers(len(pre), which)[1][start])


def byte_units(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _TABLES[which][data]


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of the documents data[bounds[i]:bounds[i+1]]: starts, ends, and each document's first word."""
    inside = ~_SEPARATOR[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = bounds[(bounds >= 0) & (bounds < len(data))]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


_SEED = tuple(U64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344))
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes of a word that are mixed eight at a time; longer words are digested whole.
_LONG = 256


def word_units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, one of two that are independent.

    Eight bytes at a time are mixed into what the length and the bytes before have given. No step is linear, so there are no
    words whose differences cancel; words of up to eight bytes and one length never collide.
    """
    size = ends - starts
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + _SEED[which])
    rows, at, left = np.flatnonzero(size <= _LONG), starts, size
    if len(rows) < len(size):
        for i in np.flatnonzero(size > _LONG).tolist():
            key = int(_SEED[which]).to_bytes(8, "little")
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
        at, left = at[rows], left[rows]
    while len(rows):
        out[rows] = mix(out[rows] ^ (eight[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def digests(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2b of units[start:end], byte by byte."""
    wide, view = units.itemsize, memoryview(np.ascontiguousarray(units)).cast("B")
    made = (int.from_bytes(hashlib.blake2b(view[a:b], digest_size=8).digest(), "little") for a, b in zip((start * wide).tolist(), (end * wide).tolist(), strict=True))
    return np.fromiter(made, U64, len(start))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges, as sorted ranges that neither overlap nor touch."""
    if len(start) == 0:
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.empty(len(start), bool)
    first[0] = True
    first[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(first)
    return start[at], end[np.append(at[1:], len(start)) - 1]

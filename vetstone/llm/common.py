"""Shared plumbing of the training-data operators: table access, keys, byte-level hashing in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside operators, so that keys are never null; it sorts first.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's shared spark.checkpoint.dir; sets one only where none is configured (local tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
        else:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            sc.setCheckpointDir(tempfile.mkdtemp(prefix="vetstone-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df` from a reliable checkpoint; lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Lets go of shuffle files that no frame needs any more: Spark deletes them only once the driver has collected its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Ids with several texts up to which they are broadcast.
SHARED = 100_000


def keyed(docs: DataFrame) -> DataFrame:
    """(d, th, text): never-null id, 64-bit hash that tells texts of one id apart, never-null text.

    th is 0 where an id has one text only, so that it costs nothing in a shuffle. Beyond SHARED ids with several texts
    it is the hash everywhere. Other columns, of whatever name, are left behind here.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))
    shared = cut(rows.groupBy("d").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo <> hi").select("d", F.lit(1).alias("shared")))
    count = shared.count()
    if not count:
        # always 0, but no literal: that would leave joins on (d, th) with d alone and one more exchange
        return rows.withColumn("th", F.col("d").bitwiseAND(F.lit(0).cast("long")))
    if count > SHARED:
        return rows
    return rows.join(F.broadcast(shared), "d", "left").select("d", F.when(F.col("shared") == 1, F.col("th")).otherwise(F.lit(0).cast("long")).alias("th"), "text")


#: 64-bit words of a sieve: 4 MB of bits, which bounds what is broadcast.
WORDS = 1 << 19


def sieve(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose `key` (a 64-bit hash) is in wanted, and, of others, about a share of len(wanted) / (64 WORDS).

    No row whose key is wanted is lost, however many are: only the share of others grows. To be followed by a join.
    """
    word, bit = F.pmod(F.col(key), F.lit(WORDS)), F.pmod(F.shiftright(F.col(key), 40), F.lit(64)).cast("int")
    bits = wanted.groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits"))
    here = rows.withColumn("__word", word).join(F.broadcast(bits), "__word")
    return here.where(F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1).drop("__word", "__bits")


def id_back(d: str | Column = "d") -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return F.when(d != F.lit(NULL_ID), d)


_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the public murmur3 one), vectorised."""
    x = x ^ (x >> np.uint64(33))
    x *= _C1
    x ^= x >> np.uint64(33)
    x *= _C2
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            out = []
            for b in (self.base, self.inv):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
            self.up, self.down = out


_POWERS = {k: Powers(b) for k, b in enumerate((0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95))}


class Prefix:
    """Polynomial prefix hashes of a sequence of unsigned integers; any slice's hash costs O(1)."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.p = _POWERS[which]
        self.p.grow(len(values) + 1)
        v = values.astype(np.uint64)
        v += np.uint64(1)
        v *= self.p.up[: len(v)]
        self.h = np.empty(len(v) + 1, np.uint64)
        self.h[0] = 0
        np.cumsum(v, out=self.h[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = self.h[end] - self.h[start]
        x *= self.p.down[start]
        return mix(x)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all slices of k values."""
        n = len(self.h) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        x = self.h[k:] - self.h[:n]
        x *= self.p.down[:n]
        return mix(x)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    span, cur = 1, a
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    if rest := w - span:
        cur = np.minimum(cur[:-rest], cur[rest:])
    return cur


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n+1 offsets (from 0); nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        import pyarrow.compute as pc

        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return raw, off - off[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, one row at least: bounds the temporary arrays."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroups a stream sorted by `key` so that no key's rows are divided between two tables."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1], "left"))
        if held and k[0] != held[-1].column(held[-1].schema.get_field_index(key))[held[-1].num_rows - 1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def longs(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    c = t.column(t.schema.get_field_index(name))
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.to_numpy(zero_copy_only=False)

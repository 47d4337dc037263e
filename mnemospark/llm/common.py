"""Shared plumbing: tables cut from their lineage, size-checked broadcasts, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side has at most so many rows of a few numbers each (some tens of MB when hashed).
BROADCAST_ROWS = 200_000
#: Places of a sieve, and of one of its pieces (what Spark's bitmaps hold).
SIEVE, BITMAP = 1 << 27, 32_768
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode, one of our own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.gettempdir()}/mnemospark-shared"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder is the cluster's to clear
        pass


class Scratch:
    """A folder of tables written in the shared folder; it goes when the session ends.

    A written table, unlike a cached one, outlives any executor, and unlike ``checkpoint()`` it is
    columnar and compressed, so later stages read only the columns they need.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        # Texts are wide rows: smaller Arrow batches hold as many bytes as the default's do of narrow ones.
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.path)

    def put(self, df: DataFrame, name: str, **options: int) -> DataFrame:
        df.write.mode("error").options(**options).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.path}/{name}")


def freed(spark: SparkSession) -> None:
    """Lets go of the shuffle files of tables that are written: Spark deletes them once no plan in the driver refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; the count stops there."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted size allows; otherwise a shuffled join with AQE's skew splits is left."""
    return F.broadcast(df) if small(df, rows) else df


def sieved(spark: SparkSession, df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df without most rows whose ``column``, a whole number, is not in keys (one column): wide rows that a join would leave out need no shuffle.

    Keys are bits of SIEVE places, sent to every task in 4 KB pieces (16 MB at most); ids below SIEVE have a place of their own.
    """
    place = lambda c: F.pmod(F.col(c).cast("long"), F.lit(SIEVE))
    bits = keys.toDF("__key").select(F.floor(place("__key") / BITMAP).alias("__piece"), place("__key").alias("__place")).repartition("__piece")
    bits = bits.groupBy("__piece").agg(F.bitmap_construct_agg(F.col("__place") % BITMAP).alias("__bits"))
    bits = Scratch(spark, "sieve").put(bits, "bits")
    out = df.withColumn("__place", place(column)).join(F.broadcast(bits), F.floor(F.col("__place") / BITMAP) == F.col("__piece"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__place") % BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return out.filter(F.getbit(byte, (F.col("__place") % 8).cast("int")) == 1).select(*df.columns)


def drawn(c: Column, share: Column) -> Column:
    """Whether a row falls into a share of all rows, by a hash of c; fine enough for shares of a part in 10**12."""
    return F.pmod(F.xxhash64(c), F.lit(1 << 40)) < share * float(1 << 40)


def trim() -> None:
    """Gives a worker's free memory back, which the C library would keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches, column: str, most: int = 1_000_000):
    """Record batches cut so that ``column`` holds about ``most`` bytes, or a single longer text."""
    for b in batches:
        if not b.num_rows:
            continue
        t = b.column(column)
        offsets = np.frombuffer(t.buffers()[1], dtype=np.int64 if pa.types.is_large_string(t.type) else np.int32)[t.offset : t.offset + len(t) + 1]
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + most, side="right")) - 1)
            end = min(end, b.num_rows)
            yield b.slice(at, end - at)
            at = end
    trim()


def text_bytes(t: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of an array, and the offsets of each text in them (null: empty)."""
    if t.null_count:
        t = t.fill_null(b"" if pa.types.is_large_binary(t.type) else "")
    kind = np.int64 if pa.types.is_large_string(t.type) or pa.types.is_large_binary(t.type) else np.int32
    offsets = np.frombuffer(t.buffers()[1], dtype=kind)[t.offset : t.offset + len(t) + 1].astype(np.int64)
    data = t.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]

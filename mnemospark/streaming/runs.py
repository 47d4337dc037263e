"""Streams that run: a table arrives in slices by time, each start takes what is there and stops, and the next goes on from the checkpoint.

What a batch gives is written under its number, over what an interrupted attempt left, so a batch that runs twice counts
once; the latest row of a key is that of the highest number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import belief
from mnemospark.operators import duels
from mnemospark.sources.shared import Tables
from mnemospark.streaming import streams

def sliced(rows: DataFrame, by: str, n: int) -> DataFrame:
    """Adds slice, 0 to n - 1: equal spans of the time that rows cover. Equal times are in one slice."""
    t = F.unix_micros(F.col(by).cast("timestamp"))
    low, high = rows.agg(F.min(t), F.max(t)).first()
    return rows.withColumn("slice", F.floor((t - F.lit(low)) * n / (F.lit(high) - F.lit(low) + 1)).cast("int")) if low is not None else rows.withColumn("slice", F.lit(0))


class Run:
    """A stream over a folder of files that grows, and the table its batches are merged into."""

    def __init__(self, spark: SparkSession, name: str, schema: DataFrame) -> None:
        self.spark, self.tables = spark, Tables(spark, f"stream-{name}")
        self.landing, self.out, self.checkpoint = (f"{self.tables.path}/{x}" for x in ("landing", "out", "checkpoint"))
        self.schema, self.progress = schema.schema, []

    def arrive(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.landing)

    def source(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.landing)

    def start(self, made: DataFrame, mode: str = "append", merge: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
        """Takes all files that are there, in as many batches as it needs, and stops."""

        def put(batch: DataFrame, number: int) -> None:
            (merge(batch, number) if merge else batch).write.mode("overwrite").parquet(f"{self.out}/batch={number}")

        q = made.writeStream.outputMode(mode).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).foreachBatch(put).start()
        q.awaitTermination()
        self.progress += q.recentProgress

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.out)

    def latest(self, *keys: str) -> DataFrame:
        """The newest row of each key."""
        rows = self.rows()
        values = [c for c in rows.columns if c not in (*keys, "batch")]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
        return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def run_slices(spark: SparkSession, name: str, rows: DataFrame, make: Callable[[DataFrame], DataFrame], by: str, mode: str = "append", slices: int = 3, merge: Callable[[Run], Callable] | None = None) -> Run:
    """Lands rows slice after slice and starts the stream anew after each, so every start but the first goes on from a checkpoint."""
    run = Run(spark, name, rows)
    cut = Tables(spark, name).put(sliced(rows, by, slices), "sliced")
    for k in range(slices):
        run.arrive(cut.filter(F.col("slice") == k).drop("slice"))
        run.start(make(run.source()), mode, merge(run) if merge else None)
    return run


def pulse_stream(spark: SparkSession, audit: DataFrame, slices: int = 3) -> DataFrame:
    return run_slices(spark, "pulses", audit, streams.pulses, "ts", slices=slices).rows()


def window_stream(spark: SparkSession, audit: DataFrame, slices: int = 3) -> DataFrame:
    """(start, end, op, n) of all windows, those still open included: counts come as updates and the newest stands."""
    return run_slices(spark, "windows", audit, streams.windowed_counts, "ts", "update", slices).latest("start", "end", "op")


def session_stream(spark: SparkSession, events: DataFrame, slices: int = 3) -> DataFrame:
    """(user_id, start, end, n) of sessions that the watermark has closed."""
    return run_slices(spark, "sessions", events, streams.sessions, "ts", slices=slices).rows()


def distinct_stream(spark: SparkSession, events: DataFrame, keys: list[str], late: str, slices: int = 3) -> DataFrame:
    return run_slices(spark, "distinct", events, lambda s: streams.deduplicated(s, keys, late), "ts", slices=slices).rows()


def duel_stream(spark: SparkSession, assertions: DataFrame, mode: str = "chat-only", slices: int = 3) -> DataFrame:
    """How each write on an axis of one value went; the values of every axis are the stream's state."""
    return run_slices(spark, "duels", assertions, lambda s: duels.streamed(s, mode), "created_at", slices=slices).rows()


def doubt_stream(spark: SparkSession, observations: DataFrame, slices: int = 3) -> DataFrame:
    return run_slices(spark, "doubt", observations, streams.doubt_counters, "at", slices=slices).rows()


def quota_stream(spark: SparkSession, writes: DataFrame, most: int, seconds: int = 60, slices: int = 3) -> DataFrame:
    return run_slices(spark, "quota", writes, lambda s: streams.quota(s, most, seconds), "ts", slices=slices).rows()


def retest_ticks(spark: SparkSession, edits: DataFrame, candidates: DataFrame, tested: Callable[[DataFrame], DataFrame], cap: int = 50, cadence: int = 3600, slices: int = 3, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Periodic re-test: each start is a tick that counts the edits since the last one, re-tests what is due, ``cap`` facts at most, and sets the next interval.

    Gives (tick, edits, processed, cadence) and the re-tested facts with their tick. ``candidates`` (id, ...) are flagged facts; one
    that a former tick tested is done. A tick's rows are written under its number, so one that runs again changes nothing.
    """
    due = order if order is not None else F.col("id")

    def merge(run: Run) -> Callable[[DataFrame, int], DataFrame]:
        done_at = f"{run.tables.path}/tested"

        def tick(batch: DataFrame, number: int) -> DataFrame:
            n = batch.count()
            before, left = cadence, candidates
            if number:
                before = spark.read.parquet(f"{run.out}/batch={number - 1}").first()["cadence"]
                earlier = spark.read.parquet(done_at).filter(F.col("batch") < number).select("id")
                left = candidates.join(earlier, "id", "left_anti")
            now = left.orderBy(due).limit(cap)
            tested(now).write.mode("overwrite").parquet(f"{done_at}/batch={number}")
            processed = spark.read.parquet(f"{done_at}/batch={number}").count()
            following = belief.cadence(F.lit(before).cast("long"), F.lit(n).cast("long"))
            return spark.range(1).select(F.lit(n).cast("long").alias("edits"), F.lit(processed).cast("long").alias("processed"), following.alias("cadence"))

        return tick

    run = run_slices(spark, "retest", edits, lambda s: s, "ts", slices=slices, merge=merge)
    ticks = run.rows().select(F.col("batch").cast("long").alias("tick"), "edits", "processed", "cadence")
    return ticks, spark.read.parquet(f"{run.tables.path}/tested").withColumnRenamed("batch", "tick")

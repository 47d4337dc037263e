"""Tables that a plan reads more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side that is sent to every task has at most so many narrow rows; the count stops there.
SENT_ROWS = 100_000


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, one of our own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/mnemospark-tables"


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder is the cluster's to clear
        pass


class Tables:
    """Written tables of one plan: they outlive executors, cut lineage, and go when the session ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(delete, spark, self.path)

    def put(self, df: DataFrame, name: str, *partitions: str) -> DataFrame:
        df.write.mode("error").partitionBy(*partitions).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that are done with; without names, all."""
        for path in [f"{self.path}/{name}" for name in names] or [self.path]:
            delete(self.spark, path)


def freed(spark: SparkSession) -> None:
    """Lets go of the shuffle files of tables that are written: Spark deletes them once no plan in the driver refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sent(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted size allows; else a shuffled join is left, whose skew AQE splits."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

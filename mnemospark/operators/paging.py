"""Keyset paging that reads few files: rows are clustered by (created_at, id), newest first, undated last, and every file keeps its bounds.

A page names its place by the last row before it, so pages stay what they are while newer rows come in elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.sources.shared import Tables

#: Undated rows stand behind all dated ones.
LAST = 1 << 62


def place(created: Column, key: Column) -> Column:
    """Where a row stands: ascending places are descending dates, then ascending keys."""
    return F.struct((F.coalesce(-F.unix_micros(created.cast("timestamp")), F.lit(LAST))).alias("at"), key.cast("long").alias("key"))


class Pages:
    """Rows (id, created_at, ...) written in order, with a zone map (file, low, high, n) of a row a file."""

    def __init__(self, spark: SparkSession, rows: DataFrame, files: int | None = None) -> None:
        self.spark, self.columns, tables = spark, rows.columns, Tables(spark, "pages")
        n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.withColumn("__place", place(F.col("created_at"), F.col("id"))).repartitionByRange(n, "__place").sortWithinPartitions("__place")
        self.rows = tables.put(ordered, "rows")
        zones = self.rows.groupBy(F.input_file_name().alias("file")).agg(F.min("__place").alias("low"), F.max("__place").alias("high"), F.count(F.lit(1)).alias("n"))
        self.zones = tables.put(zones, "zones")

    def files(self, limit: int, after: tuple[int, int] | None) -> list[str]:
        """The files that a page of ``limit`` rows, and one more, can lie in: those that end after the cursor, until they hold enough whole."""
        z = self.zones
        if after is not None:
            z = z.filter(F.col("high") > _at(after))
        before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # over a row a file
        # A file that begins before the cursor counts as empty, as most of it may lie before.
        whole = F.when(F.col("low") > _at(after), F.col("n")).otherwise(0) if after is not None else F.col("n")
        z = z.withColumn("held", F.coalesce(F.sum(whole).over(before), F.lit(0)))
        return [r["file"] for r in z.filter(F.col("held") <= limit).select("file").collect()]

    def page(self, limit: int, after: tuple[int, int] | None = None) -> tuple[DataFrame, tuple[int, int] | None]:
        """The rows after the cursor, ``limit`` at most, and the cursor of the next page; None if nothing follows."""
        files = self.files(limit, after)
        if not files:
            return self.rows.limit(0).select(*self.columns), None
        rows = self.spark.read.schema(self.rows.schema).parquet(*files)
        if after is not None:
            rows = rows.filter(F.col("__place") > _at(after))
        got = rows.orderBy("__place").limit(limit)
        ends = rows.select("__place").orderBy("__place").limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.max("__place").alias("last")).first()
        cursor = None
        if ends["n"] > limit:
            last = got.agg(F.max("__place").alias("p")).first()["p"]
            cursor = (last["at"], last["key"])
        return got.select(*self.columns), cursor


def _at(cursor: tuple[int, int]) -> Column:
    return F.struct(F.lit(cursor[0]).cast("long").alias("at"), F.lit(cursor[1]).cast("long").alias("key"))

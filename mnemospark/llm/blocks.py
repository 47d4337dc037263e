"""Deals weak components to tasks of bounded size, for operators that verify links inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_counts(rows: DataFrame, weight: str, most: int) -> tuple[DataFrame, int]:
    """(component, nb): into how many row blocks a component is cut; and over how many tasks whole ones are dealt."""
    w = rows.groupBy("component").agg(F.sum(weight).alias("w"))
    total = rows.agg(F.sum(weight)).first()[0] or 0
    return w.select("component", F.ceil(F.col("w") / most).cast("int").alias("nb")), max(1, -(-int(total) // (most // 2)))


def dealt(rows: DataFrame, node: str, tasks: int) -> DataFrame:
    """Adds t, i, j: a whole small component has one task; of a large one every two row blocks meet in one."""
    own = F.pmod(F.xxhash64(node), F.col("nb"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    cut = F.col("nb") > 1
    return (
        rows.withColumn("t", F.when(cut, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(tasks))))
        .withColumn("i", F.when(cut, F.least("own", "other")).otherwise(F.lit(-1)))
        .withColumn("j", F.when(cut, F.greatest("own", "other")).otherwise(F.lit(-1)))
        .drop("own", "other", "nb")
    )

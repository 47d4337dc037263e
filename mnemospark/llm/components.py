"""Connected components of a graph in DataFrames: alternating large and small stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemospark.llm.common import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node on an edge; the component is its smallest node.

    Nodes are integers, or structs of them where 64 bits would not tell all nodes apart. Every round is two
    aggregations with map-side minima and two joins whose hot keys AQE may split; its edges are written to
    the shared folder, so no lineage grows. Self-links and nulls are ignored.
    """
    scratch = Scratch(spark, "components")
    whole = not isinstance(edges.schema[a].dataType, StructType)
    u, v = (F.col(x).cast("long") if whole else F.col(x) for x in (a, b))
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(u.isNotNull() & v.isNotNull() & (u != v)).distinct()
    e, seen, r = scratch.put(e, "round0"), None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        star = star.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
        e = scratch.put(star.select("x.u", "x.v").filter("u <> v").distinct(), f"round{r + 1}")
        scratch.drop(f"round{r}")
        r += 1
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

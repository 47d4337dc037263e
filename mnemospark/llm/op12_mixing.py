"""Mixing of sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same expected number of copies, the source's target over its size. The
expected copies are summed up along the source's documents, one random offset is added, and a document is
taken once for each whole number that the sum crosses in it. Documents stand in order of size, so that
sampling spreads over short and long ones alike: the words taken differ from the target by about twice the
longest document at most.

The order over a source of any share of all rows is found in two steps: documents are dealt to ranges of
(source, size, id), numbered within a range and source, and the ranges' counts, a row each, are summed up.

Defined cases: null text has no words and null is a source of its own, the last; a document without words is
taken with 0 words; repeated rows and ids are documents of their own (which of several equal rows is taken is
not told apart in the result); a source without words has target 0; an empty table gives an empty result;
other columns are ignored. One window runs over all sources, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import Scratch, hinted

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by rank of source, repeating; how many times a source may be taken at most; and what the offsets are drawn from.
WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix"
#: Expected copies are counted in parts of this: 2**40.
UNIT = 1 << 40


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds weight and target (words) to rows (source, source_size), one a source.

    Shares by weight of all words, at most ``most`` times a source's own; the excess goes to the others by
    weight. In order of cap over weight this ends at the first source that its share does not fill.
    """
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1)
    ranked = ranked.withColumns({"weight": weight.cast("long"), "cap": (F.col("source_size") * most).cast("long")})
    order = Window.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), "k")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = rest.cast("double") / F.sum("weight").over(after).cast("double")
    ranked = ranked.withColumn("level", level)
    share = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    return ranked.withColumn("target", F.least(share * F.col("weight"), F.col("cap").cast("double"))).select("source", "source_size", "weight", "target")


def offset(source: Column, seed: str) -> Column:
    """The source's own offset, 0 to UNIT - 1."""
    named = F.concat(F.lit(seed), F.when(source.isNull(), "-").otherwise("+"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 10), 16, 10).cast("long")


def numbered(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds place, 1 up within each source in order of (size, doc_id, row), without a task for a source."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, F.col("source").asc_nulls_last(), "size", "doc_id", "row")
    ranged = scratch.put(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    cells = ranged.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = scratch.put(cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "cells")
    cells = hinted(cells.select(F.col("part").alias("p"), F.col("source").alias("s"), "before"))
    within = F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "doc_id", "row"))
    out = ranged.withColumn("within", within).join(cells, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return out.withColumn("place", F.col("before") + F.col("within")).drop("p", "s", "part", "before", "within")


def mix(
    spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target (its source's), copies, taken (words)."""
    scratch = Scratch(spark, "mixing")
    size = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.put(rows, "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size").cast("double") * float(UNIT))).otherwise(0).cast("long")
    sources = scratch.put(sources.withColumns({"rate": rate, "start": offset(F.col("source"), seed)}), "sources")
    sources = hinted(sources.withColumnRenamed("source", "s"))
    placed = numbered(spark, rows, scratch).join(sources, F.col("source").eqNullSafe(F.col("s")))
    # Exact: 18 digits of places times 14 of a rate.
    summed = lambda place: f"(cast({place} as decimal(18, 0)) * cast(rate as decimal(14, 0)) + cast(start as decimal(14, 0))) div cast({UNIT} as decimal(14, 0))"
    placed = placed.withColumn("copies", F.expr(summed("place")) - F.expr(summed("place - 1")))
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, source_size * 3 as cap from s),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap::double / weight::double, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
                / (sum(weight) over (order by cap::double / weight::double, source nulls last rows between current row and unbounded following))::double as level from r),
t as (select source, source_size, least((select max(level) from l where level * weight <= cap) * weight, cap::double) as target from l),
u as (select *, case when source_size > 0 then floor(target / source_size::double * {float(UNIT)})::hugeint else 0 end as rate,
             ('0x' || substr(md5('{SEED}' || case when source is null then '-' else '+' end || coalesce(source, '')), 1, 10))::bigint::hugeint as start from t),
p as (select d.doc_id, d.size, u.*, (row_number() over (partition by d.source order by d.size, d.doc_id))::hugeint as place from d join u on d.source is not distinct from u.source)
select doc_id, size, source_size, target, ((((place * rate + start) // {UNIT}) - (((place - 1) * rate + start) // {UNIT})) * size)::bigint as taken from p
"""

"""Exact deduplication by progressive refinement, in DataFrame functions only.

Rows are grouped by byte length and a hash of a short prefix first; the whole text is hashed only
for rows of groups that still hold more than one row. Lower-casing A-Z keeps the byte length.

Defined cases: null text counts as empty; of equal texts the largest id stays; repeated rows of that
id all count as staying; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import LOWER, UPPER, Scratch, ascii_lower, small

#: Characters of a text that the second refinement reads.
PREFIX_CHARS = 64


def refine(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256 (the digest of every text is part of the report)."""
    scratch = Scratch(spark, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS))).alias("prefix"),
    )
    # Lengths, then prefixes: one partially aggregated shuffle of counts; only groups of two and more go on.
    cheap = base.groupBy("n_bytes", "prefix").agg(F.count(F.lit(1)).alias("n"))
    left = scratch.put(cheap.filter("n > 1").select("n_bytes", "prefix"), "survivors")
    full = F.sha2(ascii_lower(F.col("text")), 256)
    if small(left):
        # The survivors' keys fit every executor: texts stay where they are, and the others are not hashed.
        marked = base.join(F.broadcast(left.withColumn("again", F.lit(True))), ["n_bytes", "prefix"], "left")
        marked = marked.withColumn("full", F.when(F.col("again"), full))
    else:
        # Too many keys to send out: the hash, not the text, would have to move, so it is taken at the scan.
        marked = base.withColumn("full", full)
    groups = marked.filter(F.col("full").isNotNull()).groupBy("full").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    groups = scratch.put(groups.filter("n > 1"), "groups")
    # Rows without a whole-text hash get a key of their own, so that nulls do not meet in one task.
    # What moves is the key and the digest input's hash at most: text leaves before the join.
    out = marked.select(
        "doc_id",
        F.coalesce("full", F.concat(F.lit("#"), F.col("doc_id").cast("string"))).alias("key"),
        F.coalesce("full", full).alias("digest"),
    )
    found = groups.select(F.col("full").alias("key"), "keep", "n")
    out = out.join(F.broadcast(found) if small(found) else found, "key", "left")
    return out.select(
        "doc_id",
        F.coalesce("keep", "doc_id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep", "doc_id") == F.col("doc_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
with n as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as h from documents)
select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
       doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256
from n
"""

"""The audit log's hash chain, verified by many tasks however long one log is.

A log is read in blocks of its file, each by a task in order. Within a block a line is held against the one before
it; of each block only its first link, its last line's hash and its number of lines go on, and a step over these few
rows checks the links between blocks and turns places in blocks into line numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.sources.shared import Tables

ENTRY = "prev_hash string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, block, row, raw): the lines of all logs under a path; rows of a block stand in order."""
    text = spark.read.text(path)
    return text.select(F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("raw"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(log, total, chained, broken_at): lines, lines up to the break that carry a link, and the first line, from 1, whose link is not the SHA-256 of the line before.

    A line that is no JSON is passed over, but the next one links to it. The first line's link is not checked.
    """
    raw = lines(spark, path)
    entry = F.from_json("raw", ENTRY, {"mode": "PERMISSIVE"})
    rows = raw.select("log", "block", "row", F.sha2("raw", 256).alias("hash"), F.when(F.ltrim("raw").startswith("{"), entry["prev_hash"]).alias("link"))
    # Places are those of one reading, so it is written: a block read again elsewhere would number its rows anew.
    rows = Tables(spark, "audit").put(rows, "lines")
    inside = Window.partitionBy("log", "block").orderBy("row")
    placed = rows.withColumns({"before": F.lag("hash").over(inside), "k": F.row_number().over(inside)})
    edges = placed.groupBy("log", "block").agg(F.max("k").alias("n"), F.max_by("hash", "k").alias("last"))
    blocks = Window.partitionBy("log").orderBy("block")  # a row a block
    so_far = F.coalesce(F.sum("n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.withColumns({"carried": F.lag("last").over(blocks), "so_far": so_far}).select("log", "block", "carried", "so_far")
    linked = placed.join(F.broadcast(edges) if edges.limit(10_001).count() <= 10_000 else edges, ["log", "block"])
    want = F.when(F.col("k") == 1, F.col("carried")).otherwise(F.col("before"))
    linked = linked.select("log", (F.col("so_far") + F.col("k")).alias("line"), F.col("link").isNotNull().alias("has"), (F.col("link") != want).alias("broken"))
    whole = linked.groupBy("log").agg(F.count(F.lit(1)).alias("total"), F.min(F.when(F.col("broken"), F.col("line"))).alias("broken_at"))
    until = linked.join(whole.select("log", F.col("broken_at").alias("b")), "log").filter(F.col("has") & (F.col("line") > 1) & (F.col("b").isNull() | (F.col("line") <= F.col("b"))))
    chained = until.groupBy("log").agg(F.count(F.lit(1)).alias("chained"))
    return whole.join(chained, "log", "left").select("log", "total", F.coalesce("chained", F.lit(0)).alias("chained"), "broken_at")


def recent(spark: SparkSession, path: str, n: int, target: str | None = None) -> DataFrame:
    """(raw): the last n lines of one log, newest first, and of these, if asked for, those of a target."""
    tail = lines(spark, path).orderBy(F.col("block").desc(), F.col("row").desc()).limit(n)
    if target is not None:
        tail = tail.filter(F.get_json_object("raw", "$.target") == target)
    return tail.orderBy(F.col("block").desc(), F.col("row").desc()).select("raw")


def written(spark: SparkSession, entries: DataFrame, name: str) -> str:
    """Writes entries (log, line, raw as JSON without a link) as chained logs, a file each, under a folder of its own; gives the folder.

    Each line's text holds the hash of the text before, so a log's lines are made one after another, streaming.
    """
    def chain(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, last = None, None
        for pdf in pdfs:
            out = []
            for of, raw in zip(pdf["log"], pdf["raw"], strict=True):
                if of != log:
                    log, last = of, None
                line = raw if last is None else raw[:-1] + f', "prev_hash": "{last}"}}'
                last = hashlib.sha256(line.encode()).hexdigest()
                out.append(line)
            yield pd.DataFrame({"log": pdf["log"], "raw": out})

    made = entries.select("log", "line", "raw").repartition("log").sortWithinPartitions("log", "line").mapInPandas(chain, "log string, raw string")
    path = Tables(spark, name).path
    made.write.partitionBy("log").text(path)
    return path

"""Exact sparse search that looks at few postings, as joins of tables.

Rows are dealt to blocks of about BLOCK rows of like length (a long text has large counts of every term, so
rows of like length bound each other well). A block keeps the largest count of each of its terms, which bounds
the score of all its rows for a query: the sum over the query's terms of weight times that count. A query first
scores the blocks of its highest bounds, which a rare term among its own lifts, and then only those blocks whose
bound reaches its k-th score so far. There its rarer terms come first: the commonest ones, as long as they cannot reach
that score by themselves, are looked up only for rows that can still enter with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import text
from mnemospark.operators.vectors import best
from mnemospark.sources.shared import Tables, sent

#: Rows of a block, about, and blocks that a query scores before it has a floor.
BLOCK, FIRST = 32, 6
#: Scores are rounded to 6 digits; floors are lowered by more than that and summing can move them.
SLACK = 2e-6


def terms(rows: DataFrame, key: str, content: str, *more: str) -> DataFrame:
    return rows.select(key, *more, F.explode(text.tokens(F.col(content))).alias("term"))


def inverse(df: Column, n: Column) -> Column:
    """The smoothed logarithm of rarity."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


class SparseIndex:
    """Postings of rows (id, content) for the terms of some queries (qid, content), by blocks, written to the shared folder."""

    def __init__(self, spark: SparkSession, queries: DataFrame, rows: DataFrame, block: int = BLOCK, copies: str | None = None) -> None:
        self.tables, self.found = Tables(spark, "postings"), {}
        asked = self.tables.put(terms(queries, "qid", "content").groupBy("qid", "term").agg(F.count(F.lit(1)).alias("tq")), "asked")
        # Classes of length double every second one: some sixty at most, however many rows.
        length = F.floor(2 * F.log2(1.0 + F.coalesce(F.char_length("content"), F.lit(0)))).cast("int")
        rows = rows.select("id", "content", length.alias("length"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))
        counted = rows.groupBy("length").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies")).collect()
        sizes = {r["length"]: r["rows"] for r in counted}
        self.n = sum(r["copies"] for r in counted)
        cuts = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, -(-n // block))]) if sizes else F.create_map(F.lit(0), F.lit(1))
        own = F.col("length").cast("long") * (1 << 40) + F.pmod(F.xxhash64("id"), cuts[F.col("length")])
        posted = terms(rows.withColumn("block", own), "id", "content", "block", "copies")
        posted = posted.join(sent(asked.select("term").distinct()), "term", "left_semi").groupBy("block", "id", "term", "copies").agg(F.count(F.lit(1)).alias("tf"))
        self.posted = self.tables.put(posted, "posted")
        weights = self.posted.groupBy("term").agg(inverse(F.sum("copies"), F.lit(self.n)).alias("idf"))
        self.asked = self.tables.put(asked.join(weights, "term"), "weighted")
        # What each term of a query can add in a block, and how many postings it has there.
        peaks = self.posted.groupBy("block", "term").agg(F.max("tf").alias("top"), F.count(F.lit(1)).alias("held"))
        met = peaks.join(sent(self.asked), "term")
        most = (F.col("tq") * F.col("top") * F.col("idf") * (1 + 1e-9)).alias("most")
        self.met = self.tables.put(met.select("qid", "block", "term", "tq", "idf", most, "held"), "met")

    def scored(self, visits: DataFrame) -> DataFrame:
        """(qid, id, score) of all rows of the visited blocks (qid, block) that hold a term of the query."""
        wanted = self.met.join(visits.select("qid", "block"), ["qid", "block"], "left_semi")
        hits = self.posted.join(wanted.select("qid", "block", "term", "tq", "idf"), ["block", "term"])
        return hits.groupBy("qid", "id").agg(F.round(F.sum(_worth()), 6).alias("score"))

    def visits(self, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The blocks of the first visit, their best k rows of each query, and of the blocks that can still hold a better one
        the query's terms (``needed``: the rows of a block that hold none of the needed ones score beneath the floor; ``rest``: what the others add at most)."""
        if k in self.found:
            return self.found[k]
        bounds = self.tables.put(self.met.groupBy("qid", "block").agg(F.sum("most").alias("bound")), f"bounds-{k}")
        w = Window.partitionBy("qid").orderBy(F.col("bound").desc(), "block")
        first = self.tables.put(bounds.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= FIRST + k // BLOCK).drop("place"), f"first-{k}")
        hits = self.tables.put(best(self.scored(first), k), f"hits-{k}")
        floors = hits.filter(F.col("rank") == k).select("qid", (F.col("score") - SLACK).alias("floor"))
        left = bounds.join(first.select("qid", "block"), ["qid", "block"], "left_anti").join(sent(floors), "qid", "left")
        left = left.filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).select("qid", "block", "floor")
        # The commonest terms are left for later as long as all of them together stay beneath the floor.
        common = Window.partitionBy("qid", "block").orderBy(F.col("held").desc(), "term")
        part = self.met.join(left, ["qid", "block"]).withColumn("needed", F.col("floor").isNull() | (F.sum("most").over(common) >= F.col("floor")))
        rest = F.sum(F.when(~F.col("needed"), F.col("most")).otherwise(0.0)).over(Window.partitionBy("qid", "block"))
        self.found[k] = first, hits, self.tables.put(part.withColumn("rest", rest), f"left-{k}")
        return self.found[k]

    def candidates(self, k: int) -> DataFrame:
        """(qid, block, id, sum): rows of the blocks left whose needed terms, with all that the others can add, reach the floor."""
        if -k not in self.found:
            needed = self.visits(k)[2].filter("needed").select("qid", "block", "term", "tq", "idf", "rest", "floor")
            part = self.posted.join(needed, ["block", "term"]).groupBy("qid", "block", "id").agg(F.sum(_worth()).alias("sum"), F.max("rest").alias("rest"), F.max("floor").alias("floor"))
            can = F.col("floor").isNull() | (F.col("sum") + F.col("rest") >= F.col("floor"))
            self.found[-k] = self.tables.put(part.filter(can).select("qid", "block", "id", "sum"), f"candidates-{k}")
        return self.found[-k]

    def topk(self, k: int) -> DataFrame:
        """(qid, id, score, rank): the k best rows of each query, ties by id."""
        _, hits, left = self.visits(k)
        some = self.candidates(k)
        asked = some.select("qid", "block", "id").join(left.filter("not needed").select("qid", "block", "term", "tq", "idf"), ["qid", "block"])
        more = self.posted.join(asked, ["block", "id", "term"]).select("qid", "id", _worth().alias("sum"))
        whole = some.select("qid", "id", "sum").unionByName(more).groupBy("qid", "id").agg(F.round(F.sum("sum"), 6).alias("score"))
        return best(hits.drop("rank").unionByName(whole), k)

    def work(self, k: int) -> DataFrame:
        """(qid, bounded, joined, whole): terms of blocks bounded and postings joined for a query, and how many postings joining all would take."""
        first, _, left = self.visits(k)
        whole = self.met.groupBy("qid").agg(F.count(F.lit(1)).alias("bounded"), F.sum("held").alias("whole"))
        one = self.met.join(first.select("qid", "block"), ["qid", "block"], "left_semi").select("qid", "held")
        two = left.filter("needed").select("qid", "held")
        later = left.filter("not needed").groupBy("qid", "block").agg(F.count(F.lit(1)).alias("held"))
        three = self.candidates(k).join(later, ["qid", "block"]).select("qid", "held")
        joined = one.unionByName(two).unionByName(three).groupBy("qid").agg(F.sum("held").alias("joined"))
        return whole.join(joined, "qid").select("qid", "bounded", "joined", "whole")


def _worth() -> Column:
    return F.col("tq") * F.col("tf") * F.col("idf")

"""Ingest of a batch in order: each candidate sees what was stored before it, earlier candidates included.

Whatever becomes of a memory that is no secret (stored, quarantined, promoted, reasserted, or held as a near
duplicate), its text is a point of the store after its turn. So the neighbours of a candidate are those among the
stored texts and all earlier candidates' texts, a nearest-neighbour join with an order, which needs no fold; only
whether a text is live or held hangs on outcomes, and that is a fold by text with a state of one word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import memories
from mnemospark.operators.memories import flag
from mnemospark.operators.vectors import Index
from mnemospark.sources.shared import Tables, freed

#: Neighbours whose tokens count, the least share of new ones, and from which score on a text is a near duplicate.
NEIGHBOURS, LEAST_NOVEL, NEAR = 3, 0.30, 0.95
#: Neighbours whose words are met take turns, so that a share of the words lies in shuffle files at a time.
TURNS = 4

COUNTERS = ("stored_memories", "stored_facts", "stored_procedures", "skipped_dup", "skipped_secret", "quarantined", "promoted", "reasserted", "skipped_scope_facts", "skipped_scope_procedures")


def points(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(id, library, vec, place, words): the texts of the store and of the batch, each once, by what had it first; words of the store's only.

    candidates: id, library, vec, t (a hash of the text); known: these and words. Stored ones take the ids -1 - id and
    the place -1; those of the batch keep their id, which is their place.
    """
    old = known.select((-1 - F.col("id")).cast("long").alias("id"), "library", "t", "vec", F.lit(-1).cast("long").alias("place"), "words")
    new = candidates.select("id", "library", "t", "vec", F.col("id").alias("place"), F.lit(None).cast("string").alias("words"))
    both = old.unionByName(new).filter("t is not null")
    first = both.groupBy("library", "t").agg(F.min(F.struct("place", "id")).alias("first")).select("first.id")
    return both.join(first, "id", "left_semi").drop("t")


def said() -> Column:
    """A hash of the text without blanks around it."""
    return F.sha2(F.trim("content"), 256)


def stored(known: DataFrame, *more: str | Column) -> DataFrame:
    """What is looked at of stored texts (id, library, content, vec), and more columns."""
    return known.select("id", "library", "vec", said().alias("t"), memories.worded()["words"].alias("words"), *more)


def novelty(spark: SparkSession, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(id, novelty, score): the share of a candidate's tokens that its nearest texts lack, and the nearest one's score; null without neighbours.

    candidates: id, library, content, vec; known: these, or what ``stored`` made of them. Neighbours are the nearest points of the library before each candidate. Texts are written as their distinct words and shuffled twice: to where a
    candidate's neighbours are known, and, by turns, to these.
    """
    # The vectors may cost a model's pass, so they are written once.
    tables = Tables(spark, "ingest")
    candidates = candidates.select(F.col("id").cast("long").alias("id"), "library", said().alias("t"), "vec", memories.worded().alias("w"))
    candidates = tables.put(candidates.select("id", "library", "t", "vec", "w.words", "w.counts"), "candidates")
    there = tables.put(points(candidates, known if "words" in known.columns else stored(known)), "points")
    asked = candidates.select(F.col("id").alias("qid"), "library", "vec", F.col("id").alias("place"))
    index = Index(spark, there, "library", "place")
    near = index.topk(asked, NEIGHBOURS)
    near = tables.put(near.select(F.col("qid").alias("id"), F.col("id").alias("other"), "score", "rank"), "near")
    index.tables.drop()
    pairs = memories.dealt(near)
    others = pairs.groupBy("id").agg(F.collect_list(F.struct("other", "piece")).alias("others"))
    worded = tables.put(candidates.select("id", "words", "counts").join(others, "id", "left"), "worded")
    tables.drop("candidates")
    pairs = others = asked = candidates = None
    freed(spark)
    texts = worded.select(F.col("id").alias("other"), "words").unionByName(there.filter("place = -1").select(F.col("id").alias("other"), "words"))
    seen = []
    for turn in range(TURNS):
        now = F.pmod(F.xxhash64("other"), F.lit(TURNS)) == turn
        own = worded.select("id", "words", F.explode("others").alias("o")).select("id", "o.other", "o.piece", "words").filter(now)
        wanted = worded.select(F.explode("others").alias("o")).select("o.other", "o.piece").filter(now).distinct()
        seen.append(tables.put(memories.met(own, wanted.join(texts.filter(now), "other")), f"seen{turn}"))
        own = wanted = None
        freed(spark)
    new = memories.shares(worded, functools.reduce(DataFrame.unionByName, seen))
    top = near.filter("rank = 1").select("id", "score")
    return worded.select("id").join(new, "id", "left").join(top, "id", "left")


def _fold(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by text: what is known of it (side 0), then candidates in order."""
    key, state = None, None
    for pdf in pdfs:
        ids, outcomes = [], []
        for k, side, i, live, refused, close in zip(*(pdf[c] for c in ("key", "side", "id", "live", "refused", "close")), strict=True):
            if k != key:
                key, state = k, None
            if side == 0:
                state = "live" if live or state == "live" else "held"
                continue
            if refused:
                out, state = {"held": ("promoted", "live"), "live": ("reasserted", "live")}.get(state, ("quarantined", "held"))
            elif close:
                out, state = ("skipped_dup", "live") if state == "live" else ("skipped_dup_held", "held")
            else:
                out, state = "stored_memories", "live"
            ids.append(i)
            outcomes.append(out)
        yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "outcome": pd.Series(outcomes, dtype="object")})


def run(spark: SparkSession, candidates: DataFrame, known: DataFrame, confine: bool = False) -> DataFrame:
    """(id, kind, outcome, reason, held): what becomes of each candidate, in order of id, one of the report's counters (or ``empty``).

    candidates: id (not negative), kind (memory, fact, procedure), library, content, vec, reason (of the write gate, or
    null), secret (or null), trigger (of a procedure). For a fact ``content`` is its object, for a procedure its fix.
    known: id, library, content, vec, quarantined. ``held`` is the reason under which a text went to quarantine.
    """
    c = candidates.withColumn("id", F.col("id").cast("long"))
    key = F.sha2(F.concat_ws("\0", F.coalesce("library", F.lit("")), F.trim(F.coalesce("content", F.lit("")))), 256).alias("key")
    # Stored texts are read once; no join of outcomes takes a text along.
    known = Tables(spark, "ingest").put(stored(known, key, "quarantined"), "known")
    own = c.filter("kind = 'memory' and secret is null")
    scored = own.select("id", key, "reason").join(novelty(spark, own, known), "id")
    scored = scored.withColumn("reason", F.coalesce("reason", F.when(F.col("novelty") < LEAST_NOVEL, "low_novelty")))
    turn = scored.select("key", F.lit(1).alias("side"), "id", F.lit(False).alias("live"), F.col("reason").isNotNull().alias("refused"), F.coalesce(F.col("score") >= NEAR, F.lit(False)).alias("close"))
    no = F.lit(False)
    old = known.select("key", F.lit(0).alias("side"), F.col("id").cast("long").alias("id"), (~flag("quarantined")).alias("live"), no.alias("refused"), no.alias("close"))
    done = old.unionByName(turn).repartition("key").sortWithinPartitions("key", "side", "id").mapInPandas(_fold, "id long, outcome string")
    judged = done.join(scored.select("id", "reason"), "id")
    held = F.when(F.col("outcome") == "skipped_dup_held", "near_dup_drop").when(F.col("outcome") == "quarantined", F.col("reason"))
    judged = judged.select("id", F.lit("memory").alias("kind"), F.regexp_replace("outcome", "_held$", "").alias("outcome"), "reason", held.alias("held"))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    scope = lambda kind: F.lit(f"skipped_scope_{kind}" if confine else f"stored_{kind}")
    secret = F.col("secret").isNotNull()
    fact = scope("facts") if confine else F.when(secret, "skipped_secret").otherwise(scope("facts"))
    procedure = scope("procedures") if confine else F.when(blank("trigger") | blank("content"), "empty").otherwise(scope("procedures"))
    outcome = F.when(F.col("kind") == "fact", fact).when(F.col("kind") == "procedure", procedure).otherwise("skipped_secret")
    none = F.lit(None).cast("string")
    return judged.unionByName(c.filter(~((F.col("kind") == "memory") & ~secret)).select("id", "kind", outcome.alias("outcome"), none.alias("reason"), none.alias("held")))


def report(outcomes: DataFrame) -> DataFrame:
    """One row of eleven counters."""
    return outcomes.agg(F.count(F.lit(1)).alias("considered"), *[F.count_if(F.col("outcome") == c).alias(c) for c in COUNTERS])

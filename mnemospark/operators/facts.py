"""The bi-temporal fact graph: visibility, lookups, as-of, history, duels and walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import belief, text
from mnemospark.operators import duels
from mnemospark.sources.shared import Tables

#: Statuses that a default read does not show.
HIDDEN = ("stale", "propagation_shadowed", "quarantine_candidate", "superseded")
#: Rows of a registry up to which it is sent to every executor.
SMALL = 10_000


def registered(facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """Adds the predicate's cardinality; an unregistered one is multi. A registry beyond SMALL is joined by a shuffle."""
    known = predicates.select("predicate", F.col("cardinality"))
    if known.limit(SMALL + 1).count() <= SMALL:
        known = F.broadcast(known)
    return facts.join(known, "predicate", "left").withColumn("cardinality", F.coalesce("cardinality", F.lit("multi")))


def parse_cardinality(c: Column) -> Column:
    """Tolerant spelling; null for what is unknown."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("single", "multi"), s).when(s.isin("temporal-single", "temporal_single", "temporalsingle"), "temporal-single")


def parse_status(c: Column) -> Column:
    """Tolerant spelling. A shadowed status that came from outside becomes unknown, which hides nothing."""
    s = F.regexp_replace(F.lower(F.trim(c)), "-", "_")
    return (
        F.when(s.isin("active", "contested", "stale", "unknown", "superseded", "quarantine_candidate"), s)
        .when(s == "candidate", "quarantine_candidate")
        .when(s.isin("propagation_shadowed", "shadowed"), "unknown")
    )


def visible(status: Column, valid: Column) -> Column:
    """Valid and not hidden; a fact without status is visible."""
    return F.coalesce(valid, F.lit(False)) & ~F.coalesce(status.isin(*HIDDEN), F.lit(False))


def valid_at(created: Column, until: Column, at: Column) -> Column:
    """The half-open interval [created, until); a missing bound is open."""
    return (created.isNull() | (created <= at)) & (until.isNull() | (at < until))


def as_of(facts: DataFrame, at: Column) -> DataFrame:
    """Facts that held at a moment: known states only, by validity."""
    state = F.col("status").isNull() | F.col("status").isin("active", "superseded", "stale")
    return facts.filter(F.col("valid") & state & valid_at(F.col("created_at"), F.col("valid_until"), at))


def matching(facts: DataFrame, query: str) -> DataFrame:
    """Visible facts of which one field holds every token of the query."""
    wanted = text.tokens(F.lit(query))
    hit = F.lit(False)
    for c in ("subject", "predicate", "object"):
        hit = hit | (F.size(F.array_except(wanted, text.tokens(F.col(c)))) == 0)
    return facts.filter(visible(F.col("status"), F.col("valid")) & (F.size(wanted) > 0) & hit)


def history(facts: DataFrame, predicate: str | None = None) -> DataFrame:
    """Superseded facts with their place in the subject's timeline, oldest first, undated last."""
    found = facts.filter(F.col("status") == "superseded")
    if predicate is not None:
        found = found.filter(F.col("predicate") == predicate)
    w = Window.partitionBy("subject").orderBy(F.col("created_at").asc_nulls_last(), "event_id")
    return found.withColumn("place", F.row_number().over(w))


def conflicts(facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """Subjects and predicates of one value that have several."""
    g = registered(facts, predicates).filter("cardinality <> 'multi'").groupBy("subject", "predicate", "cardinality")
    return g.agg(F.countDistinct("object").alias("n_objects")).filter("n_objects > 1")


def redo_duels(facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """Of each one-value axis the newest fact stays active; the others are stale, or superseded if temporal. Axes of many values stay out of the window."""
    w = Window.partitionBy("subject", "predicate").orderBy(F.col("created_at").desc(), "seq")
    rows = registered(facts, predicates)
    ranked = rows.filter("cardinality <> 'multi'").withColumn("place", F.row_number().over(w))
    duelled = ranked.withColumn("status", F.when(F.col("place") == 1, "active").otherwise(belief.retire(F.col("cardinality")))).drop("place")
    return duelled.unionByName(rows.filter("cardinality = 'multi'").withColumn("status", F.lit("active")))


def top_dependants(facts: DataFrame, n: int) -> DataFrame:
    """A top-n report."""
    return facts.orderBy(F.col("dependants").desc(), "seq").limit(n)


def duel_on_write(assertions: DataFrame, predicates: DataFrame, mode: str = "chat-only") -> DataFrame:
    """(event_id, subject, predicate, object, verdict, retired): how each write went, recorded, won, contested or quarantined, and which value it retired.

    Writes on axes of many values are recorded without a fold.
    """
    rows = registered(assertions, predicates)
    cols = ["event_id", "subject", "predicate", "object", "verdict", "retired"]
    free = rows.filter("cardinality = 'multi'").select("event_id", "subject", "predicate", "object", F.lit("recorded").alias("verdict"), F.lit(None).cast("string").alias("retired"))
    return free.unionByName(duels.folded(rows.filter("cardinality <> 'multi'"), mode).filter("event_id is not null").select(*cols))


def duelled_facts(assertions: DataFrame, predicates: DataFrame, mode: str = "chat-only") -> DataFrame:
    """(subject, predicate, object, status, created_at, valid_until) of one-value axes after all writes."""
    rows = registered(assertions, predicates).filter("cardinality <> 'multi'")
    return duels.folded(rows, mode).filter("event_id is null").select("subject", "predicate", "object", "status", "created_at", "valid_until")


def walk(spark: SparkSession, edges: DataFrame, start: str, hops: int) -> DataFrame:
    """Entities reachable from start (any case) with the least number of hops, breadth first along both ends of edges.

    The frontier of each hop is joined with the edges; what was met before is left out, so cycles end. Frontiers are
    written, so a hop's plan does not carry those before it.
    """
    tables = Tables(spark, "reached")
    both = edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(edges.select(F.col("object").alias("a"), F.col("subject").alias("b"))).distinct()
    seen = both.filter(F.lower("a") == start.lower()).select(F.col("a").alias("entity")).distinct().withColumn("depth", F.lit(0))
    front = seen = tables.put(seen, "hop0")
    for depth in range(1, hops + 1):
        near = both.join(front.select(F.col("entity").alias("a")), "a").select(F.col("b").alias("entity")).distinct()
        front = tables.put(near.join(seen.select("entity"), "entity", "left_anti").withColumn("depth", F.lit(depth)), f"hop{depth}")
        seen = seen.unionByName(front)
    return seen


def invalidate(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """facts with valid=false for the triples in ``gone``; nothing is deleted."""
    mark = gone.select("subject", "predicate", "object", F.lit(True).alias("__gone")).distinct()
    return facts.join(mark, ["subject", "predicate", "object"], "left").withColumn("valid", F.col("valid") & F.col("__gone").isNull()).drop("__gone")


def set_fields(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Merge, not replace: a patched column's value where there is one, the old otherwise."""
    names = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    out = rows.join(renamed, key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in names}).drop(*[f"__{c}" for c in names])

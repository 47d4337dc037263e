"""Belief revision over tables: opponents, retiring, re-tests, mode advice, and the scenarios that the formulas are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import belief

#: Fixed values: (dependants, confirmations, age in days) of the old belief, (diverse, external, live) of the new one, outcome.
SCENARIOS = {
    "first_mention_cannot_flip_core": (40, 8, 600, 0, 0, True, "quarantine"),
    "first_mention_cannot_flip_solid": (10, 2, 180, 0, 0, True, "quarantine"),
    "rumor_vs_entrenched": (20, 3, 400, 0, 0, True, "quarantine"),
    "ci_signal_flips_mild": (3, 1, 30, 0, 5, True, "flip"),
    "ci_signal_flips_core": (40, 8, 600, 0, 5, True, "flip"),
    "strong_both_flips_mild": (3, 1, 30, 5, 5, True, "flip"),
    "strong_both_flips_solid": (10, 2, 180, 5, 5, True, "flip"),
    "repeated_contests_solid": (10, 2, 180, 3, 0, True, "contested"),
    "single_confirm_vs_core_quarantine": (40, 8, 600, 1, 0, True, "quarantine"),
    "inherited_firstmention_vs_solid": (10, 2, 180, 0, 0, False, "quarantine"),
    "ext_signal_flips_young": (1, 0, 5, 0, 3, True, "flip"),
    "diverse_only_contests_core": (40, 8, 600, 5, 0, True, "contested"),
    "weak_repeat_flips_young": (1, 0, 5, 2, 0, True, "flip"),
    "ci_x2_flips_mild": (3, 1, 30, 0, 2, True, "flip"),
    "inherited_strong_vs_core_contests": (40, 8, 600, 5, 5, False, "contested"),
}


def calibration(spark: SparkSession, mode: str = "chat-only") -> DataFrame:
    """(name, expected, outcome) of every scenario; one is known to come out otherwise and stays as it is."""
    rows = spark.createDataFrame([(k, *v) for k, v in SCENARIOS.items()], "name string, dependants int, confirmations int, age int, diverse int, external int, live boolean, expected string")
    old = belief.entrenchment(F.col("dependants"), F.col("confirmations"), F.col("age"))
    new = belief.weight_new(F.lit(mode), F.col("diverse"), F.col("external"), F.lit(None).cast("double"), F.col("live"))
    return rows.select("name", "expected", belief.resolve_duel(new, old).alias("outcome"))


def modes_compared(rows: DataFrame, base: str = "chat-only") -> DataFrame:
    """(mode, expected, outcome, n) over conflicts (dependants, confirmations, age, diverse, external, live): how often a mode decides otherwise than ``base``."""
    old = belief.entrenchment(F.col("dependants"), F.col("confirmations"), F.col("age"))
    decided = lambda mode: belief.resolve_duel(belief.weight_new(mode, F.col("diverse"), F.col("external"), F.lit(None).cast("double"), F.col("live")), old)
    each = rows.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in belief.MODES])))
    return each.groupBy("mode", decided(F.lit(base)).alias("expected"), decided(F.col("mode")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def diverse(n: Column) -> Column:
    """How much so many unlike sources weigh."""
    return F.log2(1 + belief.zero(n))


def opponents(existing: DataFrame, now: Column, by: tuple[str, ...] = ("subject", "predicate")) -> DataFrame:
    """Of each axis the most entrenched fact (dependants, confirmations, created_at, seq); of equal ones the first written."""
    age = F.greatest(F.timestamp_diff("DAY", F.col("created_at").cast("timestamp"), now), F.lit(0))
    e = belief.entrenchment(F.col("dependants"), F.col("confirmations"), age)
    rows = existing.withColumn("entrenchment", F.round(e, 12))  # equal sums are ties, whatever their last bits
    w = Window.partitionBy(*by).orderBy(F.col("entrenchment").desc(), "seq")
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def retire_losers(facts: DataFrame, losers: DataFrame, now: Column, key: str = "seq") -> DataFrame:
    """Losers of duels get their status by cardinality, and end now."""
    hit = facts.join(losers.select(key, F.lit(True).alias("__hit")).distinct(), key, "left")
    lost = F.coalesce("__hit", F.lit(False))
    return hit.withColumns({"status": F.when(lost, belief.retire(F.col("cardinality"))).otherwise(F.col("status")), "valid_until": F.when(lost, now).otherwise(F.col("valid_until"))}).drop("__hit")


def citing(signals: DataFrame, confidences: DataFrame) -> DataFrame:
    """Adds to signals the confidence (of id, score) of the memory that a ``cited_by`` names as its source; null where unknown."""
    c = confidences.select(F.col("id").cast("string").alias("source"), F.col("score").alias("citing"))
    some = signals.filter("signal_type = 'cited_by'").join(c, "source", "left")
    return some.unionByName(signals.filter("signal_type <> 'cited_by'").withColumn("citing", F.lit(None).cast("double")))


def retest(facts: DataFrame, typed: DataFrame, mode: str = "chat-only") -> DataFrame:
    """Every fact's confidence anew, and what follows for the doubt window: promote, recover or none.

    facts: id, dependants, confirmations, legacy, cached (null: 0.5), counter, inherited. typed: memory_id, score of its typed
    signals, where there are any. The counter becomes DOUBT on promotion and 0 on recovery.
    """
    t = typed.select(F.col("memory_id").alias("id"), F.col("score").alias("__typed"))
    c = belief.confidence(F.lit(mode), F.col("dependants"), F.col("confirmations"), F.col("__typed"), F.col("legacy"), F.col("inherited"))
    rows = facts.join(t, "id", "left").withColumn("confidence", F.round(c, 6))
    step = belief.retest(F.coalesce("cached", F.lit(0.5)), F.col("confidence"), F.col("counter") >= DOUBT)
    rows = rows.withColumn("transition", step)
    return rows.withColumn("counter", F.when(F.col("transition") == "promote", DOUBT).when(F.col("transition") == "recover", 0).otherwise(F.col("counter"))).drop("__typed")


#: Drifted retrievals in a row from which on a fact is in the doubt window, and what the window does to its weight.
DOUBT, DOUBTED = 5, 0.5


def doubted(x: Column, inside: Column) -> Column:
    return x * F.when(inside, DOUBTED).otherwise(1.0)


def centroid(rows: DataFrame, by: str, vec: str, size: int) -> DataFrame:
    """(by, pos, x): the mean vector of each group, of length one. Vectors of another size add nothing but count."""
    fits = F.size(vec) == size
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    m = rows.filter(fits).select(by, F.posexplode(vec).alias("pos", "v")).groupBy(by, "pos").agg(F.sum(F.col("v").cast("double")).alias("s"))
    m = m.join(n, by).withColumn("m", F.col("s") / F.col("n"))
    norm = m.groupBy(by).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return m.join(norm, by).select(by, F.col("pos").cast("long").alias("pos"), F.round(F.col("m") / F.col("norm"), 6).alias("x"))


def recommend_mode(signals: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """(signals, agents, mode): what the last week's signals and the last month's agents suggest; many agents come first."""
    within = lambda c, days: (F.col(c).cast("timestamp") >= now - F.expr(f"interval {days} days")) & (F.col(c).cast("timestamp") <= now)
    s = signals.filter(within("ts", 7)).agg(F.count(F.lit(1)).alias("signals"))
    a = sessions.filter(within("last_active", 30)).agg(F.countDistinct("agent").alias("agents"))
    mode = F.when(F.col("agents") >= 3, "multi-tenant").when(F.col("signals") >= 10, "dev-with-ci").otherwise("chat-only")
    return s.join(F.broadcast(a)).select("signals", "agents", mode.alias("mode"))

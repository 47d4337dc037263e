"""Outcomes, procedures, measurement: signals, ranks, percentiles, cardinalities, recall, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import belief
from mnemospark.operators import revision


def latest_signals(signals: DataFrame) -> DataFrame:
    """One signal a memory, type and source: the latest; of equal times the first written."""
    w = Window.partitionBy("memory_id", "signal_type", "source").orderBy(F.col("ts").desc(), "event_id")
    return signals.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def typed_scores(signals: DataFrame, confidences: DataFrame, least: float = 0.5) -> DataFrame:
    """(memory_id, score, n) over the latest signals; a citation counts only if the citing memory's confidence is known and high enough."""
    known = revision.citing(latest_signals(signals), confidences)
    counts = (F.col("signal_type") != "cited_by") | F.coalesce(F.col("citing") >= least, F.lit(False))
    w = F.when(counts, belief.signal_weight(F.col("signal_type"), F.col("success"))).otherwise(0.0)
    return known.groupBy("memory_id").agg(F.round(F.sum(w), 6).alias("score"), F.count(F.lit(1)).alias("n"))


def first_signals(signals: DataFrame) -> DataFrame:
    """One signal a memory, type and source: the first, as later ones of the key are re-posts."""
    w = Window.partitionBy("memory_id", "signal_type", "source").orderBy("ts", "event_id")
    return signals.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def bump_counters(stored: DataFrame, signals: DataFrame) -> DataFrame:
    """Stored counters (id, success_count, fail_count, verified) after new test and compile signals; ``verified`` latches."""
    s = first_signals(signals).filter(F.col("signal_type").isin("test_passed", "code_compiled"))
    n = s.groupBy(F.col("memory_id").alias("id")).agg(F.count_if(F.col("success")).alias("__s"), F.count_if(~F.col("success")).alias("__f"))
    out = stored.join(n, "id", "left")
    add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    verified = F.coalesce("verified", F.lit(False)) | (F.coalesce("__s", F.lit(0)) > 0)
    return out.withColumns({"success_count": add("success_count", "__s"), "fail_count": add("fail_count", "__f"), "verified": verified}).drop("__s", "__f")


def learn(procedures: DataFrame, new: DataFrame) -> DataFrame:
    """Procedures (id, trigger_error, fix, success_count, fail_count, verified) with new ones (id, trigger_error, fix, verified).

    A known id takes the new text and keeps its counts; ``verified`` latches. A new id begins at none. Of an id that comes
    several times the greatest text counts, and it is verified if any of them is.
    """
    new = new.groupBy("id").agg(F.max(F.struct("trigger_error", "fix")).alias("t"), F.max(F.coalesce("verified", F.lit(False))).alias("verified")).select("id", "t.trigger_error", "t.fix", "verified")
    old = procedures.select("id", F.col("success_count").alias("__s"), F.col("fail_count").alias("__f"), F.col("verified").alias("__v"))
    n = new.join(old, "id", "left").select("id", "trigger_error", "fix", F.coalesce("__s", F.lit(0)).alias("success_count"), F.coalesce("__f", F.lit(0)).alias("fail_count"), (F.coalesce("verified", F.lit(False)) | F.coalesce("__v", F.lit(False))).alias("verified"))
    return procedures.join(new.select("id"), "id", "left_anti").select(*n.columns).unionByName(n)


def legacy_cardinality(facts: DataFrame) -> DataFrame:
    """(predicate, proposed, confidence) without looking at time: single if no subject has two objects, else multi, surely from a fifth of the subjects on."""
    per = facts.groupBy("predicate", "subject").agg(F.countDistinct("object").alias("d"))
    g = per.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") >= 2).alias("many"))
    return g.select("predicate", F.when(F.col("many") == 0, "single").otherwise("multi").alias("proposed"), F.when((F.col("many") == 0) | (F.col("many") / F.col("n") >= 0.2), "high").otherwise("low").alias("confidence"))


def dependants(facts: DataFrame, hits: DataFrame, least: float, most: int = 256) -> DataFrame:
    """(seq, dependants): how many of a fact's search hits (qid = seq, id, score, rank), to so many places, reach a score; 0 without any."""
    n = hits.filter((F.col("score") >= least) & (F.col("rank") <= most)).groupBy(F.col("qid").alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    return facts.select("seq").join(n, "seq", "left").select("seq", F.coalesce("n", F.lit(0)).cast("long").alias("dependants"))


#: Kinds of question by how much they ask for a search first.
FIRST = ("single-session-user", "single-session-preference", "single-session-assistant", "knowledge-update", "multi-session")
SECOND = ("temporal-reasoning",)


def policy_effect(rows: DataFrame) -> DataFrame:
    """Recall of questions (question_type, r1, r5, r10 booleans) by priority and in all, with a search policy and without, where it is 0.

    ``delta`` is the gain at five in points of a hundred.
    """
    kind = F.when(F.col("question_type").isin(*FIRST), "P1").when(F.col("question_type").isin(*SECOND), "P2").otherwise("P0")
    g = rows.withColumn("priority", kind).groupingSets([[], ["priority"]], "priority")
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(c)
    out = g.agg(F.count(F.lit(1)).alias("n"), share("r1"), share("r5"), share("r10")).withColumn("priority", F.coalesce("priority", F.lit("all")))
    return out.withColumns({"without": F.lit(0.0), "delta": F.round(100 * F.col("r5"), 4)})


def extraction_tally(rows: DataFrame, extractor) -> DataFrame:
    """One row: memories processed, facts produced, memories that gave none, and those whose extractor failed (null). ``extractor``: content to triples."""
    n = F.size(F.col("__found"))
    found = rows.withColumn("__found", extractor(F.col("content")))
    failed = F.col("__found").isNull()
    return found.agg(F.count(F.lit(1)).alias("processed"), F.coalesce(F.sum(F.when(~failed, n)), F.lit(0)).cast("long").alias("produced"), F.count_if(~failed & (n == 0)).alias("empty"), F.count_if(failed).alias("errors"))


def show(row: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value): the fields of one row that are not null, by name, as text."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    return row.select(pairs).select("x.field", "x.value").filter("value is not null")


def guardrail(signals: DataFrame, now: Column, days: int = 7, least: int = 3) -> DataFrame:
    """Memories with so many failed tests in the last days; the cutoff counts."""
    recent = signals.filter((F.col("signal_type") == "test_passed") & ~F.col("success") & (F.col("ts").cast("timestamp") >= now - F.expr(f"interval {days} days")))
    return recent.groupBy("memory_id").agg(F.count(F.lit(1)).alias("failures")).filter(F.col("failures") >= least)


def error_rate(signals: DataFrame, seconds: int = 604_800) -> DataFrame:
    """For each signal the failed tests of its source in the window that it ends.

    A failure counts one up at its second and one down when the window has passed it, so the answer is a running sum,
    taken within days and added to the sums of the days before: a row costs the same however many share its window.
    """
    s = signals.select("event_id", "source", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.when((F.col("signal_type") == "test_passed") & ~F.col("success"), 1).otherwise(0).alias("d"))
    past = s.filter("d = 1 and s is not null").groupBy("source", (F.col("s") + seconds + 1).alias("s")).agg((-F.count(F.lit(1))).alias("d"))
    both = s.withColumn("asked", F.lit(True)).unionByName(past.withColumn("asked", F.lit(False)), allowMissingColumns=True).withColumn("day", F.floor(F.col("s") / 86_400))
    within = F.sum("d").over(Window.partitionBy("source", "day").orderBy("s").rangeBetween(Window.unboundedPreceding, 0))
    days = both.filter("day is not null").groupBy("source", "day").agg(F.sum("d").alias("d"))
    before = F.sum("d").over(Window.partitionBy("source").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(F.col("source").alias("__source"), F.col("day").alias("__day"), before.alias("before"))
    rows = both.withColumn("within", within).filter("asked").join(days, F.col("source").eqNullSafe(F.col("__source")) & F.col("day").eqNullSafe(F.col("__day")), "left")
    return rows.select("event_id", "source", (F.col("within") + F.coalesce("before", F.lit(0))).alias("failures"))


def rank_procedures(procedures: DataFrame, score: Column) -> DataFrame:
    """Adds rank_score: relevance, moved by what is verified and what worked."""
    return procedures.withColumn("rank_score", F.round(belief.rank_score(score, F.col("verified"), F.col("success_count"), F.col("fail_count")), 6))


def nearest_rank(rows: DataFrame, value: str, by: list[str], shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Percentiles as the value at place round(q (n - 1)), without interpolation; min, max, mean and count beside them.

    Equal values are counted first, so what is ordered within a group is its distinct values.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    placed = counted.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > F.round(F.lit(q) * (F.col("n") - 1)), F.col("v")))
    return placed.groupBy(*by).agg(
        F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"), *[at(q).alias(f"p{round(100 * q)}") for q in shares]
    )


def shape(p50: Column, p90: Column, n: Column) -> Column:
    """The form of a formula that a distribution suggests."""
    return F.when((n == 0) | (p50 == 0), "none").when(p90 / p50 > 5, "log").when(p90 == p50, "flat").otherwise("linear")


def propose_cardinality(facts: DataFrame) -> DataFrame:
    """(predicate, subjects, proposed, confidence) from facts (subject, predicate, object, superseded boolean)."""
    per = facts.groupBy("predicate", "subject").agg(F.countDistinct("object").alias("d"), F.countDistinct(F.when(F.col("superseded"), F.col("object"))).alias("s"))
    many = F.col("d") >= 2
    g = per.groupBy("predicate").agg(
        F.count(F.lit(1)).alias("subjects"), F.sum(F.when(many, 1).otherwise(0)).alias("several"), F.sum(F.when(many, F.col("d") - 1).otherwise(0)).alias("steps"), F.sum(F.when(many, F.col("s")).otherwise(0)).alias("superseded")
    )
    ratio = F.when(F.col("steps") == 0, F.lit(0.0)).otherwise(F.col("superseded") / F.col("steps"))
    proposed = F.when(F.col("several") == 0, "single").when(ratio >= 0.6, "temporal-single").otherwise("multi")
    sure = F.when(F.col("several") == 0, "high").when(ratio > 1, "low").when(ratio >= 0.85, "high").when(ratio >= 0.6, "low").when(F.col("several") / F.col("subjects") >= 0.2, "high").otherwise("low")
    return g.select("predicate", "subjects", proposed.alias("proposed"), sure.alias("confidence"))


def recall_at(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: str | None = None) -> DataFrame:
    """Share of queries with a gold row among the first k hits (qid, id, rank); queries without gold are left out."""
    first = gold.join(hits, ["qid", "id"], "left").groupBy("qid", *([by] if by else [])).agg(F.min("rank").alias("first"))
    shares = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"r{k}") for k in ks]
    g = first.groupingSets([[], [by]], by) if by else first.groupBy()
    return g.agg(F.count(F.lit(1)).alias("queries"), *shares)


def audit_tally(audit: DataFrame) -> DataFrame:
    """Operations by library, actor and in all, in one pass."""
    g = audit.groupingSets([["op"], ["op", "library"], ["op", "actor"]], "op", "library", "actor")
    return g.agg(F.count(F.lit(1)).alias("n"), F.grouping_id("op", "library", "actor").alias("level"))


def chain(lines: DataFrame) -> DataFrame:
    """Adds to audit lines (log, line, raw) the hash of the line before, by log."""
    w = Window.partitionBy("log").orderBy("line")
    return lines.withColumn("prev_hash", F.lag(F.sha2("raw", 256)).over(w))


def first_break(lines: DataFrame) -> DataFrame:
    """(log, line): the first line whose prev_hash is not the hash of the line before; a null one is passed over."""
    w = Window.partitionBy("log").orderBy("line")
    want = F.lag(F.sha2("raw", 256)).over(w)
    return lines.withColumn("want", want).filter("prev_hash is not null and want is not null and prev_hash <> want").groupBy("log").agg(F.min("line").alias("line"))


def zombies(sessions: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Active sessions that have been idle for so long."""
    idle = F.timestamp_diff("MINUTE", F.coalesce("last_active", "started").cast("timestamp"), now)
    return sessions.filter((F.col("status") == "active") & (idle >= minutes)).withColumn("idle_minutes", idle)


def doubt_runs(rows: DataFrame, least: int = 5) -> DataFrame:
    """Of drift observations (key, at, drifted) the counter after each, and whether it opens the doubt window."""
    w = Window.partitionBy("key").orderBy("at", "seq")
    island = F.sum(F.when(F.col("drifted"), 0).otherwise(1)).over(w)
    r = rows.withColumn("island", island)
    count = F.sum(F.when(F.col("drifted"), 1).otherwise(0)).over(Window.partitionBy("key", "island").orderBy("at", "seq"))
    return r.withColumn("counter", count).withColumn("inside", F.col("counter") >= least).drop("island")


def retest_candidates(flagged: DataFrame, facts: DataFrame, most: int = 50) -> DataFrame:
    """Flagged facts first, by id, then those with most dependants, without repeats, ``most`` in all."""
    f = flagged.select("seq", F.lit(0).alias("lane"), F.lit(0).cast("long").alias("order"))
    t = facts.join(flagged.select("seq"), "seq", "left_anti").select("seq", F.lit(1).alias("lane"), (-F.col("dependants")).cast("long").alias("order"))
    return f.unionByName(t).orderBy("lane", "order", "seq").limit(most).select("seq", "lane")


def stale_verdicts(rows: DataFrame) -> DataFrame:
    """Belief-revision verdicts by type and in all: cell average, share with all three right."""
    cells = (F.col("state_resolution").cast("int") + F.col("premise_resistance").cast("int") + F.col("implicit_policy_adaptation").cast("int")) / 3
    every = F.col("state_resolution") & F.col("premise_resistance") & F.col("implicit_policy_adaptation")
    g = rows.groupingSets([[], ["type"]], "type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(cells), 6).alias("cell_average"), F.round(F.avg(F.when(every, 1.0).otherwise(0.0)), 6).alias("all_three"))


def graph_export(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity nodes with their degree, and fact edges."""
    ends = facts.select(F.explode(F.array("subject", "object")).alias("entity"))
    return ends.groupBy("entity").agg(F.count(F.lit(1)).alias("degree")), facts.select("subject", "predicate", "object").distinct()

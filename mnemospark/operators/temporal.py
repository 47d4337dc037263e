"""As-of join of many instants with validity intervals.

An interval [created_at, valid_until) is cut into cells of a binary tree over the instants' time span: at most two
a level, of which all but the outermost lie wholly inside. An instant is in one cell a level. So both meet by
equal cell of a key, an interval that holds for years costs as few rows as a short one, open bounds end at the
span's, and what meets without matching is confined to two leaves an interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.facts import valid_at

#: The span of the instants is cut into 2**LEVELS leaves.
LEVELS = 10


def cover(first: Column, last: Column, levels: int) -> Column:
    """The cells (level, cell) of a binary tree that make up the leaves first to last, each once.

    At level l the cells that lie wholly inside are a to b; those among them whose parent does not are a if it
    is odd and b if it is even.
    """

    def at(level: Column) -> Column:
        width = F.pow(F.lit(2), level).cast("long")
        a, b = F.ceil(first / width).cast("long"), (F.floor((last + 1) / width) - 1).cast("long")
        both = F.array(F.when((a <= b) & (a % 2 == 1), a), F.when((a <= b) & (b % 2 == 0), b))
        return F.transform(F.filter(both, lambda c: c.isNotNull()), lambda c: F.struct(level.cast("int").alias("level"), c.alias("cell")))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)))


def _code(c: Column) -> Column:
    """A cell as one number."""
    return c["level"].cast("long") * (1 << 40) + c["cell"]


def as_of_join(instants: DataFrame, facts: DataFrame, key: str = "subject", levels: int = LEVELS) -> DataFrame:
    """instants (key, at, more) with each fact of their key that held then: known states, valid, created_at <= at < valid_until.

    Facts bring status, valid, created_at, valid_until and more; a missing bound is open; an instant without a
    time or key, and a fact without a key, meet nothing. Columns of facts take the prefix ``fact_`` where both have them.
    """
    state = F.col("status").isNull() | F.col("status").isin("active", "superseded", "stale")
    at = F.unix_micros(F.col("at").cast("timestamp"))
    span = instants.agg(F.min(at), F.max(at)).first()
    low, high = (span[0] or 0), (span[1] or 0)
    leaf = lambda t: F.floor((t - low) / max(1.0, (high - low + 1) / (1 << levels))).cast("long")
    inside = lambda t: F.greatest(F.least(leaf(t), F.lit((1 << levels) - 1)), F.lit(0))
    created, until = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("created_at", "valid_until"))
    held = facts.filter(F.col("valid") & state & (F.coalesce(created, F.lit(low)) <= high) & (F.coalesce(until, F.lit(high + 1)) > low))
    held = held.withColumn("__c", F.explode(F.transform(cover(inside(F.coalesce(created, F.lit(low))), inside(F.coalesce(until, F.lit(high))), levels), _code)))
    taken = {c: f"fact_{c}" for c in facts.columns if c in instants.columns and c != key}
    held = held.withColumnRenamed(key, "__key").withColumnsRenamed(taken)
    steps = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: _code(F.struct(level.alias("level"), F.floor(inside(at) / F.pow(F.lit(2), level)).cast("long").alias("cell"))))
    asked = instants.filter(F.col("at").isNotNull()).withColumn("__i", F.explode(steps))
    met = asked.join(held, (F.col(key) == F.col("__key")) & (F.col("__i") == F.col("__c")))
    named = lambda c: F.col(taken.get(c, c)).cast("timestamp")
    return met.filter(valid_at(named("created_at"), named("valid_until"), F.col("at").cast("timestamp"))).drop("__i", "__c", "__key")

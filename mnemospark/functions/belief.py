"""Belief revision: closed formulas over columns. Missing counts are 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of (dependants, confirmations, external signals) by install mode.
MODES = {"chat-only": (0.7, 0.1, 0.2), "dev-with-ci": (0.5, 0.15, 0.35), "multi-tenant": (0.4, 0.4, 0.2)}
FLIP, CONTEST = 1.5, 0.5
#: Weights of typed outcome signals; a failure counts minus half.
SIGNALS = {"test_passed": 1.0, "code_compiled": 0.3, "user_confirmed": 0.7, "cited_by": 0.2}


def zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def entrenchment(dependants: Column, confirmations: Column, age_days: Column) -> Column:
    months = F.least(zero(age_days) / 30, F.lit(24.0))
    return (F.log2(1 + zero(dependants)) + F.log2(1 + zero(confirmations)) + F.log2(1 + months)) / 50


def by_mode(mode: Column, k: int) -> Column:
    out = F.lit(None).cast("double")
    for name, w in MODES.items():
        out = F.when(mode == name, F.lit(w[k])).otherwise(out)
    return out


def weight_new(mode: Column, diverse: Column, external: Column, typed: Column, live: Column) -> Column:
    w = by_mode(mode, 1) * F.log2(1 + zero(diverse)) + by_mode(mode, 2) * F.coalesce(typed, F.log2(1 + zero(external)))
    return F.when(live, w).otherwise(0.5 * w)


def resolve_duel(new: Column, old: Column, flip: Column | float = FLIP, contest: Column | float = CONTEST) -> Column:
    return F.when(new > flip * old, "flip").when(new > contest * old, "contested").otherwise("quarantine")


def retire(cardinality: Column) -> Column:
    return F.when(cardinality == "temporal-single", "superseded").otherwise("stale")


def saturating(n: Column) -> Column:
    return 1 - 1 / (1 + F.log2(1 + zero(n)))


def signed(score: Column) -> Column:
    # greatest and least pass nulls over, so a missing score must be kept missing
    return F.when(score.isNotNull(), F.greatest(F.least(score / 5, F.lit(1.0)), F.lit(-1.0)))


def confidence(mode: Column, dependants: Column, confirmations: Column, typed: Column, legacy: Column, inherited: Column) -> Column:
    """Weighted norms; typed signals where there are any, else the legacy count; less a half if inherited."""
    ext = F.coalesce(signed(typed), saturating(legacy))
    score = by_mode(mode, 0) * saturating(dependants) + by_mode(mode, 1) * saturating(confirmations) + by_mode(mode, 2) * ext
    return score - F.when(F.coalesce(inherited, F.lit(False)), 0.5).otherwise(0.0)


def retest(old: Column, new: Column, inside: Column) -> Column:
    drop, rise = (new - old < -0.2) & (new < 0.3), new - old > 0.2
    return F.when(drop & ~inside, "promote").when(inside & rise & ~drop, "recover").otherwise("none")


def signal_weight(kind: Column, success: Column) -> Column:
    w = F.lit(0.0)
    for name, x in SIGNALS.items():
        w = F.when(kind == name, F.lit(x)).otherwise(w)
    return w * F.when(success, 1.0).otherwise(-0.5)


def coldness(age_days: Column, uses: Column, idle_days: Column) -> Column:
    """Days since the last use, damped by how often; of what was never used, its age. Null without a date."""
    n = F.coalesce(uses, F.lit(0))
    since = F.greatest(F.coalesce(idle_days, age_days), F.lit(0.0))
    return F.when(age_days.isNull(), F.lit(None)).when(n == 0, F.greatest(age_days, F.lit(0.0))).otherwise(since / (1 + F.log10(1.0 + n)))


def rank_score(score: Column, verified: Column, success: Column, fail: Column) -> Column:
    s, f = zero(success), zero(fail)
    worked = F.when(s + f > 0, 0.20 * (s - f) / (s + f) * F.least((s + f) / 5, F.lit(1.0))).otherwise(0.0)
    return score + F.when(F.coalesce(verified, F.lit(False)), 0.25).otherwise(0.0) + worked


def cadence(interval: Column, edits: Column) -> Column:
    """The next re-test interval in seconds: idle doubles it, a busy time halves it."""
    base = F.greatest(F.least(interval, F.lit(86400)), F.lit(300))
    return F.when(edits == 0, F.least(base * 2, F.lit(86400))).when(edits >= 20, F.greatest(F.floor(base / 2), F.lit(300))).otherwise(base).cast("long")

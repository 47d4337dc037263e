"""Writes of facts that duel with all visible facts of their axis, one fold for batch and stream.

An axis is a subject with a predicate of one value. Its state is every value that was ever written: when it was
first written, how many dependants it had by the last write, its status, and until when it held. A write that
meets a visible value other than its own duels with the most entrenched visible value (ties: the older, then the
smaller); contested values stay visible, so they keep a conflict alive. As in the rule that this follows, a value
that is written again is among the visible ones, and can be the one that is retired.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemospark.functions import belief

VISIBLE = ("active", "contested")
EPOCH = dt.datetime(1970, 1, 1)
#: Buckets that share a stream's axes, or keys: a call of Python for each of them and batch.
BUCKETS = 2048


class Axis:
    """The values of one axis: object -> [created, dependants, status, until], times in seconds."""

    def __init__(self, temporal: bool, w_new: float, values: dict[str, list] | None = None) -> None:
        self.lost, self.w_new, self.values = "superseded" if temporal else "stale", w_new, values or {}

    def entrenchment(self, created: float, dependants: int, at: float) -> float:
        months = min(max(int((at - created) // 86400), 0) / 30, 24)
        return (log2(1 + max(dependants, 0)) + log2(1 + months)) / 50

    def write(self, obj: str, dependants: int, at: float) -> tuple[str, str | None]:
        """(verdict, the value that was retired or None)."""
        visible = [(-self.entrenchment(c, d, at), c, o) for o, (c, d, s, _) in self.values.items() if s in VISIBLE]
        verdict, status, loser = "recorded", "active", None
        if any(o != obj for _, _, o in visible):
            old, _, opponent = min(visible)
            if self.w_new > belief.FLIP * -old:
                verdict, loser = "won", opponent
            elif self.w_new > belief.CONTEST * -old:
                verdict = status = "contested"
            else:
                verdict, status = "quarantined", "quarantine_candidate"
        created = self.values[obj][0] if obj in self.values else at
        self.values[obj] = [created, dependants, status, None]
        if loser is not None:
            self.values[loser][2:] = [self.lost, at]
        return verdict, loser


def weight(mode: str) -> float:
    """Of a fresh write: live, one diverse confirmation, no signals."""
    return belief.MODES[mode][1] * log2(2)


def _seconds(c: pd.Series) -> list[float]:
    return ((pd.to_datetime(c) - EPOCH) / pd.Timedelta(seconds=1)).tolist()


_OUT = "event_id long, subject string, predicate string, object string, verdict string, retired string, status string, created_at timestamp, valid_until timestamp"


def folded(assertions: DataFrame, mode: str) -> DataFrame:
    """Rows of two kinds: writes (event_id, ..., verdict, retired), and at the end of an axis its values (status, created_at, valid_until; no event_id).

    ``assertions``: event_id, subject, predicate, object, dependants, created_at, cardinality, none of it multi.
    Axes stream sorted through a task, which holds the values of one axis, never its history.
    """
    w_new = weight(mode)
    cols = ["subject", "predicate", "created_at", "event_id", "object", "dependants", "cardinality"]
    rows = assertions.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("dependants", F.coalesce("dependants", F.lit(0)).cast("long"))
    rows = rows.select(*cols).repartition("subject", "predicate").sortWithinPartitions("subject", "predicate", "created_at", "event_id")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, axis = None, None

        def end() -> list[tuple]:
            return [] if axis is None else [(None, *key, o, None, None, s, at(c), at(u)) for o, (c, _, s, u) in axis.values.items()]

        def at(x: float | None):
            return None if x is None else EPOCH + dt.timedelta(seconds=x)

        def table(out: list[tuple]) -> pd.DataFrame:
            t = pd.DataFrame(out, columns=["event_id", "subject", "predicate", "object", "verdict", "retired", "status", "created_at", "valid_until"])
            return t.astype({"event_id": "Int64", "created_at": "datetime64[us]", "valid_until": "datetime64[us]"})

        for pdf in pdfs:
            out = []
            for s, p, e, o, d, card, t in zip(*(pdf[c] for c in ("subject", "predicate", "event_id", "object", "dependants", "cardinality")), _seconds(pdf["created_at"]), strict=True):
                if (s, p) != key:
                    out += end()
                    key, axis = (s, p), Axis(card == "temporal-single", w_new)
                out.append((e, s, p, o, *axis.write(o, d, t), None, None, None))
            yield table(out)
        yield table(end())

    return rows.mapInPandas(run, _OUT.replace("timestamp", "timestamp_ntz"))


def streamed(assertions: DataFrame, mode: str = "chat-only", ttl: str = "365 days") -> DataFrame:
    """(event_id, subject, predicate, object, verdict, retired) of a stream of writes on one-value axes, which carry their cardinality.

    State is the values of the axes, BUCKETS of which share the axes by hash: a call of Python and a row of state a bucket, not
    an axis. Visible values stay; one that was hidden for ``ttl`` before its axis's latest write is forgotten, so that it
    counts as new when it is written again. Writes of a batch are taken in event time; the order between batches is theirs.
    """
    w_new, span = weight(mode), pd.Timedelta(ttl).total_seconds()

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs)).sort_values(["subject", "predicate", "created_at", "event_id"])
        axes: dict[tuple, dict[str, list]] = {}
        for s, p, o, *v in zip(*state.get, strict=True) if state.exists else ():
            axes.setdefault((s, p), {})[o] = v
        now, axis, out, last = None, None, [], {}
        for s, p, o, d, card, t in zip(*(pdf[c] for c in ("subject", "predicate", "object", "dependants", "cardinality")), _seconds(pdf["created_at"]), strict=True):
            # Null names are one axis, as they are one group.
            of = tuple(None if pd.isna(x) else x for x in (s, p))
            if axis is None or of != now:
                now, axis = of, Axis(card == "temporal-single", w_new, axes.get(of))
                axes[of] = axis.values
            out.append(axis.write(o, int(d), t))
            last[of] = t
        for of, t in last.items():
            axes[of] = {o: v for o, v in axes[of].items() if v[2] in VISIBLE or (v[3] if v[3] is not None else v[0]) >= t - span}
        kept = [(*of, o, *v) for of, values in axes.items() for o, v in values.items()]
        state.update(tuple(map(list, zip(*kept, strict=True))) if kept else ([],) * 7)
        yield pdf[["event_id", "subject", "predicate", "object"]].assign(verdict=[v for v, _ in out], retired=[x for _, x in out])

    rows = assertions.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("dependants", F.coalesce("dependants", F.lit(0)).cast("long"))
    rows = rows.select("event_id", "subject", "predicate", "object", "dependants", "created_at", "cardinality")
    kinds = "subjects array<string>, predicates array<string>, objects array<string>, created array<double>, dependants array<long>, status array<string>, until array<double>"
    out = "event_id long, subject string, predicate string, object string, verdict string, retired string"
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("subject", "predicate"), F.lit(BUCKETS)).cast("int"))
    return rows.groupBy("bucket").applyInPandasWithState(fold, out, kinds, "append", GroupStateTimeout.NoTimeout)

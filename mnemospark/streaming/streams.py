"""Streams over the audit and event log; every input column ``ts`` is event time.

State is bounded by the watermark wherever an operator keeps any.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemospark.operators import duels as fold
from mnemospark.operators.duels import BUCKETS


def pulses(audit: DataFrame) -> DataFrame:
    """Adds what kind of pulse an operation is: write, read or process."""
    kind = F.when(F.col("op").isin("add", "ingest", "update", "delete", "restore"), "write").when(F.col("op").isin("search", "browse", "recall"), "read").otherwise("process")
    return audit.withColumn("kind", kind)


def windowed_counts(audit: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Operations by tumbling or sliding window and op; late rows count until the watermark passes."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = audit.withWatermark("ts", late).groupBy(w.alias("w"), "op").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "op", "n")


def sessions(events: DataFrame, gap: str = "30 minutes 1 microsecond", late: str = "10 minutes") -> DataFrame:
    """Activity sessions by user: a longer gap closes one."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def quota(writes: DataFrame, most: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Which writes (agent, event_id, ts) a sliding quota lets through; rejected ones do not count.

    State: the accepted times of the last ``seconds`` of each agent, ``most`` at most; it goes once the watermark has
    passed them all. Rows of a batch are taken in event time.
    """

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        kept = list(state.get[0]) if state.exists else []
        ok = []
        for t in _seconds(pdf["ts"]):
            kept = [x for x in kept if x > t - seconds]
            ok.append(len(kept) < most)
            if ok[-1]:
                kept.append(t)
        state.update((kept,))
        _forget(state, max(kept, default=0.0) + seconds)
        yield pd.DataFrame({"agent": key[0], "event_id": pdf["event_id"].to_numpy(), "accepted": ok})

    rows = writes.withWatermark("ts", late).groupBy("agent")
    return rows.applyInPandasWithState(fold, "agent string, event_id long, accepted boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def doubt_counters(observations: DataFrame, least: int = 5, forget: str = "3650 days", late: str = "10 minutes") -> DataFrame:
    """(key, seq, counter, inside) for drift observations (key, seq, drifted, at): a drift counts up, its absence resets.

    A key that is not observed for ``forget`` loses its counter once the watermark says so. Keys are dealt to buckets by
    hash, each a row of state with the counters of its keys and when these end, so that Python is called once a bucket, not a key.
    """
    span = pd.Timedelta(forget).total_seconds()

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = {k: (n, end) for k, n, end in zip(*state.get, strict=True)} if state.exists else {}
        if state.hasTimedOut:
            held = {k: v for k, v in held.items() if v[1] >= mark}
        else:
            pdf = pd.concat(list(pdfs)).sort_values("seq")
            names, out, seen = [None if pd.isna(k) else k for k in pdf["key"]], [], {}
            for k, d, t in zip(names, pdf["drifted"], _seconds(pdf["at"]), strict=True):
                n, latest = seen[k] if k in seen else (held[k][0] if k in held else 0, t)
                n = n + 1 if d else 0
                seen[k] = n, max(latest, t)
                out.append(n)
            held = {k: v for k, v in held.items() if v[1] >= mark} | {k: (n, max(int((t + span) * 1000), mark + 1)) for k, (n, t) in seen.items()}
        if held:
            state.update((list(held), [n for n, _ in held.values()], [end for _, end in held.values()]))
            state.setTimeoutTimestamp(max(min(end for _, end in held.values()), mark + 1))
        else:
            state.remove()
        if not state.hasTimedOut:
            yield pd.DataFrame({"key": names, "seq": pdf["seq"].to_numpy(), "counter": out, "inside": [x >= least for x in out]})

    rows = observations.withWatermark("at", late).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")).groupBy("bucket")
    kinds = "keys array<string>, counters array<int>, ends array<long>"
    return rows.applyInPandasWithState(fold, "key string, seq long, counter int, inside boolean", kinds, "append", GroupStateTimeout.EventTimeTimeout)


def _seconds(c: pd.Series) -> list[float]:
    return [x.timestamp() for x in pd.to_datetime(c)]


def _forget(state: GroupState, at: float) -> None:
    """Sets the state's end, which has to lie after the watermark."""
    state.setTimeoutTimestamp(max(int(at * 1000), state.getCurrentWatermarkMs() + 1))


def duels(assertions: DataFrame, mode: str = "chat-only", ttl: str = "365 days") -> DataFrame:
    """(event_id, subject, predicate, object, verdict, retired) for writes on one-value axes, which carry their cardinality."""
    return fold.streamed(assertions, mode, ttl)

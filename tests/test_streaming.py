"""Streams fed with files give what the batch operators give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import analytics
from mnemospark.plans.views import Store
from mnemospark.streaming import streams

from .conftest import SF


def run(spark, tmp_path, batch, make, mode="append", files=3):
    for k, part in enumerate(batch.randomSplit([1.0] * files, 5) if files > 1 else [batch]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(src).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql("select * from out")


@pytest.fixture
def audit(spark):
    return Store(spark, SF).audit.withColumn("ts", F.col("ts").cast("timestamp"))


def test_windows(spark, tmp_path, audit):
    got = run(spark, tmp_path, audit, lambda s: streams.windowed_counts(s, late="400 days"), mode="complete")
    want = streams.windowed_counts(audit)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dedup(spark, tmp_path, audit):
    got = run(spark, tmp_path, audit.unionByName(audit.filter("event_id % 2 = 0")), lambda s: streams.deduplicated(s, ["event_id"], "400 days"))
    assert got.count() == audit.count()


def test_doubt(spark, tmp_path):
    rows = Store(spark, SF).events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") != "view").alias("drifted"), F.col("ts").cast("timestamp").alias("at"))
    got = run(spark, tmp_path, rows, streams.doubt_counters, files=1)
    want = analytics.doubt_runs(rows.withColumn("at", F.lit(0)).drop("ts")).select("seq", "counter")
    assert sorted((r.seq, r.counter) for r in got.collect()) == sorted((r.seq, r.counter) for r in want.collect())


def test_quota(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", k, t0 + dt.timedelta(seconds=s)) for k, s in enumerate((0, 1, 2, 3, 61, 62, 63))], "agent string, event_id long, ts timestamp")
    got = run(spark, tmp_path, rows, lambda s: streams.quota(s, 2), files=1)
    assert {r.event_id: r.accepted for r in got.collect()} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False}


def test_duels(spark, tmp_path):
    from mnemospark.operators import facts

    s = Store(spark, SF)
    rows = facts.registered(s.assertions, s.predicates).filter("cardinality <> 'multi'").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = run(spark, tmp_path, rows, streams.duels, files=1)
    want = facts.duel_on_write(s.assertions, s.predicates).join(rows.select("event_id"), "event_id")
    key = lambda r: (r.event_id, r.verdict, r.retired or "")
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_sessions_and_pulses(spark, audit):
    ev = Store(spark, SF).events.withColumn("ts", F.col("ts").cast("timestamp"))
    assert streams.sessions(ev).agg(F.sum("n")).first()[0] == ev.count()
    assert {r.kind for r in streams.pulses(audit).select("kind").distinct().collect()} == {"write", "process"}


def test_runs_restart_and_repeat(spark):
    """Slices that land one by one give what the whole gives; a batch that is written again counts once."""
    from mnemospark.streaming import runs

    audit = Store(spark, SF).audit.withColumn("ts", F.col("ts").cast("timestamp"))
    run = runs.run_slices(spark, "t", audit, streams.windowed_counts, "ts", "update", 3)
    want = sorted(map(tuple, streams.windowed_counts(audit).select("start", "end", "op", "n").collect()))
    assert sorted(map(tuple, run.latest("start", "end", "op").select("start", "end", "op", "n").collect())) == want
    again = spark.read.parquet(run.out + "/batch=1")
    again = spark.createDataFrame(again.collect(), again.schema)
    again.write.mode("overwrite").parquet(run.out + "/batch=1")  # as a repeated batch would
    assert sorted(map(tuple, run.latest("start", "end", "op").select("start", "end", "op", "n").collect())) == want
    run.start(streams.windowed_counts(run.source()), "update")  # nothing new: nothing changes
    assert sorted(map(tuple, run.latest("start", "end", "op").select("start", "end", "op", "n").collect())) == want


def test_quota_state_shrinks(spark):
    """Agents that fall silent leave the state once the watermark has passed their writes."""
    from mnemospark.streaming import runs

    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"a{k}", k, t0 + dt.timedelta(seconds=k)) for k in range(50)] + [("last", 100 + k, t0 + dt.timedelta(days=1 + k)) for k in range(3)]
    df = spark.createDataFrame(rows, "agent string, event_id long, ts timestamp")
    run = runs.run_slices(spark, "q", df, lambda s: streams.quota(s, 2), "ts", slices=4)
    assert run.rows().filter("accepted").count() == len(rows)
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in run.progress if p["stateOperators"]]
    assert max(totals) >= 50 and totals[-1] <= 2


def test_ticks_go_on(spark):
    """Each start is a tick: what a former one tested is done, and the interval follows the edits."""
    from mnemospark.streaming import runs

    t0 = dt.datetime(2024, 1, 1)
    edits = spark.createDataFrame([(k, t0 + dt.timedelta(minutes=k if k < 30 else 60 + k)) for k in range(35)], "event_id long, ts timestamp")
    due = spark.createDataFrame([(k,) for k in range(7)], "id long")
    ticks, tested = runs.retest_ticks(spark, edits, due, lambda rows: rows, cap=3, slices=3)
    assert [tuple(r) for r in ticks.orderBy("tick").collect()] == [(0, 30, 3, 1800), (1, 0, 3, 3600), (2, 5, 1, 3600)]
    assert sorted(r.id for r in tested.collect()) == list(range(7))

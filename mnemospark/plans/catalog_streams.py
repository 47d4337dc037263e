"""Streams as queries: a table lands slice by slice, the stream restarts from its checkpoint after each, and what it gives is compared with SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators import analytics, auditlog, facts, memories, models, paging, revision
from mnemospark.plans import catalog_life  # noqa: F401  whose SQL one of these builds on
from mnemospark.plans.catalog import AXES, SQL, VECTORS, cited, query, scores, secs
from mnemospark.plans.views import Store
from mnemospark.sources.shared import Tables
from mnemospark.streaming import runs

#: Slices that a table lands in, what a tick re-tests at most, and the writes that a quota lets through in so many seconds.
SLICES, CAP, QUOTA, SPAN = 3, 50, 10, 21_600


def _audit(s: Store) -> DataFrame:
    return s.audit.withColumn("ts", F.col("ts").cast("timestamp"))


def _events(s: Store) -> DataFrame:
    return s.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("select event_id, op, case when op in ('add', 'ingest', 'update') then 'write' else 'process' end as kind from audit")
def st1_pulse_stream(s: Store) -> DataFrame:
    return runs.pulse_stream(s.spark, _audit(s), SLICES).select("event_id", "op", "kind")


@query("select ($S(ts) // 3600) * 3600 as start_s, op, count(*) as n from audit group by 1, 2")
def st2_window_stream(s: Store) -> DataFrame:
    return runs.window_stream(s.spark, _audit(s), SLICES).select(secs("start").alias("start_s"), "op", "n")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
k as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g),
t as (select user_id, min(ts) as first, count(*) as n from k group by user_id, k having max(ts) + interval 30 minute <= (select max(ts) from events) - interval 10 minute)
select user_id, $S(first) as start_s, n from t""")
def st3_session_stream(s: Store) -> DataFrame:
    return runs.session_stream(s.spark, _events(s), SLICES).select("user_id", secs("start").alias("start_s"), "n")


@query(f"{AXES} select event_id, subject, predicate, object, verdict, retired from duel where k > 0")
def st4_duel_stream(s: Store) -> DataFrame:
    writes = facts.registered(s.assertions, s.predicates).filter("cardinality <> 'multi'").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return runs.duel_stream(s.spark, writes, slices=SLICES).drop("batch")


@query("""with d as (select cast(user_id as varchar) as key, ts, event_id, event_type <> 'view' as drifted from events),
g as (select *, count(*) filter (not drifted) over (partition by key order by ts, event_id rows unbounded preceding) as k from d),
c as (select event_id, case when drifted then count(*) filter (drifted) over (partition by key, k order by ts, event_id rows unbounded preceding) else 0 end as counter from g)
select event_id, counter, counter >= 5 as inside from c""")
def st5_doubt_stream(s: Store) -> DataFrame:
    at = F.unix_micros("ts")
    seen = _events(s).select(F.col("user_id").cast("string").alias("key"), (at * 1000 + F.col("event_id") % 1000).alias("seq"), (F.col("event_type") != "view").alias("drifted"), F.col("ts").alias("at"), "event_id")
    got = runs.doubt_stream(s.spark, seen.drop("event_id"), SLICES).drop("batch")
    return got.join(seen.select("key", "seq", "event_id"), ["key", "seq"]).select("event_id", F.col("counter").cast("long").alias("counter"), "inside")


@query("select event_id, event_type from events")
def st6_distinct_stream(s: Store) -> DataFrame:
    twice = _events(s).unionByName(_events(s).filter("event_id % 2 = 0"))
    return runs.distinct_stream(s.spark, twice, ["event_id"], "1 hour", SLICES).select("event_id", "event_type")


TICKS = f"""t as (select $S(ts) as s, epoch_us(ts) as us from events), b as (select min(us) as low, max(us) as high from t),
e as (select k, (select count(*) from t, b where (us - low) * {SLICES} // (high - low + 1) = k) as edits from range({SLICES}) r(k)),
n as (select count(*) as n from facts)"""
STEP = "case when edits = 0 then least(2 * b, 86400) when edits >= 20 then greatest(b // 2, 300) else b end"


@query(f"""with recursive {TICKS},
c as (select 0::bigint as k, {STEP}::bigint as cadence from (select edits, 3600 as b from e where k = 0) union all select e.k, ({STEP})::bigint from (select c.k + 1 as k, cadence as b from c) c join e on e.k = c.k)
select e.k::bigint as tick, edits, greatest(least({CAP}, n - {CAP} * e.k), 0)::bigint as processed, cadence from e join c on c.k = e.k cross join n""")
def st7_retest_ticks(s: Store) -> DataFrame:
    return _ticked(s)[0]


@query(f"""with r as ({SQL["br17_retest"]}), o as (select seq, row_number() over (order by dependants desc, seq) - 1 as k from facts)
select (k // {CAP})::bigint as tick, r.id, r.confidence, r.transition from o join r on r.id = o.seq where k < {CAP * SLICES}""")
def st7_retested(s: Store) -> DataFrame:
    return _ticked(s)[1].select(F.col("tick").cast("long").alias("tick"), "id", "confidence", "transition")


def _ticked(s: Store) -> tuple[DataFrame, DataFrame]:
    k = F.col("seq")
    due = s.facts.select(k.alias("id"), "dependants", (k % 9).alias("confirmations"), (k % 4).alias("legacy"), F.when(k % 10 != 0, k * 7 % 100 / 100.0).alias("cached"), (k % 8).alias("counter"), (k % 3 == 0).alias("inherited"))
    typed = analytics.typed_scores(cited(s), scores(s))
    first = F.struct(-F.col("dependants"), F.col("id"))
    return runs.retest_ticks(s.spark, _events(s), due, lambda rows: revision.retest(rows, typed), CAP, slices=SLICES, order=first)


@query(f"""with recursive w as (select actor as agent, event_id, epoch(ts) as s, row_number() over (partition by actor order by ts, event_id) as k from audit where op in ('add', 'ingest', 'update')),
q as (select agent, 0::bigint as k, 0::bigint as event_id, false as accepted, []::double[] as kept from w where k = 1
  union all
  select agent, k, event_id, len(fresh) < {QUOTA}, case when len(fresh) < {QUOTA} then list_append(fresh, s) else fresh end
  from (select w.*, list_filter(q.kept, lambda x: x > w.s - {SPAN}) as fresh from q join w on w.agent = q.agent and w.k = q.k + 1))
select agent, event_id, accepted from q where k > 0""")
def a27_quota_stream(s: Store) -> DataFrame:
    writes = _audit(s).filter(F.col("op").isin("add", "ingest", "update")).select(F.col("actor").alias("agent"), "event_id", "ts")
    return runs.quota_stream(s.spark, writes, QUOTA, SPAN, SLICES).select("agent", "event_id", "accepted")


# --- tables that are written and read back


@query("with h as (select id, created_at, count(*) over () as n from memories where quarantined) select id, ((row_number() over (order by created_at desc nulls last, id) - 1) // greatest(cast(ceil(n / 8) as bigint), 1))::bigint as page from h")
def wd11_all_pages(s: Store) -> DataFrame:
    """All held-back memories in eight pages, one after another by their cursors, each with its number."""
    held = s.memories.filter(memories.flag("quarantined"))
    pages, out, after, size = paging.Pages(s.spark, held), None, None, max(1, -(-held.count() // 8))
    for k in range(8):
        rows, after = pages.page(size, after)
        rows = rows.select("id", F.lit(k).cast("long").alias("page"))
        out = rows if out is None else out.unionByName(rows)
        if after is None:
            break
    return out


@query(f"""with {VECTORS} select m.id, m.library, x.pos, round(x.v, 6) as x from memories m join (select id, unnest(range(64)) as pos, unnest(vec) as v from vv) x using (id) where x.v > 0""")
def sc21_resumed_reindex(s: Store) -> DataFrame:
    """A re-index that is stopped half-way, goes on, and takes the old table's place."""
    where = Tables(s.spark, "reindex").path
    s.memories.select("id", "library", "content").withColumn("vec", F.array(F.lit(1.0))).withColumn("embed_model", F.lit("old")).write.parquet(f"{where}/current")
    job = models.Reindex(s.spark, where, models.hashing(64), "hashing-64", parts=4)
    job.run(2)
    job.run()
    job.swap()
    return job.rows().select("id", "library", F.posexplode("vec").alias("pos", "x")).filter("x > 0").select("id", "library", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("""with l as (select library as log, event_id, row_number() over (partition by library order by event_id) as k, count(*) over (partition by library) as total from audit)
select log, total, case when b is null then total - 1 else b - 1 end as chained, b as broken_at from (select log, max(total) as total, min(k) filter (event_id % 1999 = 0 and k > 1) as b from l group by log)""")
def a25_log_verify(s: Store) -> DataFrame:
    """The audit events as chained logs, a file a library, in which some links are then broken; read in blocks and verified."""
    entry = F.to_json(F.struct("event_id", "op", "actor", "target"))
    path = auditlog.written(s.spark, s.audit.select(F.col("library").alias("log"), F.col("event_id").alias("line"), entry.alias("raw")), "audit-made")
    cut = F.regexp_extract("value", r'"event_id":(\d+)', 1).cast("long") % 1999 == 0
    bad = s.spark.read.text(path).select("log", F.when(cut, F.regexp_replace("value", '"prev_hash": "', '"prev_hash": "x')).otherwise(F.col("value")).alias("value"))
    spoiled = Tables(s.spark, "audit-spoiled").path
    bad.withColumn("k", F.regexp_extract("value", r'"event_id":(\d+)', 1).cast("long")).repartition("log").sortWithinPartitions("log", "k").select("log", "value").write.partitionBy("log").text(spoiled)
    found = auditlog.verify(s.spark, spoiled)
    return found.select(F.regexp_extract("log", "log=([^/]+)/", 1).alias("log"), "total", "chained", "broken_at")

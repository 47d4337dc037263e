"""The queries by name, each an operator applied to whole tables, with DuckDB SQL to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import belief, ids, text, vector
from mnemospark.operators import analytics, facts, graph, ingest, memories, models, retrieval, revision, temporal, vectors
from mnemospark.plans.views import NOW, Store, with_views
from mnemospark.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Store under its name."""

    def add(f: Callable[[Store], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Store(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def now():
    return F.timestamp_seconds(F.lit(NOW))


def secs(c):
    return F.unix_seconds((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


HIDDEN = "('stale', 'propagation_shadowed', 'quarantine_candidate', 'superseded')"
VISIBLE = "type <> 'procedure' and not quarantined and not archived"

# --- facts


@query("""
select subject, predicate, object, coalesce(p.cardinality, 'multi') as cardinality,
       case when coalesce(p.cardinality, 'multi') = 'multi' or row_number() over (partition by f.subject, f.predicate order by f.created_at desc, f.seq) = 1 then 'active'
            when p.cardinality = 'temporal-single' then 'superseded' else 'stale' end as status, $S(f.created_at) as created_s
from facts f left join predicates p using (predicate)""")
def fg14_redo_duels(s: Store) -> DataFrame:
    return facts.redo_duels(s.facts, s.predicates).select("subject", "predicate", "object", "cardinality", "status", secs("created_at").alias("created_s"))


@query("""
select subject, predicate, object, $S(created_at) as created_s from chain
where valid and (status is null or status in ('active', 'superseded', 'stale')) and created_at <= $TS(1705276800) and (valid_until is null or valid_until > $TS(1705276800))""")
def fg9_as_of(s: Store) -> DataFrame:
    return facts.as_of(s.chain, F.timestamp_seconds(F.lit(1_705_276_800))).select("subject", "predicate", "object", secs("created_at").alias("created_s"))


@query("""
with c as (select subject, predicate, object, event_id as fact_id, valid, status, valid_until, case when event_id % 97 = 0 then null else created_at end as created_at from chain)
select a.event_id, c.fact_id, c.predicate, c.object from (select event_id, concat('user_', cast(user_id as string)) as subject, ts from events) a
join c on c.subject = a.subject and (c.created_at is null or c.created_at <= a.ts) and (c.valid_until is null or a.ts < c.valid_until) where c.valid and (c.status is null or c.status in ('active', 'superseded', 'stale'))""".replace("as string", "as varchar"))
def fl13_as_of_many(s: Store) -> DataFrame:
    known = s.chain.withColumn("created_at", F.when(F.col("event_id") % 97 != 0, F.col("created_at"))).withColumnRenamed("event_id", "fact_id")
    asked = s.events.select("event_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("subject"), F.col("ts").alias("at"))
    return temporal.as_of_join(asked, known).select("event_id", "fact_id", "predicate", "object")


@query(f"select event_id, subject, predicate, object from chain where valid and (status is null or status not in {HIDDEN})")
def fl9_visible_facts(s: Store) -> DataFrame:
    return s.chain.filter(facts.visible(F.col("status"), F.col("valid"))).select("event_id", "subject", "predicate", "object")


@query(f"select event_id, subject, predicate, object from chain where valid and (status is null or status not in {HIDDEN}) and (predicate = 'purchase' or list_contains(regexp_extract_all(lower(subject), '([a-z0-9]+)', 1), 'purchase') or object = 'purchase')")
def fg7_query_facts(s: Store) -> DataFrame:
    return facts.matching(s.chain, "Purchase").select("event_id", "subject", "predicate", "object")


@query(f"select event_id, object from chain where valid and (status is null or status not in {HIDDEN}) and subject = 'user_3' and predicate = 'view'")
def fl11_axis_lookup(s: Store) -> DataFrame:
    return s.chain.filter(facts.visible(F.col("status"), F.col("valid")) & (F.col("subject") == "user_3") & (F.col("predicate") == "view")).select("event_id", "object")


@query("select event_id, subject, predicate, object, status from chain where valid and status in ('contested', 'quarantine_candidate')")
def fl12_contested(s: Store) -> DataFrame:
    return s.chain.filter(F.col("valid") & F.col("status").isin("contested", "quarantine_candidate")).select("event_id", "subject", "predicate", "object", "status")


@query("select event_id, subject, row_number() over (partition by subject order by created_at nulls last, event_id) as place from chain where status = 'superseded' and predicate = 'purchase'")
def fg8_history(s: Store) -> DataFrame:
    return facts.history(s.chain, "purchase").select("event_id", "subject", F.col("place").cast("long").alias("place"))


@query("""
select f.subject, f.predicate, p.cardinality, count(distinct f.object) as n_objects from facts f join predicates p using (predicate)
where p.cardinality <> 'multi' group by 1, 2, 3 having count(distinct f.object) > 1""")
def fg4_conflicts(s: Store) -> DataFrame:
    return facts.conflicts(s.facts, s.predicates).select("subject", "predicate", "cardinality", "n_objects")


AXES = """
with recursive axis as (
  select a.event_id, a.subject, a.predicate, a.object, a.dependants, epoch(a.created_at) as moment, case p.cardinality when 'temporal-single' then 'superseded' else 'stale' end as lost,
         row_number() over (partition by a.subject, a.predicate order by a.created_at, a.event_id) as k
  from assertions a join predicates p using (predicate)),
duel as (
  select subject, predicate, 0::bigint as k, 0::bigint as event_id, '' as object, '' as verdict, null::varchar as retired,
         []::struct(o varchar, c double, d integer, s varchar, u double)[] as st from axis where k = 1
  union all
  select subject, predicate, k, event_id, object, verdict, case when verdict = 'won' then best.o end,
         list_transform(list_append(list_filter(st, lambda x: x.o <> object),
             {'o': object, 'c': coalesce(mine[1].c, moment), 'd': dependants,
              's': case verdict when 'contested' then 'contested' when 'quarantined' then 'quarantine_candidate' else 'active' end, 'u': null::double}),
           lambda x: case when verdict = 'won' and x.o = best.o then {'o': x.o, 'c': x.c, 'd': x.d, 's': lost, 'u': moment} else x end)
  from (select *, case when not clash then 'recorded' when 0.1 > 1.5 * -best.e then 'won' when 0.1 > 0.5 * -best.e then 'contested' else 'quarantined' end as verdict
        from (select *, list_sort(list_transform(seen, lambda x: {'e': -(log2(1 + greatest(x.d, 0)) + log2(1 + least(greatest(floor((moment - x.c) / 86400), 0) / 30, 24))) / 50, 'c': x.c, 'o': x.o}))[1] as best,
                     len(list_filter(seen, lambda x: x.o <> object)) > 0 as clash
              from (select a.*, f.st, list_filter(f.st, lambda x: x.o = a.object) as mine, list_filter(f.st, lambda x: x.s in ('active', 'contested')) as seen from duel f join axis a on a.subject = f.subject and a.predicate = f.predicate and a.k = f.k + 1))))"""


@query(f"""{AXES}
select event_id, subject, predicate, object, verdict, retired from duel where k > 0
union all select event_id, subject, predicate, object, 'recorded', null from assertions where predicate not in (select predicate from predicates)""")
def fg5_duel_on_write(s: Store) -> DataFrame:
    return facts.duel_on_write(s.assertions, s.predicates).select("event_id", "subject", "predicate", "object", "verdict", "retired")


@query(f"""{AXES},
ends as (select subject, predicate, unnest(st) as x from (select *, row_number() over (partition by subject, predicate order by k desc) as place from duel) where place = 1)
select subject, predicate, x.o as object, x.s as status, floor(x.c)::bigint as created_s, floor(x.u)::bigint as until_s from ends""")
def fg5_duelled_facts(s: Store) -> DataFrame:
    return facts.duelled_facts(s.assertions, s.predicates).select("subject", "predicate", "object", "status", secs("created_at").alias("created_s"), secs("valid_until").alias("until_s"))


@query("""
with recursive ends as (select subject as a, object as b from edges union select object, subject from edges),
w as (select 'AFRICA' as entity, 0 as depth union select b.b, w.depth + 1 from w join ends b on b.a = w.entity where w.depth < 2)
select entity, min(depth) as depth from w group by entity""")
def fg10_walk(s: Store) -> DataFrame:
    return facts.walk(s.spark, s.edges, "africa", 2).select("entity", "depth")


@query("""
with recursive arcs as (select subject, predicate, object from edges union all select object, concat('of_', predicate), subject from edges),
w as (select 'africa' as a, 0 as depth union select lower(trim(e.object)), w.depth + 1 from w join arcs e on lower(trim(e.subject)) = w.a where w.depth < 2),
d as (select a, min(depth) as depth from w group by a)
select d.depth + 1 as depth, e.subject, e.predicate, e.object from arcs e join d on lower(trim(e.subject)) = d.a""")
def fg10_walk_edges(s: Store) -> DataFrame:
    back = s.edges.select(F.col("object").alias("subject"), F.concat(F.lit("of_"), "predicate").alias("predicate"), F.col("subject").alias("object"))
    return graph.walk_edges(s.spark, s.edges.unionByName(back), " africa", 3)


#: Facts whose objects are the first two words of each passage, beside the others.
OPENINGS = "f as (select subject, object, predicate, true as valid from facts union all select concat('item_', item_id), concat_ws(' ', regexp_extract(text, '([\\p{L}]+)\\s+([\\p{L}]+)', 1), regexp_extract(text, '([\\p{L}]+)\\s+([\\p{L}]+)', 2)), 'opens', item_id % 7 <> 0 from benchmark)"
BRAIN = f"""with {OPENINGS}, e as (select distinct unnest([subject, object]) as name from f where valid),
m as (select *, row_number() over (partition by library order by created_at desc nulls last, id) as k from memories where {VISIBLE} and library is not null and not starts_with(library, '_'))"""


def _brain(s: Store) -> tuple[DataFrame, DataFrame]:
    pair = r"([\p{L}]+)\s+([\p{L}]+)"
    opens = s.benchmark.select(
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("subject"), F.lit("opens").alias("predicate"),
        F.concat_ws(" ", F.regexp_extract("text", pair, 1), F.regexp_extract("text", pair, 2)).alias("object"), (F.col("item_id") % 7 != 0).alias("valid"),
    )
    known = s.facts.select("subject", "predicate", "object", F.lit(True).alias("valid")).unionByName(opens)
    return graph.brain(s.spark, known, s.memories, memories.visible(), None)


@query(f"{BRAIN} select name as id, name as label, 'entity' as kind from e union all select distinct concat('lib:', library), library, 'library' from m union all select concat('mem:', id), substr(content, 1, 80), 'memory' from m")
def fg15_brain_nodes(s: Store) -> DataFrame:
    return _brain(s)[0]


@query(f"""{BRAIN} select subject as source, object as target, predicate as label, 'fact' as kind from f where valid
union all select concat('lib:', library), concat('mem:', id), 'holds', 'holds' from m
union all select concat('mem:', m.id), e.name, 'mentions', 'mention' from m join e on octet_length(encode(e.name)) >= 4 and contains(lower(m.content), lower(e.name))""")
def fg15_brain_edges(s: Store) -> DataFrame:
    return _brain(s)[1]


@query("select subject, predicate, object, dependants, seq from facts order by dependants desc, seq limit 20")
def fg11_top_dependants(s: Store) -> DataFrame:
    return facts.top_dependants(s.facts, 20).select("subject", "predicate", "object", "dependants", "seq")


@query("select subject, predicate, count(*) as n, sum(dependants)::bigint as dependants from facts where predicate in ('purchase', 'error') group by 1, 2")
def fg12_facts_list(s: Store) -> DataFrame:
    g = s.facts.filter(F.col("predicate").isin("purchase", "error")).groupBy("subject", "predicate")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("dependants").cast("long").alias("dependants"))


@query("select predicate, count(*) filter (status = 'contested') as contested, count(*) filter (status = 'quarantine_candidate') as candidates from chain where valid group by predicate")
def fg13_pending_conflicts(s: Store) -> DataFrame:
    n = lambda v: F.sum(F.when(F.col("status") == v, 1).otherwise(0)).cast("long")
    return s.chain.filter("valid").groupBy("predicate").agg(n("contested").alias("contested"), n("quarantine_candidate").alias("candidates"))


@query("select entity, count(*) as degree from (select subject as entity from facts union all select object from facts) group by entity")
def fg15_graph_nodes(s: Store) -> DataFrame:
    return analytics.graph_export(s.facts)[0]


@query("select subject, predicate, object, not (predicate = 'error' and object = 'v3') as valid from facts")
def fg6_invalidate(s: Store) -> DataFrame:
    gone = s.facts.filter("predicate = 'error' and object = 'v3'").select("subject", "predicate", "object")
    return facts.invalidate(s.facts.withColumn("valid", F.lit(True)), gone).select("subject", "predicate", "object", "valid")


@query("select seq, case when seq % 5 = 0 then 99 else dependants end as dependants from facts")
def fg16_set_fields(s: Store) -> DataFrame:
    patch = s.facts.filter("seq % 5 = 0").select("seq", F.lit(99).alias("dependants"))
    return facts.set_fields(s.facts.select("seq", "dependants"), patch, "seq")


SPELLED = (" Single ", "temporal_single", "TemporalSingle", "MULTI", "both", "temporal-single")


@query(f"""with r as (select p_partkey, p_name as predicate, {"[" + ", ".join(f"'{x}'" for x in SPELLED) + "]"}[1 + length(p_name) % {len(SPELLED)}] as said from part union all select p_partkey, p_name, p_type from part)
select predicate, said, case lower(trim(said)) when 'single' then 'single' when 'multi' then 'multi' when 'temporal-single' then 'temporal-single' when 'temporal_single' then 'temporal-single' when 'temporalsingle' then 'temporal-single' end as cardinality, count(*) as n from r group by 1, 2""")
def fg2_parse_cardinality(s: Store) -> DataFrame:
    known = F.array(*[F.lit(x) for x in SPELLED])[F.char_length("p_name") % len(SPELLED)]
    rows = s.part.select(F.col("p_name").alias("predicate"), known.alias("said")).unionByName(s.part.select(F.col("p_name").alias("predicate"), F.col("p_type").alias("said")))
    return rows.groupBy("predicate", "said", facts.parse_cardinality(F.col("said")).alias("cardinality")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with t as (select seq, subject, predicate, object, sha1(unhex('%s') || encode(concat(subject, chr(0), predicate, chr(0), object))) as h from facts)
select seq, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab89ab89ab89ab', 1 + instr('0123456789abcdef', substr(h, 17, 1)) - 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) as id from t""" % ids.FACT)
def fg1_fact_ids(s: Store) -> DataFrame:
    return s.facts.select("seq", ids.uuid5(ids.FACT, F.col("subject"), F.col("predicate"), F.col("object")).alias("id"))


@query("select event_id, case when s in ('active', 'contested', 'stale', 'unknown', 'superseded', 'quarantine_candidate') then s when s in ('shadowed', 'propagation_shadowed') then 'unknown' when s = 'candidate' then 'quarantine_candidate' end as status from (select event_id, replace(case event_id % 4 when 0 then 'quarantine-candidate' when 1 then 'shadowed' when 2 then event_type else 'active' end, '-', '_') as s from events)")
def fg3_parse_status(s: Store) -> DataFrame:
    k = F.col("event_id") % 4
    said = F.when(k == 0, "quarantine-candidate").when(k == 1, "shadowed").when(k == 2, F.col("event_type")).otherwise("Active ")
    return s.events.select("event_id", facts.parse_status(said).alias("status"))


# --- belief revision

ENT = "(log2(1 + dependants) + log2(1 + conf) + log2(1 + least(age / 30, 24))) / 50"
DUEL = f"""
with x as (select seq, dependants * 1.0 as dependants, (seq % 9) * 1.0 as conf, floor(({NOW} - $S(created_at)) / 86400.0) as age, seq % 6 as diverse, seq % 4 as ext, seq % 3 <> 0 as live from facts)"""


def _duel_inputs(s: Store) -> DataFrame:
    age = F.floor((F.lit(NOW) - secs("created_at")) / 86400.0)
    return s.facts.select("seq", "dependants", (F.col("seq") % 9).alias("conf"), age.alias("age"), (F.col("seq") % 6).alias("diverse"), (F.col("seq") % 4).alias("ext"), (F.col("seq") % 3 != 0).alias("live"))


@query(f"{DUEL} select seq, round({ENT}, 6) as entrenchment from x")
def br1_entrenchment(s: Store) -> DataFrame:
    return _duel_inputs(s).select("seq", F.round(belief.entrenchment(F.col("dependants"), F.col("conf"), F.col("age")), 6).alias("entrenchment"))


@query(f"""{DUEL}, m as (select * from (values ('chat-only', 0.1, 0.2), ('dev-with-ci', 0.15, 0.35), ('multi-tenant', 0.4, 0.2)) as t(mode, wc, we)),
w as (select seq, mode, {ENT} as old, (wc * log2(1 + diverse) + we * log2(1 + ext)) * case when live then 1 else 0.5 end as new from x, m)
select mode, seq, case when new > 1.5 * old then 'flip' when new > 0.5 * old then 'contested' else 'quarantine' end as outcome from w""")
def br4_resolve_duel(s: Store) -> DataFrame:
    x = _duel_inputs(s).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in belief.MODES])))
    new = belief.weight_new(F.col("mode"), F.col("diverse"), F.col("ext"), F.lit(None).cast("double"), F.col("live"))
    return x.select("mode", "seq", belief.resolve_duel(new, belief.entrenchment(F.col("dependants"), F.col("conf"), F.col("age"))).alias("outcome"))


@query(f"""{DUEL}, g as (select * from (values ('baseline', 1.5, 0.5), ('flip_low', 0.75, 0.5), ('flip_high', 2.25, 0.5), ('contest_low', 1.5, 0.25), ('contest_high', 1.5, 0.75)) as t(run, f, c)),
w as (select seq, {ENT} as old, (0.1 * log2(1 + diverse) + 0.2 * log2(1 + ext)) * case when live then 1 else 0.5 end as new from x)
select run, case when new > f * old then 'flip' when new > c * old then 'contested' else 'quarantine' end as outcome, count(*) as n from w, g group by 1, 2""")
def a31_parameter_sweep(s: Store) -> DataFrame:
    runs = [("baseline", 1.5, 0.5), ("flip_low", 0.75, 0.5), ("flip_high", 2.25, 0.5), ("contest_low", 1.5, 0.25), ("contest_high", 1.5, 0.75)]
    grid = F.array(*[F.struct(F.lit(n).alias("run"), F.lit(f).alias("f"), F.lit(c).alias("c")) for n, f, c in runs])
    x = _duel_inputs(s).withColumn("g", F.explode(grid))
    new = belief.weight_new(F.lit("chat-only"), F.col("diverse"), F.col("ext"), F.lit(None).cast("double"), F.col("live"))
    out = belief.resolve_duel(new, belief.entrenchment(F.col("dependants"), F.col("conf"), F.col("age")), F.col("g.f"), F.col("g.c"))
    return x.groupBy(F.col("g.run").alias("run"), out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


SAT = "(1 - 1 / (1 + log2(1 + {0})))"


@query(f"""{DUEL}, t as (select seq, 0.7 * {SAT.format('dependants')} + 0.1 * {SAT.format('conf')} + 0.2 * case when seq % 2 = 0 then greatest(least((seq % 13 - 6) / 5.0, 1), -1) else {SAT.format('ext')} end - case when live then 0 else 0.5 end as c from x)
select seq, round(c, 6) as confidence from t""")
def br11_confidence(s: Store) -> DataFrame:
    typed = F.when(F.col("seq") % 2 == 0, (F.col("seq") % 13 - 6).cast("double"))
    c = belief.confidence(F.lit("chat-only"), F.col("dependants"), F.col("conf"), typed, F.col("ext"), ~F.col("live"))
    return _duel_inputs(s).select("seq", F.round(c, 6).alias("confidence"))


@query("""with p as (select event_id, ((event_id * 7) % 100) / 100.0::double as old, ((event_id * 13) % 100) / 100.0::double as new, event_id % 2 = 0 as inside from events)
select event_id, case when new - old < -0.2::double and new < 0.3::double then case when inside then 'none' else 'promote' end when inside and new - old > 0.2::double then 'recover' else 'none' end as transition from p""")
def br12_retest(s: Store) -> DataFrame:
    old, new = (F.col("event_id") * 7 % 100) / 100.0, (F.col("event_id") * 13 % 100) / 100.0
    return s.events.select("event_id", belief.retest(old, new, F.col("event_id") % 2 == 0).alias("transition"))


@query("""with o as (select user_id, event_id, ts, event_type <> 'view' as drifted from events),
i as (select *, sum(case when drifted then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from o),
c as (select event_id, sum(case when drifted then 1 else 0 end) over (partition by user_id, island order by ts, event_id rows unbounded preceding)::bigint as counter from i)
select event_id, counter, counter >= 5 as inside from c""")
def br15_doubt_counter(s: Store) -> DataFrame:
    rows = s.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), (F.col("event_type") != "view").alias("drifted"))
    return analytics.doubt_runs(rows).select(F.col("seq").alias("event_id"), F.col("counter").cast("long").alias("counter"), "inside")


@query("""with e as (select label, i, avg(embedding[i]::double) as m from embeddings, range(1, 65) t(i) group by label, i), n as (select label, sqrt(sum(m * m)) as norm from e group by label)
select e.label, e.i - 1 as pos, round(e.m / n.norm, 6) as x from e join n using (label)""")
def br14_centroid(s: Store) -> DataFrame:
    return revision.centroid(s.embeddings, "label", "embedding", 64)


@query("""with a as (select label, arg_min(embedding, vec_id) as v from embeddings group by label)
select e.vec_id, 1 - list_dot_product(e.embedding::double[], a.v::double[]) > 0.9 as drifted from embeddings e join a using (label)""")
def br13_drift(s: Store) -> DataFrame:
    first = s.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return s.embeddings.join(first, "label").select("vec_id", vector.drifted(F.col("embedding"), F.col("v"), 0.9).alias("drifted"))


@query("""select event_id, case when e = 0 then least(b * 2, 86400) when e >= 20 then greatest(b // 2, 300) else b end as seconds
from (select event_id, event_id % 30 as e, greatest(least((event_id * 37) % 100000, 86400), 300) as b from events)""")
def br20_cadence(s: Store) -> DataFrame:
    return s.events.select("event_id", belief.cadence(F.col("event_id") * 37 % 100000, F.col("event_id") % 30).alias("seconds"))


@query("""with f as (select seq, dependants from facts), g as (select seq from f where seq % 101 = 0)
select seq, lane from (select seq, 0 as lane, 0 as o from g union all select seq, 1, -dependants from f where seq not in (select seq from g)) order by lane, o, seq limit 50""")
def br19_retest_candidates(s: Store) -> DataFrame:
    return analytics.retest_candidates(s.facts.filter("seq % 101 = 0"), s.facts)


# --- memories


@query(f"select id, library from memories where {VISIBLE}")
def fl1_visible(s: Store) -> DataFrame:
    return s.memories.filter(memories.visible()).select("id", "library")


@query("select id from memories where type <> 'procedure' and not quarantined and archived")
def fl2_archived_only(s: Store) -> DataFrame:
    return s.memories.filter(memories.visible("only")).select("id")


@query(f"select id from memories where {VISIBLE} and library in ('src1', 'src2') and author = 'en' and created_at >= $TS(1704153600) and created_at < $TS(1706745600)")
def fl5_filters(s: Store) -> DataFrame:
    since, before = (F.timestamp_seconds(F.lit(x)) for x in (1_704_153_600, 1_706_745_600))
    return s.memories.filter(memories.selected(("src1", "src2"), "en", None, since, before)).select("id")


@query("""select 'e' || event_id as k, case event_id % 4 when 0 then $S(d) when 1 then $S(ts) when 2 then $S(ts) - 7200 end as at_s from (select event_id, ts, date_trunc('day', ts) as d from events)
union all select 'c' || c_custkey, null from customer""")
def fl6_parse_bound(s: Store) -> DataFrame:
    k, ts = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    zoned = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd")).when(k == 1, F.concat(zoned, F.lit("Z"))).when(k == 2, F.concat(zoned, F.lit("+02:00"))).otherwise(F.date_format(ts, "d.M.yyyy"))
    rows = s.events.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("k"), said.alias("said"))
    rows = rows.unionByName(s.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("k"), F.col("c_name").alias("said")))
    return rows.select("k", secs(memories.parse_bound(F.col("said"))).alias("at_s"))


@query(f"select id, $S(created_at) as created_s from memories where {VISIBLE} order by created_at desc nulls last, id limit 50")
def sc2_browse(s: Store) -> DataFrame:
    return memories.newest(s.memories.filter(memories.visible()), 50).select("id", secs("created_at").alias("created_s"))


@query("select id, case when length(content) <= 200 then content else substr(content, 1, 200) end as snippet from memories order by created_at desc nulls last, id limit 30")
def sc4_history(s: Store) -> DataFrame:
    return memories.newest(s.memories, 30).select("id", F.substring("content", 1, 200).alias("snippet"))


@query("select id, library from memories where author = 'de' and not quarantined and library in ('src1', 'src3')")
def sc5_by_author(s: Store) -> DataFrame:
    return s.memories.filter((F.col("author") == "de") & ~memories.flag("quarantined") & F.col("library").isin("src1", "src3")).select("id", "library")


@query("select id from memories where library = 'src2' and source = 'notes/en/3.md'")
def sc6_by_source(s: Store) -> DataFrame:
    return s.memories.filter("library = 'src2' and source = 'notes/en/3.md'").select("id")


@query("""select id, $S(created_at) as created_s, (select count(*) > 75 from memories where created_at is not null) as more from memories where created_at is not null order by created_at desc, id limit 75""")
def wd11_page(s: Store) -> DataFrame:
    return memories.page(s.memories, 75).select("id", secs("created_at").alias("created_s"), "more")


COLD = f"""with c as (select m.id, m.archived, coalesce(a.uses, 0) as uses, ({NOW} - $S(m.created_at)) / 86400.0 as age, coalesce(floor({NOW} - epoch(a.last_access)) / 86400.0, ({NOW} - $S(m.created_at)) / 86400.0) as idle
from memories m left join access_log a on a.id = m.id),
d as (select id, archived, uses, case when age is null then null when uses = 0 then greatest(age, 0) else greatest(idle, 0) / (1 + log10(1.0 + uses)) end as coldness from c)"""


@query(f"{COLD} select id, uses, round(coldness, 6) as coldness from d")
def wd17_coldness(s: Store) -> DataFrame:
    return memories.with_coldness(s.memories, s.access_log, now()).select("id", "uses", F.round("coldness", 6).alias("coldness"))


@query(f"{COLD} select id, case when uses = 0 and archived then 'prune' else 'archive' end as action from d where coldness >= 60")
def wd18_decay(s: Store) -> DataFrame:
    return memories.decay(s.memories, s.access_log, now(), 60).select("id", "action")


@query("""with r as (select id, library, row_number() over w as place, first_value(id) over w as keep_id from memories window w as (partition by library, content order by created_at nulls last, id))
select id, library, keep_id from r where place > 1""")
def wd15_exact_duplicates(s: Store) -> DataFrame:
    return memories.exact_duplicates(s.memories).select("id", "library", "keep_id")


MARKED = " or ".join(f"contains(lower(t), '{m}')" for m in text.DECISION_MARKERS)
NOISY = " or ".join(f"contains(lower(source), '{m}')" for m in text.NOISY_PATHS)
GATE = f"""with g as (select id, source, quarantined, content, trim(content) as t, case id % 9 when 0 then 'LS' when 1 then 'grep' end as tool from memories),
r as (select id, content, case when {MARKED} then null when length(t) < 12 then 'too_short' when length(t) > 8000 then 'too_long'
 when len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) < 3 then 'too_few_words' when {NOISY} then 'blacklist_path'
 when lower(regexp_extract(regexp_extract(source, '([^/\\\\]*)$', 1), '^([^.]*)', 1)) in ('readme', 'changelog', 'license', 'licence', 'code_of_conduct', 'contributing', 'authors', 'notice') then 'blacklist_doc'
 when lower(tool) in ('ls', 'pwd', 'echo') then 'blacklist_tool' end as reason from g)"""


def tool():
    return F.when(F.col("id") % 9 == 0, "LS").when(F.col("id") % 9 == 1, "grep")


@query(f"{GATE} select id, reason from r")
def wd3_relevance_gate(s: Store) -> DataFrame:
    return s.memories.select("id", text.gate_reason(F.col("content"), F.col("source"), tool()).alias("reason"))


@query("select id, len(list_filter(regexp_split_to_array(trim(content), '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]'))) as words from memories")
def wd4_word_count(s: Store) -> DataFrame:
    return s.memories.select("id", text.word_count(F.trim("content")).cast("long").alias("words"))


SECRET = "case " + " ".join(f"when regexp_matches(content, '{p.replace(chr(39), chr(39) * 2)}') then '{n}'" for n, p in text.SECRETS.items()) + " end"


@query(f"select id, {SECRET} as reason from memories")
def wd1_secret_scan(s: Store) -> DataFrame:
    return s.memories.select("id", text.secret_reason(F.col("content")).alias("reason"))


@query(f"""{GATE}, k as (select trim(content) as t, bool_or(not quarantined) as live, bool_or(quarantined) as held from memories where id % 2 = 0 group by 1)
select outcome, count(*) as n from (select case when {SECRET.replace('content', 'r.content')} is not null then 'refused_secret' when r.reason is not null and coalesce(held, false) then 'promoted'
 when r.reason is not null and coalesce(live, false) then 'reasserted' when r.reason is not null then 'quarantined'
 when coalesce(live, false) or row_number() over (partition by trim(r.content) order by r.id) > 1 then 'skipped_dup' else 'stored' end as outcome from r left join k on k.t = trim(r.content)) group by 1""")
def wd7_ingest_report(s: Store) -> DataFrame:
    c = s.memories.select("id", "content", "source", tool().alias("tool"))
    out = memories.ingest_outcome(c, s.memories.filter("id % 2 = 0").select("content", "quarantined"))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"{GATE} select case when reason in ('too_short', 'too_long') then reason else 'other' end as reason, count(*) as n from r where reason is not null group by 1")
def wd12_quarantine_breakdown(s: Store) -> DataFrame:
    rows = s.memories.select(text.gate_reason(F.col("content"), F.col("source"), tool()).alias("reason"))
    return memories.quarantine_breakdown(rows, ("too_short", "too_long"))


TOK = "list_filter(regexp_extract_all(lower({0}), '([\\p{{L}}\\p{{N}}]+)', 1), lambda t: length(t) >= 2)"


#: Memories by hashed tokens: their vectors, and of each those before it in its library, nearest first; ``pts`` says what is there and from which place on.
VECTORS = f"""tk as (select id, unnest({TOK.format('content')}) as tok from memories), bk as (select id, ('0x' || substr(md5(tok), 1, 4))::int % 64 as pos, count(*) as n from tk group by 1, 2),
zs as (select id, sqrt(sum(n * n)) as norm from bk group by 1),
vv as (select m.id, list(coalesce(bk.n / zs.norm, 0.0)::double order by p.pos) as vec from memories m cross join (select unnest(range(64)) as pos) p left join bk on bk.id = m.id and bk.pos = p.pos left join zs on zs.id = m.id where trim(coalesce(content, '')) <> '' group by 1)"""
NEAREST = f"""tok as (select id, {TOK.format('content')} as toks from memories),
pt as (select library, pid, vid, place from (select *, row_number() over (partition by library, trim(content) order by place, pid) as k from pts where content is not null) where k = 1),
nn as (select id, vid, score, rank from (select c.id, p.vid, round(list_dot_product(x.vec, y.vec), 6) as score, row_number() over (partition by c.id order by round(list_dot_product(x.vec, y.vec), 6) desc, p.pid) as rank
       from asked c join vv x using (id) join pt p on p.library is not distinct from c.library and p.place < c.id join vv y on y.id = p.vid) where rank <= 3),
seen as (select distinct nn.id, unnest(t.toks) as term from nn join tok t on t.id = nn.vid),
own as (select id, unnest(toks) as term from tok where id in (select id from nn)),
fresh as (select own.id, avg(case when seen.term is null then 1.0 else 0.0 end) as share from own left join seen on seen.id = own.id and seen.term = own.term group by 1),
nv as (select nn.id, nn.score, coalesce(share, 1.0) as novelty from nn left join fresh using (id) where rank = 1)"""


def hashed(rows: DataFrame) -> DataFrame:
    return models.embed(rows, models.hashing(64), "hashing-64")


@query(f"with {VECTORS}, asked as (select id, library from memories), pts as (select library, content, id as pid, id as vid, id as place from memories), {NEAREST} select m.id, round(novelty, 6)::double as novelty, score from memories m left join nv using (id)")
def wd6_novelty(s: Store) -> DataFrame:
    rows = hashed(s.memories.select("id", "library", "content"))
    return ingest.novelty(s.spark, rows, rows.limit(0)).select("id", F.round("novelty", 6).alias("novelty"), "score")


@query("""with f as (select concat('d', doc_id) as name, text from documents where doc_id % 3 <> 0), o as (select concat('d', doc_id) as name, case when doc_id % 5 = 0 then concat(text, '!') else text end as text from documents where doc_id % 4 <> 0)
select coalesce(f.name, o.name) as name, case when f.text is null then 'orphan' when length(trim(f.text)) < 10 then 'skip' when o.name is null then 'new' when trim(o.text) = trim(f.text) then 'unchanged' else 'replace' end as action from f full join o on f.name = o.name""")
def wd19_reconcile(s: Store) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name")
    files = s.documents.filter("doc_id % 3 <> 0").select(name, "text")
    stored = s.documents.filter("doc_id % 4 <> 0").select(name, F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return memories.reconcile(files, stored)


@query("""with r as (select source as name from documents union all select n_name from nation union all select c_name from customer union all select p_name from part union all select url from pages union all select left(text, 129) from documents
  union all select case when length(text) < 40 then '' else '_Procedures' end from benchmark)
select name, case when coalesce(trim(name), '') = '' then 'empty' when length(trim(name)) > 128 then 'too_long' when not regexp_full_match(trim(name), '[A-Za-z0-9._-]+') then 'charset' when lower(trim(name)) in ('_procedures', 'memories', '_kg_facts', '_kg_predicates', '_mod_procstats') then 'reserved' end as problem from r""")
def fl15_library_names(s: Store) -> DataFrame:
    rule = F.when(F.char_length("text") < 40, "").otherwise("_Procedures")
    names = [s.documents.select("source"), s.nation.select("n_name"), s.customer.select("c_name"), s.part.select("p_name"), s.pages.select("url"), s.documents.select(F.substring("text", 1, 129)), s.benchmark.select(rule)]
    rows = names[0].toDF("name")
    for n in names[1:]:
        rows = rows.unionByName(n.toDF("name"))
    return rows.withColumn("problem", text.library_problem(F.col("name")))


@query("""select page_id, case when s = 'http' then 'url_not_https' when s <> 'https' then 'url_parse' when not h in ('github.com', 'gitlab.com') then 'url_host_not_allowed' end as problem from (select page_id, lower(regexp_extract(u, '^([A-Za-z]+):', 1)) as s, lower(regexp_extract(u, '://([^/:?#]*)', 1)) as h from (select page_id, case page_id % 4 when 0 then url when 1 then concat('https://GitHub.com/x/', page_id) when 2 then replace(url, 'https:', 'http:') else replace(url, ':', '') end as u from pages))""")
def fl16_provenance(s: Store) -> DataFrame:
    k, none = F.col("page_id") % 4, F.lit(None).cast("string")
    url = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("https://GitHub.com/x/"), F.col("page_id").cast("string"))).when(k == 2, F.regexp_replace("url", "^https:", "http:")).otherwise(F.regexp_replace("url", ":", ""))
    return s.pages.select("page_id", text.provenance_problem(F.lit("x"), url, F.lit("grep"), none, none, none).alias("problem"))


@query("""select page_id, concat('[external] ', url, chr(10), 'repo: o/r', case when page_id % 2 = 0 then concat(chr(10), 'lines: ', page_id) else '' end, chr(10), 'source: grep', chr(10), chr(10), 'code') as content, concat('grep:o/r', case when page_id % 2 = 0 then concat('#L', page_id) else '' end) as tag from pages""")
def wd20_provenance_content(s: Store) -> DataFrame:
    none, repo, tool = F.lit(None).cast("string"), F.lit("o/r"), F.lit("grep")
    lines = F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string"))
    return s.pages.select("page_id", text.provenance_content(F.lit("code"), F.col("url"), tool, repo, none, lines, none, none).alias("content"), text.source_tag(tool, repo, none, lines).alias("tag"))


# --- retrieval

BASE = f"""with m as (select m.id, m.content, e.embedding as vec, m.library, m.created_at from memories m join embeddings e on e.vec_id = m.id % (select count(*) from embeddings) where {VISIBLE}),
q as (select b.item_id as qid, b.text as content, e.embedding as vec from benchmark b join embeddings e on e.vec_id = b.item_id * 7 % (select count(*) from embeddings)),
dense as (select qid, id, score, rank from (select q.qid, m.id, round(list_dot_product(q.vec::double[], m.vec::double[]), 6) as score, row_number() over (partition by q.qid order by round(list_dot_product(q.vec::double[], m.vec::double[]), 6) desc, m.id) as rank from q, m) where rank <= 20),
mp as (select id, term, count(*) as tf from (select id, unnest({TOK.format('content')}) as term from m) group by 1, 2),
qp as (select qid, term, count(*) as tq from (select qid, unnest({TOK.format('content')}) as term from q) group by 1, 2),
df as (select term, ln(((select count(*) from m) - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf from mp group by 1),
sp as (select qid, id, round(sum(tq * tf * idf), 6) as score from mp join qp using (term) join df using (term) group by 1, 2),
sparse as (select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from sp) where rank <= 20),
fused as (select qid, id, round(sum(1 / (60 + rank)), 9) as score from (select qid, id, rank from dense union all select qid, id, rank from sparse) group by 1, 2),
pool as (select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from fused) where rank <= 20),
re as (select p.qid, p.id, round(1 / (1 + exp(-case when len(list_distinct({TOK.format('q.content')})) = 0 then 0.0 else len(list_intersect(list_distinct({TOK.format('q.content')}), {TOK.format('m.content')})) / len(list_distinct({TOK.format('q.content')})) end)), 6) as score from pool p join q using (qid) join m using (id))"""


def _base(s: Store) -> tuple[DataFrame, DataFrame]:
    n = s.embeddings.count()
    vec = lambda key: s.embeddings.select(F.col("vec_id").alias(key), F.col("embedding").alias("vec"))
    m = s.memories.filter(memories.visible()).withColumn("k", F.col("id") % n).join(vec("k"), "k").select("id", "content", "vec", "library", "created_at")
    q = s.benchmark.withColumn("k", F.col("item_id") * 7 % n).join(vec("k"), "k").select(F.col("item_id").alias("qid"), F.col("text").alias("content"), "vec")
    return m, q


@query(f"{BASE} select qid, id, score, rank from dense")
def rt7_dense_topk(s: Store) -> DataFrame:
    m, q = _base(s)
    return retrieval.dense_topk(s.spark, q, m, 20).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"{BASE} select qid, id, score, rank from sparse")
def rt8_sparse_topk(s: Store) -> DataFrame:
    m, q = _base(s)
    return retrieval.sparse_topk(q, m, 20).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"{BASE} select qid, id, score, rank from pool")
def rt9_fusion(s: Store) -> DataFrame:
    m, q = _base(s)
    fused = retrieval.fuse([retrieval.dense_topk(s.spark, q, m, 20), retrieval.sparse_topk(q, m, 20)])
    return retrieval.best(fused, 20).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


TIER1 = "case when length(content) <= 100 then content else concat(regexp_replace(case when regexp_matches(substr(content, 1, 100), '\\s') and length(regexp_extract(substr(content, 1, 100), '(?s)^(.*)\\s', 1)) >= 50 then regexp_extract(substr(content, 1, 100), '(?s)^(.*)\\s', 1) else substr(content, 1, 100) end, '\\s+$', ''), '...') end"


@query(f"{BASE}, top as (select *, row_number() over (partition by qid order by score desc, id) as rank from re) select qid, id, rank, score, {TIER1} as shown from top join m using (id) where rank <= 10")
def rt14_search(s: Store) -> DataFrame:
    m, q = _base(s)
    return retrieval.search(s.spark, q, m).withColumn("rank", F.col("rank").cast("long"))


@query(f"{BASE}, top as (select *, row_number() over (partition by qid order by score desc, id) as rank from re), u as (select id, uses, last_access as t from access_log union all select id, 1, $TS({NOW}) from top where rank <= 10) select id, sum(uses)::bigint as uses, max($S(t)) as last_s from u group by id")
def rt14_recorded_access(s: Store) -> DataFrame:
    m, q = _base(s)
    log = retrieval.search_and_record(s.spark, q, m, s.access_log, now())[1]
    return log.select("id", "uses", secs("last_access").alias("last_s"))


@query(f"{BASE}, hits as (select *, row_number() over (partition by qid order by score desc, id) as rank from re), gold as (select q.qid, m.id from q join m on contains(m.content, q.content)), first as (select g.qid, min(h.rank) as first from gold g left join hits h on h.qid = g.qid and h.id = g.id and h.rank <= 10 group by 1)\nselect count(*) as queries, round(avg(case when first <= 1 then 1.0 else 0.0 end), 6) as r1, round(avg(case when first <= 5 then 1.0 else 0.0 end), 6) as r5, round(avg(case when first <= 10 then 1.0 else 0.0 end), 6) as r10 from first")
def a19_recall(s: Store) -> DataFrame:
    m, q = _base(s)
    hits = retrieval.search(s.spark, q, m)
    return analytics.recall_at(hits, retrieval.holding(q, m))


@query("""select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on a.vec_id < b.vec_id where round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) >= 0.4""")
def wd16_near_pairs(s: Store) -> DataFrame:
    return retrieval.near_pairs(s.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 0.4)


@query("""with p as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id < b.vec_id where round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) >= 0.4),
r as (select doc_id as id, length(text) as n from documents),
l as (select case when (x.n > y.n) or (x.n = y.n and x.id < y.id) then y.id else x.id end as id, case when (x.n > y.n) or (x.n = y.n and x.id < y.id) then x.id else y.id end as winner from p join r x on x.id = p.a join r y on y.id = p.b)
select id, min(winner) as winner from l group by id""")
def wd16_merge_near(s: Store) -> DataFrame:
    rows = s.documents.select(F.col("doc_id").alias("id"), F.lit("all").alias("library"), F.char_length("text").alias("chars"), F.lit(None).cast("timestamp").alias("created_at"))
    return retrieval.merged_near(rows, s.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 0.4)


MERGE = """with v as (select m.id, m.library, length(m.content) as n, coalesce($S(m.created_at), 253402214400) as at, e.embedding::double[] as vec from memories m join embeddings e on e.vec_id = m.id % (select count(*) from embeddings) where m.content is not null),
l as (select x.id, first(y.id order by y.n desc, y.at, y.id) as winner from v x join v y on x.library = y.library and x.id <> y.id and round(list_dot_product(x.vec, y.vec), 6) >= 0.95
      where (-y.n, y.at, y.id) < (-x.n, x.at, x.id) group by 1)
select id, winner from l"""


def _with_vectors(s: Store) -> DataFrame:
    n = s.embeddings.count()
    rows = s.memories.filter("content is not null").select("id", "library", F.char_length("content").alias("chars"), "created_at", (F.col("id") % n).alias("vec_id"))
    return rows.join(s.embeddings.select("vec_id", F.col("embedding").alias("vec")), "vec_id")


@query(MERGE)
def wd16_merged_exact(s: Store) -> DataFrame:
    return vectors.merged(s.spark, _with_vectors(s), 0.95, exact=True)


@query(MERGE)
def wd16_merged_bands(s: Store) -> DataFrame:
    return vectors.merged(s.spark, _with_vectors(s), 0.95)


@query("""with n as (select e.vec_id as qid, f.vec_id as id, round(list_dot_product(e.embedding::double[], f.embedding::double[]), 6) as score from embeddings e, embeddings f where e.vec_id % 20 = 0 and e.vec_id <> f.vec_id)
select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from n) where rank <= 5""")
def rt17_neighbours_by_id(s: Store) -> DataFrame:
    rows = s.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    got = retrieval.dense_topk(s.spark, rows.filter("id % 20 = 0").withColumnRenamed("id", "qid"), rows, 6).filter("qid <> id").drop("rank")
    return retrieval.best(got, 5).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with t as (select id, unnest({TOK.format('content')}) as term from memories) select term, count(distinct id) as df, count(*) as tf from t group by 1")
def rt5_sparse_vectors(s: Store) -> DataFrame:
    posted = retrieval.postings(s.memories, "id", "content")
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("""with c as (select conv_id * 1000 + turn as qid, lower(text) as q from conversations), l as (select distinct library from memories where length(library) >= 3),
n as (select qid, string_agg(library, ',' order by library) as libraries from c join l on regexp_matches(q, concat('(^|[^\\p{L}\\p{N}])', library, '($|[^\\p{L}\\p{N}])')) group by qid)
select c.qid, case when n.qid is not null then 'P1' when %s then 'P1' when %s then 'P2' else 'P0' end as priority, coalesce(libraries, '') as libraries from c left join n using (qid)"""
       % (" or ".join(f"contains(q, '{x.replace(chr(39), chr(39) * 2)}')" for x in (*retrieval.META_CUES, *retrieval.CROSS_SESSION, *retrieval.NEGATIONS)), " or ".join(f"contains(q, '{x.replace(chr(39), chr(39) * 2)}')" for x in retrieval.PERSONAL)))
def rt20_should_search(s: Store) -> DataFrame:
    asked = s.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("content"))
    return retrieval.classify_query(asked, s.memories.select("library").distinct()).select("qid", "priority", "libraries")


@query(f"""select * from (select 'facts' as silo, cast(seq as varchar) as id, concat_ws(' ', subject, predicate, object) as label from facts order by dependants desc, seq limit 10)
union all select * from (select 'memories', cast(id as varchar), {TIER1} from memories where {VISIBLE} order by created_at desc nulls last, id limit 10)
union all select * from (select 'procedures', cast(id as varchar), fix from procedures order by success_count desc, id limit 10)""")
def rt19_recall_all(s: Store) -> DataFrame:
    return retrieval.recall_all(s.facts, s.memories.filter(memories.visible()), s.procedures, 10)


# --- outcomes, procedures, measurement

LATEST = "with l as (select * from (select *, row_number() over (partition by memory_id, signal_type, source order by ts desc, event_id) as k from signals) where k = 1)"


@query(f"{LATEST} select event_id, memory_id, signal_type, source, success from l")
def a11_latest_signals(s: Store) -> DataFrame:
    return analytics.latest_signals(s.signals).select("event_id", "memory_id", "signal_type", "source", "success")


#: Confidences of some memories, by a rule.
SCORES = "c as (select doc_id as id, (doc_id % 100) / 100.0::double as score from documents where doc_id % 3 <> 0)"


def scores(s: Store) -> DataFrame:
    return s.documents.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100 / 100.0).alias("score"))


def cited(s: Store) -> DataFrame:
    """Signals whose citations name a memory as their source."""
    return s.signals.withColumn("source", F.when(F.col("signal_type") == "cited_by", F.substring("source", 4, 9)).otherwise(F.col("source")))


CITED = "sg as (select event_id, memory_id, signal_type, success, case when signal_type = 'cited_by' then substr(source, 4, 9) else source end as source, ts from signals)"


@query(f"""with {SCORES}, {CITED}, l as (select * from (select *, row_number() over (partition by memory_id, signal_type, source order by ts desc, event_id) as k from sg) where k = 1)
select memory_id, round(sum(case when signal_type = 'cited_by' and coalesce(c.score, 0) < 0.5 then 0.0 else case signal_type when 'test_passed' then 1.0 when 'code_compiled' then 0.3 when 'user_confirmed' then 0.7 else 0.2 end * case when success then 1 else -0.5 end end), 6)::double as score, count(*) as n
from l left join c on l.signal_type = 'cited_by' and c.id::varchar = l.source group by 1""")
def a10_typed_scores(s: Store) -> DataFrame:
    return analytics.typed_scores(cited(s), scores(s))


@query("select memory_id, count(*) as failures from signals where signal_type = 'test_passed' and not success and ts >= $TS(1704067200) group by 1 having count(*) >= 3")
def a12_guardrail(s: Store) -> DataFrame:
    return analytics.guardrail(s.signals, F.timestamp_seconds(F.lit(1_704_067_200 + 7 * 86400)))


@query("""select event_id, source, (sum(case when signal_type = 'test_passed' and not success then 1 else 0 end) over (partition by source order by $S(ts) range between 604800 preceding and current row))::bigint as failures from signals""")
def a12_error_rate(s: Store) -> DataFrame:
    return analytics.error_rate(s.signals)


RANKED = "round((id % 100) / 100.0 + case when verified then 0.25 else 0 end + case when success_count + fail_count > 0 then 0.20 * (success_count - fail_count) / (success_count + fail_count) * least((success_count + fail_count) / 5.0, 1) else 0 end, 6)"


@query(f"select id, {RANKED}::double as rank_score from procedures")
def a17_rank_procedures(s: Store) -> DataFrame:
    return analytics.rank_procedures(s.procedures, (F.col("id") % 100) / 100.0).select("id", "rank_score")


@query("select id, fix, success_count::bigint as success_count from procedures where verified order by success_count desc, id limit 40")
def a18_verified_procedures(s: Store) -> DataFrame:
    return s.procedures.filter("verified").orderBy(F.col("success_count").desc(), "id").limit(40).select("id", "fix", F.col("success_count").cast("long").alias("success_count"))


@query("select id, round(success_count / nullif(success_count + fail_count, 0), 6) as worked, round(max(success_count) over () , 6)::double as most from procedures")
def a16_normalised_procedures(s: Store) -> DataFrame:
    most = s.procedures.agg(F.max("success_count").alias("most"))
    worked = F.try_divide(F.col("success_count"), F.col("success_count") + F.col("fail_count"))
    return s.procedures.join(F.broadcast(most)).select("id", F.round(worked, 6).alias("worked"), F.col("most").cast("double").alias("most"))


@query(f"""with pb as (select id, trigger_error as content, fix, verified, success_count, fail_count from procedures), {VECTORS.replace("memories", "pb")},
q as (select id as qid, 'error: ' || content as content from pb where id % 20 = 0),
dn as (select q.qid, pb.id, round(list_dot_product(x.vec, y.vec), 6) as score from q join vv x on x.id = q.qid join vv y on true join pb on pb.id = y.id),
dense as (select qid, id, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from dn) where rank <= 10),
mp as (select id, term, count(*) as tf from (select id, unnest({TOK.format('content')}) as term from pb) group by 1, 2),
qp as (select qid, term, count(*) as tq from (select qid, unnest({TOK.format('content')}) as term from q) group by 1, 2),
df as (select term, ln(((select count(*) from pb) - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf from mp group by 1),
sp as (select qid, id, round(sum(tq * tf * idf), 6) as score from mp join qp using (term) join df using (term) group by 1, 2),
sparse as (select qid, id, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from sp) where rank <= 10),
fused as (select qid, id, round(sum(1 / (60 + rank)), 9) as score from (select * from dense union all select * from sparse) group by 1, 2),
pool as (select *, row_number() over (partition by qid order by score desc, id) as rank from fused)
select qid, p.id, rank, round(p.score / max(p.score) over (partition by qid), 6) as score, fix, case when p.id % 3 <> 0 then verified else false end as verified,
       (case when p.id % 3 <> 0 then success_count else 0 end)::bigint as success_count, (case when p.id % 3 <> 0 then fail_count else 0 end)::bigint as fail_count
from pool p join pb using (id) where rank <= 10""")
def a16_recall_procedures(s: Store) -> DataFrame:
    known = models.embed(s.procedures, models.hashing(64), "hashing-64", "trigger_error")
    asked = known.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.concat(F.lit("error: "), "trigger_error").alias("error"), "vec")
    out = retrieval.recall_procedures(s.spark, asked, known, s.procedures.filter("id % 3 <> 0"))
    n = lambda c: F.col(c).cast("long").alias(c)
    return out.select("qid", "id", n("rank"), "score", "fix", "verified", n("success_count"), n("fail_count"))


@query("""with r as (select predicate, dependants as v, row_number() over (partition by predicate order by dependants) - 1 as i, count(*) over (partition by predicate) as n from facts)
select predicate, max(n) as n, min(v) as low, max(v) as high, round(avg(v), 6) as mean, max(v) filter (i = round(0.1 * (n - 1))) as p10, max(v) filter (i = round(0.5 * (n - 1))) as p50, max(v) filter (i = round(0.9 * (n - 1))) as p90 from r group by predicate""")
def a9_nearest_rank(s: Store) -> DataFrame:
    return analytics.nearest_rank(s.facts, "dependants", ["predicate"])


@query("""with p as (select predicate, subject, count(distinct object) as d, count(distinct case when seq % 3 = 0 then object end) as x from facts group by 1, 2),
g as (select predicate, count(*) as subjects, sum(case when d >= 2 then 1 else 0 end) as m, sum(case when d >= 2 then d - 1 else 0 end) as t, sum(case when d >= 2 then x else 0 end) as y from p group by 1)
select predicate, subjects, case when m = 0 then 'single' when t > 0 and y / t >= 0.6 then 'temporal-single' else 'multi' end as proposed,
case when m = 0 then 'high' when t > 0 and y / t > 1 then 'low' when t > 0 and y / t >= 0.85 then 'high' when t > 0 and y / t >= 0.6 then 'low' when m / subjects >= 0.2 then 'high' else 'low' end as confidence from g""")
def a3_propose_cardinality(s: Store) -> DataFrame:
    return analytics.propose_cardinality(s.facts.withColumn("superseded", F.col("seq") % 3 == 0))


@query("select library, count(*) as n, count(*) filter (quarantined) as quarantined, count(*) filter (archived) as archived from memories group by library")
def a1_stats(s: Store) -> DataFrame:
    n = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).cast("long").alias(c)
    return s.memories.groupBy("library").agg(F.count(F.lit(1)).alias("n"), n("quarantined"), n("archived"))


@query("select op, library, actor, count(*) as n, grouping(op, library, actor)::bigint as level from audit group by grouping sets ((op), (op, library), (op, actor))")
def a23_audit_tally(s: Store) -> DataFrame:
    return analytics.audit_tally(s.audit)


@query("""with l as (select library as log, event_id as line, concat(op, ':', target) as raw, lag(concat(op, ':', target)) over (partition by library order by event_id) as before from audit)
select log, min(line) as line from l where line % 997 = 0 and before is not null group by log""")
def a25_chain_verify(s: Store) -> DataFrame:
    lines = s.audit.select(F.col("library").alias("log"), F.col("event_id").alias("line"), F.concat_ws(":", "op", "target").alias("raw"))
    broken = analytics.chain(lines).withColumn("prev_hash", F.when(F.col("line") % 997 == 0, F.concat(F.lit("x"), "prev_hash")).otherwise(F.col("prev_hash")))
    return analytics.first_break(broken)


@query("select actor, count(*) as n, max(event_id) as last from audit where op in ('add', 'update') group by actor")
def a26_by_agent(s: Store) -> DataFrame:
    return s.audit.filter(F.col("op").isin("add", "update")).groupBy("actor").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


@query(f"select agent, session, cast(floor(({NOW} - epoch(last_active)) / 60) as bigint) as idle_minutes from sessions where status = 'active' and floor(({NOW} - epoch(last_active)) / 60) >= 30")
def a28_zombies(s: Store) -> DataFrame:
    return analytics.zombies(s.sessions, now()).select("agent", "session", F.col("idle_minutes").cast("long").alias("idle_minutes"))


@query("""with e as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as new from events),
k as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from e)
select user_id, min($S(ts)) as start_s, count(*) as n from k group by user_id, k""")
def a29_sessions(s: Store) -> DataFrame:
    g = s.events.groupBy(F.session_window(F.col("ts").cast("timestamp"), F.lit("30 minutes 1 microsecond")).alias("w"), "user_id").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", secs("start").alias("start_s"), "n")


@query("select library as key, arg_max(op, event_id) as value from audit group by library")
def a34_last_values(s: Store) -> DataFrame:
    return sinks.last_values(s.audit.select(F.col("library").alias("key"), F.col("op").alias("value"), F.lit(0).alias("ts"), F.col("event_id").alias("seq")))


@query("select event_id, op, case when op in ('add', 'ingest', 'update') then 'write' else 'process' end as kind from audit")
def st1_pulses(s: Store) -> DataFrame:
    from mnemospark.streaming import streams

    return streams.pulses(s.audit).select("event_id", "op", "kind")


@query("select ($S(ts) // 3600) * 3600 as start_s, op, count(*) as n from audit group by 1, 2")
def st2_windowed_counts(s: Store) -> DataFrame:
    from mnemospark.streaming import streams

    return streams.windowed_counts(s.audit.withColumn("ts", F.col("ts").cast("timestamp"))).select(secs("start").alias("start_s"), "op", "n")


@query("select id, max(uses) as uses from (select id, uses from access_log union all select id, uses + id % 3 - 1 from access_log) group by id")
def sc23_merge_access(s: Store) -> DataFrame:
    new = s.access_log.withColumn("uses", F.col("uses") + F.col("id") % 3 - 1)
    return sinks.merge_access(s.access_log, new).select("id", "uses")


@query("select doc_id, (text = '' or length(text) <= 500) as whole from documents")
def rt18_fits_one_chunk(s: Store) -> DataFrame:
    return s.documents.select("doc_id", (F.size(sinks.chunks(F.col("text"))) == 1).alias("whole"))


@query()
def sc18_notes(s: Store) -> DataFrame:
    rows = s.memories.select("library", "source", "author", "content")
    return sinks.notes(rows, now()).select("id", "library", "source", "author", "content", "hash")


@query()
def sc15_page_text(s: Store) -> DataFrame:
    return readers.page_text(s.pages)

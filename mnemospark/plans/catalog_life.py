"""Queries of the write path: lookups, edits, quarantine, blocks, ingest, briefings, opponents and re-tests, models' places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import belief, ids, text
from mnemospark.operators import analytics, extraction, facts, ingest, lifecycle, memories, models, revision
from mnemospark.plans.catalog import CITED, ENT, GATE, HIDDEN, NEAREST, SAT, SCORES, SECRET, TOK, VECTORS, cited, hashed, now, query, scores, secs, tool
from mnemospark.plans.views import NOW, Store


def _toxic(s: Store) -> DataFrame:
    return s.labels.filter("toxic = 1").select(F.col("doc_id").alias("id"))


# --- lookups and edits


@query("select id, library, author from memories where id in (select id from access_log)")
def sc10_lookup(s: Store) -> DataFrame:
    return lifecycle.lookup(s.memories, s.access_log, ["library", "author"])


@query("""with f as (select * from facts order by dependants desc, seq limit 1)
select 'subject' as field, subject as value from f union all select 'predicate', predicate from f union all select 'object', object from f
union all select 'dependants', dependants::varchar from f union all select 'seq', seq::varchar from f""")
def a32_fact_show(s: Store) -> DataFrame:
    return analytics.show(facts.top_dependants(s.facts, 1).select("seq").join(s.facts, "seq"), ["subject", "predicate", "object", "dependants", "seq"])


@query("select id from memories where id not in (select doc_id from labels where toxic = 1)")
def wd14_delete(s: Store) -> DataFrame:
    return lifecycle.delete(s.memories, _toxic(s)).select("id")


@query("select id, archived or id in (select doc_id from labels where toxic = 1) as archived from memories")
def wd14_archive(s: Store) -> DataFrame:
    return lifecycle.archive(s.memories, _toxic(s)).select("id", "archived")


@query("select id, archived and id not in (select id from access_log) as archived, archived and id in (select id from access_log) as restored from memories")
def wd14_restore(s: Store) -> DataFrame:
    rows, done = lifecycle.restore(s.memories, s.access_log)
    back = done.select("id", F.lit(True).alias("restored"))
    return rows.join(back, "id", "left").select("id", "archived", F.coalesce("restored", F.lit(False)).alias("restored"))


@query(f"""select case when c.id is null then m.id else m.id + 1000000000 end as id, library, length(content) + case when c.id is null then 0 else 1 end as n,
case when c.id is null then $S(m.created_at) else {NOW} end as created_s from memories m left join access_log c on c.id = m.id""")
def wd14_edit(s: Store) -> DataFrame:
    changes = lifecycle.lookup(s.memories, s.access_log, ["content"]).select("id", (F.col("id") + 1_000_000_000).alias("new_id"), F.concat("content", F.lit("!")).alias("new_content"))
    return lifecycle.edit(s.memories, changes, now()).select("id", "library", F.char_length("content").cast("long").alias("n"), secs("created_at").alias("created_s"))


# --- quarantine, blocks, access


MEMORY_ID = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab89ab89ab89ab', 1 + instr('0123456789abcdef', substr(h, 17, 1)) - 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12))"


@query(f"""{GATE}, x as (select *, sha1(unhex('{ids.MEMORY}') || encode(concat(coalesce(library, ''), chr(0), trim(coalesce(content, ''))))) as h, {SECRET} as secret from memories),
k as (select *, {MEMORY_ID} as key from x),
held as (select key, min(created_at) as at from k where quarantined group by 1),
fresh as (select k.key, min(r.reason) as reason from r join k using (id) where r.reason is not null and k.secret is null and trim(coalesce(k.content, '')) <> '' group by 1)
select coalesce(n.key, h.key) as id, coalesce(n.reason, 'held') as reason, case when n.key is null then $S(h.at) else coalesce($S(h.at), {NOW}) end as created_s
from held h full join fresh n on n.key = h.key""")
def wd9_add_quarantined(s: Store) -> DataFrame:
    named = s.memories.withColumn("id", lifecycle.memory_id(F.col("library"), F.coalesce("content", F.lit(""))))
    held = named.filter(memories.flag("quarantined")).groupBy("id").agg(*[F.min(c).alias(c) for c in ("library", "content", "source", "created_at")]).withColumn("reason", F.lit("held"))
    new = s.memories.withColumn("reason", text.gate_reason(F.col("content"), F.col("source"), tool())).filter("reason is not null").select("library", "content", "source", "reason")
    return lifecycle.add_quarantined(held, new, now()).select("id", "reason", secs("created_at").alias("created_s"))


@query("select id, quarantined and id not in (select id from access_log) as quarantined, quarantined and id in (select id from access_log) as promoted from memories")
def wd10_promote(s: Store) -> DataFrame:
    rows, done = lifecycle.promote(s.memories, s.access_log)
    return rows.join(done.select("id", F.lit(True).alias("promoted")), "id", "left").select("id", "quarantined", F.coalesce("promoted", F.lit(False)).alias("promoted"))


@query("select id, case when quarantined and coalesce(created_at < $TS(1704240000), false) then 'expire' else 'keep' end as op from memories")
def wd10_expire(s: Store) -> DataFrame:
    left, audit = lifecycle.expire(s.memories, F.timestamp_seconds(F.lit(1_704_240_000)))
    return left.select("id", F.lit("keep").alias("op")).unionByName(audit)


@query(f"""with k as (select distinct lower(trim(r_name)) as name from region), n as (select lower(trim(p_type)) as name, p_partkey as place, p_size = 50 as big from part),
f as (select name, row_number() over (order by min(place)) as k from n where not big and name not in (select name from k) group by 1)
select name, place, case when big then 'too_long' when name in (select name from k) or name in (select name from f where f.k <= {lifecycle.BLOCKS} - (select count(*) from k)) then 'set' else 'too_many' end as outcome from n""")
def wd21_blocks(s: Store) -> DataFrame:
    long = F.when(F.col("p_size") == 50, F.repeat(F.lit("x"), 5000)).otherwise(F.col("p_name"))
    new = s.part.select(F.concat(F.upper("p_type"), F.lit(" ")).alias("name"), F.col("p_partkey").alias("place"), long.alias("content"))
    return lifecycle.set_blocks(s.region.select(F.col("r_name").alias("name"), F.col("r_name").alias("content")), new)


@query("select id, sum(u)::bigint as uses, max($S(t)) as last_s from (select id, uses as u, last_access as t from access_log union all select memory_id, 1, ts from signals) group by 1")
def rt21_record_access(s: Store) -> DataFrame:
    shown = s.signals.select(F.col("memory_id").alias("id"), F.col("ts").alias("at"))
    return lifecycle.record_access(s.access_log, shown).select("id", "uses", secs("last_access").alias("last_s"))


BLOCK_LINES = "b as (select 'blocks' as section, row_number() over (order by r_name) as place, r_name || ': ' || r_name as line from region)"


@query(f"""{GATE}, v as (select m.library, m.quarantined, r.reason from memories m join r using (id)), {BLOCK_LINES},
said as (select 'session' as section, row_number() over (order by turn desc) as place, '[' || role || '] ' || text as line from conversations where conv_id = (select max(conv_id) from conversations)),
fresh as (select * from chain order by created_at desc, event_id limit 20),
told as (select 'facts' as section, row_number() over (order by created_at desc, event_id) as place, concat_ws(' ', subject, predicate, object) as line from fresh where valid and (status is null or status not in ('stale', 'superseded'))),
rule as (select 'rule' as section, 1 as place, 'search this store before acting on ' || string_agg(library, ', ' order by library) as line from (select distinct library from v where not starts_with(library, '_') and library <> 'default')),
tot as (select 'totals' as section, 1 as place, 'facts: ' || (select count(*) from chain) as line union all select 'totals', 2, 'quarantined: ' || (select count(*) from v where quarantined)),
lib as (select 'libraries' as section, row_number() over (order by n desc, k) as place, k || ': ' || n as line from (select coalesce(library, 'other') as k, count(*) as n from v group by 1)),
qua as (select 'quarantine' as section, row_number() over (order by n desc, k) as place, k || ': ' || n as line from (select coalesce(reason, 'other') as k, count(*) as n from v where quarantined group by 1))
select * from said where place <= 10 union all select * from told union all select * from lib where place <= 1000 union all select * from qua union all select * from rule union all select * from tot union all select * from b""")
def rt22_briefing(s: Store) -> DataFrame:
    rows = s.memories.withColumn("reason", text.gate_reason(F.col("content"), F.col("source"), tool()))
    known = s.chain.withColumnRenamed("event_id", "seq")
    blocks = s.region.select(F.col("r_name").alias("name"), F.col("r_name").alias("content"))
    return lifecycle.briefing(s.conversations, known, rows, blocks, lifecycle.told(F.col("status"), F.col("valid")))


@query(f"""with {BLOCK_LINES}, f as (select 'facts' as section, row_number() over (order by seq) as place, concat_ws(' ', subject, predicate, object) as line from facts),
p as (select 'procedures' as section, row_number() over (order by success_count desc, id) as place, concat_ws(' -> ', trigger_error, fix) as line from procedures where verified)
select * from b union all select * from f where place <= 40 union all select * from p where place <= 15""")
def sc17_profile(s: Store) -> DataFrame:
    return lifecycle.profile(s.region.select(F.col("r_name").alias("name"), F.col("r_name").alias("content")), s.facts, s.procedures)


# --- ingest in full


INGEST = f"""{GATE.replace('with g as', 'with recursive g as', 1)}, {VECTORS},
cand as (select m.id, m.library, m.content, m.source as cause, case when type = 'procedure' then 'procedure' when m.id % 5 = 0 then 'fact' else 'memory' end as kind, {SECRET.replace('content', 'm.content')} as secret, r.reason from memories m join (select id, reason from r) r using (id)),
old as (select id, library, content, quarantined from memories where id in (select id from access_log)),
asked as (select id, library from cand where kind = 'memory' and secret is null),
pts as (select library, content, -1 - id as pid, id as vid, -1 as place from old union all select library, content, id, id, id from cand where kind = 'memory' and secret is null), {NEAREST},
said as (select c.id, coalesce(c.library, '') as lib, trim(coalesce(c.content, '')) as t, coalesce(c.reason, case when novelty < 0.3::double then 'low_novelty' end) as why, coalesce(score >= 0.95::double, false) as close,
         row_number() over (partition by coalesce(c.library, ''), trim(coalesce(c.content, '')) order by c.id) as k from cand c left join nv using (id) where kind = 'memory' and secret is null),
known as (select coalesce(library, '') as lib, trim(coalesce(content, '')) as t, case when bool_or(not quarantined) then 'live' else 'held' end as state from old group by 1, 2),
fold as (select lib, t, 0::bigint as k, null::bigint as id, '' as outcome, null::varchar as why, null::varchar as held, coalesce(known.state, 'none') as state from (select distinct lib, t from said) left join known using (lib, t)
  union all
  select s.lib, s.t, s.k, s.id, case when s.why is not null then case f.state when 'held' then 'promoted' when 'live' then 'reasserted' else 'quarantined' end when s.close then 'skipped_dup' else 'stored_memories' end, s.why,
         case when s.why is not null and f.state = 'none' then s.why when s.why is null and s.close and f.state <> 'live' then 'near_dup_drop' end,
         case when s.why is not null then case f.state when 'none' then 'held' else 'live' end when s.close then case f.state when 'live' then 'live' else 'held' end else 'live' end
  from fold f join said s on s.lib = f.lib and s.t = f.t and s.k = f.k + 1),
o as (select id, 'memory' as kind, outcome, why as reason, held from fold where k > 0
  union all select id, kind, case when kind = 'fact' then case when secret is not null then 'skipped_secret' else 'stored_facts' end
    when kind = 'procedure' then case when trim(coalesce(cause, '')) = '' or trim(coalesce(content, '')) = '' then 'empty' else 'stored_procedures' end else 'skipped_secret' end, null, null
  from cand where kind <> 'memory' or secret is not null)"""


def _ingested(s: Store) -> DataFrame:
    kind = F.when(F.col("type") == "procedure", "procedure").when(F.col("id") % 5 == 0, "fact").otherwise("memory")
    rows = hashed(s.memories)
    c = rows.select(
        "id", "library", "content", "vec", kind.alias("kind"), F.col("source").alias("trigger"),
        text.gate_reason(F.col("content"), F.col("source"), tool()).alias("reason"), text.secret_reason(F.col("content")).alias("secret"),
    )
    return ingest.run(s.spark, c, rows.join(s.access_log.select("id"), "id", "left_semi").select("id", "library", "content", "vec", "quarantined"))


@query(f"{INGEST} select id, kind, outcome, reason, held from o")
def wd7_ingest_outcomes(s: Store) -> DataFrame:
    return _ingested(s)


@query(f"{INGEST} select count(*) as considered, " + ", ".join(f"count(*) filter (outcome = '{c}') as {c}" for c in ingest.COUNTERS) + " from o")
def wd8_ingest_counters(s: Store) -> DataFrame:
    return ingest.report(_ingested(s))


# --- belief revision


def _facts(s: Store) -> DataFrame:
    return s.facts.withColumn("confirmations", F.col("seq") % 9)


AXES = f"""with x as (select *, seq % 9 as conf, greatest(floor(({NOW} - epoch(created_at)) / 86400), 0) as age from facts),
e as (select *, round({ENT}, 12) as entrenchment from x),
op as (select * from (select *, row_number() over (partition by subject, predicate order by entrenchment desc, seq) as k from e) where k = 1)"""


@query(f"{AXES} select subject, predicate, seq, round(entrenchment, 6) as entrenchment from op")
def br5_opponents(s: Store) -> DataFrame:
    return revision.opponents(_facts(s), now()).select("subject", "predicate", "seq", F.round("entrenchment", 6).alias("entrenchment"))


@query(f"""{AXES} select f.seq, case when op.seq is not null then 'active' when p.cardinality = 'temporal-single' then 'superseded' else 'stale' end as status, case when op.seq is null then {NOW} end as until_s
from facts f left join predicates p using (predicate) left join op on op.seq = f.seq""")
def br6_retire_losers(s: Store) -> DataFrame:
    losers = s.facts.join(revision.opponents(_facts(s), now()).select("seq"), "seq", "left_anti")
    held = facts.registered(s.facts, s.predicates).withColumn("status", F.lit("active")).withColumn("valid_until", F.lit(None).cast("timestamp"))
    return revision.retire_losers(held, losers, now()).select("seq", "status", secs("valid_until").alias("until_s"))


@query("select memory_id, round(log2(1 + count(distinct source)), 6) as weight from signals group by 1")
def br8_diverse(s: Store) -> DataFrame:
    return s.signals.groupBy("memory_id").agg(F.round(revision.diverse(F.countDistinct("source")), 6).alias("weight"))


@query(f"""with {SCORES}, {CITED}, l as (select * from (select *, row_number() over (partition by memory_id, signal_type, source order by ts desc, event_id) as k from sg) where k = 1),
ty as (select memory_id, round(sum(case when signal_type = 'cited_by' and coalesce(c.score, 0) < 0.5 then 0.0 else case signal_type when 'test_passed' then 1.0 when 'code_compiled' then 0.3 when 'user_confirmed' then 0.7 else 0.2 end * case when success then 1 else -0.5 end end), 6)::double as score
 from l left join c on l.signal_type = 'cited_by' and c.id::varchar = l.source group by 1),
x as (select seq as id, case when seq % 10 = 0 then 0.5::double else (seq * 7 % 100) / 100.0::double end as cached, seq % 8 as counter,
 round(0.7 * {SAT.format('dependants')} + 0.1 * {SAT.format('(seq % 9)')} + 0.2 * case when ty.score is null then {SAT.format('(seq % 4)')} else greatest(least(ty.score / 5, 1), -1) end - case when seq % 3 = 0 then 0.5 else 0 end, 6)::double as confidence from facts left join ty on ty.memory_id = seq),
y as (select *, case when confidence - cached < -0.2::double and confidence < 0.3::double then case when counter >= 5 then 'none' else 'promote' end when counter >= 5 and confidence - cached > 0.2::double then 'recover' else 'none' end as transition from x)
select id, confidence, transition, case transition when 'promote' then 5 when 'recover' then 0 else counter end as counter from y""")
def br17_retest(s: Store) -> DataFrame:
    k = F.col("seq")
    rows = s.facts.select(k.alias("id"), "dependants", (k % 9).alias("confirmations"), (k % 4).alias("legacy"), F.when(k % 10 != 0, k * 7 % 100 / 100.0).alias("cached"), (k % 8).alias("counter"), (k % 3 == 0).alias("inherited"))
    return revision.retest(rows, analytics.typed_scores(cited(s), scores(s))).select("id", "confidence", "transition", F.col("counter").cast("long").alias("counter"))


_MODES = ", ".join(f"('{m}', {w[1]}, {w[2]})" for m, w in belief.MODES.items())


@query(f"""with m as (select * from (values {_MODES}) as t(mode, wc, we)), d as (select subject, predicate, object, count(distinct author) as diverse, count(*) filter (not valid) as external from assertions group by 1, 2, 3),
x as (select (log2(1 + greatest(f.dependants, 0)) + log2(1 + seq % 9) + log2(1 + least(greatest(floor(({NOW} - epoch(f.created_at)) / 86400), 0) / 30, 24))) / 50 as held, d.diverse, d.external, seq % 5 <> 0 as live from facts f join d using (subject, predicate, object)),
w as (select mode, held, (wc * log2(1 + diverse) + we * log2(1 + external)) * case when live then 1 else 0.5 end as fresh, (0.1 * log2(1 + diverse) + 0.2 * log2(1 + external)) * case when live then 1 else 0.5 end as base from x cross join m)
select mode, case when base > 1.5 * held then 'flip' when base > 0.5 * held then 'contested' else 'quarantine' end as expected, case when fresh > 1.5 * held then 'flip' when fresh > 0.5 * held then 'contested' else 'quarantine' end as outcome, count(*) as n from w group by 1, 2, 3""")
def br23_calibration(s: Store) -> DataFrame:
    said = s.assertions.groupBy("subject", "predicate", "object").agg(F.countDistinct("author").alias("diverse"), F.count_if(~F.col("valid")).alias("external"))
    age = F.greatest(F.timestamp_diff("DAY", F.col("created_at").cast("timestamp"), now()), F.lit(0))
    rows = _facts(s).withColumns({"age": age, "live": F.col("seq") % 5 != 0}).join(said, ["subject", "predicate", "object"])
    return revision.modes_compared(rows)


@query("""with c as (select (select count(*) from signals where ts >= $TS(1705968000) and ts <= $TS(1706572800)) as signals, (select count(distinct agent) from sessions where last_active >= $TS(1703980800) and last_active <= $TS(1706572800)) as agents)
select signals, agents, case when agents >= 3 then 'multi-tenant' when signals >= 10 then 'dev-with-ci' else 'chat-only' end as mode from c""")
def br24_recommend_mode(s: Store) -> DataFrame:
    return revision.recommend_mode(s.signals, s.sessions, F.timestamp_seconds(F.lit(1_706_572_800)))


# --- places for models


@query(f"""with t as (select id, unnest({TOK.format('content')}) as tok from memories), b as (select id, ('0x' || substr(md5(tok), 1, 4))::int % 64 as pos, count(*) as n from t group by 1, 2),
z as (select id, sqrt(sum(n * n)) as norm from b group by 1) select id, pos, round(n / norm, 6) as x from b join z using (id)""")
def rt1_hashing_embeddings(s: Store) -> DataFrame:
    rows = models.embed(s.memories.select("id", "content"), models.hashing(64), "hashing-64")
    return rows.select("id", F.posexplode("vec").alias("pos", "x")).filter("x > 0").select("id", "pos", F.round("x", 6).alias("x"))


@query("""with e as (select vec_id, embedding::double[] as v from embeddings), p as (select vec_id, case when vec_id % 2 = 1 then list_transform(list_zip(v, list_reverse(v)), lambda z: (z[1] + z[2]) / 2) else v end as m, v from e)
select vec_id, round(m[1] / sqrt(list_dot_product(m, m)), 6) as mean_head, round(v[1] / sqrt(list_dot_product(v, v)), 6) as cls_head from p""")
def rt2_pooling(s: Store) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    states, mask = F.array(v, F.reverse(v)), F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"))
    return s.embeddings.select("vec_id", F.round(models.pooled(states, mask)[0], 6).alias("mean_head"), F.round(models.pooled(states, mask, "cls")[0], 6).alias("cls_head"))


@query("select vec_id, case when vec_id % 5 = 0 then 'no_vector' when vec_id % 7 = 0 then 'dimension' when vec_id % 3 = 0 then 'model' end as problem from embeddings")
def rt3_space_guard(s: Store) -> DataFrame:
    k, v = F.col("vec_id"), F.col("embedding")
    rows = s.embeddings.select("vec_id", F.when(k % 5 != 0, F.when(k % 7 == 0, F.slice(v, 1, 32)).otherwise(v)).alias("vec"), F.when(k % 3 == 0, F.when(k % 2 == 0, "old")).otherwise("new").alias("embed_model"))
    return models.of_space(rows, "new", 64).select("vec_id", "problem")


@query("select id, library, case when trim(coalesce(content, '')) <> '' then 'hashing-64' end as embed_model from memories")
def sc21_reindex(s: Store) -> DataFrame:
    before = s.memories.withColumn("vec", F.array(F.lit(1.0))).withColumn("embed_model", F.lit("old"))
    return models.reindex(before, models.hashing(64), "hashing-64").select("id", "library", "embed_model")


# --- procedures and measurement


@query("""with g as (select predicate, subject, count(distinct object) as d from facts group by 1, 2), p as (select predicate, count(*) as n, count(*) filter (d >= 2) as many from g group by 1)
select predicate, case when many = 0 then 'single' else 'multi' end as proposed, case when many = 0 or many / n >= 0.2 then 'high' else 'low' end as confidence from p""")
def a4_legacy_cardinality(s: Store) -> DataFrame:
    return analytics.legacy_cardinality(s.facts)


@query("""with h as (select f.seq, event_id % 100 >= 50 as good, row_number() over (partition by f.seq order by event_id) as rank from assertions a join facts f on f.subject = a.subject and f.predicate = a.predicate and f.object = a.object)
select f.seq, count(h.seq) as dependants from facts f left join h on h.seq = f.seq and good and rank <= 256 group by 1""")
def a7_dependants(s: Store) -> DataFrame:
    hits = s.assertions.join(s.facts.select("subject", "predicate", "object", "seq"), ["subject", "predicate", "object"])
    place = F.row_number().over(Window.partitionBy("seq").orderBy("event_id"))
    hits = hits.select(F.col("seq").alias("qid"), F.col("event_id").alias("id"), (F.col("event_id") % 100 / 100.0).alias("score"), place.alias("rank"))
    return analytics.dependants(s.facts, hits, 0.5)


@query("""with n as (select id + 100 as id, fix, id % 2 = 0 as v from procedures)
select coalesce(n.id, p.id) as id, coalesce(n.fix, p.fix) as fix, coalesce(p.success_count, 0)::bigint as success_count, coalesce(p.fail_count, 0)::bigint as fail_count, coalesce(n.v, false) or coalesce(p.verified, false) as verified
from procedures p full join n on n.id = p.id""")
def a15_learn(s: Store) -> DataFrame:
    new = s.procedures.select((F.col("id") + 100).alias("id"), "trigger_error", "fix", (F.col("id") % 2 == 0).alias("verified"))
    return analytics.learn(s.procedures, new).select("id", "fix", F.col("success_count").cast("long").alias("success_count"), F.col("fail_count").cast("long").alias("fail_count"), "verified")


_KINDS = [*analytics.FIRST, *analytics.SECOND, "other"]


@query(f"""with q as (select case when event_id % 7 < 5 then 'P1' when event_id % 7 = 5 then 'P2' else 'P0' end as priority, (event_id % 2 = 0)::int as a, (event_id % 5 <> 0)::int as b, (event_id % 11 <> 0)::int as c from events)
select coalesce(priority, 'all') as priority, count(*) as n, round(avg(a), 6) as r1, round(avg(b), 6) as r5, round(avg(c), 6) as r10, 0.0::double as "without", round(100 * round(avg(b), 6), 4) as delta from q group by grouping sets ((), (priority))""")
def a21_policy_effect(s: Store) -> DataFrame:
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (e % len(_KINDS) + 1).cast("int"))
    return analytics.policy_effect(s.events.select(kind.alias("question_type"), (e % 2 == 0).alias("r1"), (e % 5 != 0).alias("r5"), (e % 11 != 0).alias("r10")))


@query("select count(*) as processed, (count(*) filter (event_id % 4 = 1) + 2 * count(*) filter (event_id % 4 = 2))::bigint as produced, count(*) filter (event_id % 4 = 3) as empty, count(*) filter (event_id % 4 = 0) as errors from events")
def a33_extraction_tally(s: Store) -> DataFrame:
    k, one = F.col("event_id") % 4, F.concat(F.lit('["u'), "user_id", F.lit('","did","'), "event_type", F.lit('"]'))
    answers = F.when(k == 1, F.concat(F.lit("["), one, F.lit("]"))).when(k == 2, F.concat(F.lit("```json\n["), one, F.lit(","), one, F.lit("]\n```"))).when(k == 3, F.col("event_type"))
    return analytics.extraction_tally(s.events.select(answers.alias("content")), lambda c: F.when(c.isNotNull(), extraction.triples(c)))

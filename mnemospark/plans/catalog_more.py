"""More queries of the catalogue: listings, guards, outcomes and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import belief, text, vector
from mnemospark.operators import analytics, extraction, memories, retrieval, revision
from mnemospark.plans.catalog import BASE, CITED, HIDDEN, SCORES, TIER1, TOK, VISIBLE, _base, cited, query, scores, secs
from mnemospark.sources.shared import sent
from mnemospark.plans.views import NOW, Store


@query("select id from memories where library = 'src1' order by created_at desc nulls last, id limit 20")
def sc3_list_memories(s: Store) -> DataFrame:
    return memories.newest(s.memories.filter("library = 'src1'"), 20).select("id")


@query("select id, library from memories where source = 'notes/en/3.md' and created_at >= $TS(1704240000)")
def sc7_recent_by_source(s: Store) -> DataFrame:
    return s.memories.filter((F.col("source") == "notes/en/3.md") & (F.col("created_at") >= F.timestamp_seconds(F.lit(1_704_240_000)))).select("id", "library")


@query("select id, library, sha256(content) as hash from memories where type <> 'procedure'")
def sc8_memory_meta(s: Store) -> DataFrame:
    return s.memories.filter("type <> 'procedure'").select("id", "library", F.sha2("content", 256).alias("hash"))


@query(f"select predicate, count(*) as valid, count(*) filter (status is null or status not in {HIDDEN}) as visible from chain where valid group by predicate")
def sc9_facts_with_history(s: Store) -> DataFrame:
    from mnemospark.operators import facts

    seen = F.sum(F.when(facts.visible(F.col("status"), F.col("valid")), 1).otherwise(0)).cast("long")
    return s.chain.filter("valid").groupBy("predicate").agg(F.count(F.lit(1)).alias("valid"), seen.alias("visible"))


@query("select coalesce(library, 'default') as library, count(*) as n, sum(length(content))::bigint as chars from memories where content is not null group by 1")
def sc16_export_sizes(s: Store) -> DataFrame:
    rows = s.memories.filter("content is not null").withColumn("library", F.coalesce("library", F.lit("default")))
    return rows.groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("content")).alias("chars"))


@query("select id, library from memories where quarantined and library in ('src0', 'src4')")
def fl7_quarantined(s: Store) -> DataFrame:
    return s.memories.filter(memories.flag("quarantined") & F.col("library").isin("src0", "src4")).select("id", "library")


@query("select library, count(*) as n from memories where type = 'procedure' group by library")
def fl8_procedures(s: Store) -> DataFrame:
    return s.memories.filter("type = 'procedure'").groupBy("library").agg(F.count(F.lit(1)).alias("n"))


@query(f"with acl as (select distinct actor as agent, library as lib from (select actor, 'src' || substr(library, 4) as library from audit where op = 'add')) select acl.agent, count(*) as n from memories m join acl on acl.lib = m.library where {VISIBLE} group by 1")
def fl14_library_scope(s: Store) -> DataFrame:
    acl = s.audit.filter("op = 'add'").select(F.col("actor").alias("agent"), F.concat(F.lit("src"), F.substring("library", 4, 100)).alias("library")).distinct()
    return s.memories.filter(memories.visible()).join(sent(acl), "library").groupBy("agent").agg(F.count(F.lit(1)).alias("n"))


@query("select label, count(*) as n, min(len(embedding)) as low, max(len(embedding)) as high from embeddings group by label")
def rt3_dimension_guard(s: Store) -> DataFrame:
    n = F.size("embedding").cast("long")
    return s.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("low"), F.max(n).alias("high"))


@query("select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from embeddings")
def rt2_norms(s: Store) -> DataFrame:
    return s.embeddings.select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"))


@query(f"select id, {TIER1} as tier1, {TIER1.replace('100', '500').replace('>= 50', '>= 250')} as tier2 from memories")
def rt13_tiers(s: Store) -> DataFrame:
    return s.memories.select("id", text.tier(F.col("content"), F.lit(1)).alias("tier1"), text.tier(F.col("content"), F.lit(2)).alias("tier2"))


@query(f"{BASE} select qid, score from dense where rank = 1")
def rt15_nearest_score(s: Store) -> DataFrame:
    m, q = _base(s)
    return retrieval.dense_topk(s.spark, q, m, 1).select("qid", "score")


@query(f"{BASE}, seen as (select distinct d.qid, unnest({TOK.format('m.content')}) as term from dense d join m using (id) where rank <= 3),\nasked as (select qid, unnest({TOK.format('content')}) as term from q),\nnew as (select a.qid, avg(case when s.term is null then 1.0 else 0.0 end) as share from asked a left join seen s on s.qid = a.qid and s.term = a.term group by 1)\nselect q.qid, round(coalesce(share, 1.0), 6) as novelty from q left join new using (qid)")
def rt16_neighbour_novelty(s: Store) -> DataFrame:
    m, q = _base(s)
    near = retrieval.dense_topk(s.spark, q, m, 3).join(m.select("id", "content"), "id")
    seen = near.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(text.tokens(F.col("content"))))).alias("seen"))
    return q.join(seen, "qid").select("qid", F.round(text.novelty(text.tokens(F.col("content")), F.col("seen")), 6).alias("novelty"))


@query("""with l as (select conv_id, turn, trim(unnest(['my editor is vim!', 'note: ' || text, 'plain', 'always ' || role])) as t from conversations)
select conv_id, turn, count(*) filter (t like 'my editor is %') as facts, count(*) filter (t like 'note: %' and length(trim(substr(t, 7))) >= 4 or t like 'always %') as notes from l group by 1, 2""")
def wd2_heuristics(s: Store) -> DataFrame:
    said = F.concat_ws("\n", F.lit("my editor is vim!"), F.concat(F.lit("note: "), F.regexp_replace("text", "[\r\n]+", " ")), F.lit("plain"), F.concat(F.lit("always "), "role"))
    rows = s.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "conv_id", "turn", said.alias("said"))
    found = extraction.heuristics(rows, "k", "said")
    n = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("long")
    return rows.join(found.groupBy("k").agg(n("fact").alias("facts"), n("memory").alias("notes")), "k").select("conv_id", "turn", "facts", "notes")


@query("select id, exists (select 1 from memories k where trim(k.content) = trim(m.content) and not k.quarantined and k.id < m.id) as known from memories m")
def wd13_live_elsewhere(s: Store) -> DataFrame:
    w = Window.partitionBy(F.sha2(F.trim("content"), 256)).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.max(F.when(~memories.flag("quarantined"), True).otherwise(False)).over(w)
    return s.memories.select("id", F.coalesce(known, F.lit(False)).alias("known"))


@query("select seq, subject, predicate, object from facts where seq % 4 in (0, 1)")
def wd22_triples(s: Store) -> DataFrame:
    """Facts as a model would answer them, as objects, as fenced arrays with a broken one among them, or as plain words, and parsed back."""
    one = F.struct("subject", "predicate", "object")
    listed = F.to_json(F.array(F.array("subject", "predicate", "object"), F.array("subject")))
    said = F.when(F.col("seq") % 4 == 0, F.to_json(F.array(one))).when(F.col("seq") % 4 == 1, F.concat(F.lit("Here you are:\n```json\n"), listed, F.lit("\n```"))).when(F.col("seq") % 4 == 2, F.concat_ws(" ", "subject", "predicate", "object"))
    return s.facts.select("seq", F.explode(extraction.triples(said)).alias("t")).select("seq", "t.subject", "t.predicate", "t.object")


@query("select predicate, subject, count(distinct object) as objects, count(distinct case when seq % 3 = 0 then object end) as superseded from facts group by 1, 2")
def a2_group_facts(s: Store) -> DataFrame:
    return s.facts.groupBy("predicate", "subject").agg(F.countDistinct("object").alias("objects"), F.countDistinct(F.when(F.col("seq") % 3 == 0, F.col("object"))).alias("superseded"))


@query("""with r as (select predicate, dependants as v, row_number() over (partition by predicate order by dependants) - 1 as i, count(*) over (partition by predicate) as n from facts),
p as (select predicate, max(n) as n, max(v) filter (i = round(0.5 * (n - 1))) as p50, max(v) filter (i = round(0.9 * (n - 1))) as p90 from r group by 1)
select predicate, case when n = 0 or p50 = 0 then 'none' when p90 / p50 > 5 then 'log' when p90 = p50 then 'flat' else 'linear' end as shape from p""")
def a6_shape(s: Store) -> DataFrame:
    p = analytics.nearest_rank(s.facts, "dependants", ["predicate"])
    return p.select("predicate", analytics.shape(F.col("p50"), F.col("p90"), F.col("n")).alias("shape"))


@query("select id from procedures where success_count > 0")
def a8_confirmations(s: Store) -> DataFrame:
    return s.procedures.filter("success_count > 0").select("id")


@query("""with f as (select * from (select *, row_number() over (partition by memory_id, signal_type, source order by ts, event_id) as k from signals) where k = 1 and signal_type in ('test_passed', 'code_compiled')),
n as (select memory_id, count(*) filter (success) as s, count(*) filter (not success) as f from f group by 1)
select id, success_count + coalesce(s, 0) as success_count, fail_count + coalesce(f, 0) as fail_count, verified or coalesce(s, 0) > 0 as verified from procedures left join n on n.memory_id = id""")
def a13_outcome_counters(s: Store) -> DataFrame:
    return analytics.bump_counters(s.procedures, s.signals).select("id", "success_count", "fail_count", "verified")


@query("""with h as (select event_id // 10 as qid, event_id as id, event_id % 10 + 1 as rank from events), g as (select distinct event_id // 10 as qid from events),
f as (select g.qid, case when g.qid % 3 = 0 then 'compile' else 'test' end as stratum, h.rank from g left join h on h.qid = g.qid and h.id = g.qid * 10 + g.qid % 13)
select stratum, count(*) as queries, round(avg(case when rank <= 1 then 1.0 else 0.0 end), 6) as r1, round(avg(case when rank <= 5 then 1.0 else 0.0 end), 6) as r5, round(avg(case when rank <= 10 then 1.0 else 0.0 end), 6) as r10 from f group by grouping sets ((), (stratum))""")
def a20_recall_by_stratum(s: Store) -> DataFrame:
    hits = s.events.select(F.floor(F.col("event_id") / 10).alias("qid"), F.col("event_id").alias("id"), (F.col("event_id") % 10 + 1).alias("rank"))
    qid = F.col("qid")
    gold = hits.select("qid").distinct().select("qid", (qid * 10 + qid % 13).alias("id"), F.when(qid % 3 == 0, "compile").otherwise("test").alias("stratum"))
    return analytics.recall_at(hits, gold, by="stratum")


@query("""with v as (select case when event_id % 3 = 0 then 'T1' else 'T2' end as type, event_id % 2 = 0 as a, event_id % 5 <> 0 as b, event_id % 7 <> 0 as c from events)
select type, count(*) as n, round(avg((a::int + b::int + c::int) / 3), 6) as cell_average, round(avg(case when a and b and c then 1.0 else 0.0 end), 6) as all_three from v group by grouping sets ((), (type))""")
def a22_verdicts(s: Store) -> DataFrame:
    e = F.col("event_id")
    v = s.events.select(F.when(e % 3 == 0, "T1").otherwise("T2").alias("type"), (e % 2 == 0).alias("state_resolution"), (e % 5 != 0).alias("premise_resistance"), (e % 7 != 0).alias("implicit_policy_adaptation"))
    return analytics.stale_verdicts(v)


@query("select event_id, target from audit where op = 'add' and ts >= $TS(1705276800) order by event_id desc limit 30")
def a24_audit_tail(s: Store) -> DataFrame:
    rows = s.audit.filter((F.col("op") == "add") & (F.col("ts").cast("timestamp") >= F.timestamp_seconds(F.lit(1_705_276_800))))
    return rows.orderBy(F.col("event_id").desc()).limit(30).select("event_id", "target")


@query("select 'subject' as side, predicate, object as other from facts where subject = 'user_3' union all select 'object', predicate, subject from facts where object = 'v3'")
def a30_node_detail(s: Store) -> DataFrame:
    a = s.facts.filter("subject = 'user_3'").select(F.lit("subject").alias("side"), "predicate", F.col("object").alias("other"))
    return a.unionByName(s.facts.filter("object = 'v3'").select(F.lit("object").alias("side"), "predicate", F.col("subject").alias("other")))


@query(f"select agent, count(*) as n, max($S(last_active)) as last_s from sessions where last_active >= $TS({NOW - 365 * 86400}) group by agent")
def a28_agents(s: Store) -> DataFrame:
    recent = s.sessions.filter(F.col("last_active").cast("timestamp") >= F.timestamp_seconds(F.lit(NOW - 365 * 86400)))
    return recent.groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.max(secs("last_active")).alias("last_s"))


@query("select seq, round((1 - 1 / (1 + log2(1 + dependants))) * case when seq % 4 = 0 then 0.5 else 1 end, 6) as x from facts")
def br16_doubt_multiplier(s: Store) -> DataFrame:
    return s.facts.select("seq", F.round(revision.doubted(belief.saturating(F.col("dependants")), F.col("seq") % 4 == 0), 6).alias("x"))


@query(f"with {SCORES}, {CITED} select event_id, c.score as confidence from sg left join c on signal_type = 'cited_by' and c.id::varchar = sg.source")
def br18_citing_confidence(s: Store) -> DataFrame:
    return revision.citing(cited(s), scores(s)).select("event_id", F.col("citing").alias("confidence"))

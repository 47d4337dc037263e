"""A memory store derived from the driver's tables, in SQL that Spark and DuckDB both run.

``$TS(x)`` stands for the timestamp of x seconds, ``$S(t)`` for the seconds of a timestamp.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The moment that all queries take as now: time is an argument, never the clock.
NOW = 1_722_470_400

VIEWS = {
    "assertions": """
        select event_id, concat('user_', cast(user_id as string)) as subject, event_type as predicate,
               concat('v', cast(cast(regexp_extract(props, '([0-9]+)', 1) as int) % 10 as string)) as object,
               ts as created_at, (event_id % 23 <> 0) as valid, cast(floor(value) as int) % 50 as dependants,
               concat('agent', cast(event_id % 3 as string)) as author
        from events""",
    "facts": """
        select subject, predicate, object, min(created_at) as created_at, max(created_at) as updated_at,
               max(dependants) as dependants, min(event_id) as seq
        from assertions where valid group by subject, predicate, object""",
    "chain": """
        select subject, predicate, object, created_at, event_id, valid,
               lead(created_at) over (partition by subject, predicate order by created_at, event_id) as valid_until,
               case when event_id % 11 = 0 then 'contested' when event_id % 13 = 0 then 'quarantine_candidate'
                    when event_id % 7 = 0 then cast(null as string)
                    when lead(created_at) over (partition by subject, predicate order by created_at, event_id) is null then 'active'
                    else 'superseded' end as status
        from assertions""",
    "predicates": "select * from (values ('signup', 'single'), ('error', 'single'), ('purchase', 'temporal-single')) as t(predicate, cardinality)",
    "memories": """
        select d.doc_id as id, d.source as library, case when d.doc_id % 19 = 0 then cast(null as string) else d.lang end as author, d.text as content,
               case when d.doc_id % 29 = 0 then cast(null as string) else concat('notes/', d.lang, '/', cast(d.doc_id % 7 as string), case when d.doc_id % 31 = 0 then '/README.md' when d.doc_id % 37 = 0 then '/a.lock' else '.md' end) end as source,
               case when d.doc_id % 41 = 0 then cast(null as timestamp) else $TS(1704067200 + d.doc_id * 3600) end as created_at,
               coalesce(l.quality = 0, false) as quarantined, (d.doc_id % 17 = 0) as archived,
               case when d.doc_id % 10 = 9 then 'procedure' else 'memory' end as type
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "signals": """
        select event_id, event_id % (select count(*) from documents) as memory_id,
               case event_type when 'purchase' then 'test_passed' when 'error' then 'test_passed'
                    when 'view' then 'code_compiled' when 'click' then 'user_confirmed' else 'cited_by' end as signal_type,
               event_type <> 'error' as success, concat('src', cast(user_id % 20 as string)) as source, ts
        from events""",
    "access_log": "select event_id % (select count(*) from documents) as id, count(*) as uses, max(ts) as last_access from events where event_id % 3 = 0 group by 1",
    "procedures": """
        select p.p_partkey as id, concat(p.p_type, ' ', p.p_name) as trigger_error, p.p_brand as fix,
               coalesce(s.success, 0) as success_count, coalesce(s.fail, 0) as fail_count, p.p_size % 3 = 0 as verified
        from part p left join (select l_partkey, sum(case when l_returnflag <> 'R' then 1 else 0 end) as success,
                                      sum(case when l_returnflag = 'R' then 1 else 0 end) as fail from lineitem group by l_partkey) s on s.l_partkey = p.p_partkey""",
    "edges": """
        select subject, predicate, object from facts where predicate <> 'view'
        union all select n.n_name, 'in_region', r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey
        union all select c.c_name, 'in_nation', n.n_name from customer c join nation n on c.c_nationkey = n.n_nationkey
        union all select s.s_name, 'in_nation', n.n_name from supplier s join nation n on s.s_nationkey = n.n_nationkey""",
    "audit": """
        select event_id, ts, case event_type when 'signup' then 'add' when 'view' then 'ingest' when 'click' then 'update' when 'error' then 'skip_dup' else 'quarantine' end as op,
               concat('lib', cast(user_id % 5 as string)) as library, concat('agent', cast(user_id % 7 as string)) as actor, concat('t', cast(event_id % 50 as string)) as target
        from events""",
    "sessions": """
        select concat('agent', cast(user_id % 7 as string)) as agent, cast(user_id as string) as session, min(ts) as started, max(ts) as last_active,
               case when user_id % 4 = 0 then 'ended' else 'active' end as status
        from events group by user_id""",
}


def spark_sql(text: str) -> str:
    return re.sub(r"\$S\(([^()]*)\)", r"unix_seconds(cast(\1 as timestamp))", text.replace("$TS(", "timestamp_seconds("))


def duck_sql(text: str) -> str:
    text = re.sub(r"\$S\(([^()]*)\)", r"cast(floor(epoch(\1)) as bigint)", text)
    return re.sub(r"\$TS\(([^()]*)\)", r"make_timestamp(cast(\1 as bigint) * 1000000)", text)


class Store:
    """Tables and views of a folder, as DataFrames, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._found = spark, sf_dir, {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in TABLES):
            raise AttributeError(name)
        if name not in self._found:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text, args = spark_sql(VIEWS[name]), {}
                for other in [*TABLES, *VIEWS]:
                    if other != name and re.search(rf"\b(from|join)\s+{other}\b", text):
                        text = re.sub(rf"\b(from|join)\s+{other}\b", rf"\1 {{{other}}}", text)
                        args[other] = getattr(self, other)
                df = self.spark.sql(text, **args)
            self._found[name] = df
        return self._found[name]


def with_views(sql: str) -> str:
    """SQL for DuckDB with the views that it names, and theirs, before it."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                need(VIEWS[name].replace(name, "") if name == "facts" else VIEWS[name])
                if name not in used:
                    used.append(name)

    need(sql)
    sql = sql.strip()
    recursive = sql.startswith("with recursive ")
    body = re.sub(r"^with (recursive )?", "", sql)
    views = [f"{n} as ({duck_sql(VIEWS[n])})" for n in used]
    if sql.startswith("with "):
        return f"with {'recursive ' * recursive}" + ",\n".join([*views, duck_sql(body)])
    return (f"with {',\n'.join(views)}\n" if views else "") + duck_sql(sql)

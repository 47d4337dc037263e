"""Walks over the fact graph, and the graph of libraries, memories and entities with the threads between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.operators.memories import flag
from mnemospark.sources.shared import Tables

#: Names, or beginnings of names, that an automaton holds in every worker, at most; characters of a beginning, at most.
NAMES = 50_000
GRAM = 4


def _named(c: Column) -> Column:
    return F.lower(F.trim(c))


def reached(spark: SparkSession, arcs: DataFrame, start: str, hops: int) -> DataFrame:
    """(a, depth): what lies within so many hops of start along arcs (a, b), with its least depth; nothing if start is on no arc.

    Each hop joins the arcs with the last frontier alone and leaves out what was met before. Frontiers are
    written, so a hop costs the same however many came before, and cycles end.
    """
    tables = Tables(spark, "walk")
    at = _named(F.lit(start))
    front = arcs.filter((F.col("a") == at) | (F.col("b") == at)).limit(1).select(at.alias("a"), F.lit(0).alias("depth"))
    front = seen = tables.put(front, "hop0")
    for depth in range(1, hops + 1):
        near = arcs.join(front.select("a"), "a").select(F.col("b").alias("a")).distinct()
        front = tables.put(near.join(seen.select("a"), "a", "left_anti").withColumn("depth", F.lit(depth)), f"hop{depth}")
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen


def walk_edges(spark: SparkSession, facts: DataFrame, start: str, hops: int) -> DataFrame:
    """(depth, subject, predicate, object): valid facts that lead outward from start, any case, up to so many hops.

    Breadth first: an entity is expanded once, at its least depth; a fact is shown though its object was met before.
    """
    kept = facts.filter(flag("valid")) if "valid" in facts.columns else facts
    arcs = kept.select(_named(F.col("subject")).alias("a"), _named(F.col("object")).alias("b"))
    at = reached(spark, arcs, start, hops - 1) if hops > 0 else reached(spark, arcs, start, 0).limit(0)
    out = kept.join(at, _named(F.col("subject")) == F.col("a"))
    return out.select((F.col("depth") + 1).alias("depth"), "subject", "predicate", "object")


def mentions(spark: SparkSession, memories: DataFrame, names: DataFrame, most: int = NAMES) -> DataFrame:
    """(id, name), each once: memories (id, content) whose text holds a name of four bytes and more, in any case, anywhere.

    Up to ``most`` names are one automaton in every worker, which reads each text once. Of more, their beginnings of up to GRAM
    characters are; where one stands, as many characters as the names of that beginning have are joined with the names. So names
    that begin alike do not meet every text that holds their beginning.
    """
    known = names.select("name", F.lower("name").alias("low")).filter("octet_length(name) >= 4").distinct()
    counted = known.limit(most + 1).count()
    if counted <= most:
        words = [(r["low"], r["name"]) for r in known.collect()]
        shared = spark.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            found: dict[str, list[str]] = {}
            for low, name in shared.value:
                found.setdefault(low, []).append(name)
            machine = ahocorasick.Automaton()
            for low, of in found.items():
                machine.add_word(low, of)
            if found:
                machine.make_automaton()
            for b in batches:
                ids, out = [], []
                for i, t in zip(b.column("id").to_pylist(), b.column("low").to_pylist(), strict=True):
                    hit = {n for _, of in machine.iter(t) for n in of} if found and t else ()
                    ids += [i] * len(hit)
                    out += sorted(hit)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["id", "name"])

        return memories.select(F.col("id").cast("long").alias("id"), F.lower("content").alias("low")).mapInArrow(run, "id long, name string").distinct()
    for size in range(GRAM, 0, -1):  # as long beginnings as are few enough
        heads = known.groupBy(F.substring("low", 1, size).alias("head")).agg(F.collect_set(F.char_length("low")).alias("sizes"))
        if size == 1 or heads.limit(most + 1).count() <= most:
            break
    begun = spark.sparkContext.broadcast([(r["head"], sorted(r["sizes"])) for r in heads.collect()])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for head, sizes in begun.value:
            machine.add_word(head, (len(head) - 1, sizes))
        machine.make_automaton()
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("low").to_pylist(), strict=True):
                hit = {t[end - back : end - back + n] for end, (back, sizes) in machine.iter(t) for n in sizes if end - back + n <= len(t)} if t else ()
                ids += [i] * len(hit)
                out += sorted(hit)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["id", "low"])

    runs = memories.select(F.col("id").cast("long").alias("id"), F.lower("content").alias("low")).mapInArrow(pick, "id long, low string")
    return runs.join(known.hint("merge"), "low").select("id", "name").distinct()


def brain(spark: SparkSession, facts: DataFrame, memories: DataFrame, visible: Column, per_library: int | None = 200) -> tuple[DataFrame, DataFrame]:
    """The whole store as (id, label, kind) nodes and (source, target, label, kind) edges.

    Entities are the ends of valid facts; libraries, but for those that begin with an underscore, hold their visible
    memories, the newest ``per_library`` of each (None: all); a memory mentions the entities that its text names.
    """
    kept = facts.filter(flag("valid"))
    wired = kept.select(F.col("subject").alias("source"), F.col("object").alias("target"), F.col("predicate").alias("label"), F.lit("fact").alias("kind"))
    entities = kept.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    shown = memories.filter(visible & ~F.coalesce(F.col("library").startswith("_"), F.lit(True)))
    if per_library is not None:
        newest = Window.partitionBy("library").orderBy(F.col("created_at").desc_nulls_last(), "id")
        shown = shown.withColumn("__k", F.row_number().over(newest)).filter(F.col("__k") <= per_library).drop("__k")
    lib, mem = F.concat(F.lit("lib:"), "library"), F.concat(F.lit("mem:"), F.col("id").cast("string"))
    nodes = entities.select(F.col("name").alias("id"), F.col("name").alias("label"), F.lit("entity").alias("kind"))
    nodes = nodes.unionByName(shown.select(lib.alias("id"), F.col("library").alias("label"), F.lit("library").alias("kind")).distinct())
    nodes = nodes.unionByName(shown.select(mem.alias("id"), F.substring("content", 1, 80).alias("label"), F.lit("memory").alias("kind")))
    holds = shown.select(lib.alias("source"), mem.alias("target"), F.lit("holds").alias("label"), F.lit("holds").alias("kind"))
    said = mentions(spark, shown, entities).select(mem.alias("source"), F.col("name").alias("target"), F.lit("mentions").alias("label"), F.lit("mention").alias("kind"))
    return nodes, wired.unionByName(holds).unionByName(said)

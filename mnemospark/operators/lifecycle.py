"""The life of a memory after it is written: lookups, edits, archive, quarantine, pinned blocks, access, briefings.

A table of memories is a DataFrame; each operation returns the table after it. Changes come as a table of ids,
so one plan carries a whole batch, and an unknown id changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import ids as ids_of
from mnemospark.functions import text
from mnemospark.operators.memories import flag

BLOCK_BYTES, BLOCKS = 4096, 32


def lookup(rows: DataFrame, ids: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """The fields of the rows with these ids, all in one pass; unknown ids are left out."""
    return rows.join(ids.select(key).distinct(), key, "left_semi").select(key, *fields)


def _marked(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key, F.lit(True).alias("__hit")).distinct(), key, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


def archive(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return _marked(rows, ids).withColumn("archived", flag("archived") | F.col("__hit")).drop("__hit")


def restore(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with these ids back from the archive, and the ids that were in it."""
    hit = _marked(rows, ids)
    done = hit.filter(F.col("__hit") & flag("archived")).select("id")
    return hit.withColumn("archived", flag("archived") & ~F.col("__hit")).drop("__hit"), done


def edit(rows: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """A changed text (id, new_id, new_content) is a new memory: it takes the old one's place, library, author and source.

    Ids name contents, so a new id that is stored already is overwritten, and of several changes that lead to one id that
    of the smallest old id counts.
    """
    c = changes.select("id", "new_id", "new_content").join(rows.select("id").distinct(), "id", "left_semi")
    one = c.groupBy("new_id").agg(F.min(F.struct("id", "new_content")).alias("c")).select("c.id", "new_id", "c.new_content")
    new = rows.dropDuplicates(["id"]).join(one, "id").withColumns({"id": F.col("new_id"), "content": F.col("new_content"), "created_at": now}).select(*rows.columns)
    return delete(delete(rows, c), one.select(F.col("new_id").alias("id"))).unionByName(new)


def memory_id(library: Column, content: Column) -> Column:
    """The id of a text in its library, held back or live."""
    return ids_of.uuid5(ids_of.MEMORY, library, F.trim(content))


def add_quarantined(held: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Held-back texts (id, library, content, source, reason, created_at) with new ones (library, content, source, reason).

    A text is held whole, never in chunks, under the id that it would have as a live memory, so that promoting it meets it.
    Blank texts and secrets are not held at all. What is held already keeps its date and takes the new reason.
    """
    n = new.filter((F.trim(F.coalesce("content", F.lit(""))) != "") & text.secret_reason(F.col("content")).isNull())
    n = n.withColumn("content", F.trim("content")).withColumn("id", memory_id(F.col("library"), F.col("content")))
    n = n.groupBy("id").agg(*[F.min(c).alias(c) for c in ("library", "content", "source", "reason")]).withColumn("created_at", now)
    old = held.select("id", F.col("created_at").alias("__at"))
    n = n.join(old, "id", "left").withColumn("created_at", F.coalesce("__at", "created_at")).drop("__at")
    return held.join(n.select("id"), "id", "left_anti").unionByName(n.select(*held.columns))


def promote(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with these ids out of quarantine, and the ids that were in it; others stay as they are."""
    hit = _marked(rows, ids)
    done = hit.filter(F.col("__hit") & flag("quarantined")).select("id")
    return hit.withColumn("quarantined", flag("quarantined") & ~F.col("__hit")).drop("__hit"), done


def expire(rows: DataFrame, before: Column) -> tuple[DataFrame, DataFrame]:
    """Deletes what has lain in quarantine since before a moment; the second table is the audit, to be written first."""
    old = flag("quarantined") & F.coalesce(F.col("created_at") < before, F.lit(False))
    return rows.filter(~old), rows.filter(old).select("id", F.lit("expire").alias("op"))


def set_blocks(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """(name, place, outcome) of pinned blocks (name, content) written in order of place: set, too_long or too_many.

    A known name is overwritten; new names are taken until there are BLOCKS. Names are trimmed and lower-cased.
    The first block of a new name decides whether it gets a place.
    """
    tidy = lambda d: d.withColumn("name", F.lower(F.trim("name")))
    there = tidy(blocks).select("name", F.lit(True).alias("known")).distinct()
    rows = tidy(new).join(there, "name", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    rows = rows.withColumn("long", F.octet_length("content") > BLOCK_BYTES)
    first = rows.filter(~F.col("long") & ~F.col("known")).groupBy("name").agg(F.min("place").alias("place"))
    # A top-n of names is all that is ever needed to fill the places.
    room = F.lit(BLOCKS) - F.lit(there.count())
    taken = first.orderBy("place").limit(BLOCKS).withColumn("k", F.row_number().over(Window.orderBy("place"))).filter(F.col("k") <= room).select("name", F.lit(True).alias("fits"))
    out = F.when(F.col("long"), "too_long").when(F.col("known") | F.coalesce("fits", F.lit(False)), "set").otherwise("too_many")
    return rows.join(F.broadcast(taken), "name", "left").select("name", "place", out.alias("outcome"))


def record_access(log: DataFrame, surfaced: DataFrame) -> DataFrame:
    """An access log (id, uses, last_access) after rows were shown (id, at): a use each, and the latest moment."""
    both = log.select("id", F.col("uses").cast("long").alias("uses"), F.col("last_access").cast("timestamp").alias("last_access"))
    both = both.unionByName(surfaced.select("id", F.lit(1).cast("long").alias("uses"), F.col("at").cast("timestamp").alias("last_access")))
    return both.groupBy("id").agg(F.sum("uses").alias("uses"), F.max("last_access").alias("last_access"))


def _top(rows: DataFrame, section: str, n: int, order: list[Column], line: Column) -> DataFrame:
    """The first n rows as numbered lines of a report's section."""
    w = Window.orderBy(*order)
    return rows.orderBy(*order).limit(n).select(F.lit(section).alias("section"), F.row_number().over(w).cast("long").alias("place"), line.alias("line"))


def briefing(turns: DataFrame, facts: DataFrame, memories: DataFrame, blocks: DataFrame, visible: Column, lines: int = 10, newest: int = 20) -> DataFrame:
    """What an agent is told first (section, place, line): the rule with the libraries to search, the end of the last session,
    the newest facts of which the ``visible`` ones are shown, counts by library, quarantine by reason, totals, and pinned blocks.

    turns (conv_id, turn, role, text); facts (seq, subject, predicate, object, created_at and what ``visible`` names);
    memories (library, quarantined, reason); blocks (name, content). Libraries that begin with an underscore and ``default``
    are not named in the rule.
    """
    last = turns.agg(F.max("conv_id").alias("conv_id"))
    said = turns.join(F.broadcast(last), "conv_id")
    out = _top(said, "session", lines, [F.col("turn").desc()], F.concat(F.lit("["), "role", F.lit("] "), "text"))
    fresh = facts.orderBy(F.col("created_at").desc(), "seq").limit(newest).filter(visible)
    out = out.unionByName(_top(fresh, "facts", newest, [F.col("created_at").desc(), F.col("seq")], F.concat_ws(" ", "subject", "predicate", "object")))
    for section, rows, by in (("libraries", memories, "library"), ("quarantine", memories.filter(flag("quarantined")), "reason")):
        n = rows.groupBy(F.coalesce(by, F.lit("other")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(_top(n, section, 1000, [F.col("n").desc(), F.col("k")], F.concat_ws(": ", "k", F.col("n").cast("string"))))
    named = memories.select("library").distinct().filter(~F.col("library").startswith("_") & (F.col("library") != "default"))
    listed = named.agg(F.array_join(F.array_sort(F.collect_set("library")), ", ").alias("l"))  # a name a library
    rule = F.when(F.col("l") == "", "search this store before acting").otherwise(F.concat(F.lit("search this store before acting on "), "l"))
    out = out.unionByName(listed.select(F.lit("rule").alias("section"), F.lit(1).cast("long").alias("place"), rule.alias("line")))
    for k, (name, rows) in enumerate((("facts", facts), ("quarantined", memories.filter(flag("quarantined")))), 1):
        total = rows.agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(total.select(F.lit("totals").alias("section"), F.lit(k).cast("long").alias("place"), F.concat_ws(": ", F.lit(name), F.col("n").cast("string")).alias("line")))
    return out.unionByName(_top(blocks, "blocks", BLOCKS, [F.col("name")], F.concat_ws(": ", "name", "content")))


def told(status: Column, valid: Column) -> Column:
    """Facts that a briefing shows: valid ones but for stale and superseded; contested and candidate ones are told."""
    return F.coalesce(valid, F.lit(False)) & ~F.coalesce(status.isin("stale", "superseded"), F.lit(False))


def profile(blocks: DataFrame, facts: DataFrame, procedures: DataFrame, n_facts: int = 40, n_procedures: int = 15) -> DataFrame:
    """Instructions for an agent (section, place, line): blocks, the first facts, and what was verified, most successes first."""
    out = _top(blocks, "blocks", BLOCKS, [F.col("name")], F.concat_ws(": ", "name", "content"))
    out = out.unionByName(_top(facts, "facts", n_facts, [F.col("seq")], F.concat_ws(" ", "subject", "predicate", "object")))
    good = procedures.filter(flag("verified"))
    return out.unionByName(_top(good, "procedures", n_procedures, [F.col("success_count").desc(), F.col("id")], F.concat_ws(" -> ", "trigger_error", "fix")))

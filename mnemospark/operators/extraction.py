"""What can be read out of free text without a model: rules of thumb, and the parser of a model's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heuristics(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, line, kind, subject, predicate, object, note): ``my X is Y`` as a fact of the user, marked lines as notes."""
    lines = rows.select(key, F.posexplode(F.split(content, r"\r?\n")).alias("line", "raw")).withColumn("t", F.trim("raw")).filter(F.octet_length("t") >= 4)
    low = F.lower("t")
    x, y = F.trim(F.regexp_extract("t", r"(?i)^my (.*?) is ", 1)), F.regexp_replace(F.trim(F.regexp_extract("t", r"(?i)^my .*? is (.*)$", 1)), "[.!]+$", "")
    fact = low.rlike("^my .*? is ") & (x != "") & (y != "")
    told = F.trim(F.regexp_extract("t", r"(?i)^(?:remember that |remember: |note that |note: )(.*)$", 1))
    note = F.when(low.rlike("^(remember that |remember: |note that |note: )"), told).when(low.rlike("^(always |never |we decided |decision: )"), F.col("t"))
    kind = F.when(fact, "fact").when(F.octet_length(note) >= 4, "memory")
    out = lines.select(key, "line", kind.alias("kind"), F.when(fact, F.lit("user")).alias("subject"), F.when(fact, x).alias("predicate"), F.when(fact, y).alias("object"), F.when(~fact, note).alias("note"))
    return out.filter("kind is not null")


def triples(answer: Column) -> Column:
    """Subject, predicate and object structs in a model's answer: an array of objects, or of arrays of three, fenced or not; else empty."""
    body = F.regexp_extract(F.regexp_replace(answer, "```[a-zA-Z]*", ""), r"(?s)(\[.*\])", 1)
    objects = F.from_json(body, "array<struct<subject: string, predicate: string, object: string>>")
    arrays = F.transform(F.filter(F.from_json(body, "array<array<string>>"), lambda a: F.size(a) == 3), lambda a: F.struct(a[0].alias("subject"), a[1].alias("predicate"), a[2].alias("object")))
    whole = lambda t: t["subject"].isNotNull() & t["predicate"].isNotNull() & t["object"].isNotNull()
    good = F.filter(objects, whole)
    return F.when(F.size(good) > 0, good).when(F.size(arrays) > 0, arrays).otherwise(F.array().cast("array<struct<subject: string, predicate: string, object: string>>"))

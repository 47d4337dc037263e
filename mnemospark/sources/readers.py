"""Readers of notes, transcripts, data sets and audit logs; each takes any path that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = "type string, sessionId string, message struct<role: string, content: string>"
AUDIT = "ts string, op string, library string, target string, actor string, before string, after string, note string, prev_hash string"


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, text): every .md file below a folder; folders that begin with a dot are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").withColumn("path", F.input_file_name())
    return files.filter(~F.col("path").rlike(r"/\.[^/]+/")).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("value").alias("text"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(session, role, text, line): what users and assistants said, ``[role] `` before it. Malformed lines are passed over.

    A message's content is a string, or a list of blocks of which the text blocks count.
    """
    rows = spark.read.text(path).select(F.from_json("value", TRANSCRIPT).alias("r"), F.col("value")).filter("r is not null and r.message is not null")
    content = F.col("r.message.content")
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    said = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    role = F.coalesce("r.message.role", "r.type")
    out = rows.select(F.col("r.sessionId").alias("session"), role.alias("role"), F.when(F.ltrim(content).startswith("["), said).otherwise(content).alias("said"))
    return out.filter("role in ('user', 'assistant') and trim(said) <> ''").select("session", "role", F.concat(F.lit("["), "role", F.lit("] "), F.trim("said")).alias("text"))


def audit_log(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Audit lines with their raw text; lines that are no JSON are passed over."""
    rows = spark.read.text(path).select(F.col("value").alias("raw"), F.from_json("value", AUDIT).alias("r")).filter("r.op is not null")
    rows = rows.select("raw", "r.*").withColumn("ts", F.try_to_timestamp("ts"))
    return rows if target is None else rows.filter(F.col("target") == target)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Procedural error and fix pairs; a bad line is an error."""
    return spark.read.schema("error string, fix string, language string, stratum string, id string, context string").option("mode", "FAILFAST").json(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions with their haystack of sessions."""
    kind = "question_id string, question_type string, question string, haystack_session_ids array<string>, haystack_sessions array<array<struct<role: string, content: string>>>, answer_session_ids array<string>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path)
    none = F.col("question_type").endswith("_abs") | (F.size(F.coalesce("answer_session_ids", F.array())) == 0)
    return rows.withColumn("abstention", none)


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): what a page's HTML shows, without scripts, styles and tags."""
    t = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.regexp_replace(t, name, c)
    return pages.select("page_id", "url", F.trim(F.regexp_replace(t, r"\s+", " ")).alias("text"))

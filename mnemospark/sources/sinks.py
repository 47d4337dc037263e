"""Sinks: chunked notes, exports, the access journal and key-value rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import ids, text

#: Characters of a chunk, about; texts that a worker holds as Python strings at once.
CHUNK, SLICE = 500, 256


def _ranges(sizes: list[int], most: int, carry: int):
    """Which pieces go together: each range is filled until the next piece, a line end before it, would pass ``most``.

    All but the first range begin with what is carried over, so their first piece may stand beyond it.
    """
    begin = filled = 0
    for k, n in enumerate(sizes):
        if filled and filled + 1 + n > most:
            yield begin, k
            begin, filled = k, min(carry, filled)
        filled = filled + 1 + n if filled else n
        if not filled:  # empty lines at the beginning carry nothing
            begin = k + 1
    yield begin, len(sizes)


def chunks_of(s: str, most: int = CHUNK) -> list[str]:
    """Lines (cut at line ends alone) packed to about ``most`` characters; each chunk repeats the end of the one before, an eighth of ``most`` or 32."""
    if len(s) <= most:
        return [s]
    lines = [x.removesuffix("\r") for x in s.removesuffix("\n").split("\n")]
    parts = [x[i : i + most] for x in lines for i in range(0, max(len(x), 1), most)]
    carry, out = max(most // 8, 32), []
    for a, b in _ranges([len(p) for p in parts], most, carry):
        out.append("\n".join([out[-1][-carry:], *parts[a:b]] if out else parts[a:b]))
    return out if out[-1].strip() else out[:-1]


def chunks(c: Column) -> Column:
    """A text's chunks; null as empty. The carry makes each chunk hang on the one before, so this is Python, by batches, of which SLICE texts at a time are strings there."""

    @F.arrow_udf("array<string>")
    def run(s: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        some = [pa.array([chunks_of(x or "") for x in s.slice(at, SLICE).to_pylist()], kind) for at in range(0, len(s), SLICE)]
        return pa.concat_arrays(some) if some else pa.array([], kind)

    return run(c)


def notes(rows: DataFrame, now: Column) -> DataFrame:
    """Rows (library, content, source, author) as memories: secrets refused, chunked, trimmed, under 3 characters dropped.

    Ids name their content, so writing twice changes nothing.
    """
    kept = rows.filter(text.secret_reason(F.col("content")).isNull())
    c = kept.select("library", "source", "author", F.explode(chunks(F.col("content"))).alias("chunk")).withColumn("content", F.trim("chunk")).filter("char_length(content) >= 3")
    c = c.select(ids.uuid5(ids.MEMORY, F.col("library"), F.col("content")).alias("id"), "library", "source", "author", "content", ids.content_hash(F.col("content")).alias("hash"))
    return c.dropDuplicates(["id"]).withColumns({"created_at": now, "updated_at": now, "type": F.lit("memory"), "quarantined": F.lit(False), "archived": F.lit(False)})


def export_json(rows: DataFrame, path: str) -> None:
    """One folder a library; rows without content are left out."""
    rows.filter("content is not null").withColumn("library", F.coalesce("library", F.lit("default"))).write.mode("overwrite").partitionBy("library").json(path)


def merge_access(journal: DataFrame, new: DataFrame) -> DataFrame:
    """(id, uses, last_access): the greater of both sides."""
    return journal.unionByName(new).groupBy("id").agg(F.max("uses").alias("uses"), F.max("last_access").alias("last_access"))


def last_values(rows: DataFrame) -> DataFrame:
    """(key, value): the last write of each key by (ts, seq)."""
    return rows.groupBy("key").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))

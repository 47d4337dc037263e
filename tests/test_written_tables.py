"""What is written and read back: pages, audit logs in blocks, a re-index that is stopped."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import auditlog, models, paging

T0 = dt.datetime(2024, 1, 1)


def test_pages_give_everything_once_and_read_few_files(spark):
    rows = [(k, None if k % 9 == 0 else T0 + dt.timedelta(minutes=k % 40), f"t{k}") for k in range(500)]
    pages = paging.Pages(spark, spark.createDataFrame(rows, "id long, created_at timestamp, text string"), files=20)
    got, after, read = [], None, []
    while True:
        read.append(len(pages.files(60, after)))
        page, after = pages.page(60, after)
        got += [r.id for r in page.orderBy(F.col("created_at").desc_nulls_last(), "id").collect()]
        if after is None:
            break
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or T0).timestamp(), r[0]))]
    assert max(read) <= 6 and len(read) == 9
    # The next page is the same whatever its reader did before.
    assert [r.id for r in pages.page(60, pages.page(60)[1])[0].collect()] == [r.id for r in pages.page(60, pages.page(60)[1])[0].collect()]
    empty = paging.Pages(spark, spark.createDataFrame([], "id long, created_at timestamp"))
    assert empty.page(5)[0].count() == 0 and empty.page(5)[1] is None


def serial(lines):
    """The rule, line by line."""
    chained = 0
    for k in range(1, len(lines)):
        try:
            link = json.loads(lines[k]).get("prev_hash")
        except ValueError:
            continue
        if link is not None:
            chained += 1
            if link != hashlib.sha256(lines[k - 1].encode()).hexdigest():
                return len(lines), chained, k + 1
    return len(lines), chained, None


@pytest.mark.parametrize("broken", [None, 2, 150, 299])
def test_audit_chain_in_blocks(spark, tmp_path, broken):
    lines = []
    for k in range(300):
        e = {"op": "add", "target": f"t{k % 5}", "n": k}
        if k > 20 and k % 50:  # the first ones are older than links, and some have none
            e["prev_hash"] = hashlib.sha256(lines[-1].encode()).hexdigest()
        lines.append("no json" if k == 77 else json.dumps(e))
    if broken is not None:
        lines[broken] = lines[broken].replace('"n"', '"m"')
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "log" / "b.jsonl").write_text("\n".join(lines[:1]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert auditlog.lines(spark, str(tmp_path / "log")).select("block").distinct().count() > 5
        got = {r.log[-7:]: (r.total, r.chained, r.broken_at) for r in auditlog.verify(spark, str(tmp_path / "log")).collect()}
        assert got == {"a.jsonl": serial(lines), "b.jsonl": (1, 0, None)}
        tail = [r.raw for r in auditlog.recent(spark, str(tmp_path / "log" / "a.jsonl"), 12).collect()]
        assert tail == lines[:-13:-1]
        some = [r.raw for r in auditlog.recent(spark, str(tmp_path / "log" / "a.jsonl"), 12, "t3").collect()]
        assert some == [x for x in tail if '"t3"' in x]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reindex_goes_on_where_it_was(spark, tmp_path):
    where = f"file://{tmp_path}"
    rows = spark.createDataFrame([(k, f"word{k} and more" if k % 7 else None) for k in range(60)], "id long, content string").withColumn("vec", F.array(F.lit(1.0))).withColumn("embed_model", F.lit("old"))
    rows.write.parquet(f"{where}/current")
    job = models.Reindex(spark, where, models.hashing(8), "new", parts=5)
    assert job.run(2) == 2 and job.finished() == [0, 1]
    with pytest.raises(ValueError):
        job.swap()
    made = {p: p.stat().st_mtime_ns for p in tmp_path.glob("fresh/part=[01]/*.parquet")}
    assert models.Reindex(spark, where, models.hashing(8), "new", parts=5).run() == 3  # another process goes on
    assert all(p.stat().st_mtime_ns == t for p, t in made.items())
    assert {r.embed_model for r in spark.read.parquet(f"{where}/current").collect()} == {"old"}
    job.swap()
    got = job.rows()
    want = models.reindex(rows, models.hashing(8), "new")
    assert sorted(map(repr, got.select("id", "vec", "embed_model").collect())) == sorted(map(repr, want.select("id", "vec", "embed_model").collect()))
    assert spark.read.parquet(f"{where}/backup").count() == 60 and job.run() == 5  # nothing fresh is left: the next run begins anew

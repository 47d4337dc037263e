"""Indexes against brute force: cells, bands and postings lose nothing that they promise to keep."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import ingest, models, retrieval, sparse, vectors


def frame(spark, x, group=None, key="id"):
    rows = [(k, [float(v) for v in row], None if group is None else group[k], k) for k, row in enumerate(x)]
    return spark.createDataFrame(rows, f"{key} long, vec array<double>, library string, place long")


def clustered(seed, n, d, centres):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((centres, d))[rng.integers(0, centres, n)] + 0.2 * rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(q, x, k, allowed=None):
    out = []
    for a, row in enumerate(np.round(q @ x.T, 6)):
        ok = [i for i in range(len(x)) if allowed is None or allowed(a, i)]
        out += [(a, i, row[i]) for i in sorted(ok, key=lambda i: (-row[i], i))[:k]]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "equal", "random"])
def test_topk(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    monkeypatch.setattr(vectors, "PART_ROWS", 64)
    x = {"clusters": clustered(1, 600, 8, 12), "equal": np.tile([0.6, 0.8], (300, 1)), "random": clustered(2, 500, 16, 500)}[kind]
    index = vectors.Index(spark, frame(spark, x), cell_rows=40)
    q = frame(spark, x[::25], key="qid")
    got = sorted((r.qid, r.id, r.score) for r in index.topk(q, 7).collect())
    assert [g[:2] for g in got] == [w[:2] for w in brute(x[::25], x, 7)] and len(index.centres) > 1
    if kind == "clusters":  # most rows are never looked at
        assert index.visited(q, 7).agg(F.avg("rows")).first()[0] < 0.4 * len(x)


def test_topk_in_groups_and_order(spark):
    x = clustered(3, 500, 6, 20)
    group = ["ab"[k % 2] if k % 5 else None for k in range(500)]
    rows = frame(spark, x, group)
    got = vectors.Index(spark, rows, "library", "place", cell_rows=50).topk(rows.withColumnRenamed("id", "qid"), 3)
    want = brute(x, x, 3, lambda a, i: group[a] == group[i] and i < a)
    assert sorted((r.qid, r.id) for r in got.collect()) == [w[:2] for w in want]


def test_within(spark):
    x = clustered(4, 400, 8, 30)
    rows = frame(spark, x)
    got = sorted((r.a, r.b) for r in vectors.Index(spark, rows, cell_rows=30).within(0.9).collect())
    s = np.round(x @ x.T, 6)
    assert got == sorted((i, j) for i in range(400) for j in range(i + 1, 400) if s[i, j] >= 0.9) and got


def test_index_odd(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [1.0]), (5, []), (6, [0.0, 0.0]), (7, [None, 1.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(9, [0.5, 0.5]), (10, None), (11, [1.0])], "qid long, vec array<double>")
    assert [(r.qid, r.id) for r in vectors.Index(spark, rows).topk(q, 5).orderBy("rank").collect()] == [(9, 1), (9, 6)]
    empty = vectors.Index(spark, rows.filter("false"))
    assert empty.topk(q, 2).count() == 0 and empty.within(0.1).count() == 0


def test_bands_find_planted_pairs(spark):
    """Pairs planted at a cosine of about 0.95 to 0.96: at least nine in ten are found, and nothing that is not near."""
    rng = np.random.default_rng(5)
    base = clustered(6, 400, 64, 400)
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.96, (400, 1))
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * noise])
    rows = frame(spark, x, ["l"] * 800)
    found = {(r.a, r.b) for r in vectors.banded_pairs(spark, rows, 0.95).collect()}
    planted = {(k, k + 400) for k in range(400)}
    assert len(found & planted) >= 0.9 * 400
    s = x @ x.T
    assert all(s[a, b] >= 0.95 - 1e-6 for a, b in found)


@pytest.mark.parametrize("exact", [True, False])
def test_merged_copies_and_chains(spark, exact):
    """Many copies of one text are one row while pairs are sought; the most preferred near one wins, within the library."""
    t = dt.datetime(2024, 1, 1)
    a, b, far = [1.0, 0.0], [0.96, 0.28], [0.0, 1.0]
    rows = [(k, "l", "short", t, a) for k in range(200)] + [(200, "l", "long text", t, b), (201, "m", "short", t, a), (202, "l", "far away", t, far), (203, None, "x", t, a), (204, None, "xy", t, a), (205, "l", None, t, None)]
    df = spark.createDataFrame(rows, "id long, library string, content string, created_at timestamp, vec array<double>")
    got = {r.id: r.winner for r in vectors.merged(spark, df, 0.95, exact).collect()}
    assert got == {k: 200 for k in range(200)} | {203: 204}


def test_sparse_looks_at_few_postings(spark):
    """Common words are in all rows, rare ones in few: all scores are those of the whole join, with a fraction of its postings."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    weight = 1.0 / np.arange(1, 401)
    texts = [" ".join(rng.choice(words, int(rng.integers(5, 60)), p=weight / weight.sum())) + (f" rare{k % 90}" if k % 3 == 0 else "") for k in range(1500)]
    rows = spark.createDataFrame([*enumerate(texts), (5000, None), (5001, ""), (5002, "w0 " * 3000)], "id long, content string")
    q = spark.createDataFrame([(k, f"w0 w1 w2 w3 rare{k} rare{k}") for k in range(30)] + [(40, None), (41, "nothing of it"), (42, "w0")], "qid long, content string")
    index = sparse.SparseIndex(spark, q, rows)
    got = sorted((r.qid, r.id, r["rank"]) for r in index.topk(10).collect())
    whole = vectors.best(index.posted.join(index.asked, "term").groupBy("qid", "id").agg(F.round(F.sum(F.col("tq") * F.col("tf") * F.col("idf")), 6).alias("score")), 10)
    assert got == sorted((r.qid, r.id, r["rank"]) for r in whole.collect()) and len(got) > 200
    w = index.work(10).filter("qid < 30").agg(F.sum("joined").alias("joined"), F.sum("whole").alias("whole"), F.sum("bounded").alias("bounded")).first()
    assert w.joined < 0.5 * w.whole and w.bounded < 0.2 * w.whole


def test_ingest_sees_its_own_batch(spark):
    """Paraphrases of each other: the second lacks new tokens, a copy of what is held is promoted, then reasserted."""
    said = ["the staging database is postgres sixteen", "postgres sixteen is the staging database", "the staging database is postgres sixteen", "hm", "hm", "hm", "rust is what she likes most of all", None]
    kinds = ["memory"] * len(said)
    c = spark.createDataFrame([(k, m, "l", t, None, "too_short" if t == "hm" else None, None) for k, (m, t) in enumerate(zip(kinds, said, strict=True))] + [(20, "procedure", None, "fix", "  ", None, None), (21, "procedure", None, "fix", "err", None, None), (22, "fact", None, "v", None, None, None), (23, "fact", None, "v", None, None, "key"), (24, "memory", "l", "token", None, None, "key")], "id long, kind string, library string, content string, trigger string, reason string, secret string")
    c = models.embed(c, models.hashing(64), "h")
    known = models.embed(spark.createDataFrame([(0, "l", "hm", True), (1, "m", "rust is what she likes most of all", False)], "id long, library string, content string, quarantined boolean"), models.hashing(64), "h")
    got = {r.id: (r.outcome, r.held) for r in ingest.run(spark, c, known).collect()}
    assert got == {
        0: ("stored_memories", None), 1: ("quarantined", "low_novelty"), 2: ("reasserted", None), 3: ("promoted", None), 4: ("reasserted", None), 5: ("reasserted", None), 6: ("stored_memories", None),
        7: ("stored_memories", None), 20: ("empty", None), 21: ("stored_procedures", None), 22: ("stored_facts", None), 23: ("skipped_secret", None), 24: ("skipped_secret", None),
    }
    assert {r.outcome for r in ingest.run(spark, c.filter("kind <> 'memory'"), known, confine=True).collect()} == {"skipped_scope_procedures", "skipped_scope_facts"}
    assert ingest.run(spark, c.filter("false"), known).count() == 0


def test_merged_near_keeps_no_pairs(spark, monkeypatch):
    """What goes and why is as by pairs, in blocks of few rows; a task hands on a row for each row and block, not for each pair."""
    monkeypatch.setattr(vectors, "LEAST_ROWS", 40)
    monkeypatch.setattr(vectors, "BATCH", 16)
    x = np.concatenate([clustered(11, 300, 8, 20), np.tile(clustered(12, 1, 8, 1), (200, 1))])
    t = dt.datetime(2024, 1, 1)
    data = [(k, ["l", "m", None][k % 3], k * 7 % 5 if k % 11 else None, None if k % 4 else t + dt.timedelta(days=k * 5 % 9), [float(v) for v in row]) for k, row in enumerate(x)]
    rows = spark.createDataFrame(data, "id long, library string, chars int, created_at timestamp, vec array<double>")
    texts = rows.withColumn("content", F.expr("repeat('x', chars)"))
    pairs = vectors.Index(spark, rows).within(0.8)
    want = {(r.id, r.winner) for r in retrieval.merge_near(pairs, texts).collect()}
    assert {(r.id, r.winner) for r in retrieval.merged_near(rows.drop("vec"), rows, 0.8, block=30).collect()} == want and len(want) > 200
    index = vectors.Index(spark, rows.filter("id >= 300").withColumn("place", F.col("id")), order="place")
    asked = index.rows.select(F.col("id").alias("qid"), "vec", "place").withColumn("floor", F.lit(0.8))
    assert index._met(index.rows, asked, 0).count() == 200 * 199 / 2 and index._met(index.rows, asked, 0, lost=True).count() < 2 * 8 * 200

"""Work that grows with the input and no faster: what is shipped, sent to every task, or looked at again."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from mnemospark.operators import analytics, duels, graph, memories, models, retrieval, vectors
from mnemospark.plans import catalog
from mnemospark.streaming import runs, streams


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors_of(spark, n, d, seed=1, key="id"):
    x = np.random.default_rng(seed).standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], f"{key} long, vec array<double>")


def test_a_vector_is_shipped_a_few_times(spark, monkeypatch):
    """Without clusters every cell is looked at, and a vector is yet shipped once a block of the other side."""
    monkeypatch.setattr(vectors, "LEAST_ROWS", 100)
    x, rows = vectors_of(spark, 800, 16)
    index = vectors.Index(spark, rows, cell_rows=20)
    assert len(index.centres) == 40
    asked = index._asked(rows.withColumnRenamed("id", "qid"))
    assert index._dealt(index.rows, asked, False).count() <= 2 * vectors.SHARE * 800
    same = index._dealt(index.rows, asked, True)
    assert same.count() <= (vectors.SHARE + 1) * 800
    got = {(r.a, r.b) for r in index.within(0.5).collect()}
    s = np.round(x @ x.T, 6)
    assert got == {(i, j) for i in range(800) for j in range(i + 1, 800) if s[i, j] >= 0.5} and got
    best = {(r.qid, r.id) for r in index.topk(rows.withColumnRenamed("id", "qid"), 4).collect()}
    assert best == {(a, int(i)) for a in range(800) for i in np.lexsort((np.arange(800), -s[a]))[:4]}


def test_novelty_makes_no_row_of_a_token(spark):
    rows = spark.createDataFrame([(1, "aa bb bb cc"), (2, "aa dd"), (3, None), (4, "cc cc x"), (5, "zz " * 3000)], "id long, content string")
    near = spark.createDataFrame([(1, 2), (1, 4), (2, 9), (3, 1), (4, 1), (4, 2), (5, 5)], "id long, other long")
    out = memories.novelty(rows, near)
    assert {r.id: r.novelty for r in out.collect()} == {1: 0.5, 2: 1.0, 3: 1.0, 4: 0.0, 5: 0.0}
    assert "Generate" not in plan(out)


def test_alike_procedures_are_sought_once(spark, monkeypatch):
    seen, real = [], retrieval.dense_topk
    monkeypatch.setattr(retrieval, "dense_topk", lambda spark, q, rows, k: seen.append((q.count(), rows.count())) or real(spark, q, rows, k))
    errors = ["disk is full now", "no such file here", "disk was full once", "port in use"]
    made = spark.createDataFrame([(k, errors[k % 4], f"fix {k}") for k in range(120)], "id long, trigger_error string, fix string")
    known = models.embed(made, models.hashing(64), "h", "trigger_error")
    asked = known.filter("id % 10 = 0").select(F.col("id").alias("qid"), F.col("trigger_error").alias("error"), "vec")
    stats = made.select("id", F.lit(True).alias("verified"), F.lit(1).alias("success_count"), F.lit(0).alias("fail_count"))
    got = {(r.qid, r["rank"]): r.id for r in retrieval.recall_procedures(spark, asked, known, stats, 2).collect()}
    assert seen == [(2, 4)]
    assert {q for q, _ in got} == set(range(0, 120, 10))
    for q in range(0, 120, 10):
        assert [got[q, k] for k in (1, 2, 3, 4)] == [q % 4 + 4 * k for k in range(4)]


def test_questions_within_texts(spark):
    """A question of one word, or of signs alone, may stand inside a longer word or between others."""
    rows = spark.createDataFrame([(1, "many cats here"), (2, "the big dog barks"), (3, "->* x"), (4, None)], "id long, content string")
    q = spark.createDataFrame([(1, "cat"), (2, "e big dog b"), (3, "->*"), (4, "Big dog"), (5, None)], "qid long, content string")
    assert sorted((r.qid, r.id) for r in retrieval.holding(q, rows).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_words_of_questions_are_not_sent_to_every_task(spark):
    q = spark.createDataFrame([(1, "what did src1 say"), (2, "nothing")], "qid long, content string")
    out = retrieval.classify_query(q, spark.createDataFrame([("src1",)], "library string"))
    assert plan(out).count("BroadcastHashJoin") <= 1
    assert {r.qid: r.libraries for r in out.collect()} == {1: "src1", 2: ""}


def test_error_rate_looks_at_no_row_again(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(k, "ab"[k % 2] if k % 7 else None, "test_passed" if k % 3 else "cited_by", k % 4 == 0, t + dt.timedelta(hours=7 * (k // 2)) if k % 11 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id long, source string, signal_type string, success boolean, ts timestamp_ntz")
    out = analytics.error_rate(df)
    assert "604800 ," not in plan(out).replace(",", " ,") and "-604800" not in plan(out)
    failed = [(s, x) for _, s, kind, ok, x in rows if kind == "test_passed" and not ok]
    inside = lambda x, y: x is None and y is None or (x is not None and y is not None and 0 <= (y - x).total_seconds() <= 604_800)
    assert {r.event_id: r.failures for r in out.collect()} == {k: sum(s == z and inside(x, y) for z, x in failed) for k, s, _, _, y in rows}


def test_names_that_begin_alike(spark):
    """Names of one beginning meet only the texts that hold them: what is joined stays few rows."""
    texts = [(k, f"{'x' * (240 + k)} user_{k} and user_ alone " + "user_77777 😀name" * (k == 3)) for k in range(40)] + [(90, None)]
    names = [(f"user_{k}",) for k in range(3000)] + [("😀name",), ("a name of more than twenty-four characters",)]
    m = spark.createDataFrame(texts, "id long, content string")
    made = graph.mentions(spark, m, spark.createDataFrame(names, "name string"), 10)
    got = {(r.id, r.name) for r in made.collect()}
    assert got == {(k, n) for k, t in texts if t for (n,) in names if n in t}
    assert "Contains" not in plan(made) and "contains" not in plan(made)


def test_unlike_pairs_of_a_band_get_no_vectors(spark):
    """The square of the rows meets in bands; what gets vectors grows with the pairs that are near."""
    x, rows = vectors_of(spark, 3000, 64)
    near = np.vstack([x, 0.99 * x[:50] + 0.05 * x[50:100]])
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    planted = {(k, 3000 + k) for k in range(50)}
    for scale in (1.0, 1.3):  # of no unit length: a score of 0.95 is a smaller cosine
        rows = spark.createDataFrame([("l", k, [float(v) for v in r]) for k, r in enumerate(near * scale)], "library string, id long, vec array<double>")
        pairs = {(r.a, r.b) for r in vectors.banded(rows, 0.95, 20, 8, 7).collect()}
        assert planted <= pairs and (scale > 1 or len(pairs) < 200)
    found = {(r.a, r.b) for r in vectors.banded_pairs(spark, rows, 0.95, 20, 8).collect()}
    assert planted <= found


def test_texts_are_not_shipped_to_be_merged(spark):
    """Merging by length and age needs no text beyond its length."""
    store = catalog.Store(spark, "/root/testdata/sf0.001")
    assert "content" not in catalog._with_vectors(store).columns
    assert catalog.QUERIES["wd16_merged_exact"](spark, "/root/testdata/sf0.001").count() == catalog.QUERIES["wd16_merged_bands"](spark, "/root/testdata/sf0.001").count()


def test_streams_call_python_once_a_bucket(spark):
    """Axes and keys by the hundred take one row of state for each bucket, and every one keeps its own values and counter."""
    at = dt.datetime(2024, 1, 1)
    writes = spark.createDataFrame([(k, f"u{k % 300}", "p", f"v{k // 300}", 1, at + dt.timedelta(hours=k), "single") for k in range(900)], "event_id long, subject string, predicate string, object string, dependants long, created_at timestamp, cardinality string")
    monkey = duels.BUCKETS, streams.BUCKETS
    duels.BUCKETS = streams.BUCKETS = 4
    try:
        run = runs.run_slices(spark, "few-duels", writes, duels.streamed, "created_at")
        got = {r.event_id: (r.verdict, r.retired) for r in run.rows().collect()}
        want = {r.event_id: (r.verdict, r.retired) for r in duels.folded(writes, "chat-only").filter("event_id is not null").collect()}
        assert got == want and len(got) == 900
        assert max(s["numRowsTotal"] for p in run.progress for s in p["stateOperators"]) <= 4
        seen = spark.createDataFrame([(f"u{k % 300}", k, k % 300 < 200 or k < 300, at + dt.timedelta(minutes=k)) for k in range(900)], "key string, seq long, drifted boolean, at timestamp")
        run = runs.run_slices(spark, "few-doubts", seen, streams.doubt_counters, "at")
        assert {r.seq: r.counter for r in run.rows().collect()} == {k: 1 + k // 300 if k % 300 < 200 or k < 300 else 0 for k in range(900)}
        assert max(s["numRowsTotal"] for p in run.progress for s in p["stateOperators"]) <= 4
    finally:
        duels.BUCKETS, streams.BUCKETS = monkey


def test_words_of_a_text_near_many_are_sent_once_a_piece(spark, monkeypatch):
    """A long text is near 40 others: its words go to the pieces that these are dealt to, and what leaves is a bit a word, not its words."""
    monkeypatch.setattr(memories, "MEETING", 15)
    rows = spark.createDataFrame([(0, " ".join(f"word{k}" for k in range(3000)))] + [(k, f"word{k} word{k} Word{k + 1} fresh{k}") for k in range(1, 41)], "id long, content string")
    near = spark.createDataFrame([(k, 0) for k in range(1, 41)] + [(k, k - 1) for k in range(2, 41)], "id long, other long")
    seen, met = [], memories.met
    monkeypatch.setattr(memories, "met", lambda own, theirs: seen.append((own.count(), theirs.filter("other = 0").count())) or met(own, theirs))
    assert {r.id: r.novelty for r in memories.novelty(rows, near).collect()} == {k: 0.25 for k in range(1, 41)}
    assert seen == [(79, 3)]
    bits = met(spark.createDataFrame([(1, 7, 0, "aa bb cc")], "id long, other long, piece long, words string"), spark.createDataFrame([(7, 0, "cc dd aa")], "other long, piece long, words string"))
    assert [tuple(r) for r in bits.collect()] == [(1, bytearray([0b10100000]))]

"""Duels, as-of joins, walks and mentions on small tables with every odd case."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import duels, facts, graph, temporal

T0 = dt.datetime(2024, 1, 1)
WRITE = "event_id long, subject string, predicate string, object string, created_at timestamp, dependants int"


def test_axis_keeps_contested_values():
    a = duels.Axis(False, 0.1)
    day = 86400.0
    assert a.write("x", 30, 0) == ("recorded", None)
    assert a.write("y", 0, 1) == ("contested", None)  # 30 dependants: entrenched 0.099
    assert a.write("x", 30, 2) == ("contested", None)  # y is visible, so x is in a conflict though it was there first
    assert a.write("z", 0, 3) == ("contested", None)
    assert {o: v[2] for o, v in a.values.items()} == {"x": "contested", "y": "contested", "z": "contested"}
    # The most entrenched one is x; with few dependants it is the one that goes.
    a.values["x"][1] = 1
    assert a.write("w", 0, 4) == ("won", "x") and a.values["x"][2:] == ["stale", 4]
    strong = duels.Axis(True, 0.1, {"old": [0.0, 10**9, "active", None]})
    assert strong.write("new", 0, 700 * day) == ("quarantined", None) and strong.values["new"][2] == "quarantine_candidate"
    assert strong.write("old", 0, 701 * day) == ("recorded", None)  # what is quarantined is no conflict


def test_ties_and_retired_values_come_back():
    a = duels.Axis(True, 0.1)
    a.write("p", 0, 0)
    assert a.write("q", 0, 0) == ("won", "p") and a.values["p"][2:] == ["superseded", 0]
    assert a.write("p", 0, 5) == ("won", "q") and a.values["p"][0] == 0  # its first date stays


def test_duels_fold(spark):
    p = spark.createDataFrame([("one", "single"), ("then", "temporal-single")], "predicate string, cardinality string")
    rows = [(k, "s", ["one", "then", "many"][k % 3], f"v{k % 4}", T0 + dt.timedelta(days=k), None if k % 7 == 0 else k % 40) for k in range(120)]
    f = spark.createDataFrame(rows, WRITE).repartition(5)
    got = {r.event_id: (r.verdict, r.retired) for r in facts.duel_on_write(f, p).collect()}
    assert len(got) == 120 and all(got[k] == ("recorded", None) for k in range(2, 120, 3))
    for k, lost in ((0, False), (1, True)):
        a = duels.Axis(lost, duels.weight("chat-only"))
        for i in range(k, 120, 3):
            at = (rows[i][4] - dt.datetime(1970, 1, 1)).total_seconds()
            assert got[i] == a.write(rows[i][3], rows[i][5] or 0, at)
        ends = {r.object: (r.status, r.valid_until) for r in facts.duelled_facts(f, p).filter(F.col("predicate") == rows[k][2]).collect()}
        assert {o: v[0] for o, v in ends.items()} == {o: v[2] for o, v in a.values.items()} and all((v[1] is None) == (v[0] not in ("stale", "superseded")) for v in ends.values())
    assert facts.duel_on_write(f.filter("false"), p).count() == 0 and facts.duelled_facts(f.filter("false"), p).count() == 0


@pytest.mark.parametrize("levels", [0, 3, 10])
def test_as_of_join(spark, levels):
    rng = random.Random(levels)
    at = lambda: None if rng.random() < 0.15 else T0 + dt.timedelta(seconds=rng.randrange(0, 4000))
    known = [(k, rng.choice(["a", "b", None]), rng.choice([None, "active", "stale", "contested", "superseded"]), rng.random() < 0.9, at(), at()) for k in range(150)]
    asked = [(k, rng.choice(["a", "b", "c", None]), at()) for k in range(100)] + [(200, "a", T0), (201, "a", T0 + dt.timedelta(seconds=3999))]
    f = spark.createDataFrame(known, "fact_id long, subject string, status string, valid boolean, created_at timestamp, valid_until timestamp")
    q = spark.createDataFrame(asked, "event_id long, subject string, at timestamp")
    got = sorted((r.event_id, r.fact_id) for r in temporal.as_of_join(q, f, levels=levels).collect())
    want = sorted((e, k) for e, s, t in asked for k, fs, status, valid, c, u in known if s is not None and s == fs and t is not None and valid and status != "contested" and (c is None or c <= t) and (u is None or t < u))
    assert got == want and got
    assert temporal.as_of_join(q.filter("false"), f).count() == 0 and temporal.as_of_join(q, f.filter("false")).count() == 0


def test_cells_cover_each_leaf_once(spark):
    pairs = [(a, b) for a in range(16) for b in range(a, 16)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("c", F.explode(temporal.cover(F.col("a"), F.col("b"), 4))).select("a", "b", "c.*")
    cells = {}
    for r in df.collect():
        cells.setdefault((r.a, r.b), []).append((r.level, r.cell))
    for (a, b), c in cells.items():
        leaves = [x for level, cell in c for x in range(cell << level, (cell + 1) << level)]
        assert sorted(leaves) == list(range(a, b + 1)) and len(c) <= 8
    assert set(cells) == set(pairs)


def test_walk_edges(spark):
    rows = [("Aurora", "deployed_on", "srv-3", True), ("srv-3 ", "located_in", "Hetzner", True), ("Hetzner", "in_country", "Germany", True), ("AURORA", "owned_by", "Mad", True), ("Hetzner", "back", "aurora", True), ("Aurora", "hidden", "x", False), (None, "p", "Aurora", True)]
    f = spark.createDataFrame(rows, "subject string, predicate string, object string, valid boolean")
    two = [(1, "AURORA", "owned_by", "Mad"), (1, "Aurora", "deployed_on", "srv-3"), (2, "srv-3 ", "located_in", "Hetzner")]
    assert sorted(map(tuple, graph.walk_edges(spark, f, " aurora", 2).collect())) == two
    three = {(3, "Hetzner", "in_country", "Germany"), (3, "Hetzner", "back", "aurora")}
    assert set(map(tuple, graph.walk_edges(spark, f, "aurora", 9).collect())) == {*two, *three}
    assert graph.walk_edges(spark, f, "nobody", 3).count() == 0 and graph.walk_edges(spark, f, "aurora", 0).count() == 0


@pytest.mark.parametrize("most", [50_000, 1])
def test_mentions(spark, most):
    """The automaton and the join of first characters find what ``contains`` finds."""
    names = ["Redis", "redis", "öl über", "日本", "日本語", "the", "cat", "concat", "xx", "rare name", "aaaa"]
    texts = ["We CONCATenate with Redis.", "Öl Über alles, 日本語", "aaaaa", "", None, "the cat and the rare  name", "THE rare name"]
    m = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    n = spark.createDataFrame([(x,) for x in [*names, *names]], "name string")
    got = sorted((r.id, r.name) for r in graph.mentions(spark, m, n, most).collect())
    assert got == sorted((k, x) for k, t in enumerate(texts) if t for x in set(names) if len(x.encode()) >= 4 and x.lower() in t.lower())
    assert graph.mentions(spark, m, n.filter("false"), most).count() == 0


def test_edit_and_learn_keep_one_row_an_id(spark):
    from mnemospark.operators import analytics, lifecycle

    rows = spark.createDataFrame([(1, "l", "a", T0), (2, "l", "b", T0), (3, "l", "c", T0)], "id long, library string, content string, created_at timestamp")
    changes = spark.createDataFrame([(1, 2, "b"), (3, 9, "z"), (7, 8, "unknown")], "id long, new_id long, new_content string")
    assert sorted((r.id, r.content) for r in lifecycle.edit(rows, changes, F.lit(T0)).collect()) == [(2, "b"), (9, "z")]
    both = spark.createDataFrame([(1, 9, "z"), (2, 9, "z")], "id long, new_id long, new_content string")
    assert sorted(r.id for r in lifecycle.edit(rows, both, F.lit(T0)).collect()) == [3, 9]
    known = spark.createDataFrame([(1, "e", "f", 4, 2, True)], "id long, trigger_error string, fix string, success_count int, fail_count int, verified boolean")
    new = spark.createDataFrame([(1, "e", "g", False), (1, "e", "h", None), (2, "x", "y", True)], "id long, trigger_error string, fix string, verified boolean")
    assert sorted(map(tuple, analytics.learn(known, new).collect())) == [(1, "e", "h", 4, 2, True), (2, "x", "y", 0, 0, True)]


def test_quarantine_refuses_secrets_and_takes_the_memory_s_id(spark):
    from mnemospark.operators import lifecycle

    held = spark.createDataFrame([], "id string, library string, content string, source string, reason string, created_at timestamp")
    new = spark.createDataFrame([("l", " hm ", None, "too_short"), ("l", "hm", None, "too_short"), ("l", "  ", None, "too_short"), ("l", None, None, "x"), ("l", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', None, "x")], "library string, content string, source string, reason string")
    got = lifecycle.add_quarantined(held, new, F.lit(T0)).collect()
    want = spark.range(1).select(lifecycle.memory_id(F.lit("l"), F.lit("hm"))).first()[0]
    assert [(r.id, r.content) for r in got] == [(want, "hm")]

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemospark.llm import op11_hard_negatives, op12_mixing, op13_alignment
from mnemospark.llm.tokens import BYTES, Encoder
from tests.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- op11


def test_negatives_against_sql(spark, duck):
    duck.execute(f"create or replace view embeddings as select * from '{SF}/embeddings.parquet'")
    df = op11_hard_negatives.op11_hard_negatives(spark, SF)
    rel = duck.sql(op11_hard_negatives.SQL)
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = df.select(*rel.columns).collect(), rel.fetchall()
    assert len(got) > 100 and sorted(map(tuple, got)) == sorted(want)


def brute_negatives(rows, anchors, positives=5, negatives=3, low=50, high=95):
    out = set()
    for a in anchors:
        label, q = rows[a]
        others = {i: (x, sum(int(u) * int(v) for u, v in zip(q, y, strict=True))) for i, (x, y) in rows.items() if i != a and len(y) == len(q)}
        best = lambda ok, k: sorted((i for i, (x, s) in others.items() if ok(x, s)), key=lambda i: (-others[i][1], i))[:k]
        for p in best(lambda x, s: x == label, positives):
            ps = others[p][1]
            for r, n in enumerate(best(lambda x, s: x != label and low * ps <= 100 * s <= high * ps, negatives), 1):  # noqa: B023
                out.add((a, p, r, n, ps, others[n][1]))
    return out


SCHEMA = "id long, label int, vec array<double>, score long, part int, side string"


@pytest.mark.parametrize("kind", ["ties", "clusters", "huge", "equal"])
def test_negatives_against_brute_force(spark, kind, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(op11_hard_negatives, "LEAF", 8)
    n, d = (300, 3) if kind != "huge" else (60, 3)
    if kind == "ties":
        x = rng.integers(-3, 4, (n, d))
    elif kind == "clusters":
        x = rng.integers(-900, 900, (6, d))[rng.integers(0, 6, n)] + rng.integers(-9, 9, (n, d))
    elif kind == "huge":
        x = rng.integers(-5, 6, (n, d)) * 2**26 + rng.integers(0, 3, (n, d))
    else:
        x = np.tile([5, 5, 5], (n, 1)) + (rng.random((n, 1)) < 0.3) * np.array([[-1, 0, 0]])
    labels = rng.integers(0, 4, n)
    rows = {i: (int(labels[i]), [float(v) for v in x[i]]) for i in range(n)}
    df = spark.createDataFrame([(i, lab, v, 0, 0, "x") for i, (lab, v) in rows.items()], SCHEMA)
    got = op11_hard_negatives.mine(spark, df, "id % 11 = 0").collect()
    assert {tuple(r) for r in got} == brute_negatives(rows, range(0, n, 11)) and len(got) == len(set(got))


def test_tree_prunes(monkeypatch):
    """On clustered rows most leaves are left out, and nothing is lost."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (40, 16))
    x = (centres[rng.integers(0, 40, 20_000)] + rng.integers(-20, 20, (20_000, 16))).astype(float)
    labels = rng.integers(0, 5, 20_000)
    tree = op11_hard_negatives.BallTree(np.arange(20_000), labels, x)
    looked = []
    leaf = tree._leaf
    monkeypatch.setattr(tree, "_leaf", lambda rows, who, *a: (looked.append(len(rows) * len(who)), leaf(rows, who, *a)))
    q = x[:50]
    scores, ids = tree.search(q, np.arange(50), labels[:50], np.full((50, 1), -(2**62)), np.full((50, 1), 2**62), 5, True)
    s = q @ x.T
    for a in range(50):
        ok = np.flatnonzero((labels == labels[a]) & (np.arange(20_000) != a))
        want = ok[np.lexsort((ok, -s[a, ok]))][:5]
        assert ids[a, 0].tolist() == want.tolist() and scores[a, 0].tolist() == s[a, want].tolist()
    assert sum(looked) < 0.25 * s.size


def test_negatives_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [2.0, 2.0]), (2, 2, [1.0, 1.0]), (3, None, [9.0, 9.0]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (7, 2, [None, 1.0]), (None, 2, [2.0, 1.0]), (8, 2, [2.0]), (9, 2, []), (2, 2, [1.0, 1.0]), (2, 3, [0.0, 0.0])]
    df = spark.createDataFrame([(i, lab, v, 0, 0, "x") for i, lab, v in rows], SCHEMA)
    assert [tuple(r) for r in op11_hard_negatives.mine(spark, df, "id = 0").collect()] == [(0, 1, 1, 2, 6, 3)]
    assert op11_hard_negatives.mine(spark, df.filter("false"), "id = 0").count() == 0


# --- op12


def test_mixing_against_sql(spark, duck):
    df = op12_mixing.op12_mixing(spark, SF)
    rel = duck.sql(op12_mixing.SQL)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_mixing_plan_is_native(spark):
    plan = op12_mixing.op12_mixing(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_mixing_hits_targets(spark):
    got = op12_mixing.mix(spark, spark.read.parquet(f"{SF}/documents.parquet")).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(total)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 2 * max(r.size for r in rows)
        assert rows[0].target <= 3 * rows[0].source_size and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in rows)


def shares(sizes):
    """Resharing as the words of the task put it, in fractions."""
    from fractions import Fraction

    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    done, open_ = {}, set(sizes)
    while open_:
        rest, w = Fraction(sum(sizes.values())) - sum(done.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] > 3 * sizes[s] * w}
        if not over:
            return done | {s: rest * weight[s] / w for s in open_}
        done |= {s: Fraction(3 * sizes[s]) for s in over}
        open_ -= over
    return done


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 80, 4000]) for s in ["a", "b", "", "Z", "é", None, "zz", "b2"][: 3 + seed]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in op12_mixing.targets(df).collect()}
    assert got == pytest.approx({s: float(x) for s, x in shares(sizes).items()})


def test_mixing_odd(spark, odd, none):
    got = op12_mixing.mix(spark, odd.withColumn("source", F.when(F.col("doc_id") > 5, "s")))
    assert "rank" in odd.columns and sorted(got.columns) == ["copies", "doc_id", "size", "source", "source_size", "taken", "target"]
    rows = got.collect()
    assert len(rows) == odd.count() and {r.doc_id: r.size for r in rows}[1] == 0 and {r.doc_id: r.size for r in rows}[4] == 60_000
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, op12_mixing.mix(spark, odd.withColumn("source", F.when(F.col("doc_id") > 5, "s")).repartition(7)).collect()), key=repr)
    assert op12_mixing.mix(spark, none).count() == 0


def test_mixing_one_hot_source(spark):
    """Equal rows of one source: as many copies as the target asks for, whatever the parts."""
    df = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.when(F.col("id") % 100 == 0, "a").otherwise("b").alias("source"), F.lit("one two").alias("text"))
    rows = op12_mixing.mix(spark, df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    for r in rows:
        assert abs(r.taken - r.target) <= 2 and r.most <= 3


# --- op13


@given(st.text(alphabet=st.sampled_from(list("abEé ß\n.,'!3§日\t-<|>")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_ordinary_memo_is_exact(text):
    e, direct = _tools()[:2]
    for t in (text, f"{text}<|endoftext|> x", f"<|endoftext|>{text}"):
        if t:
            assert e.texts([" a", " " + t])[1] == np.array(direct.encode(" " + t, add_special_tokens=False).ids, "<u4").tobytes()


_made = []


def _tools():
    if not _made:
        direct = Tokenizer.from_file(A)
        direct.encode_special_tokens = True
        _made.extend([Encoder(A, True, ordinary=True), direct, sentencepiece.SentencePieceProcessor(model_file=B)])
    return _made


def brute_alignment(texts):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, sha)] by the words of the task."""
    _, tok, sp = _tools()
    back = {c: b for b, c in BYTES.items()}
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a = [(i, bytes(back[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + t, add_special_tokens=False).ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(t)]
        whole = (" " + t).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append(None)
            continue
        ends = [list(itertools.accumulate(len(x) for _, x in y)) for y in (a, b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for c in common:
            sides = []
            for k, y in enumerate((a, b)):
                n = ends[k].index(c) + 1
                sides.append([i for i, _ in y[at[k] : n]])
                at[k] = n
            groups.append("|".join(",".join(map(str, s)) for s in sides))
        links = [(i, j) for (i, x), e in zip(a, ends[0], strict=True) for (j, y), f in zip(b, ends[1], strict=True) if max(e - len(x), f - len(y)) < min(e, f)]
        docs.append((len(a), len(b), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for d in docs if d for p in set(d[3]))
    most = {}
    for (i, _), n in count.items():
        most[i] = max(n, most.get(i, 0))
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(count[p] == most[p[0]] for p in d[3]), sum(count[p] for p in d[3]), d[4]) for d in docs]


@pytest.mark.parametrize("sent", [200_000, 50])
def test_alignment_against_brute_force(spark, small, monkeypatch, sent):
    """The same whether all pairs or only the most frequent ones are sent out."""
    monkeypatch.setattr(op13_alignment, "BROADCAST_ROWS", sent)
    some = [t for t in list(small.values())[:60] if t is None or len(t) < 3000]
    texts = [*some, None, "", " ", "a", "  two  blanks ", "日本語のテキスト, größer!", "<|endoftext|> <s> <0x0A> <unk>", "tab\there\n\nand\r\nthere", "▁low", " x　y", "x" * 500, "á̈́ é ﬁ", "\x00\x01 b", *some[:3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("a", F.lit("x")).repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in op13_alignment.align(spark, df, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert [got[k] for k in range(len(texts))] == brute_alignment(texts)


def test_alignment_odd(spark, odd, none):
    got = op13_alignment.align(spark, odd, A, B).collect()
    assert len(got) == odd.count() and {r.doc_id: r.n_a for r in got}[1] == 0 and {r.doc_id: r.n_a for r in got}[4] > 60_000
    assert [r.n_links == r.n_a + r.n_b - r.n_groups for r in got] == [True] * len(got)
    assert op13_alignment.align(spark, none, A, B).count() == 0


def test_links_of_many_texts_at_once():
    """Tokens of random lengths: texts of a batch are cut, linked and written as if each stood alone."""
    rng = np.random.default_rng(3)
    table = [b"x" * n for n in range(1, 40)]
    tool = op13_alignment._Bytes(table)
    parts = lambda total: np.array([n - 1 for n in np.diff([0, *sorted(rng.choice(np.arange(1, total), min(total - 1, int(rng.integers(total // 8, total))), replace=False)), total])])
    sides = [(parts(n), parts(n)) for n in rng.integers(20, 30, 200)]
    counts = [np.array([len(s[k]) for s in sides]) for k in (0, 1)]
    pairs, n_links, n_groups, text = op13_alignment.links(np.concatenate([a for a, _ in sides]), tool, np.concatenate([b for _, b in sides]), tool, *counts)
    ends = np.cumsum(n_links)
    for k, (a, b) in enumerate(sides):
        ea, eb = np.cumsum(a + 1), np.cumsum(b + 1)
        want = [(int(i) << 32) + int(j) for x, i in zip(ea, a, strict=True) for y, j in zip(eb, b, strict=True) if max(x - i - 1, y - j - 1) < min(x, y)]
        assert pairs[ends[k] - n_links[k] : ends[k]].tolist() == want
        common = sorted({*ea} & {*eb})
        cut = lambda ids, e: [",".join(str(i) for i, x in zip(ids, e, strict=True) if lo < x <= hi) for lo, hi in zip([0, *common], common, strict=False)]  # noqa: E731, B023
        assert n_groups[k] == len(common) and text[k].decode() == ";".join(f"{x}|{y}" for x, y in zip(cut(a, ea), cut(b, eb), strict=True))

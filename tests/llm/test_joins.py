import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from mnemospark.llm import op4_ngram_join, op8_line_dedup
from mnemospark.llm.common import text_bytes
from mnemospark.llm.components import connected_components
from tests.conftest import SF


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(-50, 50, (60, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    want = {x: u.find(x) for x in u.up}
    df = spark.createDataFrame([*edges, (None, 1)], "x long, y long")
    assert {r.node: r.component for r in connected_components(spark, df, "x", "y").collect()} == want
    assert connected_components(spark, df.limit(0), "x", "y").count() == 0


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(texts, k, percent):
    sets, u, post = {i: shingles(t, k) for i, t in texts.items()}, Union(), defaultdict(list)
    for i, s in sets.items():
        u.find(i)
        met = Counter(j for x in s for j in post[x])
        for j, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                u.join(i, j)
        for x in s:
            post[x].append(i)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, percent, paired, weight", [(4, 85, 10, 2_000_000), (5, 80, 10, 2_000_000), (4, 85, 1, 3_000)])
def test_jaccard_against_brute_force(spark, small, monkeypatch, k, percent, paired, weight):
    """Also with every meeting a crowd, and components cut into many blocks."""
    monkeypatch.setattr(op4_ngram_join, "PAIRED", paired)
    monkeypatch.setattr(op4_ngram_join, "BLOCK_WEIGHT", weight)
    base = " ".join(f"w{i}" for i in range(120)).split()
    texts = dict(small)
    for v in range(40):  # a chain of near copies, each an edit from the one before
        base[3 * v] = f"e{v}"
        texts[10_000 + v] = " ".join(base)
    texts |= {20_000 + v: " ".join(f"long{(i * 7 + i // 50) % 3000}" for i in range(v, 6000)) for v in range(0, 60, 20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op4_ngram_join.jaccard_components(spark, docs, k, percent).collect()}
    assert got == brute(texts, k, percent)


def test_jaccard_odd(spark, odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in op4_ngram_join.jaccard_components(spark, odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (6, 2, 6), (7, 2, 6), (10, 1, 10), (None, 2, None)} <= got and {x for x in got if x[0] == 5}.pop()[2] == 4
    assert op4_ngram_join.jaccard_components(spark, odd).count() == 12 and op4_ngram_join.jaccard_components(spark, none).count() == 0


def brute_lines(texts):
    lines = defaultdict(list)
    for i, t in texts.items():
        for k, x in enumerate(t.split("\n")):
            n = op8_line_dedup.normalised(x)
            if len(n.split()) >= op8_line_dedup.LEAST_WORDS:
                lines[n].append((i, k))
    keys, u = list(lines), Union()
    sims = np.array([op8_line_dedup.line_table(*text_bytes(pa.array([x])))["sim"][0] for x in keys], np.int64).view(np.uint64)
    for i, x in enumerate(keys):
        u.find(i)
        for j in np.flatnonzero(np.bitwise_count(sims[:i] ^ sims[i]) <= op8_line_dedup.RADIUS):
            if op8_line_dedup.alike(x, keys[j]):
                u.join(i, int(j))
    groups = defaultdict(list)
    for i, x in enumerate(keys):
        groups[u.find(i)] += lines[x]
    return {o for g in groups.values() for o in g if o != min(g)}


@pytest.mark.parametrize("paired", [256, 1])
def test_lines_against_brute_force(spark, small, monkeypatch, paired):
    monkeypatch.setattr(op8_line_dedup, "PAIRED", paired)
    texts = dict(sorted(small.items())[:120])
    words = [f"word{k}" for k in range(150)]
    texts |= {9_000 + v: "\n".join([" ".join(w if i != 17 * v else f"x{v}" for i, w in enumerate(words)), "Of."]) for v in range(6)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    gone = brute_lines(texts)
    for r in op8_line_dedup.dedup_lines(spark, docs).collect():
        assert r.text == "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, k) not in gone)
        assert r.n_dropped == sum(i == r.doc_id for i, _ in gone)


def test_lines_odd(spark, odd, none):
    got = op8_line_dedup.dedup_lines(spark, odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 12 and rows[1].text is None and rows[1].n_lines == 0 and rows[2].text == "" and rows[7].text == "" and rows[None].text == "a row without id here" and rows[5].text == ""
    assert op8_line_dedup.dedup_lines(spark, none).count() == 0


def test_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("ab c"), rng.integers(0, 14))) for _ in range(2))
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        assert op8_line_dedup.edit_distance(a, b) == p[-1]
        n = max(len(a), len(b))
        assert op8_line_dedup.alike(a, b) == (1 - p[-1] / n >= 0.8 if n else True)


def test_whole_query(spark, small):
    got = op4_ngram_join.op4_ngram_join(spark, SF)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(small, 4, 85)


def test_lines_by_edit_similarity_alone(spark):
    """Lines of 5 to 50 words, and copies with words or letters changed: what is linked is what edit similarity says, whatever the SimHashes."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(2000)]
    lines = []
    for n in [5, 6, 8, 10, 15, 20, 30, 40, 50] * 8:
        x = [str(w) for w in rng.choice(words, n)]
        lines.append(" ".join(x))
        for share in (0.0, 0.1):
            y = list(x)
            for i in rng.choice(n, max(1, round(share * n)), replace=False):
                y[i] = str(rng.choice(words))
            lines.append(" ".join(y))
        z = list(lines[-1])
        for i in rng.choice(len(z), max(1, len(z) // 40), replace=False):
            z[i] = "q"
        lines.append("".join(z))
    u = Union()
    for i, x in enumerate(lines):
        u.find(i)
        for j in range(i):
            if op8_line_dedup.alike(x, lines[j]):
                u.join(i, j)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id for r in op8_line_dedup.dedup_lines(spark, docs).collect() if r.n_dropped}
    want = {i for i in range(len(lines)) if u.find(i) != i}
    assert len(want) > 150 and got == want


def test_lines_short_and_without_blanks(spark):
    """Copies of short lines, of lines without a word and of scripts without blanks go, near copies of the latter too; blank lines stay."""
    han = "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少床前明月光疑是地上霜"
    near = han.replace("声", "音")
    texts = ["Of.\n\n* * *\n" + han, "of\n\n* * *\n" + han, "\n  \nAnd so\n" + near, "and so!\nกรุงเทพมหานคร", "กรุงเทพมหานคร\n---\nnew"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in op8_line_dedup.dedup_lines(spark, docs).collect()}
    assert got == {0: texts[0], 1: "", 2: "\n  \nAnd so", 3: "กรุงเทพมหานคร", 4: "---\nnew"}


def test_lines_found_whatever_else_shares_their_words(spark, monkeypatch):
    """Near copies with letters changed go, alone and where each pair of their words stands in nine more lines, in crowds and many at a time too."""
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters, rng.integers(4, 9)))
    lines, others = [], []
    for _ in range(30):
        x = [word() for _ in range(14)]
        y = list(x)
        for i in rng.choice(14, 5, replace=False):
            y[i] = y[i][:2] + "0" + y[i][3:]
        lines += [" ".join(x), " ".join(y)]
        for a, b, c, d in zip(x, x[1:], y, y[1:]):
            if (a, b) == (c, d):
                others += [" ".join([*(word() for _ in range(6)), a, b, *(word() for _ in range(6))]) for _ in range(9)]
    want = {k for k in range(len(lines)) if k % 2}
    gone = lambda texts: {r.doc_id for r in op8_line_dedup.dedup_lines(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect() if r.n_dropped}
    assert gone(lines) == want
    assert gone(lines + others) == want
    monkeypatch.setattr(op8_line_dedup, "CROWD", 9)
    monkeypatch.setattr(op8_line_dedup, "PAIRED", 1)
    monkeypatch.setattr(op8_line_dedup, "HELD", 10)
    assert gone(lines + others) == want


def test_many_edit_distances_at_once():
    rng = np.random.default_rng(6)
    text = lambda: "".join(rng.choice(list("ab é日"), int(rng.integers(1, 200))))
    a = [text() for _ in range(150)]
    b = ["".join(c for c in x if rng.random() > 0.1) + "z" for x in a[:100]] + [text() for _ in range(50)]
    assert op8_line_dedup.edit_distances(a, b).tolist() == [op8_line_dedup.edit_distance(x, y) for x, y in zip(a, b, strict=True)]
    assert op8_line_dedup.all_alike(a, b).tolist() == [op8_line_dedup.alike(x, y) for x, y in zip(a, b, strict=True)]


def test_near_lines_leave_a_task_as_lines_not_pairs():
    """400 lines that are near each other at one seed beyond KIN bits: a row each leaves the task, where 79,800 pairs did; each pair is verified once, however many seeds it shares."""
    rng = np.random.default_rng(7)
    rows = np.zeros(400, op8_line_dedup._ROW)
    bits = rng.random((400, 128)) < 0.18
    rows["k1"], rows["chars"] = np.arange(400), op8_line_dedup._log(np.full(400, 60))
    rows["sim"], rows["sim2"] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T
    batch = pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["part", "rows"])
    out = pa.Table.from_batches(list(op8_line_dedup._near([batch])))
    assert out.num_rows < 2 * 400 and {*out.filter(pa.compute.invert(out["star"]))["a"].to_pylist()} > {*range(100)}
    lines = ["one two three four five six seven eight", "one two three four five six seven night", "other words " * 4]
    pdf = pd.DataFrame([(key, k, k, lines[k], [5, 9], (1 << 33) - 1 if k == 1 else 0, 0, None) for key in (5, 9) for k in range(3)], columns=["key", "k1", "k2", "text", "keys", "sim", "sim2", "component"])
    assert op8_line_dedup._verified(pdf)[["a1", "b1"]].to_numpy().tolist() == [[0, 1]]


def test_passage_shared_by_unlike_documents_joins_none_of_them(spark, monkeypatch):
    """A crowd at a shingle that counts as rare is no weak component: what is shipped to be verified is the three that are near, not all 600."""
    monkeypatch.setattr(op4_ngram_join, "FREQUENT", 0)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = {i: f"{passage} " + " ".join(f"u{i}x{k}" for k in range(120 + i % 7)) for i in range(600)}
    texts |= {1000 + i: texts[5] + f" end{i}" * i for i in range(3)}
    seen, count = [], op4_ngram_join.block_counts

    def counted(rows, weight, most):
        seen.append(rows.count())
        return count(rows, weight, most)

    monkeypatch.setattr(op4_ngram_join, "block_counts", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in op4_ngram_join.jaccard_components(spark, docs).collect()}
    assert got == {i: c for i, (_, c) in brute(texts, 4, 85).items()} and got[1002] == 5
    assert seen[-1] < 10


def test_parity_bits_of_unlike_widths_never_refuse_a_near_pair():
    rng = np.random.default_rng(3)
    for n in (3, 127, 129, 500, 1023, 4100):
        a = rng.integers(1, 2**63, n).astype(np.uint64)
        b = np.r_[a[: n - n // 20], rng.integers(1, 2**63, n // 10).astype(np.uint64)]
        far = [rng.integers(1, 2**63, len(b)).astype(np.uint64) for _ in range(30)]
        sets = [a, b, *far]
        rep, root = op4_ngram_join.crowd_stars(np.arange(32), np.array([len(s) for s in sets]), [op4_ngram_join.parity(s) for s in sets], 85)
        pairs = {frozenset(p) for p in zip(rep.tolist(), root.tolist(), strict=True)}
        assert n < 20 or pairs == {frozenset((0, 1))}


def test_texts_of_near_lines_take_turns_and_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(11)
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "ijklmnop"]
    base = [" ".join(rng.choice(words, 14, replace=False)) for _ in range(6)]
    texts = {}
    for i in range(90):
        w = base[i % 6].split()
        for at in rng.choice(14, 2, replace=False):
            w[at] = words[rng.integers(64)]
        texts[i] = "\n".join([" ".join(w), f"own{i} of{i * 7}"])
    docs = spark.createDataFrame([*texts.items(), (3, "another text of the same id"), (3, texts[3])], "doc_id long, text string").repartition(4)
    put, names, got = op8_line_dedup.Scratch.put, [], []
    monkeypatch.setattr(op8_line_dedup.Scratch, "put", lambda self, df, name, **o: names.append(name) or put(self, df, name, **o))
    for share in (0, 2):
        monkeypatch.setattr(op8_line_dedup, "SHARE", share)
        names.clear()
        got.append(sorted((r.doc_id, r.text, r.n_dropped) for r in op8_line_dedup.dedup_lines(spark, docs).collect()))
    assert got[0] == got[1] and sum(r[2] for r in got[0]) > 60
    assert "links3" in names and "met" not in names

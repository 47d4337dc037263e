import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mnemospark.llm import op2_pii, op3_licenses, op7_decontamination
from mnemospark.llm.common import text_bytes
from mnemospark.llm.suffix_automaton import SuffixAutomaton
from tests.conftest import SF

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def phrases(t):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return len(w), sorted((i, label) for p, label in op3_licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_licences_against_brute_force(spark, small):
    got = {r.doc_id: r for r in op3_licenses.op3_licenses(spark, SF).collect()}
    for i, t in small.items():
        n, found = phrases(t)
        places = [p for p, _ in found] or [None]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(found), places[0], places[-1], ",".join(sorted({x for _, x in found})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licences_random_words():
    lic, rng = op3_licenses.Licences(), random.Random(3)
    words = "gnu general public license apache cc by mit the is free software under x é of".split()
    for _ in range(500):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        s = lic.scan(t)
        assert (s.n_words, s.base) == phrases(t)


def test_licence_spans_survive_edits():
    lic = op3_licenses.Licences()
    label, t = op3_licenses.TEMPLATES[0]
    words = t.split()
    words[10] = "CHANGED"
    spans = lic.scan("lead in " + " ".join(words) + " tail").spans
    assert any(k == label and share > 0.7 for *_, k, share in spans) and not lic.scan("the free software is licensed to any person").spans


def test_matching_statistics():
    rng = random.Random(5)
    for _ in range(20):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 8))] for _ in range(5)]
        auto = SuffixAutomaton()
        for k, s in enumerate(seqs):
            auto.add(s, k)
        factors = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        x = [rng.randint(0, 3) for _ in range(25)]
        assert [n for _, n in auto.walk(x)] == [max(n for n in range(i + 2) if not n or tuple(x[i + 1 - n : i + 1]) in factors) for i in range(25)]


@pytest.mark.parametrize("scan", [lambda s, d: op3_licenses.scan_licences(d), lambda s, d: op2_pii.find_pii(s, d, None)])
def test_odd(spark, odd, none, scan):
    assert scan(spark, odd).count() == 12 and scan(spark, none).count() == 0


#: The patterns as they are given.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(t):
    found = []
    for k, kind in enumerate(op2_pii.KINDS):
        for m in re.finditer(GIVEN[kind], t or ""):
            d = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and sum(x // 10 + x % 10 for x in twice) % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), k, m.end()))
    return [(a, b, op2_pii.KINDS[k]) for a, k, b in sorted(found)]


def test_base_spans(small):
    hand = ["a.b+c@x.example.org, 10.0.0.256 1.2.3.4.5 4111 1111 1111 1111; +1 (743) 555-3824.", "4111111111111112 +12 é 1.2.3.4", "a@b", "0001.2.3.4 0000255.1.1.1"]
    rng = random.Random(6)
    hand += ["".join(rng.choice("ab.@@-1299+. ( ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in [*small.values(), *hand]:
        assert op2_pii.base_spans(t) == brute_spans(t), t
    long = "9" * 200_000 + "@" + "a" * 200_000 + " 1.2.3.4"
    assert [k for *_, k in op2_pii.base_spans(long)] == ["ip"]


def test_field(spark, small):
    docs = spark.createDataFrame(list(small.items()), "doc_id long, text string")
    model = op2_pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert op2_pii.train(docs.limit(0)) is None
    secret = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    t = f'une token = "{secret}" enon. ' + "mot " * 40 + f"et {secret} seul, 12 chats en 2024"
    added = op2_pii.added_spans(t, op2_pii.base_spans(t), model)
    assert [t[a:b] for a, b, _ in added] == [secret] * 2 and {k for *_, k in added} == {"secret"}  # the second by its skip edge
    got = op2_pii.find_pii(spark, docs, model).collect()
    for r in got:
        base = [f"{k}:{a}:{b}" for a, b, k in op2_pii.base_spans(small[r.doc_id])]
        assert set(base) <= set(r.spans.split(",")) | set() and r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)


def test_propagation_is_exact_on_a_tree():
    rng = np.random.default_rng(2)
    unary, adj, skip = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=(3, 3))
    skip = skip + skip.T
    edges, jumps = np.array([[0, 1], [1, 2]]), np.array([[0, 3]])
    want = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        w = np.exp(sum(unary[i, y[i]] for i in range(4)) + adj[y[0], y[1]] + adj[y[1], y[2]] + skip[y[0], y[3]])
        for i in range(4):
            want[i, y[i]] += w
    want /= want.sum(axis=1, keepdims=True)
    assert np.abs(op2_pii.propagate(unary, edges, jumps, adj, skip) - want).max() < 1e-3


def slow_align(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(item))


def test_alignment():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64)
        assert op7_decontamination.align(a, b) == slow_align(a, b)


def test_decontamination(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    edited = [x for i, x in enumerate(w) if i != 6]
    edited[11:11] = ["NEW"]
    lead = " ".join(f"lead{k}" for k in range(300))
    docs = [(1, f"{lead} {item.upper()}, {lead}"), (2, f"{lead} {' '.join(edited)} {lead}"), (3, lead), (4, " ".join(w[:5]) + " " + lead), (5, None), (6, ""), (1, f"{lead} {item.upper()}, {lead}")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, "tiny one"), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in op7_decontamination.contaminated(spark, docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1] == 1 and 0.6 < got[2, 1] < 1
    assert sorted(r.doc_id for r in op7_decontamination.decontaminate(spark, docs, items).collect()) == [3, 4, 5, 6]
    assert op7_decontamination.contaminated(spark, none, items).count() == 0
    assert op7_decontamination.contaminated(spark, docs, items.limit(0)).count() == 0
    assert op7_decontamination.decontaminate(spark, odd, items).count() == 12


def test_decontamination_finds_all_copies(spark, small, duck):
    got = {(r.doc_id, r.item_id) for r in op7_decontamination.op7_decontamination(spark, SF).collect()}
    want = set(duck.sql("select doc_id, item_id from documents d, benchmark b where contains(d.text, b.text)").fetchall())
    assert want <= got and len(got) <= len(want) + 3


def test_decontamination_edited_copy_beside_exact_ones(spark):
    """Exact leaks raise the counts of an item's n-grams; an edited copy that holds the commonest of them is found all the same."""
    w = [f"word{k}" for k in range(30)]
    edited = " ".join("NEW" if k % 5 == 4 else x for k, x in enumerate(w))
    docs = [(k, f"lead{k} {' '.join(w)} tail{k}") for k in range(3)] + [(3, f"lead {edited} tail")] + [(k, f"other{k} text of its own") for k in range(4, 40)]
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    got = {r.doc_id: r.score for r in op7_decontamination.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(got) == {0, 1, 2, 3} and got[3] == pytest.approx(op7_decontamination.align(*(op7_decontamination.word_hashes(*text_bytes(pa.array([x])))[0] for x in (" ".join(w), edited))))

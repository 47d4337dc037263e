import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemospark.llm import op1_packing, op5_token_files, op9_exact_dedup
from mnemospark.llm.elias_fano import EliasFano
from mnemospark.llm.tokens import Encoder
from tests.conftest import SF

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def direct(path):
    t = Tokenizer.from_file(path)
    return lambda s: np.array(t.encode(s or "", add_special_tokens=False).ids, "<u4")


def test_exact_against_sql(spark, duck):
    got = {tuple(r) for r in op9_exact_dedup.op9_exact_dedup(spark, SF).collect()}
    assert got == {tuple(r) for r in duck.sql(op9_exact_dedup.SQL).fetchall()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_exact_odd(spark, odd, none, monkeypatch, broadcast):
    monkeypatch.setattr(op9_exact_dedup, "small", lambda df: broadcast)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in op9_exact_dedup.refine(spark, odd).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (4, 5, 2, False), (5, 5, 2, True), (6, 7, 3, False), (7, 7, 3, True), (9, 9, 1, True)} <= got and len(got) == 11
    assert op9_exact_dedup.refine(spark, none).count() == 0


def test_exact_plan_is_native(spark):
    plan = op9_exact_dedup.op9_exact_dedup(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@given(st.lists(st.integers(0, 2**40), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = sorted(values)
    e = EliasFano.from_bytes(EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert e.all().tolist() == values and [e.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        e.select(len(values))


@given(st.text(alphabet=st.sampled_from(list("abEé ß\n.,'!3§日\t-")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_memo_is_exact(text):
    for path, keeps in ((BYTE, True), (WORD, False)):
        e = _encoder(path, keeps)
        assert e.texts([text, "x " + text])[0] == direct_of(path)(text).tobytes()


_made = {}


def _encoder(path, keeps):
    if path not in _made:
        _made[path] = Encoder(path, keeps)
    return _made[path]


def direct_of(path):
    if f"direct {path}" not in _made:
        _made[f"direct {path}"] = direct(path)
    return _made[f"direct {path}"]


def test_memo_on_documents(small):
    for path, keeps in ((BYTE, True), (WORD, False)):
        e, texts = _encoder(path, keeps), [*small.values(), None, "", "<|endoftext|> a", "a  b ", " a", "x\x01y", "á b"]
        assert e.texts(texts) == [direct_of(path)(t).tobytes() for t in texts]


def test_token_files(spark, small):
    at, want = 0, set()
    for i in sorted(small):
        a = np.append(direct_of(BYTE)(small[i]), 2).astype("<u4")
        want.add((i, at, len(a), zlib.crc32(a.tobytes())))
        at += len(a)
    assert {tuple(r) for r in op5_token_files.op5_token_files(spark, SF).collect()} == want


def test_token_files_odd(spark, odd, none, tmp_path):
    m = op5_token_files.write_tokens(spark, odd, BYTE, f"file://{tmp_path}/a", 2).cache()
    got = op5_token_files.read_tokens(spark, m).orderBy("start").collect()
    assert len(got) == 12 and [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10] and got[1].n_tokens == 1
    assert all(b.start == a.start + a.n_tokens for a, b in itertools.pairwise(got))
    f = op5_token_files.TokenFile(m.orderBy("shard").first().path)
    assert f.document(0)[-1] == 2 and f.doc_id(0) is None
    empty = op5_token_files.write_tokens(spark, none, BYTE, f"file://{tmp_path}/b", 2)
    assert op5_token_files.read_tokens(spark, empty).count() == 0


def check_packed(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, small):
    rows = op1_packing.op1_packing(spark, SF).collect()
    want, total = Counter(), 0
    for i, t in small.items():
        a = np.append(direct_of(WORD)(t), 1).astype("<u4")
        total += len(a)
        for k, at in enumerate(range(0, len(a), 4096)):
            part = a[at : at + 4096]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    assert check_packed(rows) <= -(-total // 4096) + 1


def test_packing_odd(spark, odd, none):
    rows = op1_packing.pack_documents(spark, odd, WORD).collect()
    check_packed(rows)
    assert sum(r.doc_id == 7 for r in rows) == 2 and sum(r.doc_id in (1, 2, 3) and r.length == 1 for r in rows) == 3
    assert op1_packing.pack_documents(spark, none, WORD).count() == 0


def test_packing_rounds(spark):
    rows = spark.createDataFrame([(k, 30 + k % 61) for k in range(600)], "id long, length long")
    got = op1_packing.pack(spark, rows, capacity=100, block=50).collect()
    assert len(got) == 600 and check_packed(got, 100) < 420


@given(st.lists(st.integers(1, 60), min_size=1, max_size=60))
@settings(max_examples=80, deadline=None)
def test_local_search_never_worse(lengths):
    first = op1_packing.best_fit(lengths, 60)
    bins = op1_packing.local_search([b[:] for b in first], lengths, 60)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 60 for b in bins) and len(bins) <= len(first)


@given(st.lists(st.sampled_from(["hello", " ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "\n", "wörld", "it's", ",", "don't,", "—", "A,b", "é,", "9.", "'s", "..."]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_plain_calls(parts):
    text = "".join(parts)
    for path, keeps in ((BYTE, True), (WORD, False)):
        assert _encoder(path, keeps).texts([text, None, "a " + text]) == [direct_of(path)(t).tobytes() for t in (text, None, "a " + text)]


def test_memo_forgets(small, monkeypatch):
    """Few places and a small pool: words push each other out, and all are forgotten now and then."""
    from mnemospark.llm import tokens

    monkeypatch.setattr(tokens, "SLOTS", 64)
    monkeypatch.setattr(tokens, "POOL", 5_000)
    texts = [t[:3_000] for t in list(small.values())[:150]]
    for path, keeps in ((BYTE, True), (WORD, False)):
        e = Encoder(path, keeps)
        assert [x for k in range(0, 150, 10) for x in e.texts(texts[k : k + 10])] == [direct_of(path)(t).tobytes() for t in texts]


@given(st.lists(st.integers(0, 2**34), max_size=900), st.integers(0, 900), st.integers(0, 900))
@settings(max_examples=100, deadline=None)
def test_elias_fano_runs(values, a, b):
    values = sorted(values)
    a, b = sorted((min(a, len(values)), min(b, len(values))))
    e = EliasFano.from_bytes(EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert e.selects(a, b).tolist() == values[a:b]


def test_token_width(tmp_path):
    for width in (2, 4):
        uri = f"file://{tmp_path}/w{width}.bin"
        if width == 2:
            with pytest.raises(ValueError):
                op5_token_files.write_file(uri, iter([(1, np.array([70_000], "<u4").tobytes())]), 2)
        else:
            op5_token_files.write_file(uri, iter([(1, np.array([70_000], "<u4").tobytes())]), 4)
            assert op5_token_files.TokenFile(uri).document(0).tolist() == [70_000]


def test_local_search_goes_on():
    """Pieces of which best fit leaves much room: the search saves bins, and goes on past bins that resist."""
    rng = np.random.default_rng(3)
    lengths = rng.integers(1000, 1800, 400).tolist()
    first = op1_packing.best_fit(lengths, 4096)
    bins = op1_packing.local_search([b[:] for b in first], lengths, 4096)
    assert sorted(i for b in bins for i in b) == list(range(400)) and all(sum(lengths[i] for i in b) <= 4096 for b in bins)
    assert len(bins) < len(first) - 2

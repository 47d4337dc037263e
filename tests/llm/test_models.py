import itertools

import numpy as np
import pyarrow as pa

import corpus_pipeline
from mnemospark.llm import op6_language, op10_quality
from mnemospark.llm.common import Scratch
from tests.conftest import SF


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, a = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    starts = np.array([0, 4, 5])
    want = np.zeros((7, 3))
    for first, end in ((0, 4), (4, 5), (5, 7)):
        part = np.zeros((end - first, 3))
        for y in itertools.product(range(3), repeat=end - first):
            w = np.exp(sum(e[first + i, k] for i, k in enumerate(y)) + sum(a[p, q] for p, q in itertools.pairwise(y)))
            for i, k in enumerate(y):
                part[i, k] += w
        want[first:end] = part / part.sum(axis=1, keepdims=True)
    assert np.abs(op6_language.marginals(e, starts, a) - want).max() < 1e-9


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op6_language.op6_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_code_switching(spark):
    model = op6_language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = op6_language.word_labels(model, "the thing and that ereath anonhath the with leviment éelle les queai pas dans léeau les")
    assert [x for _, x, _ in got[:4]] == ["en"] * 4 and [x for _, x, _ in got[-4:]] == ["fr"] * 4


def test_language_odd(spark, odd, none):
    model = op6_language.train(odd)
    got = {r.doc_id: r for r in op6_language.identify(spark, odd, model, keep=True).collect()}
    assert len(got) == 11 and all(got[i]["__lang_pred"] == "und" for i in (1, 2, 3, 8)) and got[4]["__lang_pred"] in ("en", "de", "fr") and got[4].key == "k"
    assert op6_language.identify(spark, none, model).count() == 0
    nothing = op6_language.train(none)
    assert {r.lang_pred for r in op6_language.identify(spark, odd, nothing).collect()} == {"und"}


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op10_quality.op10_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert labels.count() and all(r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (8, 0), (8, None), (None, 1)], "doc_id long, quality int")
    got = op10_quality.classify(spark, odd, labels)
    assert got.count() == 12 and all(0 <= r.score <= 1 for r in got.collect())
    assert {r.score for r in op10_quality.classify(spark, odd, labels.limit(0)).collect()} == {0.5}
    assert op10_quality.classify(spark, none, labels).count() == 0


def test_isotonic():
    knots, values = op10_quality.pool(np.arange(6.0), np.array([0, 1, 0, 1, 1, 1.0]), np.ones(6))
    assert np.all(np.diff(values) > 0) and values[0] == 0 and values[-1] == 1 and len(knots) == len(values)


def test_statistics_by_hand():
    x = op10_quality.statistics(pa.array(["THE END!! THE END!! THE END!!\nTHE END!! THE END!! THE END!!", None, ""]))
    s = dict(zip(op10_quality.STATS, x[0], strict=True))
    assert s["distinct_words"] == 2 / 12 and s["doubled_lines"] == 0.5 and s["marked_words"] == 0.5 and not x[1].any() and not x[2].any()


def test_pipeline(spark, small, odd, none):
    scratch, docs = Scratch(spark, "test-pipeline"), spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.put(stage(spark, docs, SF), f"{k}_{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.count() <= before
            before, docs = out.count(), out
    kept = {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in t for t in kept.values() for i in items) and len(kept) > 0.8 * len(small)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(kept)
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == len(kept)


def test_pipeline_stages_odd(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
        assert stage(spark, odd, SF).count() > 0

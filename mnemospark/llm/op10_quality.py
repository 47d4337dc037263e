"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Each document becomes ``len(STATS)`` statistics of its whole text. Random Fourier features of the
standardised statistics approximate a Gaussian kernel. Tasks sum the normal equations of their
labelled rows; the sums are added up over a tree, so the driver gets a few matrices however many rows
there are. A fifth of the labelled rows is kept from the fit for the calibration, whose input is a
histogram of scores.

Defined cases: null text counts as empty, and empty text has statistics like any other; labels of
null are left out; a document labelled twice counts twice; without labelled rows every score is 0.5;
repeated rows are rows of their own; no rows, no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import Scratch, pieces, text_bytes
from mnemospark.llm.texthash import span_hashes, spans, words_of

FEATURES, RIDGE, BINS = 384, 1e-3, 2000
STATS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "mark", "rare_mark", "not_ascii", "blank",
    "same_as_before", "distinct_words", "line_bytes", "log_lines", "capital_words", "sentence_ends", "doubled_lines", "marked_words",
)
_CLASS = np.zeros((7, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CLASS[3] = _CLASS[2]
_CLASS[3, [ord(c) for c in ".,;:'\"()-?"]] = False
_CLASS[4, 128:] = True
_CLASS[5, [9, 10, 11, 12, 13, 32]] = True
_CLASS[6, [ord(c) for c in ".?!"]] = True


def statistics(texts: pa.Array) -> np.ndarray:
    raw, offsets = text_bytes(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    per = np.maximum(size, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    upper, digit, mark, odd, high, blank, stop = (count(c[raw]) for c in _CLASS)
    starts, ends, of = words_of(raw, offsets)
    words = np.bincount(of, minlength=n)
    h = span_hashes(raw, starts, ends)
    some = np.maximum(words, 1)

    def distinct(h: np.ndarray, of: np.ndarray) -> np.ndarray:
        """How many items of each text differ."""
        if not len(h):
            return np.zeros(n, np.int64)
        order = np.lexsort((h, of))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])]
        return np.bincount(of[order][new], minlength=n)

    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    caps = _CLASS[0][raw[starts]] & _CLASS[0][raw[np.minimum(starts + 1, ends - 1)]] & (ends - starts > 1) if len(starts) else np.zeros(0, bool)
    marked = _CLASS[3][raw[ends - 1]] if len(starts) else np.zeros(0, bool)
    ls, le = spans(raw != 10, offsets)
    l_of = np.searchsorted(offsets, ls, side="right") - 1
    lines = np.bincount(l_of, minlength=n)
    l_some = np.maximum(lines, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), (size - blank) / some, upper / per, digit / per, mark / per, odd / per, high / per, blank / per,
        np.bincount(of, weights=again, minlength=n) / some, distinct(h, of) / some, np.log1p(size / l_some), np.log1p(lines),
        np.bincount(of, weights=caps, minlength=n) / some, np.minimum(stop / some, 1), (lines - distinct(span_hashes(raw, ls, le), l_of)) / l_some,
        np.bincount(of, weights=marked, minlength=n) / some,
    ])


class Fourier:
    """cos(x w + b) of standardised statistics; fixed by its seed."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, gamma: float = 0.06, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, np.sqrt(2 * gamma), (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones(len(x))])


def pool(scores: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of bins in ascending score by pooling adjacent violators: knots and their values."""
    blocks: list[list[float]] = []
    for s, y, w in zip(scores, ones, n, strict=True):
        blocks.append([y, w, s * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fit(spark: SparkSession, labelled: DataFrame) -> dict | None:
    """The model from rows (doc_id, x array<double>, y); labelled is read several times: a written table."""
    k = len(STATS)
    at = [F.col("x")[i] for i in range(k)]
    row = labelled.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)]).first()
    if not row["n"]:
        return None
    mean, scale = np.array([row[f"m{i}"] for i in range(k)]), np.array([max(row[f"s{i}"], 1e-6) for i in range(k)])
    z = Fourier(mean, scale)
    keep = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0
    if not labelled.filter(~keep).limit(1).count():
        return None
    size = FEATURES + 1

    def sums(batches):
        total = np.zeros((size, size + 1))
        for b in batches:
            f = z(np.stack(b.column("x").to_numpy(zero_copy_only=False)))
            y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
            total += f.T @ np.column_stack([f, y])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"total": [sum(np.frombuffer(x) for x in pdf["total"]).tobytes()]})

    part = labelled.filter(~keep).mapInArrow(sums, "total binary")
    for groups in (1024, 32):  # a tree of sums: the driver gets 32 matrices at most
        part = part.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("g")).applyInPandas(add, "total binary")
    total = sum(np.frombuffer(r["total"]) for r in part.collect()).reshape(size, size + 1)
    n = total[-1, size - 1]
    beta = np.linalg.solve(total[:, :size] + RIDGE * n * np.eye(size), total[:, size])
    shared = spark.sparkContext.broadcast((z, beta))

    def score(batches):
        z, beta = shared.value
        for b in batches:
            s = z(np.stack(b.column("x").to_numpy(zero_copy_only=False))) @ beta if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(s, -0.5, 1.5) * BINS).astype(np.int64)), b.column("y")], ["bin", "y"])

    held = labelled.filter(keep) if labelled.filter(keep).limit(1).count() else labelled
    bins = held.select("x", "y").mapInArrow(score, "bin long, y int").groupBy("bin").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    rows = sorted((r["bin"], r["y"], r["n"]) for r in bins.collect())  # at most 2 * BINS + 1
    knots, values = pool(*(np.array(c, float) for c in zip(*[((b + 0.5) / BINS, y, n) for b, y, n in rows], strict=True)))
    return {"z": z, "beta": beta, "knots": knots, "values": values}


def stats_of(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in pieces(batches, "text"):
            x = statistics(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "x"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(run, "doc_id long, x array<double>")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text), learned from labels (doc_id, quality)."""
    scratch = Scratch(spark, "quality")
    x = scratch.put(stats_of(docs), "statistics")
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y is not null and doc_id is not null")
    model = fit(spark, scratch.put(x.join(y, "doc_id"), "labelled"))
    if model is None:
        return x.select("doc_id", F.lit(0.5).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            if b.num_rows:
                s = m["z"](np.stack(b.column("x").to_numpy(zero_copy_only=False))) @ m["beta"]
                s = np.clip(np.interp(s, m["knots"], m["values"]), 0, 1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return x.mapInArrow(run, "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = classify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.filter(~out))
    return found.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))

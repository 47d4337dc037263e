"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

1. Every document's words are looked up for n-grams of the items (``SEED`` words). All n-grams of an
   item are seeds: how often one occurs says nothing, as the leaks themselves are counted.
2. Of the passages around seeds, those that lack too many of the item's words to reach the threshold
   are passed over; no alignment could score more than the share of words that are there.
3. Around its seeds a document is aligned with the item, word by word: match 2, mismatch and gap -1.
   The score is the best alignment over that of the item with itself; from ``CONTAMINATED`` on the
   document holds the item, copied, edited or cut.

Items are taken in blocks of ``ITEMS``, each a pass over the documents: only a block's words and
n-grams are sent out, however long the benchmark is.

Defined cases: null or empty text holds nothing; items of fewer than SEED words use all their words as
one seed; empty items are never found; repeated rows of an id are reported for each row's text once
(the best score of an id and item counts); no rows or no items, no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import Scratch, hinted, pieces, text_bytes
from mnemospark.llm.texthash import LOWER_LUT, MULT, mix, span_hashes, words_of

SEED, CONTAMINATED, ITEMS = 4, 0.5, 5_000
MATCH, MISS, GAP = 2, -1, -1
_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each lower-cased word, and the text it stands in."""
    low = LOWER_LUT[raw]
    starts, ends, of = words_of(low, offsets, _APART)
    return span_hashes(low, starts, ends), of


def grams(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.zeros(0, np.uint64)
    s = h[: len(h) - n + 1] * MULT[0]
    for j in range(1, n):
        s += h[j : len(h) - n + 1 + j] * MULT[j]
    return mix(s)


class Items:
    """Words of a block of items, and where each n-gram stands in them."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        h, of = word_hashes(*text_bytes(pa.array([t for _, t in rows], pa.string())))
        self.ids = [i for i, _ in rows]
        self.words = [h[of == k] for k in range(len(rows))]
        g, item, at = [], [], []
        self.sizes = sorted({min(SEED, len(w)) for w in self.words if len(w)})
        for k, w in enumerate(self.words):
            if len(w):
                x = grams(w, min(SEED, len(w)))
                g.append(x ^ np.uint64(min(SEED, len(w))))
                item.append(np.full(len(x), k))
                at.append(np.arange(len(x)))
        self.gram = np.concatenate(g) if g else np.zeros(0, np.uint64)
        self.item, self.at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (item, at))
        self.keys = np.unique(self.gram)

    def hits(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions of documents at which an n-gram of the items begins, and which n-gram."""
        places, found = [], []
        for n in self.sizes:
            g = grams(h, n) ^ np.uint64(n)
            k = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            at = np.flatnonzero((self.keys[k] == g) & (of[: len(g)] == of[n - 1 : n - 1 + len(g)]))
            places.append(at)
            found.append(k[at])
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def align(item: np.ndarray, passage: np.ndarray) -> float:
    """The best local alignment's score over the item's with itself; a row of the table at a time."""
    if not len(item) or not len(passage):
        return 0.0
    steps = np.arange(len(passage)) * -GAP
    row, best = np.zeros(len(passage), np.int64), 0
    for w in item:
        diagonal = np.r_[0, row[:-1]] + np.where(passage == w, MATCH, MISS)
        x = np.maximum(np.maximum(diagonal, row + GAP), 0)
        row = np.maximum.accumulate(x + steps) - steps  # gaps in the item: the best start to the left
        best = max(best, int(row.max()))
    return best / (MATCH * len(item))


def passages(at: np.ndarray, in_item: np.ndarray, size: int, end: int) -> list[tuple[int, int]]:
    """Stretches of a document in which the item may stand, given its seeds' places in both; each holds the item with slack."""
    slack, out = size // 2 + 4, []
    for p, q in sorted(zip(at.tolist(), in_item.tolist(), strict=True)):
        a, b = max(0, p - q - slack), min(end, p - q + size + slack)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = CONTAMINATED) -> DataFrame:
    """(doc_id, item_id, score) of every document (doc_id, text) that holds an item (item_id, text)."""
    scratch = Scratch(spark, "decontamination")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out, block, k = spark.createDataFrame([], "doc_id long, item_id long, score double"), [], 0
    rows = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).toLocalIterator()
    while True:
        block = [tuple(r) for _, r in zip(range(ITEMS), rows)]
        if not block:
            return out
        found = scratch.put(_block(spark, Scratch(spark, "decontamination-block"), docs, Items(block), threshold), f"found{k}")
        out, k = (found if not k else out.unionByName(found)), k + 1


def _block(spark: SparkSession, scratch: Scratch, docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    shared = spark.sparkContext.broadcast(items)

    def seen(batches):
        for b in pieces(batches, "text"):
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            h, of = word_hashes(*text_bytes(b.column("text")))
            at, g = shared.value.hits(h, of)
            if len(at):
                pairs = np.unique(np.stack([of[at], g], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]], pa.int64(), from_pandas=True), pa.array(pairs[:, 1].astype(np.int32))], ["doc_id", "gram"])

    held = scratch.put(docs.mapInArrow(seen, "doc_id long, gram int"), "held")
    index = np.searchsorted(items.keys, items.gram) if len(items.keys) else items.item
    pairs = {(int(g), int(i)) for g, i in zip(index, items.item, strict=True)}
    lookup = spark.createDataFrame(sorted(pairs), "gram int, item int")  # as many rows as the block has n-grams
    wanted = held.join(F.broadcast(lookup), "gram").groupBy("doc_id").agg(F.collect_set("item").alias("items"))
    wanted = scratch.put(wanted, "wanted")
    seeds = spark.sparkContext.broadcast(index)

    def score(batches):
        items, index = shared.value, seeds.value
        seed_of = {}
        for g, i, q in zip(index.tolist(), items.item.tolist(), items.at.tolist(), strict=True):
            seed_of.setdefault((g, i), []).append(q)
        for b in pieces(batches, "text"):
            ids, wanted = b.column("doc_id").to_pylist(), b.column("items").to_pylist()
            h, of = word_hashes(*text_bytes(b.column("text")))
            at, g = items.hits(h, of)
            first = np.searchsorted(of, np.arange(b.num_rows + 1))
            found = []
            for d in range(b.num_rows):
                a, e = first[d], first[d + 1]
                mine = (at >= a) & (at < e)
                places, which = (at[mine] - a).tolist(), g[mine].tolist()
                for i in wanted[d]:
                    p, q = [], []
                    for x, y in zip(places, which, strict=True):
                        for z in seed_of.get((y, i), ()):
                            p.append(x)
                            q.append(z)
                    item = items.words[i]
                    at_seeds = [h[a + s : a + t] for s, t in passages(np.array(p, np.int64), np.array(q, np.int64), len(item), int(e - a))]
                    best = max((align(item, x) for x in at_seeds if np.isin(item, x).sum() / len(item) >= threshold), default=0.0)
                    if best >= threshold:
                        found.append((ids[d], items.ids[i], best))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["doc_id", "item_id", "score"])

    scored = docs.join(hinted(wanted), "doc_id").mapInArrow(score, "doc_id long, item_id long, score double")
    return scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = CONTAMINATED) -> DataFrame:
    """The rows of docs that hold no item."""
    bad = contaminated(spark, docs, items, threshold).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(hinted(bad), F.col("doc_id").cast("long") == F.col("__bad"), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

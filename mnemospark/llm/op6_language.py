"""Language identification by a linear-chain conditional random field over words.

Every word has hashed features: byte bigrams and trigrams with word ends, a prefix and a suffix, and
the word itself (the lexicon). A chain is a line, cut every ``CHAIN`` words. Transitions are learned
from chains in which passages of different languages follow one another, so the model labels
code-switched text; forward-backward gives each word's label probabilities, and a document's are their
mean. All of a batch's words are scored at once in numpy.

Training uses a sample of ``SAMPLE`` rows a language at most; prediction covers every word of every text.

Defined cases: text that is null or has no letter is ``und`` with score 1; text whose letters make no
word known to the model still gets the likeliest label; no labelled rows: everything is ``und``, score
0 where the text has letters; repeated rows are rows of their own; no rows, no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import drawn, pieces, text_bytes
from mnemospark.llm.texthash import LOWER_LUT, span_hashes, spans

SAMPLE, SAMPLE_CHARS, CHAIN, BITS = 300, 20_000, 128, 16
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin letters, bytes that are no letters as blanks."""
    low = LOWER_LUT[raw]
    if len(low) > 1:
        up = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
        low[1:][up] += 0x20
    low[~_LETTER[raw]] = 32
    return low


class Words:
    """The words of many texts: their features' places in the weight tables, their chains and texts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        low = fold(raw)
        self.starts, self.ends = spans(low != 32, offsets)
        self.n = len(self.starts)
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        if not self.n:
            return
        # Every byte of a word stands for the bigram and trigram that it ends; a word's last letter also for those past its end.
        pad = np.concatenate([[32, 32], low, [32, 32]]).astype(np.uint32)
        size = self.ends - self.starts + 1
        self.first = np.cumsum(size) - size
        self.word = np.repeat(np.arange(self.n), size)
        at = np.arange(len(self.word)) - np.repeat(self.first - self.starts, size) + 2
        last = np.zeros(len(at), bool)
        last[self.first + size - 1] = True
        own = np.where(last, 32, pad[at])
        head = np.zeros(len(at), bool)
        head[self.first] = True
        second = np.zeros(len(at), bool)
        second[self.first[size > 1] + 1] = True
        b1 = np.where(head, 32, pad[at - 1])
        b2 = np.where(head | second, 32, pad[at - 2])
        self.two = ((b1 << 8) | own).astype(np.int64)
        tri = (b2 << np.uint32(16)) | (b1 << np.uint32(8)) | own
        self.three = ((tri * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
        top = np.uint64(64 - BITS)
        self.whole = (span_hashes(low, self.starts, self.ends) >> top).astype(np.int64)
        self.prefix = (span_hashes(low, self.starts, np.minimum(self.starts + 4, self.ends)) >> top).astype(np.int64)
        self.suffix = (span_hashes(low, np.maximum(self.ends - 4, self.starts), self.ends) >> top).astype(np.int64)
        # A chain: the words of one line of one text, CHAIN at most.
        line = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(raw == 10, out=line[1:])
        new = np.r_[True, (self.text[1:] != self.text[:-1]) | (line[self.starts[1:]] != line[self.starts[:-1]])]
        begin = np.flatnonzero(new)
        rank = np.arange(self.n) - np.repeat(begin, np.diff(np.r_[begin, self.n]))
        self.chain_starts = np.flatnonzero(rank % CHAIN == 0)

    def emissions(self, m: dict) -> np.ndarray:
        e = np.add.reduceat(m["two"][self.two] + m["three"][self.three], self.first, axis=0)
        return e + m["whole"][self.whole] + m["prefix"][self.prefix] + m["suffix"][self.suffix] + m["bias"]


def marginals(e: np.ndarray, chain_starts: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Label probabilities of each word, all chains side by side; with ``pairs`` also the expected transitions and the log of the sums."""
    n, k = e.shape
    top = e.max(axis=1, keepdims=True)
    p, a = np.exp(e - top), np.exp(trans)
    length = np.diff(np.r_[chain_starts, n])
    order = np.argsort(-length, kind="stable")
    begin, length = chain_starts[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    alpha, scale = np.empty_like(p), np.empty(n, p.dtype)
    for t, m in enumerate(active):
        at = begin[:m] + t
        x = p[at] if not t else (alpha[at - 1] @ a) * p[at]
        s = x.sum(axis=1)
        alpha[at], scale[at] = x / s[:, None], s
    beta = np.ones_like(p)
    expected = np.zeros((k, k))
    for t in range(len(active) - 1, 0, -1):
        at = begin[: active[t]] + t
        y = beta[at] * p[at] / scale[at][:, None]
        beta[at - 1] = y @ a.T
        if pairs:
            expected += (alpha[at - 1].T @ y) * a
    out = alpha * beta
    out /= out.sum(axis=1, keepdims=True)
    return (out, expected, float(np.log(scale).sum() + top.sum())) if pairs else out


def switched(rows: list[tuple[str, int]], rng: np.random.Generator, passages: int) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Lines made of one to four passages of 4 to 24 words, of languages drawn evenly; their labels as (label, words)."""
    by: dict[int, list[list[str]]] = {}
    for text, y in rows:
        if words := text.split():
            by.setdefault(y, []).append(words)
    labels, lines, said = sorted(by), [], []
    for _ in range(passages):
        parts, ys = [], []
        for _ in range(int(rng.integers(1, 5))):
            y = labels[int(rng.integers(len(labels)))]
            words = by[y][int(rng.integers(len(by[y])))]
            n = int(rng.integers(4, 25))
            at = int(rng.integers(max(1, len(words) - n + 1)))
            parts.append(" ".join(words[at : at + n]))
            ys.append(y)
        lines.append(parts)
        said.append(ys)
    return lines, said


def fit(rows: list[tuple[str, str]], passages: int = 6000, steps: int = 90, seed: int = 7) -> dict:
    """Adam on the chains' log-likelihood with a small ridge penalty."""
    langs = sorted({y for _, y in rows})
    k, rng = len(langs), np.random.default_rng(seed)
    m = {name: np.zeros((1 << BITS, k), np.float32) for name in ("two", "three", "whole", "prefix", "suffix")}
    m |= {"bias": np.zeros(k, np.float32), "trans": np.zeros((k, k), np.float32), "langs": langs}
    if k < 2:
        return m
    lines, said = switched([(t, langs.index(y)) for t, y in rows], rng, passages)
    moments = {name: (np.zeros_like(m[name]), np.zeros_like(m[name])) for name in m if name != "langs"}
    batches = []
    for at in range(0, passages, 1000):
        texts = pa.array([" ".join(x) for x in lines[at : at + 1000]])
        w = Words(*text_bytes(texts))
        if not w.n:
            continue
        # Every part's words keep the part's label: parts are found again by where they start in the line.
        y = np.zeros(w.n, np.int64)
        _, offsets = text_bytes(texts)
        cuts, labels = [], []
        for i, (parts, ys) in enumerate(zip(lines[at : at + 1000], said[at : at + 1000], strict=True)):
            pos = int(offsets[i])
            for part, label in zip(parts, ys, strict=True):
                cuts.append(pos)
                labels.append(label)
                pos += len(part.encode()) + 1
        y = np.array(labels)[np.searchsorted(np.array(cuts), w.starts, side="right") - 1]
        batches.append((w, y))
    for step in range(1, steps + 1):
        w, y = batches[step % len(batches)]
        prob, expected, _ = marginals(w.emissions(m), w.chain_starts, m["trans"], pairs=True)
        g = prob.copy()
        g[np.arange(w.n), y] -= 1
        inner = np.ones(w.n, bool)
        inner[w.chain_starts] = False
        seen = np.zeros((k, k))
        np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
        grads = {"bias": g.sum(axis=0), "trans": expected - seen}
        for name, idx, of in (("two", w.two, w.word), ("three", w.three, w.word), ("whole", w.whole, None), ("prefix", w.prefix, None), ("suffix", w.suffix, None)):
            grads[name] = np.stack([np.bincount(idx, weights=g[of, c] if of is not None else g[:, c], minlength=1 << BITS) for c in range(k)], axis=1)
        for name, (a, b) in moments.items():
            d = (grads[name] / w.n + 1e-6 * m[name]).astype(np.float32)
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            m[name] -= (0.08 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return m


def sample(docs: DataFrame, each: int = SAMPLE) -> list[tuple[str, str]]:
    """About ``each`` rows a language, drawn by a hash of their text; texts over SAMPLE_CHARS are left to others."""
    rows = docs.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map([x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    got: dict[str, list[str]] = {}
    for r in rows.filter(drawn(F.col("text"), share[F.col("lang")])).limit(3 * each * len(counts)).collect():
        got.setdefault(r["lang"], []).append(r["text"])
    return [(t, lang) for lang in sorted(got) for t in sorted(got[lang])[: 2 * each]]


def word_labels(m: dict, text: str) -> list[tuple[str, str, float]]:
    """Each word of a text with its likeliest language and that label's probability."""
    raw, offsets = text_bytes(pa.array([text]))
    w = Words(raw, offsets)
    if not w.n or not m["langs"]:
        return []
    p = marginals(w.emissions(m), w.chain_starts, m["trans"])
    return [(bytes(raw[a:b]).decode("utf-8", "replace"), m["langs"][i], float(q)) for a, b, i, q in zip(w.starts, w.ends, p.argmax(axis=1), p.max(axis=1), strict=True)]


def document_scores(m: dict, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    raw, offsets = text_bytes(texts)
    n = len(offsets) - 1
    w = Words(raw, offsets)
    total = np.zeros((n, max(1, len(m["langs"]))))
    if w.n and m["langs"]:
        p = marginals(w.emissions(m), w.chain_starts, m["trans"])
        for c in range(p.shape[1]):
            total[:, c] = np.bincount(w.text, weights=p[:, c], minlength=n)
    words = np.bincount(w.text, minlength=n) if w.n else np.zeros(n, np.int64)
    mean = total / np.maximum(words, 1)[:, None]
    ascii_ = np.r_[0, np.cumsum(_LETTER[raw] & (raw < 128))]
    sure = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    letters = [bool(s) or (bool(k) and any(map(str.isalpha, bytes(raw[a:b]).decode("utf-8", "replace")))) for s, k, a, b in zip(sure, words, offsets[:-1], offsets[1:], strict=True)]
    label = [m["langs"][i] if ok and m["langs"] else "und" for ok, i in zip(letters, mean.argmax(axis=1), strict=True)]
    score = np.where(letters, np.clip(mean.max(axis=1), 0, 1), 1.0)
    return label, score


def identify(spark: SparkSession, docs: DataFrame, model: dict, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text); with ``keep``, docs' own columns, then __lang_pred, __score."""
    shared = spark.sparkContext.broadcast(model)
    own, new = (docs.columns, ["__lang_pred", "__score"]) if keep else (["doc_id"], ["lang_pred", "score"])

    def run(batches):
        for b in pieces(batches, "__text"):
            label, score = document_scores(shared.value, b.column("__text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(label), pa.array(score)], [*own, *new])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    docs = docs.select(*own, F.coalesce("text", F.lit("")).alias("__text"))
    return docs.mapInArrow(run, f"{kinds}, {new[0]} string, {new[1]} double")


def held_out(c: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> dict:
    return fit(sample(docs.filter(~held_out())))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

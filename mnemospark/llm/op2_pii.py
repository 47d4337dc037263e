"""Personal data: exact base patterns, and a skip-chain conditional random field that adds to them.

The base kinds (email, ip, card, phone) are found by their patterns in the whole text. The field labels
every blank-separated token that holds a digit or an ``@``, with those kinds, ``secret`` or none. Its
factors: features of the token and its neighbours; pairs of adjacent tokens; and skip edges between
repeated or similar tokens anywhere in the document (each with the one before it, so edges grow with
tokens, not with their pairs). Loopy sum-product passes messages over all edges, so what one place
makes plain holds for its other occurrences. Tokens sure of a kind that no base span covers are added.

The factors are learned piecewise on about ``SAMPLE`` documents that hold candidates, drawn by a hash, labelled by the
base patterns and by values assigned to secret-like names.

Defined cases: null text counts as empty and has no spans; spans are in code points, end exclusive;
without a sample nothing is added; repeated rows are rows of their own; no rows, no result.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import drawn, pieces, text_bytes

SAMPLE, SAMPLE_CHARS, BITS, ROUNDS, SURE = 2_000, 20_000, 14, 12, 0.9
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS, "secret")
#: The base patterns. The ip pattern begins at the start of a run of digits and gives no digit back,
#: which changes no match and keeps very long runs linear.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The email pattern's parts on either side of the @, the first read backwards.
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]*"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_TOKEN, _HELD, _DIGIT, _SECRET = re.compile(r"\S+"), re.compile("[0-9@]"), re.compile("[^0-9]"), re.compile(r"[A-Za-z0-9_\-+/]{20,}")
_NAMES = {"token", "secret", "password", "passwd", "key", "api_key", "apikey", "access_key", "auth"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _holds(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "email":
        return True
    digits = _DIGIT.sub("", s)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def _emails(text: str) -> list[tuple[int, int]]:
    """What the email pattern finds, sought from each @: the pattern itself would try every place of a long token."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        local = _LOCAL.match(text[end:at][::-1]).end()
        if local and (domain := _DOMAIN.match(text, at + 1)):
            found.append((at - local, domain.end()))
            end = domain.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by the kinds' order."""
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        if kind == "email":
            found += [(a, b, k) for a, b in _emails(text)]
            continue
        if kind == "phone" and "+" not in text:
            continue
        found += [(m.start(), m.end(), k) for m in pattern.finditer(text) if _holds(kind, m[0])]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


class Tokens:
    """The candidates of a text with their features' places and their edges."""

    def __init__(self, text: str) -> None:
        words = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        said = [text[a:b] for a, b in words]
        self.at = [i for i, w in enumerate(said) if _HELD.search(w)]
        self.spans, self.features, keys = [], [], []
        for i in self.at:
            w = said[i]
            core = w.strip("\"'()[]{}<>,;:!?.*#&%$=")
            a = words[i][0] + (w.find(core) if core else 0)
            self.spans.append((a, a + len(core)))
            near = [said[j].lower() if 0 <= j < len(said) else "" for j in (i - 2, i - 1, i + 1)]
            self.features.append(self._features(core, near))
            keys.append("".join(c for c in core.lower() if c.isalnum()))
        adjacent = [(k, k + 1) for k in range(len(self.at) - 1) if self.at[k + 1] == self.at[k] + 1]
        last: dict[str, int] = {}
        skip = set()
        for k, key in enumerate(keys):
            # Repeated: equal letters and digits; similar: equal length and beginning.
            for mark in (key, f"{len(key)}:{key[:8]}"):
                if len(key) >= 5:
                    if mark in last and self.at[k] - self.at[last[mark]] > 1:
                        skip.add((last[mark], k))
                    last[mark] = k
        self.adjacent, self.skip = np.array(adjacent, np.int64).reshape(-1, 2), np.array(sorted(skip), np.int64).reshape(-1, 2)

    @staticmethod
    def _features(core: str, near: list[str]) -> list[int]:
        digits = _DIGIT.sub("", core)
        shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in core))[:24]
        kind = "hex" if re.fullmatch("[0-9a-f]+", core.lower()) else "digits" if core.isdigit() else "other"
        names = [w.strip("\"'=:") for w in near[:2]]
        said = [
            "bias", f"shape {shape}", f"size {min(len(core), 48) // 4}", f"digits {min(len(digits), 20)}", f"kind {kind} {len(core) >= 20}", f"at {core.count('@')}",
            f"dots {min(core.count('.'), 4)}", f"plus {core[:1] == '+'}", f"luhn {len(digits) >= 14 and luhn(digits)}", f"base {[k for k, p in PATTERNS.items() if (m := p.fullmatch(core)) and _holds(k, m[0])]}",
            f"before {shape_of(near[1])}", f"after {shape_of(near[2])}", f"named {any(w in _NAMES for w in names)}", f"named {any(w in _NAMES for w in names)} {kind} {len(core) >= 20}",
        ]
        return [zlib.crc32(s.encode()) % (1 << BITS) for s in said]


def shape_of(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in word))[:6]


def weak_labels(text: str, t: Tokens) -> np.ndarray:
    """What the patterns say of each candidate, and values of secret-like names."""
    y = np.zeros(len(t.spans), np.int64)
    base = base_spans(text)
    for k, (a, b) in enumerate(t.spans):
        for s, e, kind in base:
            if s < b and a < e:
                y[k] = LABELS.index(kind)
        before = text[max(0, a - 24) : a].lower()
        if not y[k] and _SECRET.fullmatch(text[a:b]) and any(n in before for n in _NAMES) and ("=" in before or ":" in before):
            y[k] = LABELS.index("secret")
    return y


def fit(texts: list[str], steps: int = 120) -> dict | None:
    """Piecewise: the token factors by multinomial logistic regression, the edges by how labels go together."""
    rows, ys, edges = [], [], {"adjacent": [], "skip": []}
    for text in texts:
        t = Tokens(text)
        if not t.spans:
            continue
        y = weak_labels(text, t)
        rows += t.features
        ys.append(y)
        for name, e in (("adjacent", t.adjacent), ("skip", t.skip)):
            if len(e):
                edges[name].append(np.stack([y[e[:, 0]], y[e[:, 1]]], axis=1))
    if not rows:
        return None
    x, y, k = np.array(rows), np.concatenate(ys), len(LABELS)
    w, speed = np.zeros((1 << BITS, k), np.float32), np.full((1 << BITS, k), 1e-3, np.float32)
    for _ in range(steps):
        p = _softmax(w[x].sum(axis=1))
        p[np.arange(len(y)), y] -= 1
        g = np.stack([np.bincount(x.ravel(), weights=np.repeat(p[:, c], x.shape[1]), minlength=1 << BITS) for c in range(k)], axis=1) / len(y)
        speed += g * g
        w -= (0.3 * g / np.sqrt(speed)).astype(np.float32)
    share = (np.bincount(y, minlength=k) + 0.5) / (len(y) + 0.5 * k)
    tables = {}
    for name, found in edges.items():
        both = np.full((k, k), 0.0)
        np.add.at(both, tuple(np.concatenate(found).T) if found else (np.zeros(0, int), np.zeros(0, int)), 1)
        if name == "skip":
            both += both.T
        # Smoothed towards labels that do not depend on each other, with 20 pairs' weight.
        p = (both + 20 * np.outer(share, share)) / (both.sum() + 20)
        tables[name] = np.clip(np.log(p / np.outer(share, share)), -3, 3)
    return {"w": w, **tables}


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def propagate(unary: np.ndarray, adjacent: np.ndarray, skip: np.ndarray, adj_table: np.ndarray, skip_table: np.ndarray) -> np.ndarray:
    """Loopy sum-product: label probabilities of every node. Exact on trees; damped elsewhere."""
    edges = np.concatenate([adjacent, skip])
    if not len(edges):
        return _softmax(unary)
    tables = np.concatenate([np.broadcast_to(np.exp(t), (len(e), *t.shape)) for e, t in ((adjacent, adj_table), (skip, skip_table))])
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    m = np.full((len(src), unary.shape[1]), -np.log(unary.shape[1]))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, dst, m)
        out = _softmax(belief[src] - m[back])
        new = np.log(np.maximum(np.einsum("ek,ekl->el", out, tables), 1e-30))
        new -= np.log(np.exp(new).sum(axis=1, keepdims=True))
        if np.abs(new - m).max() < 1e-4:
            break
        m = 0.3 * m + 0.7 * new
    belief = unary.copy()
    np.add.at(belief, dst, m)
    return _softmax(belief)


def added_spans(text: str, base: list[tuple[int, int, str]], model: dict) -> list[tuple[int, int, str]]:
    t = Tokens(text)
    if not t.spans:
        return []
    p = propagate(model["w"][np.array(t.features)].sum(axis=1).astype(float), t.adjacent, t.skip, model["adjacent"], model["skip"])
    out = []
    for k, (a, b) in enumerate(t.spans):
        y = int(p[k].argmax())
        if y and p[k, y] >= SURE and b - a >= 6 and not any(s < b and a < e for s, e, _ in base):
            out.append((a, b, LABELS[y]))
    return out


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], LABELS.index(s[2]))))


def train(docs: DataFrame) -> dict | None:
    rows = docs.select("text").filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS))
    n = rows.count()
    rows = rows.filter(drawn(F.col("text"), F.lit(min(1.0, SAMPLE / max(n, 1))))).limit(2 * SAMPLE).collect()
    return fit(sorted({r["text"] for r in rows}))


def find_pii(spark: SparkSession, docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, the base kinds' counts, base_sha256 and spans of every row of docs (doc_id, text)."""
    shared = spark.sparkContext.broadcast(model)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    held = np.zeros(256, bool)
    held[48:58] = held[64] = True
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        model = shared.value
        for b in pieces(batches, "text"):
            raw, offsets = text_bytes(b.column("text"))
            total = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(held[raw], out=total[1:])
            # Every base pattern and every candidate holds an ASCII digit or an @; other texts have no spans.
            some = (total[offsets[1:]] > total[offsets[:-1]]).tolist()
            rows = []
            for k, doc_id in enumerate(b.column("doc_id").to_pylist()):
                if not some[k]:
                    rows.append((doc_id, 0, 0, 0, 0, nothing, ""))
                    continue
                text = b.column("text")[k].as_py()
                base = base_spans(text)
                more = added_spans(text, base, model) if model else []
                count = [sum(s[2] == kind for s in base) for kind in KINDS]
                rows.append((doc_id, *count, hashlib.sha256(digest(base).encode()).hexdigest(), digest(base + more)))
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_pii(spark, docs, train(docs))

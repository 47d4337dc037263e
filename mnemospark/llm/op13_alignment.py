"""Alignment of two tokenizers' tokens by bytes.

Python tasks tokenise and link, all texts of a batch at once: the byte ends of the tokens by either
vocabulary are marked along the batch, and both vocabularies end at a text's end, so texts part by
themselves. The ends that both have cut the tokens into groups. An A and a B token overlap in exactly one
run of bytes between neighbouring ends of either, so the links are the tokens that own the byte before each
distinct end, which is linear in a text however long its groups are.

How many documents hold a pair is one aggregation with map-side sums over distinct pairs. Sums over a
document's links need the counts again: the most frequent pairs, whose number is bounded by a histogram of
the counts, are sent to every task, and the links that are left, of which none is frequent, meet theirs in a
shuffle. So no task gets a frequent pair's links and no table of unbounded size is sent.

Defined cases: a text that is null, empty, or not given back by the bytes of its tokens has no tokens: zeros
and ''; strings of special tokens are ordinary text; repeated rows are documents of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import BROADCAST_ROWS, Scratch, hinted, pieces
from mnemospark.llm.tokens import BYTES, encoder

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
_LINKS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>"
#: Bytes of a dictionary of pairs in a written table: enough for those of a task, so that a link takes about two bytes there.
DICTIONARY = 8 << 20
#: Steps of a doubling in the histogram of counts.
STEPS = 16


#: What follows an id in the text of groups.
_SIGNS = ("", ",", "|", ";")
_LAST, _COMMA, _BAR, _SEMICOLON = range(4)


class _Bytes:
    """The bytes of each id, and their numbers; and the id as text before each of the signs, in the eight bytes of a number."""

    def __init__(self, table: list[bytes]) -> None:
        self.table, self.size = table, np.array([len(x) for x in table], np.int32)
        self.named = np.array([[f"{i}{s}".encode() for i in range(len(table))] for s in _SIGNS], "S8").view("<u8").reshape(len(_SIGNS), -1)

    def of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


_made: dict[tuple[str, str], tuple] = {}


def _tokenizers(a_path: str, b_path: str):
    """The worker's own: A's ids of texts, A's bytes, B's processor, B's bytes."""
    if (a_path, b_path) not in _made:
        import sentencepiece

        enc = encoder(a_path, True, ordinary=True)
        back = {c: b for b, c in BYTES.items()}
        vocab = enc.tok.get_vocab()
        a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            a[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
        _made.clear()
        _made[a_path, b_path] = (enc, _Bytes(a), sp, _Bytes([piece(i) for i in range(sp.get_piece_size())]))
    return _made[a_path, b_path]


def links(a: np.ndarray, a_bytes: _Bytes, b: np.ndarray, b_bytes: _Bytes, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of texts with so many tokens each, in a row: the links' pairs, how many links and groups each text has, and its groups as text.

    A link's pair is its A id times 2**32 plus its B id. Every text has tokens, and either side's are of the same bytes."""
    a_ends, b_ends = np.cumsum(a_bytes.size[a], dtype=np.int64), np.cumsum(b_bytes.size[b], dtype=np.int64)
    mark = np.zeros(a_ends[-1] + 1, np.int8)
    mark[a_ends] = 1
    mark[b_ends] += 2
    ends = np.flatnonzero(mark)
    mark = mark[ends]
    # The owners of the byte before each end: as many tokens as ended before it come first.
    ends_a, ends_b, cut = mark & 1 > 0, mark > 1, mark == 3
    own_a, own_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    pairs = a[own_a].astype(np.int64) << 32 | b[own_b]
    last_a, last_b = own_a[cut], own_b[cut]
    of_text = np.searchsorted(ends, a_ends[np.cumsum(n_a) - 1]) + 1
    # A group's A tokens and then its B tokens: a token comes after those of the other side in the groups before it, or up to it.
    sign_a, sign_b = np.full(len(a), _COMMA), np.full(len(b), _COMMA)
    sign_a[last_a], sign_b[last_b] = _BAR, _SEMICOLON
    sign_b[np.cumsum(n_b) - 1] = _LAST
    per_a, per_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    named = np.zeros(len(a) + len(b), np.uint64)
    named[np.arange(len(a)) + np.repeat(last_b + 1 - per_b, per_a)] = a_bytes.named[sign_a, a]
    named[np.arange(len(b)) + np.repeat(last_a + 1, per_b)] = b_bytes.named[sign_b, b]
    chars = named.view(np.uint8)
    full = chars != 0
    size = np.add.reduceat(full.view(np.int8), 8 * (np.cumsum(n_a + n_b) - n_a - n_b), dtype=np.int64)
    data, at = chars[full].tobytes(), np.cumsum(size).tolist()
    return pairs, np.diff(of_text, prepend=0), np.diff(np.cumsum(cut)[of_text - 1], prepend=0), [data[x:y] for x, y in zip([0, *at], at, strict=False)]


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) over blank+text; no tokens where either's bytes differ from it."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        enc, a_bytes, sp, b_bytes = _tokenizers(a_path, b_path)
        for batch in pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            spaced = [" " + t if t else "" for t in texts]
            a = [np.frombuffer(x, "<u4") for x in enc.arrow(pa.array(spaced, pa.string()))]
            b = [np.array(x, np.uint32) for x in sp.encode(texts, num_threads=1)]
            n = np.zeros((4, len(texts)), np.int64)
            sha, pairs = [""] * len(texts), np.zeros(0, np.int64)
            whole = [k for k, t in enumerate(spaced) if t and a_bytes.of(a[k]) == b_bytes.of(b[k]) == t.encode()]
            if whole:
                n[:2, whole] = [[len(a[k]) for k in whole], [len(b[k]) for k in whole]]
                pairs, n[3, whole], n[2, whole], groups = links(np.concatenate([a[k] for k in whole]), a_bytes, np.concatenate([b[k] for k in whole]), b_bytes, *n[:2, whole])
                for k, g in zip(whole, groups, strict=True):
                    sha[k] = hashlib.sha256(g).hexdigest()
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[3])].astype(np.int32)), pa.array(pairs))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *map(pa.array, n), pa.array(sha, pa.string()), lists], [c.split()[0] for c in _LINKS.split(", ")])

    return rows.mapInArrow(run, _LINKS)


def pair_counts(spark: SparkSession, links: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """(pair, n, best): in how many documents a pair of ids is linked, whether that is its A id's highest; and the count from which on pairs are few enough to be sent out."""
    pairs = links.select(F.explode(F.array_distinct("pairs")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    pairs = scratch.put(pairs, "pairs")
    first = F.shiftright("pair", 32)
    top = hinted(pairs.groupBy(first.alias("a")).agg(F.max("n").alias("most")))
    pairs = scratch.put(pairs.join(top, first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    # At most a few hundred rows, whatever the input.
    bins = pairs.groupBy(F.floor(F.log2("n") * STEPS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("k")).collect()
    total, least = 0, float("inf")
    for r in sorted(bins, key=lambda r: -r["bin"]):
        total += r["k"]
        if total > BROADCAST_ROWS:
            break
        least = r["bin"]
    return pairs, least


def align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    scratch = Scratch(spark, "alignment")
    links = scratch.put(linked(docs, a_path, b_path, id_col, text_col), "links", **{"parquet.dictionary.page.size": DICTIONARY})
    pairs, least = pair_counts(spark, links, scratch)
    frequent = F.floor(F.log2("n") * STEPS) >= least
    hot, cold = F.broadcast(pairs.filter(frequent)), pairs.filter(~frequent)
    each = links.select("row", F.explode("pairs").alias("pair"))
    sums = lambda df: df.groupBy("row").agg(F.sum("n").alias("count_sum"), F.sum(F.col("best").cast("long")).alias("n_best"))
    found = sums(each.join(hot, "pair")).unionByName(sums(each.join(hot.select("pair"), "pair", "left_anti").join(cold, "pair")))
    found = found.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = links.drop("pairs").join(found, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(A), public_tokenizers.path(B))

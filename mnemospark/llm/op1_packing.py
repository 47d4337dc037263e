"""Best-fit packing of document pieces into sequences, bettered by a swap-based local search.

Documents are cut into pieces of at most ``capacity`` tokens; full pieces are sequences already. The
others are dealt to blocks of about ``BLOCK`` pieces. A block is packed best-fit decreasing; then the
local search takes the emptiest bin and moves a piece, exchanges one for one, or two for one with
other underfull bins, whenever that raises the sum of squared fills, until the bin is empty or nothing
helps; the search ends once no underfull bin can be emptied, or the tokens need every bin that is left. What blocks leave in underfull bins is dealt and packed again with the others' leavings, so
blocks cost no sequences in the end.

Defined cases: null text counts as empty (the end id alone, one piece); repeated rows are pieces of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import Scratch, pieces
from mnemospark.llm.tokens import encoder

CAPACITY, BLOCK = 4096, 8_000
#: A bin filled so far stays as it is; emptier ones go to the next round.
KEPT_FILL = 0.999


def best_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Bins of indices, best-fit decreasing; a bit for each residual capacity finds the fullest bin that fits."""
    bins, free, mask = [], [[] for _ in range(capacity + 1)], 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        if room > n:
            free[room - n].append(b)
            mask |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Empties underfull bins one by one. Each step raises the sum of squared fills, so it ends."""
    least = -(-sum(lengths) // capacity)
    fill = [sum(lengths[i] for i in b) for b in bins]
    under = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
    alive = len(bins)

    def shift(a: int, b: int, give: tuple[int, ...], take: tuple[int, ...]) -> None:
        for i in give:
            bins[a].remove(i)
            bins[b].append(i)
        for i in take:
            bins[b].remove(i)
            bins[a].append(i)
        d = sum(lengths[i] for i in give) - sum(lengths[i] for i in take)
        fill[a] -= d
        fill[b] += d

    def step(a: int, b: int) -> bool:
        """The exchange after which b is fullest: b gains d tokens, at most its room. As b is the fuller, more raises the sum more."""
        room, best, how = capacity - fill[b], 0, None
        ones = [(lengths[i], (i,)) for i in bins[a]]
        twos = [(m + n, (*i, *k)) for x, (m, i) in enumerate(ones) for n, k in ones[x + 1 :]]
        takes = [(0, ()), *((lengths[j], (j,)) for j in bins[b])]
        pairs = [(m + n, (*j, *k)) for y, (m, j) in enumerate(takes[1:], 1) for n, k in takes[y + 1 :]]
        for gives, backs in ((ones, takes), (twos, takes), (ones, pairs)):
            for m, give in gives:
                for n, back in backs:
                    if best < m - n <= room:
                        best, how = m - n, (give, back)
                        if best == room:
                            break
        if how:
            shift(a, b, *how)
        return bool(how)

    # When a bin last changed, and when two bins were last found to have no exchange: pairs of which neither changed are passed over.
    now, changed, barren = 0, [0] * len(bins), {}
    tried = 0
    while alive > least and tried < len(under) - 1:
        a, moved = under[tried], True
        while bins[a] and moved:
            moved = False
            for b in sorted((b for b in under if b != a and capacity > fill[b] >= fill[a]), key=lambda b: -fill[b]):
                if not bins[a] or fill[b] < fill[a] or barren.get((a, b), -1) >= max(changed[a], changed[b]):
                    continue
                now += 1
                if step(a, b):
                    changed[a] = changed[b] = now
                    moved = True
                else:
                    barren[a, b] = now
        if bins[a]:
            tried += 1  # this one cannot be emptied; what it gave may help the next
            continue
        alive, tried = alive - 1, 0
        under = sorted((b for b in under if b != a and fill[b] < capacity), key=lambda b: fill[b])
    return [b for b in bins if b]


def pack_block(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer, keeps_space=False)
        for b in pieces(batches, "text"):
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.arrow(b.column("text")), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays(cols[:n], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:n])

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, fields)


def _packer(round_: int, last: bool, capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].tolist()
        seq, off, again = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        first = (round_ << 56) | (int(pdf["block"].iloc[0]) << 20)
        for b, members in enumerate(pack_block(lengths, capacity)):
            at = 0
            for i in members:
                seq[i], off[i] = first + b, at
                at += lengths[i]
            if not last and at < KEPT_FILL * capacity:
                again[members] = True
        return pdf.drop(columns="block").assign(sequence_id=seq, offset=off, again=again)

    return run


def pack(spark: SparkSession, parts: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to capacity. ``parts`` is read more than once: a written table."""
    scratch = Scratch(spark, "packing")
    full = parts.filter(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_, done, before, r = parts.filter(F.col("length") < capacity), [full], None, 0
    fields = parts.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", sequence_id long, offset long, again boolean"
    while n := open_.count():
        # One block takes all in the end, or earlier rounds no longer help (all pieces fill bins poorly).
        last = n <= block or (before is not None and n > 0.9 * before)
        k = -(-n // block)
        dealt = open_.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(r)), F.lit(k)))
        packed = scratch.put(dealt.groupBy("block").applyInPandas(_packer(r, last, capacity), fields), f"round{r}")
        done.append(packed.filter(~F.col("again")).drop("again"))
        if last:
            break
        open_, before, r = packed.filter("again").drop("sequence_id", "offset", "again"), n, r + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    return pack(spark, Scratch(spark, "pieces").put(cut(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def op1_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer)

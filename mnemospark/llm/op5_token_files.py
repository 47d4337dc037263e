"""Token ids of documents in binary files, with Elias-Fano coded document boundaries.

A file holds the ids of a run of documents, 2 bytes each where the vocabulary has at most 65,536 ids and 4 otherwise,
then the ends of the documents and their ids, both Elias-Fano coded, then a fixed footer. Files follow
one another in ascending order of document id. Tasks write to names of their own and report them; only
what committed tasks reported is read, so a task that is run again leaves at most a file nobody names.

Defined cases: null text counts as empty (its document is the end id alone); null ids come first;
repeated ids stand side by side, in the order of a hash of their text; no rows, no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import Scratch, pieces
from mnemospark.llm.elias_fano import EliasFano
from mnemospark.llm.tokens import encoder

MAGIC = b"MNEMTOK1"
#: Documents whose boundaries a reader decodes at once.
RUN = 4096
_FOOT = struct.Struct("<QQQqQQI8s")  # documents, tokens, null ids, least id, bytes of ends, bytes of ids, width, magic


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFile:
    """Reader: any document's ids by its rank, through select on the boundaries."""

    def __init__(self, uri: str) -> None:
        store, path = _fs(uri)
        self.f = store.open_input_file(path)
        size = self.f.size()
        self.n_docs, self.n_tokens, self.n_null, self.least, n_ends, n_ids, self.width, magic = _FOOT.unpack(self.f.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        at = len(MAGIC) + self.n_tokens * self.width
        self.ends = EliasFano.from_bytes(self.f.read_at(n_ends, at))
        self.ids = EliasFano.from_bytes(self.f.read_at(n_ids, at + n_ends))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.ids.select(i - self.n_null) + self.least

    def tokens(self, first: int, end: int) -> np.ndarray:
        b = self.f.read_at((end - first) * self.width, len(MAGIC) + first * self.width)
        return np.frombuffer(b, f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.tokens(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def close(self) -> None:
        self.f.close()


def write_file(uri: str, docs: Iterator[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Writes documents (id, ids as unsigned 32-bit bytes) that come in order; returns documents and tokens."""
    store, path = _fs(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    ends, ids, n_null, total = [], [], 0, 0
    with store.open_output_stream(path) as out:
        out.write(MAGIC)
        for doc_id, b in docs:
            a = np.frombuffer(b, "<u4")
            if width < 4 and len(a) and int(a.max()) >> (8 * width):
                raise ValueError(f"id {a.max()} does not fit {width} bytes")
            total += len(a)
            ends.append(total)
            if doc_id is None:
                n_null += 1
            else:
                ids.append(doc_id)
            out.write(a.astype(f"<u{width}").tobytes())
        least = ids[0] if ids else 0
        coded = [EliasFano.of(np.array(x, np.uint64)).to_bytes() for x in (ends, [x - least for x in ids])]
        out.write(b"".join(coded) + _FOOT.pack(len(ends), total, n_null, least, len(coded[0]), len(coded[1]), width, MAGIC))
    return len(ends), total


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str, end_id: int, width: int | None = None, keeps_space: bool = True) -> DataFrame:
    """Writes docs (doc_id, text) and returns the manifest: shard int, path, n_docs, n_tokens, in no order. The width follows from the vocabulary."""
    end = np.array([end_id], "<u4").tobytes()

    def ids(batches):
        enc = encoder(tokenizer, keeps_space)
        for b in pieces(batches, "text"):
            yield from zip(b.column("doc_id").to_pylist(), (x + end for x in enc.arrow(b.column("text"))), strict=True)

    def run(batches):
        from pyspark import TaskContext

        first = next(rows := ids(batches), None)
        if first is None:
            return
        uri = f"{folder}/tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        wide = width or max(encoder(tokenizer, keeps_space).id_bytes, 2 if end_id < 1 << 16 else 4)
        n, total = write_file(uri, (x for part in ([first], rows) for x in part), wide)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [uri], "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    text = F.coalesce("text", F.lit(""))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    The manifest has a row for each file that a task wrote (some hundred MB of ids each on a cluster),
    so the running sum over it is taken in the driver.
    """
    rows, at, base = sorted(manifest.collect()), 0, []
    for r in rows:
        base.append((r.path, at))
        at += r.n_tokens
    files = spark.createDataFrame(base, "path string, base long")
    files = files.repartition(max(1, len(base)))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                f, done = TokenFile(path), 0
                f = TokenFile(path)
                for done in range(0, f.n_docs, RUN):  # boundaries of some documents at a time, by select
                    end = min(f.n_docs, done + RUN)
                    first = f.ends.select(done - 1) if done else 0
                    cuts = np.r_[first, f.ends.selects(done, end).astype(np.int64)]
                    null = max(0, min(end, f.n_null) - done)
                    ids = [None] * null + (f.ids.selects(done + null - f.n_null, end - f.n_null).astype(np.int64) + f.least).tolist() if end > f.n_null else [None] * null
                    crc, k = [], 0
                    while k < end - done:  # a few MB of ids at a time
                        to = max(k + 1, int(np.searchsorted(cuts, cuts[k] + 1_000_000, side="right")) - 1)
                        b4 = memoryview(f.tokens(int(cuts[k]), int(cuts[to])).tobytes())
                        crc += [zlib.crc32(b4[4 * i : 4 * j]) for i, j in zip((cuts[k:to] - cuts[k]).tolist(), (cuts[k + 1 : to + 1] - cuts[k]).tolist(), strict=True)]
                        k = to
                    cols = ids, base + cuts[:-1], np.diff(cuts), crc
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])
                f.close()

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    scratch = Scratch(spark, "token-files")
    folder = f"{scratch.path}/files"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = scratch.put(write_tokens(spark, docs, tokenizer, folder, end_id=2), "manifest")
    return read_tokens(spark, manifest)

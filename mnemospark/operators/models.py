"""Places for models: an embedder, a scorer of pairs and an extractor are functions of columns.

A model is given as a function from columns to a column: for a neural one a pandas UDF that loads it once a worker. What
stands here needs no model and gives equal results everywhere, for tests and for stores without one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import text

Embedder = Callable[[Column], Column]
Scorer = Callable[[Column, Column], Column]


def buckets(c: Column, size: int) -> Column:
    """The bucket of each token: the first 16 bits of its MD5."""
    return F.transform(text.tokens(c), lambda t: (F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % size))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f names it: it is a lambda's variable."""
    return F.transform(F.array(c), f)[0]


def normalised(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x))
    return once(v, lambda w: once(norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)))


def hashing(size: int = 64, prefix: str = "") -> Embedder:
    """Embeds a text as its counted token buckets, normalised; ``prefix`` tells queries from passages, as models want it."""

    @F.arrow_udf("array<double>")
    def counted(b: pa.Array) -> pa.Array:
        """All buckets of a batch are counted at once; a zero vector stays."""
        n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(b), 0), np.int64)
        of = np.repeat(np.arange(len(b), dtype=np.int64), n)
        c = np.bincount(of * size + b.flatten().to_numpy(zero_copy_only=False), minlength=len(b) * size).reshape(-1, size).astype(float)
        norm = np.sqrt((c * c).sum(axis=1))
        c /= np.where(norm > 0, norm, 1)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * size), pa.array(c.ravel()), mask=b.is_null())

    return lambda c: counted(buckets(F.concat(F.lit(prefix), c) if prefix else c, size))


def pooled(states: Column, mask: Column, how: str = "mean") -> Column:
    """One normalised vector of a model's token states (arrays of one size): the mean of those the mask keeps, or the first."""
    if how == "cls":
        return normalised(states[0])
    zero = F.transform(states[0], lambda _: F.lit(0.0))
    kept = F.transform(F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda x: x["m"] > 0), lambda x: x["s"])
    total = lambda k: F.aggregate(k, zero, lambda a, v: F.zip_with(a, v, lambda p, q: p + q))
    return normalised(once(kept, lambda k: once(F.greatest(F.size(k), F.lit(1)), lambda n: F.transform(total(k), lambda x: x / n))))


def embed(rows: DataFrame, embedder: Embedder, stamp: str, content: str = "content") -> DataFrame:
    """rows with ``vec`` and the stamp of the model that made it; null and blank texts get no vector."""
    blank = F.trim(F.coalesce(content, F.lit(""))) == ""
    return rows.withColumn("vec", F.when(~blank, embedder(F.col(content)))).withColumn("embed_model", F.when(~blank, F.lit(stamp)))


def of_space(rows: DataFrame, stamp: str, size: int) -> DataFrame:
    """Says of each row why its vector cannot be compared in a space (``problem``), or null."""
    return rows.withColumn("problem", F.when(F.col("vec").isNull(), "no_vector").when(F.size("vec") != size, "dimension").when(~F.col("embed_model").eqNullSafe(F.lit(stamp)), "model"))


def reindex(rows: DataFrame, embedder: Embedder, stamp: str) -> DataFrame:
    """All contents embedded anew; whatever else a row has stays."""
    return embed(rows.drop("vec", "embed_model"), embedder, stamp)


class Reindex:
    """Rows embedded anew, part by part, into a table that takes the old one's place when all parts are there.

    Parts are hashes of the key. One that is finished has its marker and is not made again, so a run that was stopped goes
    on where it was; until the swap, readers see the old table.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, stamp: str, key: str = "id", parts: int = 16) -> None:
        self.spark, self.path, self.embedder, self.stamp, self.key, self.parts = spark, path.rstrip("/"), embedder, stamp, key, parts
        self.current, self.fresh, self.backup = (f"{self.path}/{x}" for x in ("current", "fresh", "backup"))

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def finished(self) -> list[int]:
        out = []
        for k in range(self.parts):
            fs, p = self._fs(f"{self.fresh}/part={k}/_SUCCESS")
            if fs.exists(p):
                out.append(k)
        return out

    def run(self, most: int | None = None) -> int:
        """Makes the parts that are missing, ``most`` of them at most; gives how many it made."""
        rows = self.spark.read.parquet(self.current)
        left = [k for k in range(self.parts) if k not in self.finished()][:most]
        for k in left:
            part = rows.filter(F.pmod(F.xxhash64(self.key), F.lit(self.parts)) == k)
            reindex(part, self.embedder, self.stamp).write.mode("overwrite").parquet(f"{self.fresh}/part={k}")
        return len(left)

    def swap(self) -> None:
        """Puts the new table in the place of the old one, which stays as a backup; refuses while parts are missing."""
        if len(self.finished()) < self.parts:
            raise ValueError("parts are missing")
        for source, target in ((self.current, self.backup), (self.fresh, self.current)):
            fs, p = self._fs(target)
            if target == self.backup and fs.exists(p):
                fs.delete(p, True)
            fs.rename(self._fs(source)[1], p)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.current).drop("part")


def token_overlap(asked: Column, content: Column) -> Column:
    """The share of a question's tokens that a text holds."""
    q = F.array_distinct(text.tokens(asked))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, text.tokens(content))) / F.size(q))

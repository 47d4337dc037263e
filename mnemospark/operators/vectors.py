"""Exact dense search by an inverted file of cells, and near pairs, as joins of tables.

Rows are assigned to the nearest of at most CELLS centroids, which are learnt from a sample of SAMPLE rows a
hash draws; every row is assigned and every cell keeps its radius. For a query q and a cell with centre c and
radius r no row of the cell scores above ``q.c + |q| r`` (triangle inequality). Rows and queries are dealt to
blocks, and every block of rows meets every block of queries of its group in a task, where the rows stand by cell:
a query looks at its likeliest cells first, and then only at those whose bound reaches its k-th score so far. So a
vector is shipped once a block of the other side, about SHARE times, and not once a cell; the looking
itself is quadratic where bounds leave nothing out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.sources.shared import Tables, sent

#: Rows that centroids are learnt from, at most; centroids, at most; rows of a cell, about, while there are fewer.
SAMPLE, CELLS, CELL_ROWS = 16_384, 1024, 256
#: Blocks that a group's rows, and its queries, are dealt to; rows of a block, at least and at most, about: so many vectors are held by a task.
SHARE, LEAST_ROWS, PART_ROWS = 8, 16_384, 262_144
#: Queries that a block's rows are multiplied with at once, and rows of a tile of these, at least about and at most.
BATCH, TILE, WIDE = 1024, 64, 1024
#: Signs that sift pairs which share a band; a multiple of 64.
SIFT = 192
#: Scores are rounded to 6 digits; bounds are widened by more than rounding and summing can move them.
SLACK = 2e-6
#: What stands where no id is found.
LAST = np.iinfo(np.int64).max


def centroids(sample: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Lloyd's rounds over a sample; a cell that empties keeps its centre."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None] - 2 * sample @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def matrix(b: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, dim)


class Index:
    """Rows (id, vec, and a group if named: a query meets rows of its own group) in cells, written to the shared folder.

    Where an order is named, rows and queries have such a column, and a query meets rows before its own place only.

    Vectors of another length than most, null ones and those with a null or non-finite component are left out.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame, group: str | None = None, order: str | None = None, cell_rows: int = CELL_ROWS) -> None:
        self.spark, self.group, self.order, self.tables, self.asks = spark, group, order, Tables(spark, "vectors"), 0
        kept = rows.select("id", "vec", (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("place"), *([group] if group else [])).filter(usable("vec"))
        sizes = kept.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
        self.dim, self.n = (sizes[0]["d"], sizes[0]["n"]) if sizes else (0, 0)
        kept = kept.filter(F.size("vec") == self.dim)
        k = int(min(CELLS, max(1, self.n // cell_rows)))
        draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < (1 << 30) * min(1.0, 1.25 * SAMPLE / max(self.n, 1))
        drawn = kept.filter(draw).select("vec").limit(SAMPLE).collect() if k > 1 else []
        k = max(1, min(k, len(drawn)))
        self.centres = centroids(np.array([r["vec"] for r in drawn], float), k) if k > 1 else np.zeros((1, self.dim))
        self.rows = self.tables.put(self._assigned(kept), "rows")
        cells = {r["cell"]: r for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()}  # a row a cell
        self.counts = np.array([cells[c]["n"] if c in cells else 0 for c in range(k)], np.int64)
        self.radius = np.array([cells[c]["r"] if c in cells else -np.inf for c in range(k)])

    def _assigned(self, rows: DataFrame) -> DataFrame:
        """Adds cell and the distance to its centre."""
        shared, dim = self.spark.sparkContext.broadcast(self.centres), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in batches:
                if b.num_rows:
                    x = matrix(b, "vec", dim)
                    near = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, axis=1) if len(x) else np.zeros(0, int)
                    far = np.sqrt(((x - c[near]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(far)], [*b.schema.names, "cell", "far"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(run, f"{kinds}, cell int, far double")

    def _blocks(self, n, most: int):
        """Into how many blocks n rows are dealt: eight, of LEAST_ROWS rows at least and ``most`` at most."""
        size = F.least(F.lit(most), F.greatest(F.lit(LEAST_ROWS), F.ceil(n / SHARE)))
        return F.greatest(F.ceil(n / size), F.lit(1)).cast("int")

    def _dealt(self, rows: DataFrame, queries: DataFrame, same: bool) -> DataFrame:
        """Rows (side 0) and queries (side 1) by pairs of a block of rows ``i`` and one of queries ``j`` of their group, each pair a task's; same: pairs of a block with itself or a later one."""
        self.asks += 1
        g = [self.group] if self.group else []
        count = lambda d, c: d.groupBy(*g).agg(F.count(F.lit(1)).alias(c))
        sizes = count(rows, "n")
        if g:
            asked = count(queries, "m").withColumnRenamed(g[0], "__h")
            sizes = sizes.join(asked, F.col(g[0]).eqNullSafe(F.col("__h"))).drop("__h").withColumnRenamed(g[0], "__g")
        else:
            sizes = sizes.crossJoin(count(queries, "m"))
        sizes = sent(self.tables.put(sizes.select(*(["__g"] if g else []), self._blocks(F.col("n"), PART_ROWS).alias("ni"), self._blocks(F.col("m"), PART_ROWS).alias("nj")), f"sizes-{self.asks}"))
        on = F.col(g[0]).eqNullSafe(F.col("__g")) if g else F.lit(True)
        of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        upto = lambda a, b: F.explode(F.sequence(a, b))
        cols = ["side", "cell", "id", "vec", "place", "floor"]
        x = rows.select(*g, F.lit(0).alias("side"), "cell", "id", "vec", "place", F.lit(0.0).alias("floor")).join(sizes, on).withColumn("i", of("ni"))
        x = x.withColumn("j", upto(F.col("i") if same else F.lit(0), F.col("nj") - 1))
        q = queries.select(*g, F.lit(1).alias("side"), F.lit(0).alias("cell"), F.col("qid").alias("id"), "vec", "place", "floor").join(sizes, on).withColumn("j", of("nj"))
        q = q.withColumn("i", upto(F.lit(0), F.col("j") if same else F.col("ni") - 1))
        keys = [*g, "i", "j"]
        both = x.select(*keys, *cols).unionByName(q.select(*keys, *cols))
        return both.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "side", "cell", "id")

    def _met(self, rows: DataFrame, queries: DataFrame, k: int, lost: bool = False) -> DataFrame:
        """(qid, id, score): the k best rows of each block with a score of the query's floor at least; k 0: all, each pair once, the larger id as qid;
        lost: of these pairs, for the one of the later place the smallest id that it meets in a block, without a score."""
        met, dim, ordered = self._dealt(rows, queries, not k), self.dim, self.order is not None
        shared = self.spark.sparkContext.broadcast((self.centres, self.radius))
        keys = [*([self.group] if self.group else []), "i", "j"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, block, waiting, count = None, [], None, [], 0

            def visit() -> Iterator[pa.RecordBatch]:
                nonlocal waiting, count
                if block is not None and waiting:
                    q = tuple(np.concatenate(y) for y in zip(*waiting, strict=True))
                    own = now[-2] == now[-1]
                    for some in _top(block, *q, k, ordered) if k else _lost(block, *q, own) if lost else _all(block, *q, own):
                        yield pa.RecordBatch.from_arrays([pa.array(y) for y in some], ["qid", "id", "score"])
                waiting, count = [], 0

            def beaten() -> Iterator[pa.RecordBatch]:
                if lost and block is not None:
                    some = np.flatnonzero(block.winner < LAST)
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids[some]), pa.array(block.winner[some]), pa.array(np.zeros(len(some)))], ["qid", "id", "score"])

            for b in batches:
                code = np.zeros(b.num_rows, bool)
                for name in [*keys, "side"]:
                    c = b.column(name)
                    if b.num_rows > 1:
                        same = pa.compute.equal(c.slice(1), c.slice(0, b.num_rows - 1)).fill_null(False).to_numpy(zero_copy_only=False)
                        null = c.is_null().to_numpy(zero_copy_only=False)
                        code[1:] |= ~(same | (null[1:] & null[:-1]))
                cuts = np.flatnonzero(code).tolist()
                for i, j in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                    if i == j:
                        continue
                    piece = b.slice(i, j - i)
                    key = tuple(piece.column(name)[0].as_py() for name in keys)
                    if key != now:
                        yield from visit()
                        yield from beaten()
                        now, held, block = key, [], None
                    ids, v, place = piece.column("id").to_numpy().copy(), matrix(piece, "vec", dim), piece.column("place").to_numpy().copy()
                    if piece.column("side")[0].as_py() == 0:
                        held.append((ids, v, place, piece.column("cell").to_numpy().copy()))
                        continue
                    if held:
                        block, held = Block(*(np.concatenate(y) for y in zip(*held, strict=True)), *shared.value), []
                    for at in range(0, len(ids), BATCH):
                        some = slice(at, at + BATCH)
                        waiting.append((ids[some], v[some], place[some], piece.column("floor").to_numpy()[some].copy()))
                        count += len(waiting[-1][0])
                        if count >= BATCH:
                            yield from visit()
            yield from visit()
            yield from beaten()

        return met.mapInArrow(run, "qid long, id long, score double")

    def _asked(self, queries: DataFrame) -> DataFrame:
        g = [self.group] if self.group else []
        place = F.col(self.order).cast("long") if self.order else F.lit(0).cast("long")
        return queries.filter(usable("vec") & (F.size("vec") == self.dim)).select("qid", "vec", place.alias("place"), *g).withColumn("floor", F.lit(float("-inf")))

    def topk(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, score, rank): the k rows of the highest dot product with each query (qid, vec, the group if named), ties by id."""
        self.asks += 1
        asked = self.tables.put(self._asked(queries), f"asked-{self.asks}")
        return best(self._met(self.rows, asked, k), k)

    def within(self, least: float) -> DataFrame:
        """(a, b, score), a < b: all pairs of rows of a group with a dot product of ``least`` or more."""
        g = [self.group] if self.group else []
        asked = self.rows.select(F.col("id").alias("qid"), "vec", "place", *g).withColumn("floor", F.lit(float(least)))
        met = self._met(self.rows, asked, 0)
        return met.select(F.col("id").alias("a"), F.col("qid").alias("b"), "score")

    def beaten(self, least: float) -> DataFrame:
        """(id, winner): of the rows of a group with a dot product of ``least`` or more that come before a row in the order named, the smallest id.

        Pairs are folded where they are found, so that what leaves a task is a row for each row and block, however many are near.
        """
        g = [self.group] if self.group else []
        asked = self.rows.select(F.col("id").alias("qid"), "vec", "place", *g).withColumn("floor", F.lit(float(least)))
        return self._met(self.rows, asked, 0, lost=True).groupBy(F.col("qid").alias("id")).agg(F.min("id").alias("winner"))

    def visited(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, cells, rows): how many cells and rows have a bound that reaches a query's k-th score, for a report of what the bounds leave out."""
        floors = self.topk(queries, k).filter(F.col("rank") == k).select(F.col("qid").alias("q"), F.col("score").alias("found"))
        asked = self._asked(queries).join(floors, F.col("qid") == F.col("q"), "left").select("qid", "vec", F.coalesce("found", "floor").alias("floor"))
        shared, dim = self.spark.sparkContext.broadcast((self.centres, self.radius, self.counts)), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, r, n = shared.value
            for b in batches:
                q = matrix(b, "vec", dim)
                ok = (_bounds(q, c, r) >= b.column("floor").to_numpy()[:, None]) & (n > 0)
                yield pa.RecordBatch.from_arrays([b.column("qid"), pa.array(ok.sum(1)), pa.array(ok @ n)], ["qid", "cells", "rows"])

        return asked.mapInArrow(run, "qid long, cells long, rows long")


def _bounds(q: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """What no row of a cell scores above, for each query."""
    return q @ c.T + np.sqrt((q * q).sum(1))[:, None] * np.maximum(r, 0) + SLACK


class Block:
    """Rows by cell, in tiles of TILE to WIDE rows (of whole cells, or of one cell), with what their scores take."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, place: np.ndarray, cell: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> None:
        self.ids, self.x, self.place = ids, x, place
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.c, self.r = centres[cell[first]], radius[cell[first]]
        end, self.tiles, begin = np.r_[first[1:], len(ids)].tolist(), [], 0
        for k, (a, b) in enumerate(zip(first.tolist(), end, strict=True)):
            if b - first[begin] >= TILE or k == len(end) - 1:
                self.tiles += [(at, min(at + WIDE, b), begin, k + 1) for at in range(int(first[begin]), b, WIDE)]
                begin = k + 1
        self.winner = np.full(len(ids), LAST)
        self.norm = float(np.sqrt((x * x).sum(1).max(initial=0)))
        # Single precision sifts, double precision scores. Where single could overflow, all is double.
        self.small = x.astype(np.float32) if self.norm < 1e15 else None

    def sifted(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bound of each query and tile, the queries to sift with, and by how much a sifted score may be off."""
        bounds = _bounds(v, self.c, self.r)
        tops = np.stack([bounds[:, i:j].max(1) for _, _, i, j in self.tiles], axis=1)
        norms = np.sqrt((v * v).sum(1))
        low = self.small is not None and norms.max(initial=0) < 1e15
        off = norms * self.norm * ((v.shape[1] + 8) * 2.0**-23 if low else 1e-12) + SLACK
        return tops, v.astype(np.float32) if low else v, off

    def scores(self, w: np.ndarray, a: int, b: int) -> np.ndarray:
        return w @ (self.small if w.dtype == np.float32 else self.x)[a:b].T

    def exact(self, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for at in range(0, len(i), 65_536):
            some = slice(at, at + 65_536)
            out[some] = np.round(np.einsum("ij,ij->i", v[i[some]], self.x[j[some]]), 6)
        return out


def _top(block: Block, qid: np.ndarray, v: np.ndarray, before: np.ndarray, floor: np.ndarray, k: int, ordered: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """The k best rows of a block for each query: its likeliest tile first, then those whose bound reaches the k-th score so far."""
    tops, w, off = block.sifted(v)
    score, who = np.full((len(qid), k), -np.inf), np.full((len(qid), k), LAST)

    def look(t: int, q: np.ndarray) -> None:
        a, b, _, _ = block.tiles[t]
        least = np.maximum(floor[q], score[q, k - 1])
        hit = block.scores(w[q], a, b) >= (least - off[q]).astype(w.dtype)[:, None]
        n = np.count_nonzero(hit)
        if 16 * n > hit.size and b - a > k:  # many rows reach it: the tile's own k best, of ties those of the smallest ids
            s = np.round(v[q] @ block.x[a:b].T, 6)
            hit &= s >= least[:, None]
            if ordered:
                hit &= block.place[None, a:b] < before[q][:, None]
            s = np.where(hit, s, -np.inf)
            kth = np.partition(s, b - a - k, axis=1)[:, b - a - k]
            hit &= s >= kth[:, None]
            by = np.argsort(block.ids[a:b], kind="stable")
            tie = hit & (s == kth[:, None])
            rank = np.empty(hit.shape, np.int32)
            rank[:, by] = np.cumsum(tie[:, by], axis=1)
            i, j = np.nonzero(hit & (~tie | (rank <= k)))
            s, j = s[i, j], j + a
        else:
            i, j = np.nonzero(hit)
            j += a
            if ordered:
                ok = block.place[j] < before[q[i]]
                i, j = i[ok], j[ok]
            s = block.exact(v[q], i, j)
            ok = s >= least[i]
            i, j, s = i[ok], j[ok], s[ok]
        if not len(i):
            return
        some = np.unique(i)
        at = np.r_[np.repeat(some, k), i]
        s, ids = np.r_[score[q[some]].ravel(), s], np.r_[who[q[some]].ravel(), block.ids[j]]
        order = np.lexsort((ids, -s, at))
        at, s, ids = at[order], s[order], ids[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        take = first[:, None] + np.arange(k)
        score[q[some]], who[q[some]] = s[take], ids[take]

    likely = tops.argmax(1)
    for t in np.unique(likely).tolist():
        look(t, np.flatnonzero(likely == t))
    for t in range(len(block.tiles)):
        need = (tops[:, t] >= np.maximum(floor, score[:, k - 1])) & (likely != t)
        if need.any():
            look(t, np.flatnonzero(need))
    i, j = np.nonzero(score > -np.inf)
    yield qid[i], who[i, j], score[i, j]


def _all(block: Block, qid: np.ndarray, v: np.ndarray, before: np.ndarray, floor: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(larger id, smaller id, score) of all pairs of a query and a row of a block that reach the query's floor."""
    for i, j, s in _reached(block, qid, v, floor, own):
        x, y = qid[i], block.ids[j]
        yield np.maximum(x, y), np.minimum(x, y), s


def _lost(block: Block, qid: np.ndarray, v: np.ndarray, before: np.ndarray, floor: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, winner, 0) of the queries that a row of the block comes before; what the queries come before is noted in the block."""
    winner = np.full(len(qid), LAST)
    for i, j, _ in _reached(block, qid, v, floor, own):
        later = before[i] > block.place[j]
        np.minimum.at(winner, i[later], block.ids[j[later]])
        np.minimum.at(block.winner, j[~later], qid[i[~later]])
    some = np.flatnonzero(winner < LAST)
    yield qid[some], winner[some], np.zeros(len(some))


def _reached(block: Block, qid: np.ndarray, v: np.ndarray, floor: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, row, score) of all pairs that reach the query's floor; own: the queries are the block's rows, and the row has the smaller id."""
    tops, w, off = block.sifted(v)
    for t, (a, b, _, _) in enumerate(block.tiles):
        q = np.flatnonzero(tops[:, t] >= floor)
        if not len(q):
            continue
        i, j = np.nonzero(block.scores(w[q], a, b) >= (floor - off)[q].astype(w.dtype)[:, None])
        i, j = q[i], j + a
        if own:
            ok = block.ids[j] < qid[i]
            i, j = i[ok], j[ok]
        s = block.exact(v, i, j)
        ok = s >= floor[i]
        if ok.any():
            yield i[ok], j[ok], s[ok]


def usable(vec: str):
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties by id, with their rank. Spark cuts each task's share before the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def banded_pairs(spark: SparkSession, rows: DataFrame, least: float, bands: int = 20, bits: int = 16, seed: int = 7) -> DataFrame:
    """(library, a, b, score), a < b: pairs of unit vectors of a library that share a band of signs and score ``least`` or more.

    Each band is ``bits`` signs of projections on seeded random directions. A pair at a cosine of 0.95 agrees
    on a sign with 0.899, so on one of 20 bands of 16 with 0.98; closer pairs more often. Of the pairs that meet, those
    that ``banded`` leaves get their vectors and the dot product decides.
    """
    kept = rows.filter(usable("vec")).select("library", "id", "vec")
    pairs = banded(kept, least, bands, bits, seed)
    va, vb = kept.select(F.col("id").alias("a"), F.col("vec").alias("va")), kept.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    return pairs.join(va, "a").join(vb, "b").withColumn("score", F.round(dot, 6)).filter(F.col("score") >= least).select("library", "a", "b", "score")


def banded(kept: DataFrame, least: float, bands: int, bits: int, seed: int) -> DataFrame:
    """(library, a, b), a < b: pairs that share a band and whose SIFT signs of further directions can be those of a score of ``least``.

    How many unlike pairs meet in a band grows with the square of the rows, so they are refused where they meet. Of a
    pair at an angle of p times pi, SIFT * p signs differ in the mean; eight deviations more are let through.
    """
    words = [f"s{k}" for k in range(SIFT // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            size = pa.compute.list_value_length(b.column("vec")).to_numpy()
            for dim in np.unique(size).tolist():
                some = b.filter(pa.array(size == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bands * bits)), np.random.default_rng([seed, dim, 1]).standard_normal((dim, SIFT))
                x = matrix(some, "vec", dim)
                signs = (x @ planes[dim][0] >= 0).reshape(some.num_rows, bands, bits)
                keys = (signs @ powers).astype(np.int64) + (np.arange(bands, dtype=np.int64) << 40) + (dim << 48)
                again = np.repeat(np.arange(some.num_rows), bands)
                sifted = np.packbits(x @ planes[dim][1] >= 0, axis=1).view(np.int64)[again]
                norm = np.ceil(1000 * np.sqrt((x * x).sum(1)))[again] / 1000
                yield pa.RecordBatch.from_arrays([some.column("library").take(pa.array(again)), some.column("id").take(pa.array(again)), pa.array(keys.ravel()), pa.array(norm), *[pa.array(np.ascontiguousarray(w)) for w in sifted.T]], ["library", "id", "key", "norm", *words])

    keys = kept.mapInArrow(run, f"library string, id long, key long, norm double, {', '.join(f'{w} long' for w in words)}")
    x, y = keys.alias("x"), keys.alias("y")
    p = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), least / F.greatest(F.col("x.norm") * F.col("y.norm"), F.lit(1e-9))))) / math.pi
    unlike = functools.reduce(lambda s, w: s + F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))), words, F.lit(0))
    met = F.col("x.library").eqNullSafe(F.col("y.library")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))
    near = unlike <= SIFT * p + 8 * F.sqrt(SIFT * p * (1 - p)) + 1
    return x.join(y, met & near).select("x.library", F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_classes(spark: SparkSession, rows: DataFrame, least: float = 0.95, exact: bool = False, bands: int = 20, bits: int = 16) -> tuple[DataFrame, DataFrame]:
    """(class, id) for rows (library, id, vec), and (a, b, score) of classes: rows of a library with equal vectors are one class, named by its smallest id.

    So the copies of one text, however many, are one row while pairs are sought: by bands, or by cells where
    ``exact`` is asked for.
    """
    tables = Tables(spark, "near")
    rows = rows.filter(usable("vec")).withColumn("vec", F.col("vec").cast("array<double>"))
    firsts = rows.groupBy("library", "vec").agg(F.min("id").alias("class"))
    firsts = tables.put(firsts, "classes")
    members = rows.join(firsts.withColumnRenamed("library", "l").withColumnRenamed("vec", "v"), F.col("library").eqNullSafe(F.col("l")) & (F.col("vec") == F.col("v"))).select("class", "id")
    one = firsts.select("library", F.col("class").alias("id"), "vec")
    if exact:
        pairs = Index(spark, one, "library").within(least)
    else:
        pairs = banded_pairs(spark, one, least, bands, bits).select("a", "b", "score")
    return members, pairs


def merged(spark: SparkSession, rows: DataFrame, least: float = 0.95, exact: bool = False) -> DataFrame:
    """(id, winner) for memories (library, id, content, created_at, vec) that go: the most preferred near one stays. ``chars`` may stand for the content, which then is shipped nowhere.

    A near row of the library is preferred if it is longer, then older, then has the smaller id.
    """
    members, pairs = near_classes(spark, rows.select("library", "id", "vec"), least, exact)
    far = F.lit("9999-12-31").cast("timestamp")
    order = rows.select("id", F.struct(-(F.col("chars") if "chars" in rows.columns else F.char_length("content")).alias("n"), F.coalesce("created_at", far).alias("at"), F.col("id").alias("id")).alias("o"))
    tables = Tables(spark, "merge")
    ranked = tables.put(members.join(order, "id"), "ranked")
    top = ranked.groupBy("class").agg(F.min("o").alias("o"))
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))
    around = both.join(top.withColumnRenamed("class", "other"), "other").select("class", "o").unionByName(top).groupBy("class").agg(F.min("o").alias("first"))
    return ranked.join(around, "class").filter(F.col("o.id") != F.col("first.id")).select("id", F.col("first.id").alias("winner"))

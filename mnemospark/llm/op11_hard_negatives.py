"""Hard negatives by branch and bound over ball trees, one tree a part of the rows.

Rows are dealt to parts by hash, and the anchors, a stated set, visit every part. A part's rows come first
and are built into a ball tree; the anchors then stream past it in batches. A ball with centre c and radius r
bounds the inner products of its rows with q between ``q.c - |q| r`` and ``q.c + |q| r``: a node is left out
for anchors whose score windows it misses, for which it lies strictly beneath the current k-th hit, or where
no row has a label that is asked for. Each part gives its best few rows of an anchor and window, and a
window function keeps the best of all parts, so what is shuffled does not depend on how many rows match.

Scores are exact: inner products of whole numbers in double precision where they stay below 2**53, and in
unbounded integers beyond; one that 62 bits do not hold counts as the largest that they do.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part;
of rows with one id the one with the smallest label, then vector, counts; vectors of different length do not
meet; ties go by smaller id; an anchor without positives, or a positive without negatives, gives no row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import Scratch

#: Rows of a part at most, about: so many vectors are held by a task.
PART_ROWS = 100_000
#: Rows of a leaf at most, and anchors that visit a tree together.
LEAF, BATCH = 256, 1024
POSITIVES, NEGATIVES = 5, 3
_MOST = 1 << 62


class BallTree:
    """Rows in leaves of at most LEAF, in order of id within each; nodes with centre, radius and the one label they may have."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.labels, self.x = ids, labels, x
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.label: list[int | None] = []  # where all rows of a node have one
        self.below: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        self.large = float(np.abs(x).max(initial=0.0))
        self._grow(np.arange(len(ids)))

    def _grow(self, rows: np.ndarray) -> int:
        k, x = len(self.radius), self.x[rows]
        c = x.mean(0)
        self.centre.append(c)
        self.radius.append(float(np.sqrt(((x - c) ** 2).sum(1).max(initial=0.0))))
        labels = self.labels[rows]
        self.label.append(int(labels[0]) if (labels == labels[0]).all() else None)
        self.below.append(None)
        self.rows.append(rows)
        if len(rows) > LEAF:
            wide = x[:, np.argmax(np.ptp(x, axis=0))] if x.shape[1] else np.zeros(len(rows))
            order, half = np.argsort(wide, kind="stable"), len(rows) // 2
            left = self._grow(np.sort(rows[order[:half]]))
            self.below[k] = (left, self._grow(np.sort(rows[order[half:]])))
            self.rows[k] = rows[:0]
        return k

    def search(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of shape (anchors, windows, k), best first, id -1 where there is none: for each anchor q the k best rows with low <= score <= high, of its label or of others."""
        m, w = low.shape
        scores, ids = np.full((m, w, k), -_MOST - 1, np.int64), np.full((m, w, k), -1, np.int64)
        size = np.sqrt((q * q).sum(1))
        # Sums below 2**53 are exact in double precision, in whatever order they are taken.
        exact = self.large * float(np.abs(q).max(initial=0.0)) * max(q.shape[1], 1) < 2.0**53
        stack = [(0, np.arange(m))]
        while stack:
            node, who = stack.pop()
            one = self.label[node]
            if one is not None:
                who = who[(label[who] == one) == same]
            if not len(who):
                continue
            mid, reach = q[who] @ self.centre[node], size[who] * self.radius[node]
            slack = 1 + 1e-9 * (np.abs(mid) + reach)
            worst = np.maximum(low[who], scores[who, :, -1])
            can = ((mid + reach + slack)[:, None] >= worst) & ((mid - reach - slack)[:, None] <= high[who])
            who = who[can.any(1)]
            if not len(who):
                continue
            if self.below[node] is not None:
                a, b = self.below[node]
                if (q[who] @ (self.centre[a] - self.centre[b])).sum() > 0:
                    a, b = b, a
                stack += [(a, who), (b, who)]  # the likelier one is taken first
                continue
            self._leaf(self.rows[node], who, q, own, label, low, high, k, same, exact, scores, ids)
        return scores, ids

    def _leaf(self, rows, who, q, own, label, low, high, k, same, exact, scores, ids) -> None:
        if exact:
            s = np.rint(q[who] @ self.x[rows].T).astype(np.int64)
        else:
            whole = np.vectorize(int, otypes=[object])
            s = np.clip(whole(q[who]) @ whole(self.x[rows]).T, -_MOST, _MOST).astype(np.int64) if q.shape[1] else np.zeros((len(who), len(rows)), np.int64)
        fits = (self.labels[rows] == label[who, None]) == same
        fits &= self.ids[rows] != own[who, None]
        for j in range(low.shape[1]):
            ok = fits & (s >= np.maximum(low[who, j], scores[who, j, -1])[:, None]) & (s <= high[who, j][:, None])
            hit = np.flatnonzero(ok.any(1))
            if not len(hit):
                continue
            at, t = who[hit], np.where(ok[hit], s[hit], -_MOST - 1)
            # Leaves and hits stand by id: a stable order by score leaves ties to the smaller id within a leaf.
            first = np.argsort(-t, axis=1, kind="stable")[:, :k]
            t = np.concatenate([scores[at, j], np.take_along_axis(t, first, 1)], 1)
            i = np.concatenate([ids[at, j], self.ids[rows][first]], 1)
            order = np.lexsort((i, -t), axis=1)[:, :k]
            t, i = np.take_along_axis(t, order, 1), np.take_along_axis(i, order, 1)
            scores[at, j], ids[at, j] = t, np.where(t >= -_MOST, i, -1)


_OUT = "anchor_id long, win int, id long, score long"


def _visits(k: int, same: bool):
    """A function over batches sorted by (dim, part, side, id): rows (side 0) become a tree, anchors (side 1) visit it."""

    def vectors(b: pa.RecordBatch, name: str, kind) -> np.ndarray:
        c = b.column(name)
        return c.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1)

    def run(batches):
        now, tree, held, waiting, count = None, None, [], [], 0

        def visit():
            nonlocal waiting, count
            if tree is not None and waiting:
                a = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                own, label = a.column("id").to_numpy(), a.column("label").to_numpy()
                low, high = vectors(a, "low", np.int64), vectors(a, "high", np.int64)
                scores, ids = tree.search(vectors(a, "vec", float), own, label, low, high, k, same)
                n, w, j = np.nonzero(scores >= -_MOST)
                yield pa.RecordBatch.from_arrays([pa.array(own[n]), pa.array(w.astype(np.int32)), pa.array(ids[n, w, j]), pa.array(scores[n, w, j])], ["anchor_id", "win", "id", "score"])
            waiting, count = [], 0

        for b in batches:
            dims, parts, sides = (b.column(c).to_numpy() for c in ("dim", "part", "side"))
            cuts = np.flatnonzero(np.diff(dims) | np.diff(parts) | np.diff(sides)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if i == j:
                    continue
                if now != (dims[i], parts[i]):
                    yield from visit()
                    now, tree, held = (dims[i], parts[i]), None, []
                piece = b.slice(i, j - i)
                if sides[i] == 0:
                    held.append((piece.column("id").to_numpy().copy(), piece.column("label").to_numpy().copy(), vectors(piece, "vec", float).copy()))
                    continue
                if held:
                    tree, held = BallTree(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                waiting.append(piece)
                count += piece.num_rows
                if count >= BATCH:
                    yield from visit()
        yield from visit()

    return run


def _meet(rows: DataFrame, anchors: DataFrame, parts: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, win, id, score, rank): the k best rows of each anchor and score window over all parts."""
    nothing = F.array().cast("array<long>")
    r = rows.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("side"), "id", "label", "vec", nothing.alias("low"), nothing.alias("high"))
    a = anchors.select(F.size("vec").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("side"), "id", "label", "vec", "low", "high")
    met = r.unionByName(a).repartition(parts, "dim", "part").sortWithinPartitions("dim", "part", "side", "id")
    found = met.mapInArrow(_visits(k, same), _OUT)
    w = Window.partitionBy("anchor_id", "win").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def usable(rows: DataFrame) -> DataFrame:
    """(id, label, vec) of the rows that take part, one an id; components become whole numbers in double precision."""
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<double>").alias("vec")).filter(good)
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x"))
    return one.select("id", "x.label", "x.vec")


def mine(spark: SparkSession, rows: DataFrame, anchor: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (id, label, vec of whole numbers).

    ``anchor`` is a condition on id. A negative scores between low and high per cent of its positive.
    """
    scratch = Scratch(spark, "hard-negatives")
    rows = scratch.put(usable(rows), "rows")
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    anchors = rows.filter(anchor)
    every = anchors.withColumns({"low": F.array(F.lit(-_MOST)), "high": F.array(F.lit(_MOST))})
    found = scratch.put(_meet(rows, every, parts, positives, True).select("anchor_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # The windows in whole numbers, exactly: low * p <= 100 * n <= high * p.
    p = F.col("positive_score").cast("decimal(20,0)")
    bounds = found.withColumns({"lo": F.ceil(p * low / 100).cast("long"), "hi": F.floor(p * high / 100).cast("long")}).groupBy("anchor_id")
    bounds = bounds.agg(F.array_sort(F.collect_list(F.struct("rank", "lo", "hi"))).alias("w"))
    bounds = bounds.select(F.col("anchor_id").alias("id"), F.col("w.lo").alias("low"), F.col("w.hi").alias("high"), F.size("w").alias("n"))
    # All anchors of a batch have as many windows: one that is missing is empty.
    filled = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.lit(positives) - F.col("n")))
    asked = anchors.join(bounds, "id").withColumns({"low": filled(F.col("low"), _MOST), "high": filled(F.col("high"), -_MOST)})
    hits = _meet(rows, asked, parts, negatives, False).select("anchor_id", (F.col("win") + 1).alias("w"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    both = hits.join(found.select(F.col("anchor_id").alias("a"), F.col("rank").alias("pr"), "positive_id", "positive_score"), (F.col("anchor_id") == F.col("a")) & (F.col("w") == F.col("pr")))
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.when(finite, scaled)
    return mine(spark, rows.select(F.col("vec_id").alias("id"), label.alias("label"), scaled.alias("vec")), "id % 50 = 0")


SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
           from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as materialized (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by score desc, id))::int as rank, id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, id) <= 3
"""

"""N-gram Jaccard self-join by blocked sparse products of the document by n-gram incidence.

1. Documents with equal shingle sets become one class, represented by its smallest id.
2. Two sets that are similar enough share k of their rarest shingles (k more than a set may lack, less
   one; k grows with long sets). Documents that meet at so many are pairs to look at, unless their
   sizes or the parity bits of their sets show that they differ in too many shingles. Where more than ``PAIRED`` meet,
   they are a crowd: it gets the parity bits, and stars of those that these let through stand for its pairs, so
   a passage that unlike documents share joins none of them. Components over these are weak components: no link leaves its weak component.
3. The shingles of classes in weak components of two and more move once. A block of rows times its
   transpose accumulates the overlap counts; pairs below the bound that their sizes give are discarded.
   A component larger than a block is cut into row blocks, and every two of them meet in a task.
4. Blocks return spanning stars of the links found; components over these are the classes' components.

Rarity is counted over all documents; the ``FREQUENT`` most frequent shingles come last in the order,
the others by hash. Any fixed order is exact; this one keeps passages that many documents share from
joining their documents into one weak component.

Defined cases: null, empty or blank text has no shingles and is linked with nothing; a null id is
reported with a null component; repeated rows of an id are rows of one class; no rows, no result.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.blocks import block_counts, dealt
from mnemospark.llm.common import Scratch, freed, hinted, pieces, sieved, text_bytes, trim
from mnemospark.llm.components import connected_components
from mnemospark.llm.texthash import mix, shingle_sets

#: Shingles whose frequency is kept (4 MB); a task reports at most so many of its own, seen LOCAL_LEAST times
#: in sets that differ (copies would crowd out the passages that unlike documents share).
FREQUENT, LOCAL_MOST, LOCAL_LEAST = 1 << 18, 150_000, 2
#: So many documents that meet at a shingle are paired with each other; more are a crowd, of which more than CROWD are cut into blocks.
PAIRED, CROWD = 20, 8192
#: Longs of parity bits, at least; a set of n shingles has n / 128 or more, a power of two. Bits that differ between two sets are at
#: most the shingles in which these differ, and bits of more longs are folded to fewer.
PARITY = 4
#: Shingles that documents meet at take turns, so that a share of them lies in shuffle files at a time.
TURNS = 4
#: Pairs of a crowd that are looked at at once.
LOOKED = 200_000
#: A block holds shingles of so many, each row counting for ROW_WEIGHT at least: at most 2,000 rows.
BLOCK_WEIGHT, ROW_WEIGHT = 2_000_000, 1_000
#: A column of at most so many rows is multiplied pair by pair.
LIGHT = 12


def sets_of(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return shingle_sets(*text_bytes(batch.column("text")), k)


def frequent(spark: SparkSession, docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted by hash, and their counts: a table of bounded size."""

    def run(batches):
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        met: set[int] = set()

        def fold(values, counts, held, most):
            """Sorted values and their counts with those held; what is held is counted first, so little is sorted beside the table."""
            h, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(values, h)
            known = at < len(values)
            known[known] = values[at[known]] == h[known]
            counts[at[known]] += n[known]
            values, counts = np.r_[values, h[~known]], np.r_[counts, n[~known]]
            keep = np.argpartition(-counts, most)[:most] if len(values) > most else np.arange(len(values))
            keep = keep[np.argsort(values[keep], kind="stable")]
            return values[keep], counts[keep]

        for b in pieces(batches, "text"):
            for s in sets_of(b, k):
                if (key := hash(s.tobytes())) not in met:
                    met.add(key)
                    held.append(s)
            if sum(map(len, held)) > 1_000_000:
                (values, counts), held = fold(values, counts, held, 2_000_000), []
        values, counts = fold(values, counts, [*held, values[:0]], LOCAL_MOST)
        held, met = [], set()
        keep = counts >= LOCAL_LEAST
        values, counts = values[keep], counts[keep]
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["h", "n"])

    found = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    scratch = Scratch(spark, "frequent")
    found = scratch.put(found.withColumn("class", F.floor(64 * F.log2("n")).cast("int")), "found")
    # Whole classes of counts, from the top, as many as fit: a few thousand classes at most come to the driver, and no sort is needed.
    least, left = 1 << 30, FREQUENT
    for c, n in sorted((tuple(r) for r in found.groupBy("class").count().collect()), reverse=True):
        if n > left:
            break
        least, left = c, left - n
    top = found.filter(F.col("class") >= least).select("h", "n").toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    scratch.drop("found")
    order = np.argsort(h)
    return h[order], n[order]


def shared_least(n):
    """How many rare shingles a set of n shows beyond those it may lack; linked sets share the smaller set's number."""
    return 1 + np.maximum(n - 800, 0) // 20


def rarest(s: np.ndarray, n: int, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n of a sorted set in the order of frequency, then hash: those of at most PAIRED documents, and the others."""
    if not len(values):
        return s[:n], s[:0]
    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
    common = values[at] == s
    rare = s[~common][:n]
    if len(rare) == n:
        return rare, s[:0]
    c, x = counts[at[common]], s[common]
    order = np.lexsort((x, c))[: n - len(rare)]
    crowd = c[order] > PAIRED
    return np.concatenate([rare, x[order][~crowd]]), x[order][crowd]


def parity(s: np.ndarray) -> np.ndarray:
    """A bit for each of many places: whether an odd number of the set's shingles falls there."""
    places = 64 * max(PARITY, 1 << max(0, -(-len(s) // 128) - 1).bit_length())
    odd = (np.bincount((s >> np.uint64(20)).astype(np.int64) % places, minlength=places) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of parity bits as those of fewer places."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), bits.shape[1] // width, width), axis=1)


def crowd_stars(rep: np.ndarray, n: np.ndarray, bits: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): trees over the pairs of a crowd that sizes and parity bits let through."""
    order = np.argsort(n, kind="stable")
    rep, n, width = rep[order], n[order].astype(np.int64), np.array([len(bits[k]) for k in order])
    at, table = np.zeros(len(rep), np.int64), {}
    for w in np.unique(width).tolist():
        some = np.flatnonzero(width == w)
        at[some], table[w] = np.arange(len(some)), np.stack([bits[k] for k in order[some]])
    end = np.searchsorted(percent * n, 100 * n, side="right")  # a row and those after it that are short enough
    root = np.arange(len(rep))
    done = np.r_[0, np.cumsum(end - np.arange(len(rep)) - 1)]
    first = 0
    while first < len(rep):
        last = max(first + 1, int(np.searchsorted(done, done[first] + LOOKED, side="right")) - 1)
        count = done[first + 1 : last + 1] - done[first:last]
        i = np.repeat(np.arange(first, last), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        new = root[i] != root[j]  # what is joined already need not be looked at
        i, j = i[new], j[new]
        apart = np.zeros(len(i), np.int64)
        for w, v in np.unique(np.stack([width[i], width[j]], axis=1), axis=0).tolist() if width[0] != width[-1] else [width[:2].tolist()]:
            some = np.flatnonzero((width[i] == w) & (width[j] == v))
            apart[some] = np.bitwise_count(table[w][at[i[some]]] ^ folded(table[v][at[j[some]]], w)).sum(axis=1, dtype=np.int64)
        near = apart * (100 + percent) <= (100 - percent) * (n[i] + n[j])
        i, j = i[near], j[near]
        while len(i):  # the smaller root of a pair becomes that of both
            low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
            left = root[i] != root[j]
            i, j = i[left], j[left]
        first = last
    some = np.flatnonzero(root != np.arange(len(rep)))
    return rep[some], rep[root[some]]


def longs(lists: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The product of the incidence matrix and its transpose: how many shingles rows i and j share."""
    m = len(sets)
    if m == 2:
        return np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[col] > 1
    rows, col = rows[shared], col[shared]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    if not len(rows):
        return np.zeros((m, m), np.int64)
    starts = np.flatnonzero(np.r_[True, col[1:] != col[:-1]])
    width = np.diff(np.r_[starts, len(col)])
    acc = np.zeros(m * m, np.float32)
    for d in np.unique(width[width <= LIGHT]):  # light columns: their pairs one by one
        of = rows[starts[width == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                np.add.at(acc, of[:, i] * m + of[:, j], 1)
    acc = acc.reshape(m, m)
    heavy, wide = starts[width > LIGHT], width[width > LIGHT]
    step = max(1, 4_000_000 // m)
    for at in range(0, len(heavy), step):  # heavy columns: dense blocks of them
        s, w = heavy[at : at + step], wide[at : at + step]
        dense = np.zeros((m, len(s)), np.float32)
        dense[rows[np.concatenate([np.arange(a, a + n) for a, n in zip(s, w, strict=True)])], np.repeat(np.arange(len(s)), w)] = 1
        acc += dense @ dense.T
    return np.triu(acc, 1)


def stars(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(node, root) for the nodes of each set of linked rows but its root, the smallest id."""
    m = len(ids)
    size = np.array([len(s) for s in sets], np.int64)
    shared = overlaps(sets).astype(np.int64)
    # 100 i >= p (a + b - i): the bound on the overlap that the two sizes give
    linked = (shared > 0) & ((100 + percent) * shared >= percent * (size[:, None] + size[None, :]))
    linked = np.triu(linked, 1)
    linked |= linked.T
    out, left = [], np.ones(m, bool)
    for i in np.argsort(ids, kind="stable"):
        if left[i]:
            left[i] = False
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & left)
                left[front] = False
                out += [(int(x), int(ids[i])) for x in ids[front]]
    return out


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    common = spark.sparkContext.broadcast(frequent(spark, docs, k))

    def signatures(batches):
        values, counts = common.value
        for b in pieces(batches, "text"):
            sets = sets_of(b, k)
            with np.errstate(over="ignore"):
                keys = [(int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))) for s in sets]
            rare = [rarest(s, len(s) - -(-percent * len(s) // 100) + int(shared_least(len(s))), values, counts) if len(s) else (s, s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.int64()), longs([x for x, _ in rare]), longs([x for _, x in rare]), longs([parity(s) for s in sets])],
                ["doc_id", "n", "k1", "k2", "rare", "hot", "bits"],
            )

    t = scratch.put(docs.mapInArrow(signatures, "doc_id long, n long, k1 long, k2 long, rare array<long>, hot array<long>, bits array<long>"), "signatures")
    some = t.filter("n > 0 and doc_id is not null")
    classes = some.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    classes = scratch.put(classes, "classes")

    # Rare shingles of representatives: who meets whom. Their rows are wide and are not shuffled; a row besides them that the sieve lets through
    # is looked at in vain.
    reps = classes.select("rep", "n", "k1", "k2")
    some = sieved(spark, some, "doc_id", reps.select("rep")).select(F.col("doc_id").alias("rep"), F.col("n").cast("int").alias("n"), "rare", "hot", "bits")

    def meet(batches):
        """Pairs of those that meet at a shingle and whose sizes allow it; of more than PAIRED, each with the shingle (``crowd``)."""
        cols = [[b.column(c).to_numpy() for c in ("h", "rep", "n")] for b in batches]
        if not cols:
            return
        h, rep, n = (np.concatenate(x) for x in zip(*cols, strict=True))
        order = np.argsort(h, kind="stable")
        h, rep, n = h[order], rep[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[first, len(h)])
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in np.unique(size[(size > 1) & (size <= PAIRED)]):
            rows = first[size == m][:, None] + np.arange(m)
            for d in range(1, int(m)):
                i, j = rows[:, :-d].ravel(), rows[:, d:].ravel()
                fit = percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])
                x.append(rep[i[fit]])
                y.append(rep[j[fit]])
        x, y = np.concatenate(x), np.concatenate(y)
        out, met = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0, return_counts=True)
        many = np.repeat(size > PAIRED, size)
        a, b = np.r_[out[:, 0], rep[many]], np.r_[out[:, 1], h[many]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) >= len(out)), pa.array(np.r_[met, np.ones(many.sum(), np.int64)])], ["a", "b", "crowd", "met"])

    found = []
    for turn in range(TURNS):
        post = some.select("rep", "n", F.explode("rare").alias("h")).filter(F.pmod("h", F.lit(TURNS)) == turn).repartition("h")
        found.append(scratch.put(post.mapInArrow(meet, "a long, b long, crowd boolean, met long").filter("crowd or a <> b"), f"met{turn}"))
        post = None
        freed(spark)
    found = functools.reduce(DataFrame.unionByName, found)
    pairs = scratch.put(found.filter("not crowd").groupBy("a", "b").agg(F.sum("met").alias("met")), "pairs")
    side = some.select("rep", "n", "bits")
    fold = lambda x, y: F.expr(f"case when size({x}) <= size({y}) then {x} else transform({y}, (_, i) -> aggregate(sequence(0, size({x}) div size({y}) - 1), 0L, (s, f) -> s ^ {x}[cast(f * size({y}) + i as int)])) end")
    differ = F.aggregate(F.zip_with(fold("x.bits", "y.bits"), fold("y.bits", "x.bits"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    look = pairs.join(side.select(F.col("rep").alias("a"), F.struct("n", "bits").alias("x")), "a")
    look = look.join(side.select(F.col("rep").alias("b"), F.struct("n", "bits").alias("y")), "b")
    smaller = F.least("x.n", "y.n")
    look = look.filter(F.col("met") >= 1 + F.floor(F.greatest(smaller - 800, F.lit(0)) / 20))
    look = scratch.put(look.filter(differ * (100 + percent) <= (100 - percent) * (F.col("x.n") + F.col("y.n"))).select("a", "b"), "look")
    freed(spark)

    def crowd_links(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("component")
        component, rep, n = (t.column(c).to_numpy() for c in ("component", "rep", "n"))
        size = pa.compute.list_value_length(t.column("bits")).to_numpy()
        bits = np.split(pa.compute.list_flatten(t.column("bits")).to_numpy().view(np.uint64), np.cumsum(size)[:-1])
        out = [np.zeros((0, 2), np.int64)]
        first = np.flatnonzero(np.r_[True, component[1:] != component[:-1]])
        for f, e in zip(first.tolist(), [*first[1:].tolist(), t.num_rows], strict=True):
            if e > f + 1:
                out.append(np.stack(crowd_stars(rep[f:e], n[f:e], bits[f:e], percent), axis=1))
        out = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    crowd = found.filter("crowd").select(F.col("a").alias("rep"), F.col("b").alias("component")).unionByName(some.select("rep", F.explode("hot").alias("component")))
    crowd = scratch.put(crowd.join(side, "rep").withColumn("weight", F.lit(1)), "crowds")
    freed(spark)
    counts, tasks = block_counts(crowd, "weight", CROWD)
    blocks = dealt(crowd.join(hinted(scratch.put(counts, "crowd_counts")), "component"), "rep", tasks)
    trees = scratch.put(blocks.groupBy("t", "i", "j").applyInArrow(crowd_links, "a long, b long"), "trees")
    freed(spark)
    weak = scratch.put(connected_components(spark, look.unionByName(trees), "a", "b"), "weak")
    for done in (*(f"met{turn}" for turn in range(TURNS)), "pairs", "look", "crowds", "crowd_counts", "trees"):
        scratch.drop(done)
    freed(spark)

    # Blocks of rows: whole weak components, or every two row blocks of a large one.
    rows = scratch.put(weak.join(reps.select(F.col("rep").alias("node"), "n"), "node"), "rows")
    counts, tasks = block_counts(rows.withColumn("weight", F.greatest("n", F.lit(ROW_WEIGHT))), "weight", BLOCK_WEIGHT)
    rows = scratch.put(rows.join(counts, "component").select(F.col("node").alias("doc_id"), "component", "nb"), "dealt")

    def ship(batches):
        for b in pieces(batches, "text"):
            sets = sets_of(b, k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("component"), b.column("nb"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "component", "nb", "elements"])

    sets = sieved(spark, docs, "doc_id", rows.select("doc_id")).join(hinted(rows), "doc_id").mapInArrow(ship, "node long, component long, nb int, elements binary")
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, g in pdf.drop_duplicates(["node"]).groupby("component", sort=False):
            if len(g) > 1:
                found += stars(g["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in g["elements"]], percent)
        return pd.DataFrame(found, columns=["node", "root"], dtype="int64")

    links = scratch.put(dealt(sets, "node", tasks).groupBy("t", "i", "j").applyInPandas(link, "node long, root long"), "links")
    strong = scratch.put(connected_components(spark, links, "node", "root"), "strong")

    # Only classes of several rows or in a component need to be looked up; any other row is its own component.
    found = classes.join(hinted(strong).withColumnRenamed("node", "rep"), "rep", "left")
    found = scratch.put(found.filter("members > 1 or component is not null").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component")), "found")
    for done in ("classes", "weak", "rows", "dealt", "links", "strong"):
        scratch.drop(done)
    out = t.filter("n > 0").select("doc_id", "n", "k1", "k2").join(hinted(found), ["n", "k1", "k2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.unionByName(t.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)

"""Problem 1: the most similar vectors of every vector.

Low-dimensional stable projections indexed by kd-trees. Every tree has its own
Gaussian (2-stable) projection into ``DIMS`` dimensions and a kd-tree over it,
whose splits are fitted on a bounded sample; every vector is indexed. Its
cells, of about ``CELL`` rows, are what is shuffled; a cell that holds more than
four times that is split again by a sample of its own, until none is left. In
its task a cell is searched by kd-trees over projections of its own, fitted on
all its rows, down to leaves of ``LEAF`` rows.

In a leaf the neighbours of a block of rows come chunk by chunk. A neighbour
is verified by the full vectors only if the chi-square test does not hold for
it: for vectors at distance d the squared projected distance is d^2 times a
chi-square variable with ``DIMS`` degrees of freedom, so beyond d^2 *
quantile(1 - miss) a vector as near as d is left only with probability
``miss``. Here d is the distance of the k-th best so far of each row (and at
most the distance searched for, where there is one), so the test tightens as
neighbours are found. The numbers of trees follow from the depths and the
recall wanted.

Two searches use the index. ``similar_pairs`` asks for neighbours above a
cosine. ``knn`` asks for the k nearest of every vector however far they are;
how far that is in these data it measures on a bounded sample of vectors
against all, and takes as many trees as the recall wanted needs. Where vectors
are hardly more alike than chance (as embeddings without structure are), that
number grows with a power of the size: no index avoids it.

Defined results: null, empty and all-zero vectors, vectors with a null, NaN or
infinite element and vectors of another length than ``dim`` have no
neighbours; a null key has none; repeats of a key are one vector (of the
repeats with different vectors each counts for the key); equal vectors are one
point of the index and are linked directly, each with the k + 1 smallest keys
of its class only (by the tie rule the others are never nearer); among equally
near ones the smaller key comes first; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import flat
from lexspark.sources.tables import cut

DIMS = 16
#: Rows of a cell that is shuffled, and of a leaf that is searched in its task.
CELL = 32_768
LEAF = 2048
#: The trees are fitted on this many vectors (bounded); all vectors are indexed.
FIT_ROWS = 40_000
#: Cells split again in one round, each by this many of its vectors at most.
ROUND_CELLS, CELL_FIT = 64, 4096
#: Vectors on which ``knn`` measures how far the k nearest are.
PROBES = 128
#: Share of partners that the chi-square test may leave unverified in a cell.
MISS = 0.03
RECALL = 0.985
BLOCK = 512
CHUNK = 4096


def chi2_quantile(p: float, m: int) -> float:
    """The p-quantile of chi-square with an even number m of degrees of freedom (bisection)."""

    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def depth_and_trees(rows: int, cosine: float, leaf: int = CELL, recall: float = RECALL) -> tuple[int, int]:
    """Levels of the kd-trees and how many trees reach ``recall`` for a pair somewhat above ``cosine``.

    A pair at angle a stays together at a median split with probability
    1 - a / pi; trees have independent projections.
    """
    depth = max(0, math.ceil(math.log2(max(1, rows) / leaf)))
    stay = (1 - math.acos(min(1.0, cosine + 0.02)) / math.pi) ** depth * (1 - MISS)
    return depth, max(2, math.ceil(math.log(1 - recall) / math.log(1 - stay)))


def projection(tree: int, dim: int) -> np.ndarray:
    return np.random.default_rng([7919, tree]).standard_normal((dim, DIMS)).astype("f4")


def fit_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split dimension and threshold of every inner node, in heap order: median of the widest dimension."""
    axis, cutoff = np.zeros(2**depth - 1, "i4"), np.zeros(2**depth - 1, "f4")
    node = [np.arange(len(points))]
    for k in range(2**depth - 1):
        own = points[node[k]]
        if len(own):
            axis[k] = int(np.argmax(own.var(axis=0)))
            cutoff[k] = np.median(own[:, axis[k]])
        elif k:
            axis[k] = k % DIMS
        right = own[:, axis[k]] > cutoff[k] if len(own) else np.zeros(0, bool)
        node += [node[k][~right], node[k][right]]
    return axis, cutoff


def route(points: np.ndarray, axis: np.ndarray, cutoff: np.ndarray, depth: int) -> np.ndarray:
    at = np.zeros(len(points), "i8")
    rows = np.arange(len(points))
    for _ in range(depth):
        at = 2 * at + 1 + (points[rows, axis[at]] > cutoff[at])
    return at - (2**depth - 1)


def unit_vectors(df: DataFrame, key: str, vector: str, dim: int, kind: str = "f2") -> DataFrame:
    """(id long, vec binary, vkey long): usable vectors at unit length, as half floats by default; vkey hashes the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            values, offsets = flat(lists)
            good = (np.diff(offsets) == dim) & ~ids.is_null().to_numpy(zero_copy_only=False)
            at = offsets[:-1][good]
            x = values.to_numpy(zero_copy_only=False).astype("f4")  # a null element becomes NaN
            x = x[at[:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim), "f4")
            # exact scaling by a power of two first: neither huge nor tiny lengths overflow
            with np.errstate(all="ignore"):
                top = np.abs(x).max(axis=1, initial=0)
                x = x / top[:, None]
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            fine = np.isfinite(x).all(axis=1) & (top > 0)
            h = x[fine].astype(kind)
            raw = [r.tobytes() for r in h]
            hashes = np.fromiter((xxhash.xxh64_intdigest(r) for r in raw), "u8", len(raw)).view("i8")
            out = ids.to_numpy(zero_copy_only=False)[good][fine].astype("i8")
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(raw, pa.binary()), pa.array(hashes)], ["id", "vec", "vkey"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(run, "id long, vec binary, vkey long")


class Forest:
    """Trees of equal depth, and subtrees for the leaves that hold too much. A leaf is numbered within its tree."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray]], depth: int, dim: int):
        self.trees, self.depth, self.dim = trees, depth, dim
        self.size = [2**depth] * len(trees)
        self.more: list[dict[int, tuple[np.ndarray, np.ndarray, int, int]]] = [{} for _ in trees]

    def grow(self, tree: int, leaf: int, points: np.ndarray, levels: int) -> bool:
        """Splits a leaf by some of its (projected) points; whether that parts them."""
        if (points == points[:1]).all():
            return False
        axis, cutoff = fit_tree(points, levels)
        self.more[tree][leaf] = (axis, cutoff, levels, self.size[tree])
        self.size[tree] += 2**levels
        return True

    def cells(self, tree: int, x: np.ndarray) -> np.ndarray:
        p = x @ projection(tree, self.dim)
        at = route(p, *self.trees[tree], self.depth)
        for leaf, (axis, cutoff, levels, first) in self.more[tree].items():  # in the order of growth
            rows = np.flatnonzero(at == leaf)
            if len(rows):
                at[rows] = first + route(p[rows], axis, cutoff, levels)
        return at


def _vectors(vecs: pa.Array, dim: int, kind: str = "f2") -> np.ndarray:
    return np.frombuffer(b"".join(vecs.to_pylist()), kind).reshape(-1, dim).astype("f4")


def _cells(forest: Forest, counts: bool = False):
    """(cell, id, vec) of every vector in every tree; with ``counts`` only how many a cell gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vecs = batch.column(0), batch.column(1)
            x = _vectors(vecs, forest.dim)
            for t in range(len(forest.trees)):
                cell = forest.cells(t, x) + (t << 40)
                if counts:
                    own, n = np.unique(cell, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n.astype("i8"))], ["cell", "n"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(cell), ids, vecs], ["cell", "id", "vec"])

    return run


def _some_of(forest: Forest, share: dict[int, float]):
    """(cell, vec): about ``share`` of the vectors of the cells named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1), forest.dim)
            luck = ((batch.column(0).to_numpy().view("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype("f8") / 2**24
            for t in sorted({c >> 40 for c in share}):
                cell = forest.cells(t, x) + (t << 40)
                most = np.array([share.get(c, 0.0) for c in cell.tolist()])
                at = pa.array(np.flatnonzero(luck < most))
                yield pa.RecordBatch.from_arrays([pa.array(cell).take(at), batch.column(1).take(at)], ["cell", "vec"])

    return run


def build(points: DataFrame, n: int, dim: int, depth: int, count: int, cell: int | None = None) -> Forest:
    """Trees over (id, vec), fitted on bounded samples; no cell is left with more than four times ``cell`` rows if a split parts it."""
    cell = CELL if cell is None else cell
    part = min(1.0, FIT_ROWS / max(1, n))
    sample = points.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(part * 1_000_000) + 1).select("vec").limit(2 * FIT_ROWS).toPandas()["vec"]
    x = np.frombuffer(b"".join(sample), "f2").reshape(-1, dim).astype("f4")
    forest = Forest([fit_tree(x @ projection(t, dim), depth) for t in range(count)], depth, dim)
    whole: set[int] = set()
    while True:
        sizes = points.mapInArrow(_cells(forest, counts=True), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        # the largest first; few, as a round splits no more
        large = [r for r in sizes.filter(F.col("n") > 4 * cell).orderBy(F.desc("n"), "cell").limit(ROUND_CELLS + len(whole)).collect() if r["cell"] not in whole][:ROUND_CELLS]
        if not large:
            return forest
        share = {r["cell"]: CELL_FIT / r["n"] for r in large}
        got = points.mapInArrow(_some_of(forest, share), "cell long, vec binary").toPandas()
        for r in large:
            c = r["cell"]
            own = np.frombuffer(b"".join(got["vec"][got["cell"] == c]), "f2").reshape(-1, dim).astype("f4")
            levels = min(8, math.ceil(math.log2(r["n"] / cell)))
            if len(own) < 2 or not forest.grow(c >> 40, c & ((1 << 40) - 1), own @ projection(c >> 40, dim), levels):
                whole.add(c)


def leaves(p: np.ndarray, leaf: int) -> list[np.ndarray]:
    """A kd-tree over points: the rows of its leaves, halved at the median of the widest dimension until they hold ``leaf`` rows at most."""
    todo, out = [np.arange(len(p))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        own = p[rows]
        order = np.argpartition(own[:, int(np.argmax(own.var(axis=0)))], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def search(x: np.ndarray, p: np.ndarray, k: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the k best neighbours of every row at ``cosine`` or more, among those the chi-square test leaves to verify."""
    quantile = np.float32(chi2_quantile(1 - MISS, DIMS))
    sq = (p * p).sum(axis=1)
    one = np.ones_like(sq)
    left, right = np.column_stack([p, sq, one]), np.ascontiguousarray(np.column_stack([-2 * p, one, sq]).T)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(x), BLOCK):
        rows = x[a : a + BLOCK]
        least = np.full(len(rows), cosine - 0.004, "f4")  # the k-th best of each row so far
        best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for b in range(0, len(x), CHUNK):
            near = left[a : a + BLOCK] @ right[:, b : b + CHUNK]  # squared projected distances
            test = near <= (2 * (1 - least) * quantile)[:, None]  # the chi-square test holds for all others
            n = np.count_nonzero(test)
            if n * 8 > test.size:
                c = np.where(test, rows @ x[b : b + CHUNK].T, np.float32(-9))
                good, few = c >= least[:, None], min(k + 1, c.shape[1])
                if np.count_nonzero(good) > 4 * few * len(rows):
                    # no more than each row's k best (one more, as it may meet itself) and their equals
                    good &= c >= np.partition(c, -few, axis=1)[:, -few][:, None]
                i, j = np.nonzero(good)
                c = c[i, j]
            elif n:
                i, j = np.nonzero(test)
                c = np.concatenate([np.einsum("ij,ij->i", rows[i[s : s + (1 << 17)]], x[b + j[s : s + (1 << 17)]]) for s in range(0, n, 1 << 17)])
            else:
                continue
            ok = (c >= least[i]) & (i + a != j + b)
            i, j, c = i[ok], j[ok] + b, c[ok]
            if not len(i):
                continue
            best = _top(i, j, c, k) if best is None else _top(*(np.concatenate(z) for z in zip(best, (i, j, c))), k)
            first = np.searchsorted(best[0], np.arange(len(rows)))
            full = np.searchsorted(best[0], np.arange(len(rows)), side="right") - first >= k
            least[full] = best[2][first[full] + k - 1]
        if best is not None:
            found.append((best[0] + a, best[1], best[2]))
    if not found:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "f4")
    return tuple(np.concatenate(z) for z in zip(*found))


def _partners(dim: int, k: int, cosine: float, aim: float, leaf: int | None):
    """Within one cell: (a, b, cosine) of every row's k best partners among those verified; ``aim`` is the cosine that the trees are to find."""

    def run(key: tuple, tab: pa.Table) -> pa.Table:
        tree = key[0].as_py() >> 40
        ids, x = tab["id"].to_numpy(), _vectors(tab["vec"], dim)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        _, count = depth_and_trees(len(ids), aim, leaf) if leaf and len(ids) > leaf else (0, 1)
        best = None
        for t in range(count):
            p = x @ projection((tree + 1) * 1009 + t, dim)
            for rows in leaves(p, leaf or len(p)):
                rows.sort()  # neighbours stay in the order of keys
                i, j, c = search(x[rows], p[rows], k, cosine)
                got = (rows[i], rows[j], c)
                best = [got] if best is None else [*best, got]
            # those of all trees so far, each once
            i, j, c = (np.concatenate(z) for z in zip(*best))
            _, once = np.unique(i * len(ids) + j, return_index=True)
            best = [_top(i[once], j[once], c[once], k)]
        i, j, c = best[0]
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        return pa.table({"a": a.astype("i8"), "b": b.astype("i8"), "c": c.astype("f8")})

    return run


def _top(i: np.ndarray, j: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best partners j of every i; the smaller j (they are in the order of keys) first among equals."""
    order = np.lexsort((j, -c, i))
    i, j, c = i[order], j[order], c[order]
    first = np.searchsorted(i, i, side="left")
    keep = np.arange(len(i)) - first < k
    return i[keep], j[keep], c[keep]


def _points(df: DataFrame, key: str, vector: str, dim: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vkey, id) of all keys, (vkey, heads) with the k + 1 smallest keys of every vector, and the distinct vectors (id = vkey, vec)."""
    own = cut(unit_vectors(df, key, vector, dim))
    ids = own.select("vkey", "id").distinct()
    # the rank limit also runs before the shuffle
    w = Window.partitionBy("vkey").orderBy("id")
    heads = ids.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).groupBy("vkey").agg(F.array_sort(F.collect_list("id")).alias("heads"))
    points = own.groupBy("vkey").agg(F.first("vec").alias("vec"))
    return ids, cut(heads), cut(points.select(F.col("vkey").alias("id"), "vec"))


def _expanded(near: DataFrame, ids: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """(q, id, cosine, rank): the k best of every key, from pairs (a, b, c) of vectors and the keys of each vector."""
    h = heads.select(F.col("vkey").alias("a"), F.col("heads").alias("ha"))
    g = heads.select(F.col("vkey").alias("b"), F.col("heads").alias("hb"))
    across = near.join(h, "a").join(g, "b").select(F.explode("ha").alias("x"), "hb", "c").select("x", F.explode("hb").alias("y"), "c")
    # copies of one vector: every key with the k + 1 smallest of its class
    many = heads.filter(F.size("heads") > 1)
    within = ids.join(many, "vkey").select(F.col("id").alias("x"), F.explode("heads").alias("y"), F.lit(1.0).alias("c"))
    both = across.unionByName(within).filter("x <> y")
    pairs = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "c").groupBy("a", "b").agg(F.max("c").alias("c"))
    ends = pairs.select(F.col("a").alias("q"), F.col("b").alias("id"), F.col("c").alias("cosine")).unionByName(pairs.select(F.col("b").alias("q"), F.col("a").alias("id"), F.col("c").alias("cosine")))
    top = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
    return ends.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)


def _near(points: DataFrame, forest: Forest, k: int, cosine: float, aim: float, leaf: int | None) -> DataFrame:
    cells = points.mapInArrow(_cells(forest), "cell long, id long, vec binary").groupBy("cell")
    return cells.applyInArrow(_partners(forest.dim, k, cosine, aim, leaf), "a long, b long, c double").groupBy("a", "b").agg(F.max("c").alias("c"))


def similar_pairs(df: DataFrame, key: str = "id", vector: str = "embedding", dim: int = 64, cosine: float = 0.90, k: int = 10) -> DataFrame:
    """(id_a, id_b, cosine): id_b is among the k nearest of id_a or the other way round, at ``cosine`` or more; id_a < id_b.

    Recall is that of the index (see ``depth_and_trees``); precision is exact
    up to the rounding of half floats (5e-4).
    """
    ids, heads, points = _points(df, key, vector, dim, k)
    n = points.count()
    depth, count = depth_and_trees(n, cosine)
    near = _near(points, build(points, n, dim, depth, count), k, cosine, cosine, LEAF)
    best = _expanded(near, ids, heads, k)
    return best.groupBy(F.least("q", "id").alias("id_a"), F.greatest("q", "id").alias("id_b")).agg(F.max("cosine").alias("cosine")).filter(F.col("cosine") >= cosine)


def trees_for(cosines: np.ndarray, depth: int, recall: float) -> int:
    """The least number of trees with which neighbours at these cosines are found with ``recall`` on average."""
    stay = (1 - np.arccos(np.clip(cosines, -1, 1)) / math.pi) ** depth * (1 - MISS)
    count = 1
    while len(stay) and (1 - (1 - stay) ** count).mean() < recall:
        count += 1
    return count


def knn(df: DataFrame, key: str = "id", vector: str = "embedding", dim: int = 64, k: int = 10, recall: float = 0.92) -> DataFrame:
    """(q, id, cosine, rank): the k nearest of every vector, found with ``recall`` on average.

    How near they are is measured on PROBES vectors against all others; the
    number of trees follows from it. Cells are searched as a whole.
    """
    ids, heads, points = _points(df, key, vector, dim, k)
    n = points.count()
    depth, _ = depth_and_trees(n, 0.0)
    count = 1
    if depth:
        probes = points.orderBy(F.xxhash64("id")).limit(PROBES).toPandas()
        q, own = np.frombuffer(b"".join(probes["vec"]), "f2").reshape(-1, dim).astype("f4"), probes["id"].to_numpy()

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Per task the k best of every probe."""
            top = np.full((len(q), k), -2, "f4")
            for b in batches:
                if b.num_rows:
                    c = q @ _vectors(b.column(1), dim).T
                    c[own[:, None] == b.column(0).to_numpy()[None, :]] = -2
                    top = -np.sort(-np.concatenate([top, c], axis=1), axis=1)[:, :k]
            probe, r = np.divmod(np.arange(top.size), k)
            yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(top.ravel().astype("f8"))], ["probe", "c"])

        w = Window.partitionBy("probe").orderBy(F.desc("c"))
        sure = points.mapInArrow(best, "probe long, c double").withColumn("r", F.row_number().over(w)).filter((F.col("r") <= k) & (F.col("c") > -2)).toPandas()["c"]
        count = trees_for(sure.to_numpy(), depth, recall)
    near = _near(points, build(points, n, dim, depth, count), k, -1.0, 0.0, None)
    return _expanded(near, ids, heads, k)


def nearest(df: DataFrame, queries: DataFrame, key: str = "id", vector: str = "embedding", dim: int = 64, k: int = 10) -> DataFrame:
    """(q, id, cosine, rank): the k nearest of every stated query among all rows, exactly.

    Queries go in blocks of 1,024 against all rows, which stay where they are;
    each task sends its k best of a query, so a task's output does not depend
    on the number of rows.
    """
    own = cut(unit_vectors(df, key, vector, dim, "f4").groupBy("id").agg(F.first("vec").alias("vec")))
    asked = unit_vectors(queries, key, vector, dim, "f4").groupBy("id").agg(F.first("vec").alias("vec"))
    n_shards = max(1, math.ceil(own.count() / 4096))

    def pack(key: tuple, tab: pa.Table) -> pa.Table:
        """The rows of a block as two binary values."""
        return pa.table({"blk": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([tab["id"].to_numpy().astype("i8").tobytes()], pa.binary()), "vecs": pa.array([b"".join(tab["vec"].to_pylist())], pa.binary())})

    def packed(df: DataFrame, blocks: int) -> DataFrame:
        own = df.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("blk"), "id", "vec")
        return own.groupBy("blk").applyInArrow(pack, "blk int, ids binary, vecs binary")

    asks = packed(asked, max(1, math.ceil(asked.count() / 1024))).select(F.col("ids").alias("qids"), F.col("vecs").alias("qvecs"))
    asks = asks.select("qids", "qvecs", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("blk"))  # each shard meets each block once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qi, xi = (np.frombuffer(batch.column(c)[r].as_buffer(), "i8") for c in ("qids", "ids"))
                q, x = (np.frombuffer(batch.column(c)[r].as_buffer(), "f4").reshape(-1, dim) for c in ("qvecs", "vecs"))
                s = q @ x.T
                s[qi[:, None] == xi[None, :]] = -2
                kk = min(k, len(xi))
                top = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
                val = np.take_along_axis(s, top, 1)
                ok = val > -2
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, kk)[ok.ravel()]), pa.array(xi[top][ok]), pa.array(val[ok].astype("f8"))], ["q", "id", "cosine"])

    hits = packed(own, n_shards).join(asks, "blk").select("ids", "vecs", "qids", "qvecs").mapInArrow(run, "q long, id long, cosine double")
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

"""Centroid clustering (k-means in whole numbers) by kd-tree filtering.

Each partition cuts its rows into blocks of a bounded number.  A block is ordered as a
kd-tree: halved at the median of the widest component until a leaf has at most ``LEAF`` vectors.  That order is written
once, with the number of each vector's leaf; nodes are the leaves whose numbers agree but for their last bits, so any
stretch of rows that a task reads gives back its trees by summing up runs: counts, sums and bounding boxes.

A round walks all nodes of a level together.  Of the centroids that a node still has, the one nearest to the middle of its
box is compared with each other one at the corner of the box that favours the other most; who is farther even there is
strictly dominated and leaves.  A node with one centroid left is assigned whole by its count and sums, leaves with more
are resolved vector by vector.  Only sums of clusters, one row per cluster and component and task, are shuffled, and only
the centroids reach the driver.

All arithmetic is in whole numbers: floats hold them where every sum stays below 2^53, else 64-bit integers do.

Defined results: vectors of another length, or with a null, NaN or infinite component, and null vectors are left out; a
component beyond 2^26 in size counts as 2^26, so that distances fit a long, and a sum beyond a long is the largest long;
a null id hashes as an empty one; of rows that share an id the one with the smaller vector starts first; with fewer
vectors than centroids there are fewer centroids; equal vectors may start several centroids, of which the later ones stay
empty; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

BLOCK, LEAF = 1 << 15, 32
LIMIT = 1 << 26
_LONG = (1 << 63) - 1


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, size: int, scale: float) -> DataFrame:
    """``id, vec``: the vectors that count, as ``floor(scale * x)``."""
    vec = F.col(vector_col)
    fine = (F.size(vec) == size) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    low, high = F.lit(float(-LIMIT)), F.lit(float(LIMIT))
    number = lambda x: F.greatest(low, F.least(high, F.floor(scale * x.cast("double")).cast("double"))).cast("int")
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(vec, number).alias("vec"))


def start_order(id_: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def tree_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a block's rows as a kd-tree, and the number of each place's leaf; leaves are a power of two."""
    order, ends = np.arange(len(x)), [0, len(x)]
    while max(np.diff(ends)) > LEAF:
        halves = [0]
        for a, b in zip(ends, ends[1:], strict=False):
            own = order[a:b]
            if b - a > 1:
                seen = x[own]
                widest = int(np.argmax(seen.max(axis=0).astype(np.int64) - seen.min(axis=0)))
                order[a:b] = own[np.argpartition(seen[:, widest], (b - a) // 2)]
            halves += [a + (b - a) // 2, b]
        ends = halves
    return order, np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table, size: int) -> np.ndarray:
    return _matrix(table["vec"].combine_chunks(), size)


class Trees:
    """The kd-trees of consecutive rows: ``levels`` from the roots down to the leaves, each of starts, boxes and sums."""

    def __init__(self, x: np.ndarray, block: np.ndarray, leaf: np.ndarray):
        self.x, self.levels = x, []
        number, lo, hi, total = leaf, x, x, x.astype(np.int64)
        starts = np.arange(len(x))
        while True:
            new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (number[1:] != number[:-1])]))
            block, number, starts = block[new], number[new], starts[new]
            lo, hi, total = np.minimum.reduceat(lo, new), np.maximum.reduceat(hi, new), np.add.reduceat(total, new)
            self.levels.append((starts, lo, hi, total))
            if not number.any():
                break
            number = number >> 1
        self.levels.reverse()

    def ends(self, level: int) -> np.ndarray:
        return np.append(self.levels[level][0][1:], len(self.x))

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all rows: what nodes were assigned whole (level, node, centroid), and rows resolved one by one (row, centroid)."""
        most = max(int(np.abs(self.x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
        kind = np.float64 if most <= 1 << 22 and centroids.shape[1] <= 64 else np.int64  # all sums below 2^53
        far, z = np.inf if kind is np.float64 else _LONG, centroids.astype(kind)
        norm, k = (z * z).sum(axis=1), len(z)
        nodes, left = np.arange(len(self.levels[0][0])), np.ones((len(self.levels[0][0]), k), bool)
        whole, rows, near = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for level, (starts, lo, hi, _) in enumerate(self.levels):
            low, high = lo[nodes].astype(kind), hi[nodes].astype(kind)
            middle = norm - (low + high) @ z.T
            best = np.where(left, middle, far).argmin(axis=1)
            for s in np.unique(best):
                at = np.flatnonzero(best == s)
                toward = 2 * (z - z[s])
                least = norm - norm[s] - high[at] @ np.maximum(toward, 0).T - low[at] @ np.minimum(toward, 0).T
                left[at] &= least <= 0  # a positive least: farther than s at every point of the box
            alone = left.sum(axis=1) == 1
            whole.append(np.stack([np.full(alone.sum(), level), nodes[alone], best[alone]], axis=1))
            nodes, left = nodes[~alone], left[~alone]
            first, end = starts[nodes], self.ends(level)[nodes]
            if level + 1 == len(self.levels):
                rows = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(first, end, strict=True))])
                left = np.repeat(left, end - first, axis=0)
                gap = norm - 2 * (self.x[rows].astype(kind) @ z.T)
                near = np.where(left, gap, far).argmin(axis=1)  # the first of equals
            else:
                below = self.levels[level + 1][0]
                a, b = np.searchsorted(below, first), np.searchsorted(below, end)
                nodes, left = np.concatenate([np.zeros(0, np.int64), *(np.arange(i, j) for i, j in zip(a, b, strict=True))]), np.repeat(left, b - a, axis=0)
        return np.concatenate(whole), rows, near

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, totals = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        whole, rows, near = self.assign(centroids)
        for level, (starts, _, _, total) in enumerate(self.levels):
            own = whole[whole[:, 0] == level]
            np.add.at(counts, own[:, 2], (self.ends(level) - starts)[own[:, 1]])
            np.add.at(totals, own[:, 2], total[own[:, 1]])
        counts += np.bincount(near, minlength=len(counts))
        for c in np.unique(near):
            totals[c] += self.x[rows[near == c]].sum(axis=0, dtype=np.int64)
        return counts, totals

    def clusters(self, centroids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.x), np.int64)
        whole, rows, near = self.assign(centroids)
        for level, node, c in whole:
            out[self.levels[level][0][node] : self.ends(level)[node]] = c
        out[rows] = near
        return out


def _trees(table: pa.Table, size: int) -> Trees:
    return Trees(_columns(table, size), table["block"].to_numpy(), table["leaf"].to_numpy())


def grow(vectors: DataFrame, size: int) -> DataFrame:
    """``id, vec, block, leaf``: vectors in the order of their partition's kd-trees, written to the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in enumerate(_blocks(batches, BLOCK)):
            order, leaf = tree_order(_columns(table, size))
            table = table.take(pa.array(order)).append_column("block", pa.array(np.full(len(order), number))).append_column("leaf", pa.array(leaf.astype(np.int32)))
            yield from table.to_batches(max_chunksize=8192)

    kinds = dict(vectors.dtypes)
    return materialise(vectors.mapInArrow(build, f"id {kinds['id']}, vec array<int>, block long, leaf int"), "kd-trees")


def _next(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    at, size = np.array(centroids, np.int64), len(centroids[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(len(at), np.int64), np.zeros(at.shape, np.int64)
        for table in _blocks(batches, BLOCK):
            n, s = _trees(table, size).sums(at)
            counts, totals = counts + n, totals + s
        c, d = np.divmod(np.arange(at.size), size)
        seen = counts[c] > 0
        yield pa.RecordBatch.from_arrays([pa.array(v[seen]) for v in (c, d, counts[c], totals.ravel())], ["cluster", "d", "n", "total"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    found = trees.select("vec", "block", "leaf").mapInArrow(add, "cluster long, d long, n long, total long").groupBy("cluster", "d").agg(exact("n").alias("n"), exact("total").alias("total"))
    out = [list(c) for c in centroids]
    for r in found.collect():  # a row per cluster and component
        out[r.cluster][r.d] = int(r.total) // int(r.n)
    return out


def centroid_clusters(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, k: int = 16, rounds: int = 3, scale: float = 64.0, seed: int = 1) -> DataFrame:
    """One row per vector that counts: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256``.

    ``k`` centroids of ``size`` components are the only data that the driver and every task hold.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vector_col, size, scale)
    first = [list(r.vec) for r in vectors.orderBy(start_order(F.col("id"), seed), "vec").limit(k).collect()]
    kind = dict(vectors.dtypes)["id"]
    if not first:
        return vectors.select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.col("vec").cast("array<long>").alias("centroid"), F.lit("").alias("centroid_sha256"))
    trees, centroids = grow(vectors, size), first
    for _ in range(rounds):
        centroids = _next(trees, centroids)
    at = np.array(centroids, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, BLOCK):
            grown = _trees(table, size)
            cluster = grown.clusters(at)
            for a in range(0, len(cluster), 8192):
                own = cluster[a : a + 8192]
                gap = grown.x[a : a + 8192].astype(np.int64) - at[own]
                yield pa.RecordBatch.from_arrays([table["id"].slice(a, 8192).combine_chunks(), pa.array(own.astype(np.int32)), pa.array((gap * gap).sum(axis=1))], ["vec_id", "cluster", "distance"])

    placed = materialise(trees.mapInArrow(place, f"vec_id {kind}, cluster int, distance long"), "clusters")
    inertia = {r.cluster: int(r.total) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    whole = min(sum(inertia.values()), _LONG)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = [(c, min(n, _LONG), whole, centroids[c], digest(centroids[c])) for c, n in sorted(inertia.items())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")  # k rows

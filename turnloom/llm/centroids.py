"""Centroid clustering of integer vectors with kd-tree filtering.

Vectors are turned into integers once, and each task cuts its rows into blocks of at
most ``LEAVES`` vectors and builds a kd-tree over every block. A node holds the count
and the componentwise integer sum of its vectors, and their box. The blocks are written to
the shared folder, so every round reads trees instead of building them.

A round walks each tree from the root, level by level, with the centroids that may be
nearest to some vector of a node:

- the candidate nearest to the middle of the box is compared with every other one; another
  that is strictly farther from the corner of the box that lies most towards it is
  strictly farther from every vector of the node, and is left out below;
- a node with one candidate left gives its count and sum to it as a whole;
- what stays open down to a leaf is resolved vector by vector, ties going to the smaller number.

Everything is exact: sums and distances are integers, so the result doesn't depend on
how rows lie in tasks or blocks. A task returns one count and sum per centroid; the
driver collects only those of all tasks together, ``k`` rows.

Defined cases: a vector that is null, of another length, or holds a null or non-finite
component isn't kept and gives no row; repeated rows are vectors of their own; a null
id comes last in the order of first centroids; fewer vectors than ``k`` make as many
centroids; an empty table gives no rows; other columns are ignored. A component whose
integer exceeds ``MOST`` in size would overflow a squared distance: that is an error.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import cut, forget, small_batches

DIMS, K, ROUNDS, SCALE = 64, 8, 10, 1024
#: Vectors of a block, and of a leaf of its tree.
BLOCK, LEAF = 2048, 16
#: With components up to this size, no squared distance of DIMS components leaves 63 bits.
MOST = 1 << 26


class Tree:
    """A kd-tree over a block: vectors in tree order, and per node its range, box, count, sum and children."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, points: np.ndarray, nodes: dict[str, np.ndarray]):
        self.ids, self.null, self.points, self.nodes = ids, null, points, nodes

    @classmethod
    def build(cls, ids: np.ndarray, null: np.ndarray, points: np.ndarray) -> Tree:
        order = np.arange(len(points))
        begin, stop, left, low, high, sums = [], [], [], [], [], []
        todo = [(0, len(points))]
        at = 0
        while at < len(todo):
            a, b = todo[at]
            own = points[order[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            begin.append(a)
            stop.append(b)
            low.append(lo)
            high.append(hi)
            sums.append(own.sum(axis=0))
            axis = int((hi - lo).argmax())
            if b - a > LEAF and hi[axis] > lo[axis]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], mid)]
                left.append(len(todo))
                todo += [(a, a + mid), (a + mid, b)]
            else:
                left.append(-1)
            at += 1
        nodes = {"begin": np.array(begin), "stop": np.array(stop), "left": np.array(left), "low": np.array(low), "high": np.array(high), "sums": np.array(sums)}
        return cls(ids[order], null[order], points[order], nodes)

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, ids=self.ids, null=self.null, points=self.points.astype(np.int32), **{k: v if k == "sums" else v.astype(np.int32) for k, v in self.nodes.items()})
        return held.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        held = np.load(io.BytesIO(data))
        return cls(held["ids"], held["null"], held["points"].astype(np.int64), {k: held[k].astype(np.int64) for k in ("begin", "stop", "left", "low", "high", "sums")})

    def filter(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The cluster of each vector, counts and sums of each cluster, and how many vectors were settled one by one."""
        k, n = len(centroids), self.nodes
        cluster = np.full(len(self.points), -1, np.int32)
        counts, sums = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
        level, may = np.zeros(1, np.int64), np.ones((1, k), bool)
        single = 0
        while len(level):
            low, high = n["low"][level], n["high"][level]
            # Twice the middle of the box against twice the centroids stays an integer.
            off = ((low + high)[:, None, :] - 2 * centroids[None]).astype(np.float64)
            near = np.where(may, np.einsum("nkd,nkd->nk", off, off), np.inf).argmin(axis=1)
            best = centroids[near][:, None, :]
            corner = np.where(centroids[None] > best, high[:, None, :], low[:, None, :])
            # |corner - z|^2 - |corner - best|^2, factored.
            margin = ((best - centroids[None]) * (2 * corner - centroids[None] - best)).sum(axis=2)
            may &= margin <= 0
            alone = may.sum(axis=1) == 1
            for node, z in zip(level[alone], may[alone].argmax(axis=1), strict=True):
                a, b = n["begin"][node], n["stop"][node]
                cluster[a:b] = z
                counts[z] += b - a
                sums[z] += n["sums"][node]
            leaf = ~alone & (n["left"][level] < 0)
            for node, own in zip(level[leaf], may[leaf], strict=True):
                a, b = n["begin"][node], n["stop"][node]
                these = np.flatnonzero(own)
                points = self.points[a:b]
                # Of equal distances the first, whose number is smaller.
                z = these[((points[:, None, :] - centroids[these][None]) ** 2).sum(axis=2).argmin(axis=1)]
                cluster[a:b] = z
                counts += np.bincount(z, minlength=k)
                np.add.at(sums, z, points)
                single += int(b - a)
            deeper = ~alone & ~leaf
            below = n["left"][level[deeper]]
            level, may = np.concatenate([below, below + 1]), np.concatenate([may[deeper], may[deeper]])
        return cluster, counts, sums, single


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec) of each vector with ``dims`` components, none null or non-finite: vec is floor(scale * component)."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v))
    return vectors.where((F.size(vector) == dims) & fine).select(F.col(key).cast("long").alias("vec_id"), whole.alias("vec"))


def first_hash(key: Column) -> Column:
    return F.sha2(F.concat(F.lit("3:"), key.cast("string")), 256)


def first_centroids(whole: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors whose ids hash lowest."""
    rows = whole.select(first_hash(F.col("vec_id")).alias("h"), "vec").orderBy(F.asc_nulls_last("h"), "vec").limit(k).collect()
    return np.array([r["vec"] for r in rows], np.int64)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def block() -> pa.RecordBatch:
        tree = Tree.build(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([tree.to_bytes()], pa.binary())], ["tree"])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, min(BLOCK - sum(len(x[0]) for x in held), batch.num_rows - at))
            at += part.num_rows
            points = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            if ((points > MOST) | (points < -MOST)).any():
                raise ValueError(f"a component beyond {MOST} has no exact squared distance in 64 bits")
            null = part.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            held.append((part.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False), null, points))
            if sum(len(x[0]) for x in held) >= BLOCK:
                yield block()
    if held:
        yield block()


def _moments(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty cluster its count and sums; every task sends one row per cluster."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for data in batch.column("tree"):
                _, c, s, _ = Tree.from_bytes(data.as_py()).filter(centroids)
                counts += c
                sums += s
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = trees.mapInArrow(rows, "cluster int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    got = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*exact).alias("sums")).collect()
    return {r["cluster"]: (r["n"], [int(x) for x in r["sums"]]) for r in got}


def _assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("tree"):
                tree = Tree.from_bytes(data.as_py())
                cluster = tree.filter(centroids)[0]
                distance = ((tree.points - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64(), mask=tree.null), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(rows, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of each kept vector, and the centroids after ``rounds`` rounds."""
    spark = vectors.sparkSession
    whole = integers(vectors, key, vector, dims, scale)
    centroids = first_centroids(whole, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    with small_batches(spark):
        trees = cut(whole.mapInArrow(_trees, "tree binary"), "kd-trees")
        for _ in range(rounds):
            found = _moments(trees, centroids)
            centroids = np.array([[s // found[z][0] for s in found[z][1]] if z in found else centroids[z].tolist() for z in range(len(centroids))], np.int64)
        out = cut(_assigned(trees, centroids), "kd-assigned")
    forget(trees)
    return out, centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256."""
    # One row per cluster.
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(z, sums[z], sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for z, c in enumerate(centroids.tolist()) if z in sums]
    of_cluster = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

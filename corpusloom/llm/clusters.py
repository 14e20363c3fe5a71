"""Clustering of vectors by dual-tree Lloyd rounds in exact integers.

Vectors become integers once.  Each task builds cover trees over its vectors, up to
``TREE`` to a tree: the children of a node lie within a power of two of their
parents and, among themselves, farther apart.  The trees are written once; every
round reads them, builds a cover tree over the centroids and goes down both trees
at once.  A pair of nodes is dropped if the least distance of their members is over
the greatest distance that the vectors' node has to any centroid; a node with one
centroid left takes it for all its vectors, and what is left at the leaves is
compared exactly.  Sums of whole nodes come from running sums over the tree's order.
Only sums of a centroid's components leave a task, and only centroids come to the
driver.

Kept are vectors of exactly ``dims`` components, none null or not finite; others,
and null vectors, have no row.  Components are floor(scale * x), held to
``+-2**27`` so that distances fit a long.  Repeated rows are vectors of their own, a
null vec_id stays (and counts as empty in the seeds' digests; ties by the vector).
Fewer vectors than ``k`` are as many centroids; no vectors give no rows.  Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, slices

#: Vectors of a cover tree, and of a leaf, at most; greatest component.
TREE, LEAF, MOST = 2048, 8, 1 << 27
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, v): the kept vectors' integer components."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    bounded = lambda c: F.greatest(F.least(c.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))
    return vectors.where((F.size(x) == dims) & finite).select("vec_id", F.transform(x, lambda c: F.floor(bounded(c)).cast("long")).alias("v"))


class CoverTree:
    """Nodes in rows: the node's place ``start:end`` in ``order``, its center, its
    radius, and its children ``child:child + n``.  Node 0 is the root."""

    def __init__(self, points: np.ndarray, leaf: int):
        own = points.astype(np.float64)
        square = (own * own).sum(axis=1)
        apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * own @ own.T, 0))
        order = np.arange(len(points))
        rows: list[list] = [[0, len(points), 0, 0.0, 0, 0]]
        at = 0
        while at < len(rows):
            start, end, center = rows[at][:3]
            members = order[start:end]
            away = apart[center, members]
            rows[at][3] = far = float(away.max(initial=0.0))
            if end - start > leaf and (far > 0 or leaf == 1):
                groups = self._net(apart, members, center, far)
                order[start:end] = np.concatenate([m for _, m in groups])
                rows[at][4:6] = len(rows), len(groups)
                for c, m in groups:
                    rows.append([start, start + len(m), c, 0.0, 0, 0])
                    start += len(m)
            at += 1
        start, end, center, radius, child, n = map(np.array, zip(*rows, strict=True))
        self.order, self.start, self.end, self.radius, self.child, self.n = order, start, end, radius, child, n
        self.points, self.center = points[order], points[center]

    @staticmethod
    def _net(apart: np.ndarray, members: np.ndarray, center: int, far: float) -> list[tuple[int, np.ndarray]]:
        """Centers (the node's own first) farther apart than the greatest power
        of two under the radius, with the members that each of them covers."""
        if far == 0:
            return [(int(m), np.array([m])) for m in members]
        reach = 2.0 ** (np.ceil(np.log2(far)) - 1)
        out = []
        while len(members):
            near = apart[center, members] <= reach
            near |= members == center
            out.append((int(center), members[near]))
            members = members[~near]
            center = members[0] if len(members) else -1
        return out

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points.astype(np.int32), center=self.center.astype(np.int32), **{k: getattr(self, k) for k in ("start", "end", "radius", "child", "n")})
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> CoverTree:
        tree = object.__new__(cls)
        with np.load(io.BytesIO(raw)) as x:
            for k in x.files:
                setattr(tree, k, x[k])
        return tree


def nearest(tree: CoverTree, centroids: np.ndarray) -> tuple[np.ndarray, dict]:
    """The number of each point's nearest centroid (ties: the smaller), in the
    tree's order, and how much was decided how."""
    other = CoverTree(centroids, 1)
    number = other.order  # of the centroid tree's places
    out = np.full(len(tree.points), -1, np.int64)
    slack = 1e-6 * (1 + float(np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1)).max()) + float(np.sqrt((tree.points.astype(np.float64) ** 2).sum(axis=1)).max()))
    done = {"node_pairs": 0, "dropped": 0, "whole": 0, "leaf_pairs": 0}
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(v):
        # pairs are sorted by v
        gap = tree.center[v].astype(np.float64) - other.center[c]
        d = np.sqrt((gap * gap).sum(axis=1))
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        within = np.minimum.reduceat(d + tree.radius[v], first)  # a node's center is one of its centroids
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))
        keep = d - tree.radius[v] - other.radius[c] <= within[of] + slack
        done["node_pairs"] += len(v)
        done["dropped"] += int((~keep).sum())
        v, c, of = v[keep], c[keep], of[keep]
        count = np.bincount(of)
        single = other.end[c] - other.start[c] == 1
        # one centroid left: it takes the whole node
        alone = (count[of] == 1) & single
        for i, j in zip(v[alone], c[alone], strict=True):
            out[tree.start[i] : tree.end[i]] = number[other.start[j]]
            done["whole"] += 1
        v, c, of, single = v[~alone], c[~alone], of[~alone], single[~alone]
        if not len(v):
            break
        leaf = tree.n[v] == 0
        wide = ~single & (leaf | (other.radius[c] >= tree.radius[v]))
        apart = np.zeros(len(count), bool)
        apart[of[wide]] = True  # nodes whose centroid nodes are taken apart first
        split = apart[of] & ~single
        down = ~apart[of] & ~leaf
        ready = ~apart[of] & leaf
        if ready.any():
            done["leaf_pairs"] += _compare(tree, centroids, v[ready], number[other.start[c[ready]]], out)
        stay = apart[of] & single
        v1, c1 = _children(other, c[split], v[split])
        c2, v2 = _children(tree, v[down], c[down])
        v, c = np.concatenate([v[stay], v1, v2]), np.concatenate([c[stay], c1, c2])
        by = np.lexsort((c, v))
        v, c = v[by], c[by]
    return out, done


def _children(tree: CoverTree, nodes: np.ndarray, partners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(partner, child) for each child of each node."""
    n = tree.n[nodes]
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(partners, n), np.repeat(tree.child[nodes], n) + offset


def _compare(tree: CoverTree, centroids: np.ndarray, nodes: np.ndarray, numbers: np.ndarray, out: np.ndarray) -> int:
    """Exact distances of the points of leaves to the centroids that are left."""
    n = tree.end[nodes] - tree.start[nodes]
    point = np.repeat(tree.start[nodes], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    to = np.repeat(numbers, n)
    d = squared(tree.points[point], centroids[to])
    by = np.lexsort((to, d, point))
    point, to = point[by], to[by]
    best = np.concatenate([[True], point[1:] != point[:-1]])
    out[point[best]] = to[best]
    return len(point)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    gap = a.astype(np.int64) - b
    return (gap * gap).sum(axis=1)


def trees(kept: DataFrame, dims: int = 64) -> DataFrame:
    """(ids, tree): cover trees over the vectors of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TREE, TREE * dims * 8):
            tree = CoverTree(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), LEAF)
            ids = pa.array([batch.column(0).take(pa.array(tree.order)).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([tree.pack()], pa.binary())], ["ids", "tree"])

    return kept.mapInArrow(run, "ids array<long>, tree binary")


def _sums(built: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, place, n, total): sums of the components of each cluster's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, object)
        for batch in slices(batches, 1):
            tree = CoverTree.unpack(batch.column(1)[0].as_py())
            to, _ = nearest(tree, centroids)
            n += np.bincount(to, minlength=len(centroids))
            # clusters' runs in the tree's order, from running sums
            ends = np.append(np.flatnonzero(to[1:] != to[:-1]) + 1, len(to))
            upto = np.cumsum(tree.points.astype(np.int64), axis=0)[ends - 1]
            part = np.zeros(centroids.shape, np.int64)
            np.add.at(part, to[ends - 1], np.diff(upto, axis=0, prepend=0))
            total += part
        k, dims = centroids.shape
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k), dims), pa.int32()), pa.array(np.tile(np.arange(dims), k), pa.int32()), pa.array(np.repeat(n, dims)), pa.array([str(x) for x in total.ravel()], pa.string())], ["cluster", "place", "n", "total"]
        )

    parts = built.mapInArrow(run, "cluster int, place int, n long, total string")
    return parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _assigned(built: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            tree = CoverTree.unpack(batch.column(1)[0].as_py())
            to, _ = nearest(tree, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), pa.array(to, pa.int32()), pa.array(squared(tree.points, centroids[to]))], ["vec_id", "cluster", "distance"])

    return built.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """Each kept vector with its cluster after some rounds, its squared distance
    to the centroid, the distances' sums (null beyond a long) and the centroid's digest.

    Collected are the ``k`` first vectors and sums of ``k`` centroids: ``k * dims``
    numbers, whatever the table's size."""
    kept = integers(vectors, dims, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    centroids = np.array([r.v for r in first], np.int64)
    built = durable(trees(kept, dims))
    for _ in range(rounds):
        for r in _sums(built, centroids).where("n > 0").collect():
            centroids[r.cluster, r.place] = int(r.total) // r.n
    own = durable(_assigned(built, centroids))
    inertia = {r.cluster: r.n for r in own.groupBy("cluster").agg(F.try_sum("distance").alias("n")).collect()}
    whole = own.agg(F.try_sum("distance").alias("n")).first().n
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centroids.tolist()]
    of = lambda values, kind: F.array(*[F.lit(x).cast(kind) for x in values])[F.col("cluster")]
    sums = of([inertia.get(i) for i in range(len(centroids))], "long")
    return own.select("vec_id", "cluster", "distance", sums.alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))

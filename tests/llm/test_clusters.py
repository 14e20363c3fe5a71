"""Dual-tree clustering against plain Lloyd rounds."""

import hashlib
import math

import numpy as np
import pytest

from corpusloom.llm import clusters


def plain(rows, k=16, rounds=3):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted((digest(i), v) for i, v in kept)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        to = assign()
        for j in range(len(centers)):
            own = [v for (_, v), (_, c) in zip(kept, to, strict=True) if c == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    to = assign()
    inertia = {j: sum(d for d, c in to if c == j) for j in range(len(centers))}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((repr(i), c, d, inertia[c], sum(inertia.values()), text[c]) for (i, _), (d, c) in zip(kept, to, strict=True))


def got(df):
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, tree string")


def test_table_against_plain_rounds(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert got(clusters.cluster(table.repartition(3))) == plain([(r.vec_id, r.embedding) for r in table.collect()])


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(60)]
    rows += [(7, rows[7][1])] * 30 + [(None, rows[9][1]), (None, rows[10][1]), (200, [0.0] * 64), (201, [1e12] + [0.0] * 63)]
    odd = [(300, None), (301, []), (302, [1.0] * 63), (303, [float("nan")] * 64), (304, [float("inf")] + [0.0] * 63), (305, [None] + [0.0] * 63), (306, [1.0] * 65)]
    assert got(clusters.cluster(vectors(spark, rows + odd, "double"))) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(40)]])
def test_few_or_equal_vectors(spark, rows):
    assert got(clusters.cluster(vectors(spark, rows))) == plain(rows)


def test_cover_tree():
    """Members lie within their nodes, children cover them, siblings are apart."""
    points = np.random.default_rng(1).integers(-64, 64, (500, 64)) // np.arange(1, 65)
    tree = clusters.CoverTree(points, 4)
    apart = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=-1))
    assert sorted(tree.order) == list(range(500)) and (tree.points == points[tree.order]).all()
    for i in range(len(tree.start)):
        assert apart(tree.points[tree.start[i] : tree.end[i]], tree.center[i]).max() <= tree.radius[i] + 1e-6
        own = np.arange(tree.child[i], tree.child[i] + tree.n[i])
        if len(own):
            assert tree.start[own[0]] == tree.start[i] and tree.end[own[-1]] == tree.end[i] and (tree.center[own[0]] == tree.center[i]).all()
            reach = 2.0 ** (math.ceil(math.log2(tree.radius[i])) - 1)
            assert tree.radius[own].max() <= reach + 1e-6
            gaps = apart(tree.center[own][:, None], tree.center[own][None]) + np.eye(len(own)) * 1e9
            assert len(own) > 1 and gaps.min() > reach - 1e-6


@pytest.mark.parametrize("spread", [0.5, 20])
def test_pruning_changes_nothing(spread):
    """Groups far apart are decided by whole nodes, close ones at the leaves."""
    rng = np.random.default_rng(5)
    centers = rng.integers(-200, 200, (16, 64))
    points = (centers[rng.integers(0, 16, 1500)] + rng.normal(size=(1500, 64)) * spread).astype(np.int64)
    centers[5] = centers[11]  # a tie for every point
    to, done = clusters.nearest(tree := clusters.CoverTree(points, 8), centers)
    d = ((tree.points[:, None].astype(np.int64) - centers[None]) ** 2).sum(axis=2)
    assert (to == d.argmin(axis=1)).all() and not (to == 11).any()
    assert done["node_pairs"] + done["leaf_pairs"] < 1500 * 16 * 0.8

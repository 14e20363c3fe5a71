"""Edges chosen by rounds against the sequential rule."""

import hashlib
import random
from collections import Counter

import pytest

from corpusloom.operators import matching


def sequential(edges, quotas, caps):
    used, taken = Counter(), set()
    for scope in sorted({e[0] for e in edges}):
        used.clear()
        for g in sorted({e[1] for e in edges if e[0] == scope}):
            todo, left = sorted((e for e in edges if e[:2] == (scope, g)), key=lambda e: e[2]), quotas.get((scope, g), 0)
            for cap in caps:
                rest = []
                for e in todo:
                    if left > 0 and used[e[3]] < cap and used[e[4]] < cap:
                        used.update(e[3:])
                        taken.add(e)
                        left -= 1
                    else:
                        rest.append(e)
                todo = rest
    return taken


@pytest.mark.parametrize(("seed", "caps", "ends"), [(1, [1, 2, 3], 12), (2, [2, 4], 30), (3, range(1, 6), 6)])
def test_rounds_follow_the_sequential_rule(spark, seed, caps, ends):
    rng = random.Random(seed)
    edges = set()
    for scope in ("s", "t", "u"):
        for g in ("a|0", "a|1", "b|0"):
            for _ in range(rng.choice([5, 40, 80])):
                a, b = (f"{rng.choice('vw')}{rng.randrange(ends)}" for _ in range(2))
                edges.add((scope, g, hashlib.md5(f"{scope}{a}:{b}".encode()).hexdigest(), a, b))
    quotas = {(s, g): rng.choice([0, 3, 12, 1000]) for s in ("s", "t", "u") for g in ("a|0", "a|1", "b|0")}
    df = spark.createDataFrame(sorted(edges), "scope string, g string, o string, a string, b string").repartition(4)
    q = spark.createDataFrame([(*k, n) for k, n in quotas.items()], "scope string, g string, quota int")
    got = {tuple(r) for r in matching.in_order(df, q, list(caps)).collect()}
    assert got == sequential(edges, quotas, caps) and got


def test_no_edges(spark):
    df = spark.createDataFrame([], "scope string, g string, o string, a string, b string")
    assert matching.in_order(df, spark.createDataFrame([("s", "g", 3)], "scope string, g string, quota int"), [1]).collect() == []


def test_fitting_leaves_room(spark):
    edges = spark.createDataFrame([("s", i, f"a{i % 3}", f"b{i % 5}") for i in range(30)], "scope string, o int, a string, b string")
    used = spark.createDataFrame([("s", "a0", 2), ("s", "b1", 1)], "scope string, v string, n int")
    got = matching.fitting(edges.withColumn("cap", matching.F.lit(4)), used, "scope", ["o"]).collect()
    n = Counter({"a0": 2, "b1": 1})
    for r in got:
        n.update((r.a, r.b))
    assert got and max(n.values()) <= 4


def test_totals_of_no_pairs_are_red(spark, monkeypatch):
    """The queries of totals tell a builder that gives nothing from one that works."""
    from corpusloom.plans import pairing

    none = spark.createDataFrame([], "subject string, id1 long, id2 long, score double")
    monkeypatch.setattr(pairing.ops, "graded_pairs", lambda *_: none)
    monkeypatch.setattr(pairing.ops, "select_with_least_reuse", lambda candidates, *_: candidates.limit(0))
    graded = pairing.graded_pairs_totals(spark, "/root/testdata/sf0.001").collect()
    assert len(graded) == 40 and {r.n for r in graded} <= {0, None} and sum(not r.enough for r in graded) >= 30
    assert {(r.n, r.known_once) for r in pairing.reuse_min_totals(spark, "/root/testdata/sf0.001").collect()} == {(0, False)}


def test_a_split_wants_as_many_pairs_as_there_are_up_to_3000(spark):
    from corpusloom.plans import pairing

    candidates = pairing.cut(pairing._split_candidates(spark, "/root/testdata/sf0.001"))
    there = {r.split: r["count"] for r in candidates.groupBy("split").count().collect()}
    wanted = {r.split: r.n for r in pairing._split_quotas(candidates).groupBy("split").agg(pairing.F.sum("quota").alias("n")).collect()}
    assert wanted == {k: min(3000, n) for k, n in there.items()} and max(wanted.values()) > 100


def test_totals_of_a_selection_that_stops_early_are_red(spark, monkeypatch):
    from corpusloom.plans import pairing

    monkeypatch.setattr(pairing.ops, "select_with_least_reuse", lambda candidates, *_: candidates.where("label = 'positive'"))
    got = pairing.reuse_min_totals(spark, "/root/testdata/sf0.001").collect()
    assert {(r.label, r.enough, r.known_once) for r in got} == {("positive", True, True), ("negative", False, False)}


@pytest.mark.parametrize(("seed", "most"), [(1, 10**6), (2, 10**6), (3, 40)])
def test_edges_are_followed_again_with_those_that_were_missed(spark, monkeypatch, seed, most):
    """A task sees some edges of a scope; what it misses is found, also where an edge
    comes twice, and scopes that are too large for a task go by rounds."""
    rng, followed, seen = random.Random(seed), matching._followed, []
    monkeypatch.setattr(matching, "_followed", lambda some, caps: seen.append(Counter(r.scope for r in some.collect())) or followed(some, caps))
    monkeypatch.setattr(matching, "_BEGIN", 1)
    quotas = {("s", "a"): 30, ("s", "b"): 45, ("t", "a"): 4, ("t", "b"): 6}
    edges = set()
    for scope, g in quotas:
        for _ in range(300):
            a, b = (f"{rng.choice('vw')}{rng.randrange(8)}" for _ in range(2))
            edges.add((scope, g, hashlib.md5(f"{scope}{g}{a}:{b}{seed}".encode()).hexdigest(), a, b))
    df = spark.createDataFrame([*edges, *sorted(edges)[::3]], "scope string, g string, o string, a string, b string").repartition(4)
    q = spark.createDataFrame([(*k, n) for k, n in quotas.items()], "scope string, g string, quota int")
    got = [tuple(r) for r in matching.in_order(df, q, range(1, 11), most).collect()]
    assert len(got) == len(set(got)) and set(got) == sequential(edges, quotas, range(1, 11))
    assert most < 10**6 and {k for c in seen for k in c} == {"t"} or most == 10**6 and len(seen) > 1 and max(seen[-1].values()) < 300


def test_a_selection_takes_few_jobs(spark):
    """Rounds are over what was missed, not over every pass of every group."""
    from corpusloom.plans import pairing

    tracker, group = spark.sparkContext.statusTracker(), "reuse-min"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert len(pairing.reuse_min_selection(spark, "/root/testdata/sf0.001").collect()) == 738
        assert len(tracker.getJobIdsForGroup(group)) < 120
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_totals_take_few_jobs(spark):
    from corpusloom.plans import pairing

    tracker, group = spark.sparkContext.statusTracker(), "reuse-min-totals"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = pairing.reuse_min_totals(spark, "/root/testdata/sf0.001").collect()
        assert len(got) == 24 and all(r.enough and r.known_once for r in got)
        assert len(tracker.getJobIdsForGroup(group)) < 120
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

"""Calls inside tasks, rewards by group, resumed work, dealing by cost, sentences in
windows, and databases."""

import asyncio
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scores, text
from corpusloom.operators import calls, embeddings, rewards, segments
from corpusloom.sources import io
from corpusloom.streaming import state


def flaky():
    running = Counter()

    async def ask(request, n):
        running["now"] += 1
        running["most"] = max(running["most"], running["now"])
        await asyncio.sleep(0.001 * (hash(request) % 3))
        running["now"] -= 1
        if request == "never":
            raise OSError("down")
        if request == "slow":
            await asyncio.sleep(60)
        if request == "most":
            return str(running["most"])
        if n < 2:
            raise OSError("down")
        return None if request == "null" else f"{request}!{n}"

    return ask


def test_calls_fail_twice_then_answer(spark):
    rows = [(i, t) for i, t in enumerate(["a", "b", None, "never", "null", "slow", *(f"r{i}" for i in range(200))])]
    df = spark.createDataFrame(rows, "id long, request string").coalesce(2)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    out = calls.called(df, "request", flaky, lambda r: True, tries=3, at_once=8, seconds=2.0)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before  # no job until it is read
    got = {r.id: (r.reply, r.tries, r.error) for r in out.collect()}
    assert len(got) == len(rows) and got[0] == ("a!2", 3, None) and got[2] == ("!2", 3, None)
    assert got[3] == (None, 3, "OSError: down") and got[4] == (None, 3, "invalid reply") and got[5][0] is None and got[5][2].startswith("TimeoutError")
    assert all(got[i] == (f"{t}!2", 3, None) for i, t in rows[6:])
    assert {r.id for r in calls.dead_letters(out).collect()} == {3, 4, 5} and calls.answered(out).count() == len(rows) - 3
    assert calls.called(df.limit(0), "request", flaky, lambda r: True).collect() == []


def test_calls_are_bounded(spark):
    df = spark.createDataFrame([(i, f"x{i}" if i < 99 else "most") for i in range(100)], "id long, request string").coalesce(1)
    got = {r.id: r.reply for r in calls.called(df, "request", flaky, lambda r: True, tries=3, at_once=5).collect()}
    assert 1 <= int(got[99]) <= 5


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_rewards_by_group(spark, batch):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(5)}" if i % 11 else None, rng.choice(["", " ", None, "word " * rng.randrange(1, 60)]), i) for i in range(300)] + [("alone", "word", 999)]
    seen = []

    def style():
        seen.append(1)
        return lambda prompts, texts, columns: [len(t) / 10 + i % 3 for t, i in zip(texts, columns["i"], strict=True)]

    df = spark.createDataFrame(rows, "prompt string, completion string, i long").repartition(4)
    own = rewards.advantages(rewards.with_rewards(df, {"style": style}, batch), F.col("style"), "prompt")
    want, groups = {}, {}
    for p, t, i in rows:
        want[i] = len(t) / 10 + i % 3 if (t or "").strip() else 0.0
        groups.setdefault(p, []).append(want[i])
    got = own.collect()
    assert len(got) == len(rows)
    for r in got:
        own = groups[r.prompt]
        std = statistics.stdev(own) if len(own) > 1 else 0.0
        assert r.reward == pytest.approx(want[r.i]) and r.group_std == pytest.approx(std) and r.advantage == pytest.approx((want[r.i] - statistics.mean(own)) / (std + 1e-4))


def test_batches_that_are_replayed(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "task string"
    batch = lambda *names: spark.createDataFrame([(n,) for n in names], schema)
    done = lambda: sorted(r.task for r in state.finished(spark, path, schema).collect())
    assert done() == []
    for _ in range(2):  # the same batch twice
        state.save(batch("a", "b", "b"), 0, path, "task")
    state.save(batch("c"), 1, path, "task")
    assert done() == ["a", "b", "c"]
    state.save(batch("d"), 2, path, "task")
    state.compact(spark, path, schema, 1)
    assert done() == ["a", "b", "c", "d"] and {p.name for p in (tmp_path / "state").iterdir()} == {"base=0000000001", "batch=0000000002"}
    state.save(batch("other"), 1, path, "task")  # in the base already
    state.save(batch("d", "e"), 2, path, "task")
    assert done() == ["a", "b", "c", "d", "e"]


def test_stream_is_resumed(spark, tmp_path):
    folder = str(tmp_path)
    worked = []

    def work(df):
        worked.extend(r.task for r in df.collect())
        return df.withColumn("n", F.length("task"))

    for names in (["a", "b"], ["b", "c"], ["a", "d"]):
        spark.createDataFrame([(n,) for n in names], "task string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("task string").parquet(f"{folder}/in")
        state.resumed(stream, work, f"{folder}/out", f"{folder}/state", f"{folder}/log", "task", compact_every=2).awaitTermination()
    assert sorted(worked) == ["a", "b", "c", "d"]
    assert sorted((r.task, r.n) for r in state.written(spark, f"{folder}/out").collect()) == [(t, 1) for t in "abcd"]


def test_dealing_by_cost(spark):
    rng = random.Random(1)
    rows = [(i, int(1000 / (1 + i % 97)) + rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, cost long").repartition(7)
    own = {r.id: r.worker for r in embeddings.dealt(df, 6, F.col("cost"), "id").collect()}
    loads = Counter()
    for i, c in rows:
        loads[own[i]] += c
    assert set(loads) == set(range(6)) and max(loads.values()) <= 1.3 * sum(loads.values()) / 6
    out = embeddings.fan_out(df, 6, lambda part: part.assign(n=len(part))[["id", "n"]], "id long, n long", F.col("cost"), ("id",))
    assert sorted(r.id for r in out.collect()) == list(range(500)) and out.rdd.getNumPartitions() == 6


@pytest.mark.parametrize("window", [1, 2, 7, 50, 10_000])
def test_sentences_in_windows(window):
    rng = random.Random(4)
    texts = ["", "   ", "One.", ". . .", "A?!  B.\n\n C", "  lead. tail ", "".join(rng.choice("ab. !?\n") for _ in range(400))]
    spans = segments.by_marks()
    for t in texts:
        assert list(segments.in_windows(t, spans, window)) == [t[a:b] for a, b in spans(t)]


def test_database_in_parts(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(i if i < 900 else 1_000_000 + i, f"t{i}") for i in range(1000)] + [(None, "none")]
    spark.createDataFrame(rows, "id long, title string").coalesce(1).write.jdbc(url, "books", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    own = io.read_jdbc(spark, url, "books", '"id"', 4)
    assert sorted(map(tuple, own.collect()), key=str) == sorted(rows, key=str)
    sizes = [r["count"] for r in own.where("id is not null").groupBy(F.spark_partition_id()).count().collect()]
    assert own.rdd.getNumPartitions() == 5 and len(sizes) == 4 and max(sizes) <= 1.2 * 250
    assert sorted(r.title for r in own.where("id > 1000000").collect()) == sorted(f"t{i}" for i in range(900, 1000))


def test_strip_and_end_marks(spark):
    texts = ["", " x ", " 　a b\x85", "the end", "a THE END!..", "THEEND.", "The end. x", "\t\n", "xTHE  END"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    white = F.regexp_replace("t", r"(?U)^\s+|\s+\z", "")
    assert df.where(text.strip(F.col("t")) != white).count() == 0
    got = [r.s > 0 for r in df.select(scores.completeness(F.lit(1300), F.col("t")).alias("s")).collect()]
    assert got == [False, False, False, True, True, True, False, False, False]

"""Sharding along the Hilbert curve: the curve itself, the laws, files and pruning."""

import itertools
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import shards


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 3)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(n)))
    at = {r.h: tuple(r[:n]) for r in df.select("*", shards.hilbert_index([F.col(f"c{i}") for i in range(n)], bits).alias("h")).collect()}
    assert sorted(at) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(len(cells) - 1))


def test_odd_rows(spark, odd):
    repeated = odd.unionByName(odd.where("doc_id = 6")).unionByName(odd.where("doc_id is null"))
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in repeated.collect())
    for law in ("rows", "bytes"):
        got = shards.shards(repeated, 4, law).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want and {r.law for r in got} == {law}
        _slots(got)
    assert shards.shards(odd.limit(0)).collect() == []
    gone = odd.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"))
    assert sorted(r["size"] for r in shards.shards(gone).collect()) == [1] * odd.count()
    with pytest.raises(ValueError):
        shards.shards(odd, law="none")


def _slots(got):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    return by


@pytest.mark.parametrize(("law", "copies"), [("rows", 1), ("rows", 70_000), ("bytes", 1)])
def test_laws(spark, docs, law, copies):
    """A third of the rows, or far more, may be copies of one row."""
    one = docs.limit(1).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("k")
    got = shards.shards(docs.unionByName(one), 16, law)
    rows = got.collect()
    by = _slots(rows)
    assert len(rows) == docs.count() + copies and set(by) == set(range(16))
    if law == "rows":
        sizes = [len(x) for x in by.values()]
        assert max(sizes) - min(sizes) <= 1
    else:
        sizes = Counter()
        for r in rows:
            sizes[r.shard] += r["size"]
        assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    along = [r.hilbert for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert along == sorted(along)


def test_files_hold_runs_and_filters_read_few(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = str(tmp_path / "shards")
    shards.write_shards(docs, path, 16)
    want = {r.doc_id: r.shard for r in shards.shards(docs, 16).collect()}
    assert {r.doc_id: r[shards.SHARD] for r in spark.read.parquet(path).collect()} == want
    about = shards.manifest(spark, path)
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    source = docs.groupBy("source").count().orderBy("count").first().source
    ranges = {"source": {"source": (source, source)}, "doc_id": {"doc_id": (least, least + (most - least) // 8)}, "n_chars": {"n_chars": (0, 300)}}
    ranges["two"] = ranges["source"] | ranges["n_chars"]
    touched = {}
    for name, own in ranges.items():
        found = shards.read_where(spark, path, about, own)
        plain = docs
        for c, (lo, hi) in own.items():
            plain = plain.where(F.col(c).between(lo, hi))
        assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in plain.collect())
        touched[name] = len(shards.holding(about, own))
    assert touched["two"] <= min(touched["source"], touched["n_chars"]) and max(touched.values()) < 16

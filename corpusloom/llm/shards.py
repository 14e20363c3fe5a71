"""Shards along a Hilbert curve over a document's metadata.

Four dimensions (source, language, size and doc_id) are quantised to ``BITS`` bits
each, the cells numbered along the Hilbert curve, the rows sorted by that number and
cut into runs.  Rows near each other in all dimensions so lie in few shards, and a
filter on any of the dimensions prunes shards by their least and greatest values.

Quantising keeps order.  A value is a number first: an id itself, a size by its
binary logarithm in steps of 1/64, a string by the six bytes behind the prefix that
all values share.  ``BINS`` bins of equal width between the least and the greatest
number are counted, and a bin's cell is the share of rows in the bins before it; so
common values get cells of their own.  Only the cells' first bins, ``2**BITS`` a
dimension at most, come to the driver.

Places in the sorted order are counted without a task that sees all rows: equal rows
collapse to one with a number of copies, rows are counted by cell and by ``SPREAD``
buckets of the id's digest in it, the counts' running sums say where a bucket begins,
and rows are numbered inside their bucket.  A cell that holds a third of all rows is
so dealt to many tasks.  All is DataFrame code; there is no Python on executors.

Laws: ``rows``, counts at most one apart; ``bytes``, a shard ends with the row that
reaches its share of all bytes, so sizes differ by a document at most.  Null texts
have no bytes, so a size of 1; null strings count as empty and come with the least;
null ids count as the least bin.  Repeated rows stay rows of their own with slots of
their own.  No rows give no shards.  Extra columns are not read.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable

DIMENSIONS = ("source", "lang", "size", "doc_id")
#: Bits of a dimension; bins that are counted; buckets of a cell.
BITS, BINS, SPREAD = 4, 4096, 4096
#: Cells whose counts are summed up in one task; copies that are told apart at once.
TOGETHER, COPIES = 256, 1 << 16
#: The sorted order; the bucket is of the id's and text's digest.
ORDER = ("hilbert", "bucket", "doc_id", "size", "text_crc32")
#: The column that written shards are told by.
SHARD = "hilbert_shard"


def _turned(x: int, by: int, n: int) -> int:
    return (x >> by % n | x << (n - by % n)) & ((1 << n) - 1)


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """For each state of the curve in ``n`` dimensions (its entry corner, its
    direction) and each corner of a cell: the corner's place on the curve, and the
    state inside."""
    size = 1 << n
    gray = [w ^ w >> 1 for w in range(size)]
    trailing = [next((b for b in range(n) if not w >> b & 1), n) for w in range(size)]
    entry = [gray[(w - 1) // 2 * 2] if w else 0 for w in range(size)]
    direction = [(trailing[w] if w & 1 else trailing[w - 1]) % n if w else 0 for w in range(size)]
    places, states = [], []
    for e in range(size):
        for d in range(n):
            for corner in range(size):
                w = gray.index(_turned(corner ^ e, d + 1, n))
                places.append(w)
                states.append((e ^ _turned(entry[w], n - 1 - d, n)) * n + (d + direction[w] + 1) % n)
    return places, states


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The number along the Hilbert curve of the cells' coordinates."""
    n = len(cells)
    places, states = (F.array(*map(F.lit, x)) for x in curve_tables(n))
    corner = lambda b: sum((F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), i) for i, c in enumerate(cells)), F.lit(0))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))

    def step(s: Column, c: Column) -> Column:
        at = s.state * (1 << n) + c
        return F.struct(states[at].alias("state"), (s["index"] * (1 << n) + places[at]).alias("index"))

    return F.aggregate(F.array(*[corner(b) for b in range(bits - 1, -1, -1)]), start, step)["index"]


def _described() -> list[Column]:
    text, word = F.coalesce(F.col("text"), F.lit("")), lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return [F.col("doc_id"), word("source"), word("lang"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


@dataclass
class Curve:
    """What quantising needs: shared prefixes, least numbers, widths and cells'
    first bins by dimension, and the rows' number and bytes."""

    same: dict[str, int]
    least: dict[str, int]
    width: dict[str, int]
    firsts: dict[str, list[tuple[int, int]]]
    n: int
    bytes: int

    def number(self, c: str) -> Column:
        """A dimension as a number that keeps its order."""
        if c == "doc_id":
            return F.col(c)
        if c == "size":  # 64 times the number of bits, and the six bits behind the first
            return F.expr("64L * length(bin(size)) + shiftright(size * 64, length(bin(size)) - 1)")
        six = F.substring(F.encode(c, "utf-8"), self.same[c] + 1, 6)
        return F.conv(F.rpad(F.hex(six), 12, "0"), 16, 10).cast("long")

    def bin(self, c: str) -> Column:
        shifted = _div(self.number(c), self.width[c]) - _div(F.lit(self.least[c]).cast("long"), self.width[c])
        return F.coalesce(shifted, F.lit(0)).cast("int")

    def cell(self, c: str) -> Column:
        return sum((F.when(F.col(f"_{c}") >= b, step).otherwise(0) for b, step in self.firsts[c]), F.lit(0))

    def keyed(self, rows: DataFrame, bits: int = BITS) -> DataFrame:
        """The rows with ``hilbert`` and ``bucket``."""
        names = [f"_{c}" for c in DIMENSIONS]
        bins = rows.select("*", *[self.bin(c).alias(f"_{c}") for c in DIMENSIONS])
        digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string")))
        bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % SPREAD
        return bins.select("*", hilbert_index([self.cell(c) for c in DIMENSIONS], bits).alias("hilbert"), bucket.cast("int").alias("bucket")).drop(*names)


def fit(rows: DataFrame, bits: int = BITS) -> Curve:
    """The curve over described rows, from two aggregations of them."""
    words = ("source", "lang")
    ends = rows.agg(*[f(F.encode(c, "utf-8")) for c in words for f in (F.min, F.max)], F.count("*"), F.sum("size")).first()
    same = {c: len(os.path.commonprefix([bytes(ends[2 * i] or b""), bytes(ends[2 * i + 1] or b"")])) for i, c in enumerate(words)}
    curve = Curve(same, {}, {}, {c: [] for c in DIMENSIONS}, ends[4], ends[5] or 0)
    ends = rows.agg(*[f(curve.number(c)) for c in DIMENSIONS for f in (F.min, F.max)]).first()
    for i, c in enumerate(DIMENSIONS):
        curve.least[c], most = ends[2 * i] or 0, ends[2 * i + 1] or 0
        curve.width[c] = (most - curve.least[c]) // BINS + 1
    each = F.array(*[F.struct(F.lit(c).alias("dimension"), curve.bin(c).alias("bin")) for c in DIMENSIONS])
    counts = rows.select(F.explode(each).alias("x")).groupBy("x.dimension", "x.bin").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("dimension").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.select("dimension", "bin", _div(before * (1 << bits), max(1, curve.n)).alias("cell"))
    at = dict.fromkeys(DIMENSIONS, 0)
    for r in sorted(cells.groupBy("dimension", "cell").agg(F.min("bin").alias("bin")).collect(), key=lambda r: r.cell):
        curve.firsts[r.dimension].append((r.bin, r.cell - at[r.dimension]))
        at[r.dimension] = r.cell
    return curve


def _running(counts: DataFrame) -> DataFrame:
    """The rows and bytes before each bucket: sums inside blocks of cells, and
    over the blocks, of which there are ``2**(4 * BITS) / TOGETHER`` at most."""
    own = counts.withColumn("block", _div(F.col("hilbert"), TOGETHER))
    upto = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("block").orderBy("hilbert", "bucket")
    blocks = own.groupBy("block").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = blocks.select("block", *[upto(c, Window.orderBy("block")).alias(f"block_{c}") for c in ("n", "bytes")])
    both = own.select("*", *[upto(c, inside).alias(f"own_{c}") for c in ("n", "bytes")]).join(F.broadcast(blocks), "block")
    return both.select("hilbert", "bucket", *[(F.col(f"own_{c}") + F.col(f"block_{c}")).alias(f"before_{c}") for c in ("n", "bytes")])


def shards(docs: DataFrame, n_shards: int = 16, law: str = "rows", bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert, bucket) of
    each document."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    rows = durable(docs.select(*_described()))
    curve = fit(rows, bits)
    equal = curve.keyed(rows, bits).groupBy(*ORDER).agg(F.count("*").alias("n"))
    counts = equal.groupBy("hilbert", "bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
    inside = Window.partitionBy("hilbert", "bucket").orderBy(*ORDER[2:]).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda x: F.coalesce(F.sum(x).over(inside), F.lit(0))
    numbered = equal.select("*", upto(F.col("n")).alias("own_n"), upto(F.col("n") * F.col("size")).alias("own_bytes")).join(_running(counts), ["hilbert", "bucket"])
    # copies in blocks, so that no array is longer
    some = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("first"))
    each = some.select("*", F.explode(F.sequence("first", F.least(F.col("first") + COPIES, F.col("n")) - 1)).alias("copy"))
    place = F.col("before_n") + F.col("own_n") + F.col("copy")
    shard_of = lambda at, whole: _div(at * n_shards, max(1, whole)).cast("int")
    out = [F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", "bucket"]
    own = each.select("*", place.alias("place"))
    if law == "rows":
        own = own.withColumn("shard", shard_of(F.col("place"), curve.n))
        first = _div(F.col("shard").cast("long") * curve.n + n_shards - 1, n_shards)
        return own.withColumn("slot", F.col("place") - first).select("doc_id", "size", "text_crc32", *out)
    at = F.col("before_bytes") + F.col("own_bytes") + F.col("copy") * F.col("size")
    own = durable(own.withColumn("shard", shard_of(at, curve.bytes)))
    first = own.groupBy("shard").agg(F.min("place").alias("least"))  # a row for each shard
    return own.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("least")).select("doc_id", "size", "text_crc32", *out)


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, law: str = "rows", bits: int = BITS) -> None:
    """Write the documents, with all their columns, as a folder for each shard,
    sorted along the curve.

    A row's shard follows from its place among the shards' first rows, so texts
    are shuffled once; equal rows on both sides of a cut go to the later shard."""
    cuts = sorted(tuple(r) for r in shards(docs, n_shards, law, bits).where("slot = 0").select("shard", *ORDER).collect())
    rows = docs.select(F.struct("*").alias("row"), *_described())
    curve = fit(rows, bits)
    kinds = {"hilbert": "long", "bucket": "int", "doc_id": "long", "size": "long", "text_crc32": "long"}
    key = F.struct(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    cut = lambda x: F.struct(*[F.lit(v).cast(k).alias(c) for v, (c, k) in zip(x, kinds.items(), strict=True)])
    shard = F.coalesce(*[F.when(key >= cut(x[1:]), F.lit(x[0])) for x in reversed(cuts)], F.lit(0))
    own = curve.keyed(rows, bits).withColumn("shard", shard)
    own = own.repartitionByRange(max(1, len(cuts)), "shard", *ORDER[:2]).sortWithinPartitions("shard", *ORDER)
    own.select("row.*", F.col("shard").alias(SHARD)).write.partitionBy(SHARD).mode("overwrite").parquet(path)


def manifest(spark: SparkSession, path: str, columns: tuple[str, ...] = ("source", "lang", "n_chars", "doc_id")) -> DataFrame:
    """Each written shard's rows, and the least and greatest value of some columns."""
    own = spark.read.parquet(path)
    return own.groupBy(SHARD).agg(F.count("*").alias("n"), *[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("least", F.min), ("greatest", F.max))])


def holding(about: DataFrame, ranges: dict[str, tuple]) -> list[int]:
    """The shards of a manifest that can hold rows with columns between two
    values each."""
    for c, (lo, hi) in ranges.items():
        about = about.where(F.col(f"least_{c}").isNotNull() & (F.col(f"least_{c}") <= hi) & (F.col(f"greatest_{c}") >= lo))
    return sorted(r[0] for r in about.select(SHARD).collect())  # a number for each shard


def read_where(spark: SparkSession, path: str, about: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """The rows with columns between two values each; the folders of shards that
    hold none are not read."""
    rows = spark.read.parquet(path).where(F.col(SHARD).isin(holding(about, ranges)))
    for c, (lo, hi) in ranges.items():
        rows = rows.where(F.col(c).between(lo, hi))
    return rows

"""Near duplicates: a Jaccard join on word n-grams by MinHash banding.

Texts become sets of hashed five-word shingles.  Equal sets collapse into one
node first, by an aggregate that copies of any number go through.  Signatures of
the nodes are cut into bands; what shares a band hash is a candidate.  Candidates
are tied to their bucket's least node and so to components; inside a component
every pair is verified on the full sets, in blocks: a component too large for one
task is split into blocks of nodes, and each pair of blocks is a task of its own
that counts links and sends only a spanning forest of them.  So no pair is
emitted and none is left out.

A shingle is five words, lower-cased; words are runs of letters, digits and
non-ASCII characters.  A text of one to four words has one shingle, of all of
them; a text without words is in a class of its own and has no links.  Nodes are
sets, whatever the ids of their rows: rows of one id with different sets are
different nodes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, durable, mixed, partitions, slices, thrifty
from .components import components

WORDS, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.999, 256
#: Bytes of text hashed at once; shingles and nodes of a block at most, about.
CHUNK, BLOCK_SHINGLES, BLOCK_NODES = 512 << 10, 400_000, 1500
#: A component is split into so many blocks, unless they had fewer nodes than
#: this or more than above: its pairs of blocks then keep many tasks busy.
BLOCKS, LEAST_BLOCK_NODES = 16, 250
#: Bits for each member of a component in the filter that keeps other texts out of
#: the shuffle, and bits of the filter at most (8 MB): beyond, it lets more through.
BITS_EACH, MOST_BITS = 16, 1 << 26

_IS_WORD = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = mixed(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, and so the fewest false candidates, with
    which pairs of the similarity meet in a band with the recall, within a
    number of hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows))) if similarity < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and the text of each."""
    raws = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    word = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), out=total[1:])
    hashes = mixed((total[end] - total[start]) * _powers(_INVERSE, len(raw))[start])
    return hashes, np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), start, side="right")


_BLANK = re.compile(r"[ \t\n]")


def _long_set(text: str) -> np.ndarray:
    """The set of a long text, window after window, cut at blanks."""
    found, tail, at = [], np.zeros(0, np.uint64), 0
    while at < len(text):
        blank = _BLANK.search(text, at + CHUNK)
        end = blank.start() if blank else len(text)
        words = np.concatenate([tail, _word_hashes([text[at:end]])[0]])
        if len(words) >= WORDS:
            h = np.zeros(len(words) - WORDS + 1, np.uint64)
            for k in range(WORDS):
                h += words[k : k + len(h)] * _PLACE[k]
            found.append(np.unique(mixed(h)))
        tail, at = words[-(WORDS - 1) :], end
        if len(found) > 32:
            found = [np.unique(np.concatenate(found))]
    return np.unique(np.concatenate(found)) if found else _some_sets([text])[0]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    out: list[np.ndarray] = []
    start = size = 0
    for i, t in enumerate(texts):
        if len(t) > 4 * CHUNK:
            out += [*(_some_sets(texts[start:i]) if start < i else []), _long_set(t)]
            start, size = i + 1, 0
            continue
        size += len(t)
        if size >= CHUNK:
            out += _some_sets(texts[start : i + 1])
            start, size = i + 1, 0
    return out + (_some_sets(texts[start:]) if start < len(texts) else [])


def _some_sets(texts: list[str]) -> list[np.ndarray]:
    words, of = _word_hashes(texts)
    n = len(words) - WORDS + 1
    none = np.zeros(0, np.uint64)
    h, doc = none, np.zeros(0, np.int64)
    if n > 0:
        h = np.zeros(n, np.uint64)
        for k in range(WORDS):
            h += words[k : k + n] * _PLACE[k]
        inside = of[:n] == of[WORDS - 1 :]
        h, doc = mixed(h[inside]), of[:n][inside]
    counts = np.bincount(of, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    few = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(few):
        extra = np.zeros(len(few), np.uint64)
        for k in range(WORDS - 1):
            has = counts[few] > k
            extra[has] += words[begin[few[has]] + k] * _PLACE[k]
        h, doc = np.concatenate([h, mixed(extra + counts[few].astype(np.uint64))]), np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    cut = np.searchsorted(doc, np.arange(1, len(texts)))
    return np.split(h, cut)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row of band hashes for each non-empty set."""
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = np.concatenate(sets)
    k = np.arange(1, bands * rows + 1, dtype=np.uint64)
    a, b = mixed(k * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mixed(k + np.uint64(0xD1B54A32D192ED03))
    out = np.zeros((len(sets), bands), np.uint64)
    for i in range(bands):
        for j in range(i * rows, (i + 1) * rows):
            out[:, i] = mixed(out[:, i] + np.minimum.reduceat(x * a[j] + b[j], begin))
    return out


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets([t.as_py() for t in batch.column(1)])
            keys: list[bytes | None] = [set_key(s) if len(s) else None for s in sets]
            known: dict[bytes, int] = {}
            first = [i for i, k in enumerate(keys) if k is not None and known.setdefault(k, i) == i]
            sketches = {}
            for at in range(0, len(first), 128):
                some = first[at : at + 128]
                for i, row in zip(some, band_hashes([sets[i] for i in some], bands, rows), strict=True):
                    sketches[keys[i]] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketches.get(k) for k in keys], pa.binary())],
                ["doc_id", "hash", "set_key", "n", "bands"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of nodes; a text with another set falls out."""
    for batch in slices(batches):
        sets = shingle_sets([t.as_py() for t in batch.column(0)])
        keep = [i for i, k in enumerate(batch.column(1).to_pylist()) if len(sets[i]) and set_key(sets[i]) == k]
        rest = [batch.column(c).take(pa.array(keep, pa.int64())) for c in range(2, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([pa.array([sets[i].tobytes() for i in keep], pa.binary()), *rest], ["shingles", "node", "component", "blocks", "block"])


def links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """The symmetric matrix of pairs whose Jaccard similarity is enough."""
    n, size = len(sets), np.array([len(s) for s in sets])
    x, of = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(x, kind="stable")
    x, of = x[order], of[order]
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    times = np.diff(start, append=len(x))
    column = np.repeat(np.cumsum(times > 1) - 1, times)
    shared = np.repeat(times > 1, times)
    column, of = column[shared], of[shared]
    common = np.zeros((n, n), np.float32)
    width = max(64, min(4096, 8_000_000 // n))
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + width + 1, width))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        m = np.zeros((n, width), np.float32)
        m[of[a:b], column[a:b] - i * width] = 1
        common += m @ m.T
    union = size[:, None] + size[None, :] - common
    found = common >= np.float32(similarity) * union - 1e-3
    close = np.argwhere(found & (np.abs(common - similarity * union) < 1))  # decide in whole numbers
    num, den = round(similarity * 1000), 1000
    for i, j in close:
        found[i, j] = int(common[i, j]) * den >= num * int(union[i, j])
    np.fill_diagonal(found, False)
    return found


def _forest(found: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest."""
    out, seen = [], np.zeros(len(found), bool)
    for root in range(len(found)):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            i = todo.pop()
            fresh = np.flatnonzero(found[i] & ~seen)
            seen[fresh] = True
            out += [(i, int(j)) for j in fresh]
            todo += fresh.tolist()
    return out


def _verify(table: pa.Table) -> pa.Table:
    """Links inside a block or between two: counts (v null) and a forest."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    rows: dict[int, dict[int, tuple[int, bytes]]] = {}
    for shingles, node, component, block in zip(*(table[c].to_pylist() for c in ("shingles", "node", "component", "block")), strict=True):
        rows.setdefault(component, {}).setdefault(node, (block, shingles))
    us, vs, counts = [], [], []
    for own in rows.values():
        nodes = sorted(own)
        found = links([np.frombuffer(own[x][1], np.uint64) for x in nodes]) if len(nodes) > 1 else np.zeros((1, 1), bool)
        if i != j:
            block = np.array([own[x][0] for x in nodes])
            found &= block[:, None] != block[None, :]
        n = found.sum(axis=1)
        for k in np.flatnonzero(n).tolist():
            us.append(nodes[k]), vs.append(None), counts.append(int(n[k]))
        for a, b in _forest(found):
            us.append(nodes[a]), vs.append(nodes[b]), counts.append(0)
    return pa.table([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(counts, pa.int64())], ["u", "v", "links"])


def _text_hash(text: str = "text"):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _likely(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows (doc_id, text, hash) of ``docs`` that may be members (id, h): all
    of these, and of the others those that a filter of bounded size lets through."""
    spark = docs.sparkSession
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(6, (members.count() * BITS_EACH).bit_length()))
    place = lambda i, h: F.pmod(F.xxhash64(h, i), F.lit(bits)).alias("place")
    words = members.select(place("id", "h")).select(F.floor(F.col("place") / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    there = np.zeros(bits // 64, np.uint64)
    there[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.column(3).to_numpy(zero_copy_only=False)
            held = shared.value[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)
            yield batch.select([0, 1, 2]).filter(pa.array(held.astype(bool)))

    return docs.select("doc_id", "text", "hash", place("doc_id", "hash")).mapInArrow(run, "doc_id long, text string, hash long")


def _sets_and_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, hash, set_key, n), and the sets (set_key, class_id,
    n_links, n_copies, first): ``first`` is the id and text hash of the row that
    stands for the class, the least; rows without an id come last."""
    bands, rows = choose_bands()
    docs = doc_columns(docs).withColumn("hash", _text_hash())
    spark = docs.sparkSession
    n = partitions(spark)
    sketch = durable(docs.mapInArrow(_sketch(bands, rows), "doc_id long, hash long, set_key binary, n long, bands binary"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")
    nodes = sketch.where("set_key is not null").groupBy("set_key").agg(F.min(row).alias("row"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    place = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.expr("bands").substr(i * 8 + 1, F.lit(8))))
    banded = nodes.select("node", place.alias("band", "h"))
    centres = banded.groupBy("band", "h").agg(F.min("node").alias("centre"), F.count("*").alias("size")).where("size > 1").select("band", "h", "centre").hint("rebalance")  # so that the join may split a large bucket
    candidates = banded.join(centres, ["band", "h"]).where("node != centre").select(F.col("node").alias("u"), F.col("centre").alias("v"))
    groups = components(candidates).join(nodes.select("node", "set_key", "n", "row"), "node")
    sizes = groups.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / F.least(F.lit(BLOCK_NODES), F.greatest(F.lit(LEAST_BLOCK_NODES), F.count("*") / BLOCKS)))).cast("int").alias("blocks"))
    members = groups.join(sizes, "component").select(F.col("row.doc_id").alias("id"), F.col("row.hash").alias("h"), "node", "set_key", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    members = durable(members)  # it is read three times
    # rows without an id may repeat a text, which is then sent once
    likely = _likely(docs, members)
    one = likely.where("doc_id is not null").unionByName(likely.where("doc_id is null").distinct())
    texts = one.join(members, one.doc_id.eqNullSafe(members.id) & (one.hash == members.h)).select("text", "set_key", "node", "component", "blocks", "block")
    sets = texts.mapInArrow(_sets, "shingles binary, node long, component long, blocks int, block int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = sets.select("*", other).select(
        "shingles", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        # components of one block share tasks; a larger one has its own for each pair of blocks
        F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("component"), F.lit(8 * n))).otherwise(F.col("component")).alias("task"),
    )
    verified = durable(tasks.groupBy("task", "i", "j").applyInArrow(thrifty(_verify), "u long, v long, links long"))
    classes = components(verified.where("v is not null").select("u", "v"))
    counts = verified.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("n_links"))
    least = classes.join(nodes.select("node", "row"), "node").groupBy("component").agg(F.min("row").alias("least"))
    found = nodes.select("set_key", "node", "n_copies", "row").join(counts, "node", "left").join(classes, "node", "left").join(least, "component", "left")
    first = F.coalesce("least", "row")
    found = found.select("set_key", first.doc_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", first.alias("first"))
    return sketch.select("doc_id", "hash", "set_key", "n"), found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: ``class_id`` (the least id of its class; null
    where no row of the class has an id), ``n_links`` (other texts, different as
    sets, of the similarity or more), ``n_copies`` (documents with its very set),
    ``n_shingles``."""
    rows, found = _sets_and_classes(docs)
    return rows.join(found, "set_key", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), F.col("n").alias("n_shingles")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The document of the least id of each class, with all its columns.

    Rows without an id have no class and all stay.  Of rows that repeat an id and
    have one set one stays, the same in every run: that of the least hash."""
    known = docs.where("doc_id is not null")
    rows, found = _sets_and_classes(known)
    wordless = rows.where("set_key is null").groupBy(F.col("doc_id").alias("kept_id")).agg(F.min("hash").alias("kept_hash"))
    first = found.select(F.col("first.doc_id").alias("kept_id"), F.col("first.hash").alias("kept_hash")).distinct().unionByName(wordless)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct("text", F.to_json(F.struct("doc_id", *rest)))
    kept = known.join(first, (known.doc_id == first.kept_id) & (_text_hash(known.text) == first.kept_hash), "left_semi")
    kept = kept.groupBy("doc_id", _text_hash()).agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id is null"))

"""Operators that compare documents, and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import components, decontaminate, ngram_join, suffixes

from .conftest import ODD

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def brute_removal(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                m[p : p + 50] = True
        spans = int(np.count_nonzero(np.diff(m.astype(int), prepend=0) == 1))
        out[i, len(b), int(m.sum()), spans, hashlib.sha256(bytes(x for x, cut in zip(b, m, strict=False) if not cut)).hexdigest()] += 1
    return out


def planted(seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, rows = text(30), []
    for i in range(60):
        rows.append((i, text(rng.randint(1, 60)) + (" " + passage[rng.randint(0, 20) :] if i % 3 == 0 else "") + text(5)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 7)]  # exact copies
    for i in range(0, 60, 9):  # near copies
        t = rows[i][1].split(" ")
        t[len(t) // 2] = "changed"
        rows.append((200 + i, " ".join(t)))
    rows += [(300, "x" * 49), (301, "x" * 50), (302, "x" * 200), (303, "y" * 120 + "x" * 50), (304, "ab" * 100), (305, "ab" * 60), (10, "the id ten again, with the passage " + passage)]
    return rows


def test_removal_against_brute_force(spark, docs, odd, rows):
    plant = spark.createDataFrame(planted(), "doc_id long, text string")
    for df, own in ((docs, rows), (plant, planted()), (odd, ODD)):
        assert Counter(tuple(r) for r in suffixes.removal_digests(df).collect()) == brute_removal(own)
    assert suffixes.removal_digests(odd.limit(0)).count() == 0


def test_long_documents_in_segments(spark, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choice("ab \n") for _ in range(4000))
    rows = [(1, "x" * 700), (2, long[500:900]), (3, long), (4, long[:2500] + "!" + long[2500:]), (5, "ab" * 600), (6, "ba" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffixes, "CHUNK", 130)
    assert len(list(suffixes._chunks([long.encode()]))) > 10
    assert Counter(tuple(r) for r in suffixes.removal_digests(df).collect()) == brute_removal(rows)


def test_windows_of_one_rank_are_told_apart(monkeypatch):
    raw = np.frombuffer(b"".join(bytes([x]) * 60 for x in b"abcab"), np.uint8)
    at = np.array([0, 60, 120, 180, 240, 5, 65])
    ranks = suffixes.Ranks(raw)

    def kinds():
        order, new = ranks.groups(at)
        out = [set() for _ in range(new.sum())]
        for i, k in zip(order.tolist(), np.cumsum(new) - 1, strict=True):
            out[k].add(int(at[i]))
        return sorted(map(sorted, out))

    want = [[0, 5, 180], [60, 65, 240], [120]]
    assert kinds() == want
    monkeypatch.setattr(suffixes.Ranks, "whole", lambda self, at: np.zeros(len(at), np.uint64))
    assert kinds() == want


def test_removal_is_the_same_in_many_batches(spark, monkeypatch):
    df = spark.createDataFrame(planted(), "doc_id long, text string")
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 300)
    got = Counter(tuple(r) for r in suffixes.removal_digests(df).collect())
    assert got == brute_removal(planted())
    for r in suffixes.remove_repeats(df.selectExpr("*", "'x' as lang"), "lang").collect():
        raw = next(t for i, t in planted() if i == r.doc_id).encode()
        if r.doc_id != 10:
            kept = bytearray(raw)
            for s in reversed(r.spans):
                del kept[s["start"] : s["end"]]
            assert bytes(r.kept) == bytes(kept) and r.lang == "x"


def shingles(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    own, ids = {}, defaultdict(set)
    for i, t in rows:
        own[i] = shingles(t)
        ids[own[i]].add(i)
    sets = [s for s in ids if s]
    parent, degree = {s: s for s in sets}, Counter()

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for n, a in enumerate(sets):
        for b in sets[n + 1 :]:
            if 1000 * len(a & b) >= 800 * len(a | b):
                degree[a] += 1
                degree[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for s in sets:
        least[root(s)] = min(least.get(root(s), 1 << 60), min(ids[s]))
    return {i: (least[root(s)], degree[s], len(s)) if s else (i, 0, 0) for i, s in own.items()}


def near_rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 120)))) for i in range(80)]
    base = rng.choices(words, k=150)
    for i in range(60):  # a group of near copies that the block size below splits
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(150)] = rng.choice(words)
        rows.append((1000 + i, " ".join(t)))
    return rows + [(2000 + i, rows[i][1]) for i in range(5)] + [(3000, None), (3001, ""), (3002, "two words"), (3003, "Two, words")]


@pytest.mark.parametrize("nodes", [1500, 7])
def test_classes_and_links_against_brute_force(spark, monkeypatch, nodes):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", nodes)
    rows = near_rows()
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, node string")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_classes(rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for c, _, _ in got.values()}


def test_join_odd_rows(spark, odd):
    got = ngram_join.near_duplicates(odd)
    assert got.count() == len(ODD)
    by = {r.doc_id: r.class_id for r in got.collect()}
    assert by[6] == by[5] == 5 and by[1] == 1 and by[2] == 2
    assert ngram_join.near_duplicates(odd.limit(0)).count() == 0


def test_kept_rows_without_or_with_repeated_ids(spark):
    rows = [(None, "a text", 1), (None, "another text", 2), (None, "a text", 1), (None, None, 3), (1, "one text of some words", 4), (1, "one text of some words", 4), (2, "One text, of some words.", 5), (3, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter([*rows[:5], rows[7]])


def near_texts(n):
    rng = random.Random(n)
    own = [f"{n}v{rng.randrange(10**6)}" for _ in range(100)]
    return [" ".join(own), " ".join([*own[:-1], "changed"]), " ".join(["other", *own[1:]])]


def test_texts_that_share_an_id_are_nodes_of_their_own(spark):
    (a, a2, a3), (b, b2, _), (c, _, _) = near_texts(1), near_texts(2), near_texts(3)
    rows = [(7, a), (7, b), (7, c), (7, c), (8, b2), (9, a2), (7, a3), (7, None), (7, "?!"), (5, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_copies, r.n_shingles) for r in ngram_join.near_duplicates(df).collect())
    assert got == Counter({(7, 7, 2, 1, 96): 2, (9, 7, 2, 1, 96): 1, (7, 7, 1, 1, 96): 1, (8, 7, 1, 1, 96): 1, (7, 5, 0, 3, 96): 2, (5, 5, 0, 3, 96): 1, (7, 7, 0, 1, 0): 2})
    kept = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect())
    assert sum(kept[7, t] for t in (a, a3)) == 1 and sum(kept[7, t] for t in (None, "?!")) == 1
    assert kept[7, b] == kept[5, c] == 1 and sum(kept.values()) == 4


def test_rows_without_an_id_take_part(spark):
    (a, a2, a3), (b, b2, _) = near_texts(4), near_texts(5)
    rows = [(None, a), (None, a), (None, a2), (10, a3), (None, b), (None, b2), (None, b2), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join.near_duplicates(df).collect())
    assert got == Counter({(None, 10, 2, 2): 2, (None, 10, 2, 1): 1, (10, 10, 2, 1): 1, (None, None, 1, 1): 1, (None, None, 1, 2): 2, (None, None, 0, 1): 2})


def test_recall_on_the_corpus(spark):
    """Every document whose id is divisible by 100 against all documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {r.doc_id: shingles(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()}
    sets = {}
    for i, s in own.items():
        sets.setdefault(s, []).append(i)
    links = same = found = 0
    for q in (i for i in own if i % 100 == 0 and own[i]):
        near = [ids for s, ids in sets.items() if s and s != own[q] and 1000 * len(s & own[q]) >= 800 * len(s | own[q])]
        links += len(near)
        found += min(got[q][1], len(near))
        same += sum(got[ids[0]][0] == got[q][0] for ids in near)
        assert got[q][1] <= len(near)
    assert found >= 0.99 * links and same >= 0.99 * links


def test_long_texts_have_the_same_sets(monkeypatch):
    rng = random.Random(2)
    text = " ".join(f"Wörd{rng.randrange(300)}," for _ in range(3000))
    want = ngram_join.shingle_sets(["a b", text, "x" * 900, "", text[:50]])
    monkeypatch.setattr(ngram_join, "CHUNK", 60)
    got = ngram_join.shingle_sets(["a b", text, "x" * 900, "", text[:50]])
    assert len(got) == len(want) == 5 and all((a == b).all() and len(a) == len(b) for a, b in zip(got, want, strict=True))


def test_members_pass_the_filter(spark, monkeypatch):
    docs = spark.createDataFrame([(i if i % 7 else None, f"text {i}") for i in range(2000)], "doc_id long, text string").selectExpr("*", "xxhash64(text) as hash")
    members = docs.where("hash % 10 = 0").selectExpr("doc_id as id", "hash as h")
    want = {tuple(r) for r in members.collect()}
    for most in (1 << 26, 1 << 6):
        monkeypatch.setattr(ngram_join, "MOST_BITS", most)
        got = {(r.doc_id, r.hash) for r in ngram_join._likely(docs, members).collect()}
        assert want <= got and (most == 1 << 6 or len(got) < len(want) + 250)


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= ngram_join.MOST_HASHES


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5)] + [(300, 300 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, **{300 + i: 300 for i in range(50)}}


def items():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "er", "io", "ul", "ent", "ish")]
    sentence = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    return [(i, f"{sentence(rng.randint(3, 30))} {sentence(rng.randint(2, 9))}") for i in range(25)] + [(90, None), (91, "..."), (92, "One sentence alone without an answer at all")], words


def test_bounds_of_a_large_vocabulary_are_bounded(monkeypatch):
    monkeypatch.setattr(decontaminate, "BOUNDS", 4000)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(10))) for i in range(100)]
    frequency = Counter(w for _, t in rows for w in set(decontaminate.words_of(t)))
    index = decontaminate.build(rows, frequency, 100, 10.0)
    assert index.bounds.size <= 4000 and index.block == 25
    assert [i for i, *_ in decontaminate.search(index, sorted(index.vocabulary[w] for w in decontaminate.words_of(rows[57][1])))] == [57]


def test_search_returns_all_above_threshold():
    own, _ = items()
    words = {i: decontaminate.words_of(t or "") for i, t in own}
    frequency = Counter(w for ws in words.values() for w in set(ws))
    index = decontaminate.build(own, frequency, 26, 20.0)
    rng = random.Random(1)
    for _ in range(400):
        terms = sorted(rng.sample(range(len(index.vocabulary)), rng.randint(1, len(index.vocabulary))))
        scores = Counter()
        for t in terms:
            for d, x in zip(*index.postings[t], strict=True):
                scores[d] += x
        for threshold in (0.3, 0.6, 0.9):
            assert sorted(d for d, _ in decontaminate.search(index, terms, threshold)) == sorted(d for d, x in scores.items() if x >= threshold - 1e-9)


@pytest.mark.parametrize("size", [8 << 20, 200])
def test_planted_items_are_found(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)  # the small one makes many indexes
    own, words = items()
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choices([f"z{w}" for w in words], k=n))
    rows, want = [], set()
    for n, (i, t) in enumerate(own):
        if t and t != "...":
            rows.append((n, f"{filler(rng.randint(0, 300))} {t.upper()} {filler(70)}"))
            want.add((n, i))
    rows += [(500 + i, filler(200)) for i in range(20)] + [(600, None), (601, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(own, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_long_items_are_found_at_any_offset(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    bench = [(n, f"{text(n)}. {text(40)}.") for n in (30, 2000, 2500, 4200, 9000, 20_000)]
    rows = [(at * 100_000 + i, f"{text(at)} {t} {text(700)}") for i, t in bench for at in (0, 900, 1900, 3100)]
    rows += [(-1, text(30_000)), (-2, text(2500)), (-3, bench[4][1][: len(bench[4][1]) // 4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(d, d % 100_000) for d, _ in rows if d >= 0}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, benchmark).collect()} == {-1, -2, -3}


@pytest.mark.parametrize("size", [8 << 20, 40])
def test_one_row_for_an_id_of_many_texts(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
    own, _ = items()
    texts = [t for _, t in own[:6]]
    bench = spark.createDataFrame([(1, t) for t in texts] + [(2, texts[0]), (2, texts[0])], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(texts)), (2, texts[5]), (2, texts[5]), (3, "nothing")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, 1), (1, 2), (2, 1)])
    assert all(r.score > 0.99 for r in got)


@pytest.mark.parametrize("size", [8 << 20, 3000, 60])
def test_windows_depend_on_an_item_alone(spark, monkeypatch, size):
    """A short item whose question and answer stand 700 words apart is not found,
    whatever longer items stand beside it; each length is found whole in its windows."""
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    question, answer = text(22), text(8)
    bench = [(1, f"{question}. {answer}."), *((n, f"{text(n - 9)}. {text(9)}.") for n in (40, 64, 65, 128, 200, 500, 1600))]
    rows = [(-1, f"{question}. {text(700)} {answer}."), *((i, f"{text(77)} {t} {text(50)}") for i, t in bench)]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, of string").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i, _ in bench} and len(got) == len(bench)
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [-1]


def test_stretches_of_a_long_text_hold_every_passage(monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    bench = [(n, f"{text(n - 9)}. {text(9)}.") for n in (30, 90, 250)]
    long = " ".join(f"{text(rng.randint(100, 900))} {bench[k % 3][1]}" for k in range(40))
    frequency = Counter(w for _, t in bench for w in set(decontaminate.words_of(t)))
    group = [decontaminate.build(own, frequency, 3, 120.0, 3, step) for step, own in decontaminate.by_length(bench).items()]
    assert [g.step for g in group] == [64, 128, 256]

    def best():
        out = {}
        for i, index, d, *x in decontaminate.find(group, ["", long, long[:5000]]):
            out[i, index.ids[d]] = max(out.get((i, index.ids[d]), ()), tuple(x))
        return out

    whole = best()
    monkeypatch.setattr(decontaminate, "CHUNK", 300)
    monkeypatch.setattr(decontaminate, "CHARS", 1000)
    assert max(map(len, decontaminate.stretches(long, 512, 256))) == 768
    assert best() == whole and {k for _, k in whole} == {30, 90, 250}


def plain_contamination(docs, bench):
    """Every passage against every item: BM25 shares, then both overlaps."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    kept = [(i, words(t), t) for i, t in bench if words(t)]
    df = Counter(w for _, ws, _ in kept for w in set(ws))
    mean = sum(len(ws) for _, ws, _ in kept) / len(kept)
    out = {}
    for item, ws, text in kept:
        step = next(64 << k for k in range(40) if 64 << k >= len(ws))
        norm = 1.2 * (0.25 + 0.75 * len(ws) / mean)
        weight = {w: np.log(1 + (len(kept) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + norm) for w, n in Counter(ws).items()}
        total = sum(weight.values())
        parts = [words(p) for p in re.split(r"(?<=[.!?])\s+|\n+", text) if words(p)]
        q, a = ([w for p in parts[:-1] for w in p], parts[-1]) if len(parts) > 1 else (parts[0], [])
        grams = lambda own, n: {tuple(own[k : k + n]) for k in range(max(1, len(own) - n + 1))}
        n = min(5, len(q))
        for doc, t in docs:
            ds = words(t)
            for at in range(0, max(1, len(ds)), step):
                p = ds[at : at + 2 * step]
                held = set(p)
                score = sum(x for w, x in weight.items() if w in held) / total
                if score < 0.6 - 1e-9:
                    continue
                wanted = grams(q, 5)
                question = len(wanted & grams(p, n)) / len(wanted)
                answer = sum((Counter(a) & Counter(p)).values()) / len(a) if a else 1.0
                if question >= 0.5 and answer >= 0.6:
                    out[doc, item] = max(out.get((doc, item), ()), (score, score * total, question, answer))
    return out


def test_query_against_plain_search(spark, docs, rows):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items_ = [(r.item_id, r.text) for r in bench.collect()]
    rng = random.Random(4)
    near = []
    for n, (_, t) in enumerate(items_):  # items with some words changed, about the thresholds
        ws = t.split(" ")
        for k in rng.sample(range(len(ws)), min(len(ws), len(ws) * (n % 6) // 10)):
            ws[k] = "other"
        near.append((100_000 + n, " ".join(ws)))
    both = rows + near
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    want = plain_contamination(both, items_)
    got = {(r.doc_id, r.item_id): (r.score, r.bm25, r.question_overlap, r.answer_overlap) for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == set(want) and len(want) > 15
    for k, x in got.items():
        assert x == pytest.approx(want[k], abs=1e-6)


@pytest.mark.parametrize("size", [8 << 20, 60])
def test_items_without_an_id_are_found(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
    one, two, three = ("The grey heron waits all morning by the weir. It eats.", "Seven bakers carried warm bread up the hill. They slept.", "Old maps show a harbour where the fields are now. Yes.")
    bench = spark.createDataFrame([(None, one), (None, one), (None, two), (4, three)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{one} and {two}"), (2, three), (3, "nothing of this kind is held here")], "doc_id long, text string")
    assert Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == Counter([(1, None), (1, None), (2, 4)])
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()] == [3]


def test_pipeline_stages(spark, docs, odd, tmp_path):
    sf = "/root/testdata/sf0.001"
    for start in (docs, odd, odd.limit(0)):
        own = start.select(*corpus_pipeline.COLUMNS)
        for name, stage in corpus_pipeline.STAGES:
            before = own
            own = stage(spark, before, sf)
            own.write.parquet(out := f"{tmp_path}/{id(start)}-{name}")
            own = spark.read.parquet(out)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert sorted(own.columns) == sorted(docs.columns)
            assert own.count() <= before.count()
            assert {r.doc_id for r in own.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "ngram_join", "suffix_dedup", "decontaminate", "tokens"]


def test_pipeline_run_against_brute_force(spark, rows):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    texts = {i: t for i, t in rows if re.search(r"[^\W\d_]", t or "")}
    classes = brute_classes(texts.items())
    texts = {i: t for i, t in texts.items() if classes[i][0] == i}
    bench = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    seen = {}
    for i in sorted(texts):
        b = texts[i].encode()
        m = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                m[p : p + 50] = True
        texts[i] = np.frombuffer(b, np.uint8)[~m].tobytes().decode("utf-8", "ignore")
    want = {i for i, t in texts.items() if not any(x in t for x in bench)}
    assert set(got) == want
    assert all(r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in got.items())

"""Operators that look at one document at a time."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, langid, licenses, quality, queries, token_counts

from .conftest import ODD

RANKS = queries.tokenizer_file("byte_bpe_50k.tiktoken")
PIECES = queries.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tik():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def odd_strings(n=200):
    rng = random.Random(7)
    return ["".join(rng.choice("ab \n\t's1é漢\U0001f600<|>\\") for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(map(h.slot, keys)) == list(range(3000))


def test_bpe_is_the_librarys(spark, docs, odd, rows, tik):
    exp = {(i, len(ids := tik.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows + ODD}
    got = bpe.digest_documents(docs, RANKS, queries.tokenizer_pattern()).collect() + bpe.digest_documents(odd, RANKS, queries.tokenizer_pattern()).collect()
    assert {tuple(r) for r in got} == exp and len(got) == len(rows) + len(ODD)
    codec = bpe.codec_at(RANKS, queries.tokenizer_pattern())
    for s in odd_strings():
        assert codec.encode(s) == tik.encode_ordinary(s) and codec.decode(codec.encode(s)) == s.encode()
    assert bpe.digest_documents(odd.limit(0), RANKS, queries.tokenizer_pattern()).count() == 0


def test_bpe_stretches_parts_and_generations(monkeypatch, tik):
    rng = random.Random(3)
    monkeypatch.setattr(bpe, "LONG", 40)
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 5)
    codec = bpe.BytePairCodec(bpe.read_ranks(RANKS), queries.tokenizer_pattern())
    texts = odd_strings(300) + ["".join(rng.choice([" ", "  ", "\n", "\u2003", "\x1c", "a", "it's", "12", "é!"]) for _ in range(60)) for _ in range(300)]
    assert [codec.encode(t) for t in texts] == [tik.encode_ordinary(t) for t in texts]
    assert [x for x in codec.encode_all(texts)] == [tik.encode_ordinary(t) for t in texts]
    assert any(len(list(codec.parts(t))) > 1 for t in texts)
    assert all(codec.hits) and len(codec.pretokens.young) <= 5


def test_bpe_memos_are_small(tik):
    """What is remembered is packed, and a pre-token that is a stretch is kept a while only."""
    codec = bpe.BytePairCodec(bpe.read_ranks(RANKS), queries.tokenizer_pattern())
    text = " ".join(f"{chr(0xE0 + i % 29)}q{i:x}" for i in range(bpe.MEMO_ENTRIES // 2))
    assert codec.encode(text) == tik.encode_ordinary(text)
    assert {type(x) for x in codec.stretches.young.values()} == {bytes}
    assert len(codec.stretches.young) >= bpe.MEMO_ENTRIES // 4 + 1 and len(codec.pretokens.young) <= bpe.MEMO_ENTRIES // 4
    few = bpe.codec_at(RANKS, queries.tokenizer_pattern(), 1000)
    assert few.encode(text) == tik.encode_ordinary(text) and max(len(m.young) + len(m.old) for m in (few.stretches, few.pretokens)) <= 2000


def test_bpe_writes_and_decodes_a_stretch_once(monkeypatch, tik):
    """Digests of many texts of the same stretches ask for the pieces and decimals of each
    distinct stretch only, not for those of each place."""

    class Counted(list):
        asked = 0

        def __getitem__(self, i):
            self.asked += 1
            return super().__getitem__(i)

    rng = random.Random(9)
    words = [f"qz{i:x}é" for i in range(50)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(100)] + ["", " ", "a  b \n c\n", "x" * 70, "q\n", " q", "  "]
    for long in (bpe.LONG, 60):
        monkeypatch.setattr(bpe, "LONG", long)
        codec = bpe.BytePairCodec(bpe.read_ranks(RANKS), queries.tokenizer_pattern())
        codec.pieces, codec.decimal = Counted(codec.pieces), Counted(codec.decimal)
        monkeypatch.setattr(bpe, "codec_at", lambda *_, codec=codec: codec)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
        got = [tuple(r.values()) for b in bpe._task(RANKS, queries.tokenizer_pattern(), True)([batch]) for r in b.to_pylist()]
        ids = list(map(tik.encode_ordinary, texts))
        exp = [(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, (t, x) in enumerate(zip(texts, ids, strict=True))]
        assert got == exp
        if long > 60:
            assert max(codec.pieces.asked, codec.decimal.asked) < 1500 < sum(r[1] for r in got) / 10


def test_bpe_tiers_take_many_at_a_time(monkeypatch, tik):
    ranks = bpe.read_ranks(RANKS)
    codec = bpe.BytePairCodec(ranks, queries.tokenizer_pattern())
    keys = [*ranks, b"no such key at all", b"\xff" * 9]
    assert codec.whole(keys) == [ranks.get(k) for k in keys]
    assert codec.hash.slots(np.array([bpe.xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)).tolist() == list(map(codec.hash.slot, keys))
    monkeypatch.setattr(bpe, "MERGED_BYTES", 300)
    rng = random.Random(4)
    words = ["".join(rng.choices("aeinorst", k=rng.choice([1, 2, 5, 9, 30]))) for _ in range(300)] + ["th" * 5000, "é" * 700, "b" * 257]
    assert list(codec.merge([w.encode() for w in words])) == [tik.encode_ordinary(w) for w in words]


def test_bpe_ids_round_trip(odd):
    for r in bpe.encode_documents(odd, RANKS, queries.tokenizer_pattern()).collect():
        assert r.n_tokens == len(r.ids)
        assert bytes(r.decoded).decode() in [t or "" for i, t in ODD if i == r.doc_id]


def test_shares_of_any_number_of_rows(spark):
    assert common.parts_of(2000, 2000) == common.SHARES and common.parts_of(2000, 0) == common.SHARES
    for n in (10**4, 10**9, 10**12):
        assert abs(common.parts_of(2000, n) * n / common.SHARES - 2000) < 1
    taken = spark.range(20_000).where(common.in_share("id", common.parts_of(2000, 20_000))).count()
    assert 1800 < taken < 2200


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.predict_documents(docs).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_odd_rows(spark, odd):
    got = langid.predict_documents(odd)
    by = {r.doc_id: r.lang_pred for r in got.collect()}
    assert by[1] == by[2] == by[3] == by[4] == "und" and by[5] == by[9] == "en" and got.count() == len(ODD)
    assert langid.predict_documents(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict_documents(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_ngrams(text):
    letters = "".join(c if c.isalpha() else " " for c in f" {text} ".lower())
    letters = " ".join(["", *letters.split(), ""]) if letters.strip() else " "
    return [letters[i : i + n] for n in langid.ORDERS for i in range(len(letters) - n + 1)]


def test_language_against_plain_sets(spark):
    """The filter against sets of n-grams: what it adds are false positives, of
    about the rate that is taken off."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = [(r.doc_id, r.text, r.lang) for r in docs.collect() if r.text and r.lang]
    model = langid.fit(docs)
    counts = {k: Counter(g for _, t, x in own if x == k for g in plain_ngrams(t)) for k in {x for _, _, x in own}}
    total = {k: sum(c.values()) for k, c in counts.items()}
    best = {}
    for k, c in counts.items():
        for g, n in c.items():
            best[g] = max(best.get(g, 0), n / total[k])
    least = {k: min(langid.LEAST_SEEN, 1 + total[k] // langid.SEEN_EACH) for k in counts}
    sets = {k: {g for g, n in c.items() if n / total[k] >= langid.RATE_SHARE * best[g] and n >= least[k]} for k, c in counts.items()}
    assert model.languages == sorted(sets)
    texts = [t for _, t, _ in own]
    held, every, _ = model.counts(texts)
    plain = np.array([[sum(g in sets[k] for g in plain_ngrams(t)) for k in model.languages] for t in texts])
    assert [len(plain_ngrams(t)) for t in texts] == every.astype(int).tolist() and (held >= plain).all()
    strange = np.random.default_rng(5).integers(0, 1 << 63, 400_000, np.int64).view(np.uint64)
    claimed = np.array([(model.contains(strange) >> np.uint64(b) & np.uint64(1)).mean() for b in range(len(model.languages))])
    assert np.allclose(claimed, model.false_rates(), rtol=0.3, atol=1e-4)
    labels, _ = model.predict(texts)
    assert np.mean([a == model.languages[b] for a, b in zip(labels, plain.argmax(axis=1), strict=True)]) > 0.99


def test_more_than_64_languages(spark):
    rng = random.Random(6)
    rows = []
    for k in range(120):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(40)]
        rows += [(10 * k + i, " ".join("".join(rng.choices(letters, k=4)) for _ in range(60)), f"l{k:03}") for i in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    labels, scores = model.predict([t for _, t, _ in rows])
    assert labels == [x for _, _, x in rows] and scores.min() > 0.8


def test_ties_go_to_the_first_name():
    f = langid.LanguageFilter(["b", "c"], np.full(64, 3, np.uint64), "c")
    assert f.predict(["some words"])[0] == ["c"]  # a full filter tells nothing
    slots = np.zeros(1 << 14, np.uint64)
    h, _ = langid.ngram_hashes(*langid.folded(["some words"])[:2])
    for i in range(langid.PROBES):
        np.bitwise_or.at(slots, (h + np.uint64(i) * (h >> np.uint64(32) | np.uint64(1)) & np.uint64((1 << 14) - 1)).astype(np.int64), np.uint64(3))
    assert langid.LanguageFilter(["b", "c"], slots, "c").predict(["some words"])[0] == ["b"]


def test_long_texts_in_windows(monkeypatch, rows):
    texts = [t or "" for _, t in rows[:40]] + ["ÀÉ, 12 \n" * 50, "a" * 500, "1" * 300, "漢 字" * 100]
    parts = lambda: {(a, tuple(sorted(Counter(h.tolist()).items()))) for a, h in merged().items()}

    def merged():
        out = {}
        for a, _, h, of, _ in langid.ngram_parts(texts):
            for k in np.unique(of):
                out[a + int(k)] = np.concatenate([out.get(a + int(k), np.zeros(0, np.uint64)), h[of == k]])
        return out

    whole = parts()
    monkeypatch.setattr(langid, "CHUNK", 101)
    assert parts() == whole


def test_small_languages_keep_their_ngrams(spark):
    rng = random.Random(2)
    large = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(150_000))  # 450,000 n-grams
    small = " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(40))
    few = " ".join("".join(rng.choice("nopqrstuvwxyz") for _ in range(6)) for _ in range(40))
    rows = [(i, large, "la") for i in range(4)] + [(10 + i, small, "sm") for i in range(3)] + [(20, few, "fw")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    labels, scores = model.predict([small, few, large[:1000]])
    assert labels == ["sm", "fw", "la"] and min(scores) > 0.9


def test_language_filter_has_all_it_was_given():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 500, np.int64).view(np.uint64)
    slots = np.zeros(1 << 13, np.uint64)
    for i in range(langid.PROBES):
        np.bitwise_or.at(slots, (h + np.uint64(i) * (h >> np.uint64(32) | np.uint64(1)) & np.uint64((1 << 13) - 1)).astype(np.int64), np.uint64(5))
    f = langid.LanguageFilter(["a", "b", "c"], slots, "a")
    assert (f.contains(h) & np.uint64(5) == 5).all() and f.false_rates()[1] == 0


def plain_scan(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses_against_plain_scan(docs, odd, rows):
    texts = ["CC-BY cc by cc by, General\nPublic License; all rights reserved all rights", "écc by", "cc bycc by", "cc by", "by"]
    for t in texts + [t or "" for _, t in rows + ODD]:
        assert licenses.scan(t)[:5] == plain_scan(t)
    got = licenses.scan_documents(odd).collect()
    assert len(got) == len(ODD) and all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert [r.first_word for r in got if r.doc_id == 2] == [None]


@pytest.mark.parametrize(
    ("line", "ids", "free"),
    [
        (" MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)", {"mit", "apache-2.0", "gpl-2.0-only with classpath-exception-2.0"}, 0.95),
        ("MIT AND GPL-3.0", {"mit", "gpl-3.0"}, 0.5),
        ("MIT OR", {"mit"}, 0.95),
        ("(MIT", {"mit"}, 0.95),
    ],
)
def test_license_expressions(line, ids, free):
    assert licenses.parse_expression(line) == (ids, free)


@pytest.mark.parametrize("tag", ["SPDX-License-Identifier:", "License-Expression:"])
@pytest.mark.parametrize(
    ("line", "ids"),
    [("NCSA", "id:ncsa"), ("PostgreSQL */", "id:postgresql"), ("MIT OR Ruby", "id:mit,id:ruby"), ("(Vim AND curl) OR OpenSSL", "id:curl,id:openssl,id:vim"), ("JSON", "id:json"), ("OR", ""), ("", ""), ("\nBeerware", "")],
)
def test_any_id_after_a_strict_tag(tag, line, ids):
    got = licenses.scan(f"# {tag} {line}\nmore text")
    assert got[5] == ids and got[4] == ""
    assert licenses.scan("License: see the file, or ask Ruby")[5] == ""


def test_long_line_of_tags():
    n = 100_000
    got = licenses.scan("license: MIT or (" * n)
    assert got[0] == 3 * n and got[5] == "id:mit"
    assert licenses.parse_expression("x: MIT and BSD\nGPL", 2, 10)[0] == {"mit"}


def plain_value(text):
    """(ids, ids to comply with, freedom) by recursive descent."""
    tokens = text.lower().replace("(", " ( ").replace(")", " ) ").split()

    def parse(level):
        if level == 3:
            t = tokens.pop(0)
            if t == "(":
                found = parse(0)
                tokens.pop(0)
                return found
            return {t}, {t}, licenses.freedom(t)
        left = parse(level + 1)
        while tokens and tokens[0] == ("or", "and", "with")[level]:
            tokens.pop(0)
            right = parse(level + 1)
            if level == 0:
                better = left if (-left[2], len(left[1])) <= (-right[2], len(right[1])) else right
                left = (left[0] | right[0], better[1], better[2])
            elif level == 1:
                left = (left[0] | right[0], left[1] | right[1], min(left[2], right[2]))
            else:
                both = {f"{a} with {b}" for a in left[0] for b in right[0]}
                left = (both, both, left[2])
        return left

    return parse(0)


def test_expressions_decide_the_result():
    rng = random.Random(12)
    names = ["mit", "gpl-3.0-only", "apache-2.0", "epl-2.0", "zlib", "agpl-3.0", "mpl-2.0"]

    def expression(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(names)
        a, b = expression(depth - 1), expression(depth - 1)
        return f"({a} {rng.choice(['OR', 'AND'])} {b})" if rng.random() < 0.6 else f"{a} {rng.choice(['OR', 'AND'])} {b}"

    for _ in range(300):
        e = expression(3)
        ids, needs, free = plain_value(e)
        got = licenses.scan(f"SPDX-License-Identifier: {e}\n")
        assert got[5] == ",".join(sorted(f"id:{x}" for x in ids)) and got[8] == ",".join(sorted(needs)) and got[7] == free
        assert got[6] == pytest.approx(1 - 1 / (2 - free / 2))
    either, both = (licenses.scan(f"SPDX-License-Identifier: MIT {op} GPL-3.0-only") for op in ("OR", "AND"))
    assert either[5] == both[5] and either[6] < both[6] and (either[8], both[8]) == ("mit", "gpl-3.0-only,mit")
    notices = licenses.scan("All rights reserved. MIT License")
    assert notices[5] == "mit,reserved" and notices[6] == pytest.approx(1 - 1 / (1 + 1 + 1 - 0.95 / 2)) and notices[7:] == (0.0, "")
    assert licenses.scan("")[6:] == (0.0, None, "")


def test_long_texts_have_the_same_scan(monkeypatch, rows):
    texts = [t or "" for _, t in rows] + ["a  b\n\nall rights   reserved ", "   "]
    want = list(map(licenses.scan, texts))
    monkeypatch.setattr(licenses, "_LONG", 0)
    assert list(map(licenses.scan, texts)) == want


def test_license_expression_precedence():
    assert licenses.shunting_yard("a or b and c with d".split()) == "a b c d with and or".split()
    assert licenses.parse_expression("whatever you like") is None


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) >= 0.95


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1), (6, 0), (8, 0)], "doc_id long, quality int")
    assert quality.score_documents(odd, labels).where("score between 0 and 1").count() == len(ODD)
    assert quality.score_documents(odd, labels.limit(0)).where("score = 0.5").count() == len(ODD)
    assert quality.score_documents(odd.limit(0), labels).count() == 0


def test_quality_lines(spark, monkeypatch):
    """Labels, marginals and scores against a plain pass over each document."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    assert abs(model.trans[0, 1] + model.trans[1, 0] - model.trans[0, 0] - model.trans[1, 1]) > 1e-3
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    some = sorted(texts)[:40]
    got = {}
    for r in quality.label_lines(docs, model).collect():
        got.setdefault(r.doc_id, {})[r.line] = (r.good, r.marginal)
    scores = {r.doc_id: (r.score, r.n_lines, r.n_good) for r in quality.score_documents(docs, labels).collect()}
    for i in some:
        lines = texts[i].split("\n")
        own = quality.line_features(lines)
        rows = [np.concatenate([own[k], own[k - 1] if k else 0 * own[k], own[k + 1] if k + 1 < len(own) else 0 * own[k], [k == 0, k == len(own) - 1]]) for k in range(len(own))]
        emit = np.array([((x - model.mean) / model.scale) @ model.weights + model.bias for x in rows])
        m, s = emit.copy(), emit.copy()  # messages from the left, from the right
        m[0] += model.start
        for k in range(1, len(lines)):
            m[k] = [emit[k, b] + np.logaddexp.reduce(m[k - 1] + model.trans[:, b]) for b in range(2)]
        for k in range(len(lines) - 2, -1, -1):
            s[k] = [emit[k, a] + np.logaddexp.reduce(model.trans[a] + s[k + 1]) for a in range(2)]
        p = m + s - emit + (np.arange(len(lines)) == -1)[:, None]
        marginal = np.exp(p[:, 1] - np.logaddexp(p[:, 0], p[:, 1]))
        assert np.allclose([got[i][k][1] for k in range(len(lines))], marginal, atol=1e-6)
        weight = np.array([len(x) + 1 for x in lines])
        good = np.clip((marginal * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        a, b = model.curve
        assert scores[i][0] == pytest.approx(1 / (1 + np.exp(-(a * np.log(good / (1 - good)) + b))), abs=1e-6)
        assert scores[i][1:] == (len(lines), sum(g for g, _ in got[i].values()))
    monkeypatch.setattr(quality, "BLOCK_LINES", 3)
    monkeypatch.setattr(quality, "LONG_LINE", 5)
    for i in some:
        assert np.allclose(model.score([texts[i]]), scores[i][0], atol=1e-6)


def test_transitions_learn_what_follows():
    """Bad lines come in pairs inside good documents: the field learns it."""
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "slowly"]) for _ in range(8)) + "."
    bad = lambda: "$$ " + "!" * rng.randint(5, 9) + " " + "#" * 4
    texts, labels = [], []
    for n in range(120):
        y = n % 2
        lines = [(bad if (k // 2 == 5) == bool(y) else good)() for k in range(60)]
        texts.append("\n".join(lines))
        labels.append(y)
    model = quality.fit(texts, labels)
    bad_doc, good_doc = (m for m, _ in model.label(texts[:2]))
    assert np.flatnonzero(bad_doc >= 0.5).tolist() == [10, 11] and sorted(np.argsort(good_doc)[:2].tolist()) == [10, 11]


def test_forward_backward_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(3)
    lengths = np.array([1, 4, 3])
    emit, trans, start = rng.normal(size=(8, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    marginal, pairs, log_z = quality.forward_backward(emit, lengths, trans, start)
    want, want_pairs, z_all, at = np.zeros((8, 2)), np.zeros((2, 2)), 0.0, 0
    for n in lengths:
        z = 0.0
        m, q = np.zeros((n, 2)), np.zeros((2, 2))
        for path in product((0, 1), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(emit[at + i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            z += w
            for i, s in enumerate(path):
                m[i, s] += w
            for a, b in zip(path, path[1:]):
                q[a, b] += w
        want[at : at + n] = m / z
        want_pairs += q / z
        z_all += np.log(z)
        at += n
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, z_all)


def unigram(byte_fallback=True):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, _ = token_counts.read_pieces(PIECES)
    vocabulary = [("<unk>", 0.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256)], *pieces.items()]
    # the library's unknown penalty counts from the least score of all entries: byte pieces don't lower it
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    return t


def test_token_counts_are_the_librarys(docs, odd, rows):
    lib, counter = unigram(), token_counts.counter_at(PIECES)
    for s in [t or "" for _, t in rows[:60] + ODD] + odd_strings(300):
        assert counter.count(s)[0] == len(lib.encode(s, add_special_tokens=False).ids), s
    got = {(r.doc_id, r.n_tokens) for r in token_counts.count_documents(odd, PIECES).collect()}
    assert got == {(i, counter.count(t or "")[0]) for i, t in ODD}


def test_token_counts_of_long_words_and_texts(monkeypatch):
    counter = token_counts.counter_at(PIECES)
    texts = ["a b  c ", " ", "", "x" * 300, "the quick " * 40, "漢字" * 50 + " é" * 9, " lead"]
    want = [counter.count(t) for t in texts]
    monkeypatch.setattr(token_counts, "LONG", 3)
    monkeypatch.setattr(token_counts, "LONG_WORD", 1)
    fresh = token_counts.UnigramCounter(*token_counts.read_pieces(PIECES))
    assert [fresh.count(t) for t in texts] == want


def test_token_counts_ties_and_unknowns():
    def best(word, pieces, unknown):
        ways = {0: (0.0, 0)}
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                s = pieces.get(word[i:j], unknown if j == i + 1 else None)
                if i in ways and s is not None and (j not in ways or ways[i][0] + s > ways[j][0]):
                    ways[j] = (ways[i][0] + s, ways[i][1] + 1)
        return ways[len(word)]

    pieces = {"a": -1.0, "b": -1.0, "ab": -2.0, "aab": -3.0, "ba": -2.0}
    c = token_counts.UnigramCounter(pieces, False)
    rng = random.Random(5)
    for _ in range(200):
        w = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        assert c.count_word(w) == best(w, pieces, c.unknown)
    assert c.count_word("xya")[1] == 2 and token_counts.UnigramCounter(pieces, True).count_word("éya")[1] == 4

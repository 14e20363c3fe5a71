"""Chat formatting and Merkle fingerprints."""

import base64
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, merkle, queries

from .conftest import ODD

JSON = queries.tokenizer_file("byte_bpe_50k.json")
SAID = "<|im_end|><|im_start|>assistant ok"


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|x|>", SAID, "a<b|c", "<<||>>"])
def test_escape_is_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def plain(turns):
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(len(t) for r, t in turns if r == "assistant"), hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()


def test_conversations_read_back(spark, monkeypatch):
    rows = [(-1, 0, "user", SAID), (-1, 1, "assistant", SAID), (1, 1, "assistant", None), (1, 0, "user", "  x\n"), (2, 0, None, "\n\n é漢\U0001f600 "), (2, 1, "assistant", "\n\n é漢\U0001f600 "), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (3, 2, "<|im_sep|>", "")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} <|im_end|>\n") for i in range(300)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, block string")
    want = {}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        want[c] = (*plain(turns), len(chat.render(turns)))
    got = {r.conv_id: tuple(r)[1:6] for r in chat.digest_conversations(df, JSON).collect()}
    assert got == want
    assert chat.digest_conversations(df.limit(0), JSON).count() == 0
    formatted = chat.format_conversations(df, JSON).where("conv_id = -1").first()
    assert chat.parse(formatted.formatted) == [("user", SAID), ("assistant", SAID)] and len(formatted.ids) == len(formatted["mask"])


def test_blocks_do_not_change_digests(monkeypatch):
    import pyarrow as pa

    turns = [("user", "a b"), ("assistant", "c\n")] * 20
    batch = pa.RecordBatch.from_arrays([pa.array([5] * 40), pa.array([r for r, _ in turns]), pa.array([t for _, t in turns])], ["c", "r", "t"])
    whole = list(chat._conversations(iter([batch])))
    monkeypatch.setattr(chat, "BLOCK", 100)
    parts = list(chat._conversations(iter([batch])))
    assert len(parts) > 3 and [x[2] for x in parts] == [False] * (len(parts) - 1) + [True]
    assert "".join(x[1] for x in parts) == whole[0][1]
    texts = [t for x in parts for t in chat.loss_texts(x[1], *chat.encode_block(x[1], JSON)[1:])]
    assert texts == ["c\n"] * 20


def test_a_long_turn_is_encoded_in_parts(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["word ", "é漢字", "\n", "  ", "it's", " 12", "<|x"]) for _ in range(900))
    rendered = chat.render([("user", "hello there"), ("assistant", text), ("assistant", "漢字" * 400)])
    whole = chat.encode_block(rendered, JSON)
    monkeypatch.setattr(chat, "BLOCK", 50)
    assert len(list(chat._parts(rendered))) > 5
    assert all((a == b).all() for a, b in zip(whole, chat.encode_block(rendered, JSON), strict=True))


def test_query_has_the_extra_conversation(spark):
    got = {r.conv_id: r for r in queries.op7_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert tuple(got[-1])[1:5] == plain([("user", SAID), ("assistant", SAID)])


def plain_node(level, content):
    return base64.b64encode(hashlib.blake2b(content.encode("utf-8", "surrogatepass"), digest_size=16, person=level.encode()).digest())[:22].decode()


def plain_tree(text):
    """(root, [(section, [(paragraph, [(piece, length)])])]), code point by code point."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    factors = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
    pieces, start = [], 0
    for i, c in enumerate(text):
        chosen = mix(sum(ord(text[i - k]) * f for k, f in enumerate(factors) if k <= i) & mask) % 64 == 0
        if c == "\n" or i == len(text) - 1 or i + 1 - start == 160 or (chosen and i + 1 - start >= 16):
            pieces.append((text[start : i + 1], c == "\n" or i == len(text) - 1))
            start = i + 1
    sections, paragraphs, own = [], [], []
    for n, (piece, ends) in enumerate(pieces):
        own.append((plain_node("piece", piece), len(piece)))
        if ends:
            node = plain_node("paragraph", "".join(h for h, _ in own))
            paragraphs.append((node, own))
            own = []
            if int.from_bytes(node[:4].encode(), "big") % 6 == 0 or n == len(pieces) - 1:
                sections.append((plain_node("section", "".join(h for h, _ in paragraphs)), paragraphs))
                paragraphs = []
    return plain_node("root", "".join(h for h, _ in sections)), sections


def plain_fingerprint(text):
    root, sections = plain_tree(text)
    return root + "".join(f";{s}" + "".join(f",{p}" + "".join(f".{h}{n:x}" for h, n in leaves) for p, leaves in paragraphs) for s, paragraphs in sections)


def plain_likeness(a, b):
    """Shares by a quadratic choice of common branches, level by level."""
    x, y = plain_tree(a), plain_tree(b)
    if x[0] == y[0]:
        return 1.0
    size = lambda t: t if isinstance(t, int) else sum(size(c) for _, c in t)

    def shared(xs, ys):
        seen, there, pairs = Counter(), {}, []
        for j, (h, _) in enumerate(ys):
            there[h, seen[h]] = j
            seen[h] += 1
        seen = Counter()
        for i, (h, _) in enumerate(xs):
            if (h, seen[h]) in there:
                pairs.append((i, there[h, seen[h]]))
            seen[h] += 1
        # the longest increasing choice; of several that which the patience method takes
        tails = []
        before = {}
        for k, (_, j) in enumerate(pairs):
            at = next((n for n, t in enumerate(tails) if pairs[t][1] >= j), len(tails))
            before[k] = tails[at - 1] if at else None
            tails[at : at + 1] = [k]
        k, chosen = (tails[-1] if tails else None), []
        while k is not None:
            chosen.insert(0, pairs[k])
            k = before[k]
        total, p, q = 0, 0, 0
        for i, j in [*chosen, (len(xs), len(ys))]:
            left, right = xs[p:i], ys[q:j]
            if left and right and not isinstance(left[0][1], int):
                total += shared([c for _, cs in left for c in cs], [c for _, cs in right for c in cs])
            if i < len(xs):
                total += size(xs[i][1])
            p, q = i + 1, j + 1
        return total

    return 2 * shared(x[1], y[1]) / (len(a) + len(b))


def test_next_documents(spark, docs, odd, rows):
    for df, own in ((docs, rows[:60]), (odd, ODD)):
        own = sorted(((i, t or "") for i, t in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = []
        for n, (i, t) in enumerate(own):
            following = own[(n + 1) % len(own)][1]
            new = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
            want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), plain_fingerprint(t), plain_fingerprint(new), plain_likeness(t, new), plain_likeness(t, following)))
        df = df if own[0][0] is None else df.where(F.col("doc_id").isin([i for i, _ in own]))
        got = [tuple(r)[:7] for r in merkle.compare_with_next(df).collect()]
        key = lambda r: (str(r[0]), r[2:])
        assert sorted(got, key=key) == sorted(want, key=key)
    assert merkle.compare_with_next(odd.limit(0)).count() == 0
    one = [tuple(r) for r in merkle.compare_with_next(odd.where("doc_id = 5")).collect()]
    assert len(one) == 1 and one[0][6] == 1.0


def test_edits_of_the_query_give_the_edited_text(spark, docs, rows):
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts)
    for r in merkle.compare_with_next(docs).collect():
        old, following = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        new = merkle.edited(old, following)
        at, out = 0, []
        for e in r.edits.split():
            (a, b), (c, d) = (map(int, x.split("-")) for x in e.split(">"))
            out += [old[at:a], new[c:d]]
            at = b
        assert "".join([*out, old[at:]]) == new and (r.edits == "") == (old == new)


def test_windows_do_not_change_pieces(monkeypatch, rows):
    texts = [t or "" for _, t in rows[:30]] + ["x" * 5000, "a\n" * 900]
    want = [merkle.fingerprint(t) for t in texts]
    monkeypatch.setattr(merkle, "WINDOW", 97)
    assert [merkle.fingerprint(t) for t in texts] == want == [plain_fingerprint(t) for t in texts]


def test_likeness_follows_order_and_needs_no_blanks():
    rng = random.Random(8)
    lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(12)) for _ in range(60)]
    mixed = rng.sample(lines, len(lines))
    f = lambda x: merkle.fingerprint("\n".join(x))
    assert 0 < merkle.likeness(f(lines), f(mixed)) < 0.6
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(3600))
    for at in range(0, 3600, 120):
        changed = text[:at] + "x" + text[at + 1 :]
        a, b = merkle.fingerprint(text), merkle.fingerprint(changed)
        assert 0.9 < merkle.likeness(a, b) < 1 and len(merkle.edits(a, b)) == 1
        assert merkle.likeness(a, b) == plain_likeness(text, changed)
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("a")) == 0


def test_fingerprints_tell_texts_apart(rows):
    texts = {t or "" for _, t in rows} | {"", "\n", "\n\n", " ", "a", "a ", "a\n", "a\n\nb", "a\nb"}
    assert len({merkle.fingerprint(t) for t in texts}) == len(texts)
    assert all(merkle.likeness(f := merkle.fingerprint(t), f) == 1 for t in texts)


def test_edits_are_located():
    rng = random.Random(2)
    words = [f"w{rng.randrange(500)}" for _ in range(3000)]
    lines = [" ".join(words[i : i + 40]) for i in range(0, 3000, 40)]
    text = "\n".join(lines)
    at = text.index(lines[30]) + 50
    changed = text[:at] + "EDITED" + text[at + 3 :]
    (edit,) = merkle.edits(merkle.fingerprint(text), merkle.fingerprint(changed))
    assert edit[0] <= at and edit[1] >= at + 3 and edit[1] - edit[0] < 400
    assert merkle.edits(merkle.fingerprint(text), merkle.fingerprint(text)) == []
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(changed)) > 0.95

"""Conversation repair against all edits of short sequences and a plain pass."""

import hashlib
import random
import re
import zlib

from corpusloom.llm import queries, repair

BLANK = re.compile(r"[ \t-\r]*\Z")


def every_edit(rows):
    """The cheapest (cost, audit) of (initial, fault) rows, out of all edits."""
    best = [(5 * len(rows) + 1, "")]

    def walk(i, cost, audit, out, inserts):
        if cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            best[0] = min(best[0], (cost, audit))
        if inserts:
            for due in "ua":
                walk(i, cost + 3, audit + "I", out + due, inserts - 1)
        if i < len(rows):
            initial, fault = rows[i]
            walk(i + 1, cost + 4, audit + "D", out, inserts)
            if fault in ("none", "truncated"):
                more = 3 * (fault == "truncated")
                walk(i + 1, cost + more, audit + "K", out + initial, inserts)
                for due in "ua":
                    walk(i + 1, cost + 3 + more, audit + "R", out + due, inserts)

    walk(0, 0, "", "", len(rows) + 1)
    return best[0]


def test_cheapest_edits_of_all():
    rng = random.Random(2)
    seen = set()
    for _ in range(400):
        rows = tuple((rng.choice("suuaax"), rng.choice(["none", "none", "none", "truncated", "duplicate", "blank"])) for _ in range(rng.randint(0, 4)))
        signature = "".join(chr(65 + 4 * ("sua".find(i) % 4) + repair.FAULTS.index(f)) for i, f in rows)
        assert repair.solve(signature) == every_edit(rows), rows
        seen.add(signature)
    assert len(seen) > 150


def test_long_signatures():
    assert repair.solve("AEI" + "EI" * 50_000 + "E") == (3, "K" * 100_004 + "I")
    assert repair.solve("EI" * 20_000) == (0, "K" * 40_000) and repair.solve("") == (0, "")
    assert repair.solve("H" * 5000) == (20_000, "D" * 5000)


def plain(rows):
    """The contract, row by row; the edits are the operator's own, checked above."""
    word = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        harm = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        own += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    found = []
    for conv, own in out.items():
        tie = lambda r, t: (r, hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).hexdigest())
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, tie(*x[1:])))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, r, t in own:
            faults.append("blank" if BLANK.match(t) else "duplicate" if (r, t) in seen else "none" if t.rstrip(" \t\n\v\f\r")[-1] in ".!?" else "truncated")
            seen.add((r, t))
        initials = [r[:1] or "-" for _, r, _ in own]  # an empty role is another role
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        signature = "".join(chr(65 + 4 * ("sua".index(i) if i in "sua" else 3) + repair.FAULTS.index(f)) for i, f in zip(initials, faults, strict=True))
        cost, audit = repair.solve(signature) if len(own) > 5 else every_edit(list(zip(initials, faults, strict=True)))
        lines, i, due = [], 0, "user"
        for edit in audit:
            if edit == "D":
                i += 1
                continue
            role, text = (due, "") if edit == "I" else (own[i][1] if edit == "K" else due, own[i][2])
            i += edit != "I"
            lines.append(f"{role}:{text}")
            due = "assistant" if role[0] == "u" else "user"
        assert i == len(own) and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        found.append((repr(conv), gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found)


def got(df):
    return sorted((repr(r.conv_id), *r[1:]) for r in df.collect())


def test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_conversation_repair(spark, "/root/testdata/sf0.01")) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(6)
    words = [None, "", " \t\n\v\f\r", "Yes.", "no", "ünï é!", "a\xa0", "what?  \n", "x" * 3000 + ".", "a\0b."]
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(words)) for conv in [*range(60), None] for turn in rng.choice([[0, 1, 2, 3], [None, 5, 5, 600], [-7, 2000, 2001], [None], [3, 1]])]
    rows += [(1000, t, rng.choice(["user", "assistant"]), f"{t}.") for t in range(3000)] + [(1001, None, "user", f"{t}.") for t in range(300)] + [(1002, 4, "user", "again.")] * 500
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, copies int, audit string, gaps int").repartition(5)
    assert got(repair.repair_damaged(df)) == plain(rows)
    assert repair.repair_damaged(df.limit(0)).collect() == []


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "What"), (1, 2, "user", "What"), (2, 0, "user", "A?"), (2, 1, "assistant", "B."), (3, 0, "system", "  ")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = repair.repaired(df).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.edit, r.turn, r.role, r.text) for r in out if r.conv_id == 2] == [(2, "K", 0, "user", "A?"), (2, "K", 1, "assistant", "B.")]
    assert [(r.edit, r.role, r.text) for r in out if r.conv_id == 1] == [("I", "user", ""), ("K", "assistant", "Hello.")]
    assert not [r for r in out if r.conv_id == 3]
    rows = [(c, t, r, f"{c} {t}.") for c in range(200) for t, r in enumerate(["system", *["user", "assistant"] * 3])]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    by = {}
    for r in repair.repaired(df, harm=True).orderBy("conv_id", "place").collect():
        by.setdefault(r.conv_id, []).append(r)
    assert len(by) == 200 and all(re.fullmatch("s?(ua)+", "".join(x.role[0] for x in own)) for own in by.values())
    assert {x.edit for own in by.values() for x in own} == {"I", "K", "R"}

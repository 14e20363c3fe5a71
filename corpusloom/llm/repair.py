"""Conversation repair by distinct signatures.

A conversation's rows, in order, become one letter each: the role's initial (s, u, a
or another) and the row's first fault (none, truncated, duplicate, blank).  The
letters joined are its signature, built by Spark out of parts of ``PART`` turns.
Each distinct signature is solved once: a memoised recursion over (row, state of the
grammar) finds the cheapest edits, of which the audit names one letter each: K keep,
R give the role that is due, D delete, I insert an empty turn of the role that is
due.  The audits are joined back by signature and replayed on the rows, which come
to their tasks sorted, as a stream.

A legal conversation is ``(s?(ua)+)?`` by initials.  Reroling and inserting cost 3,
deleting 4, a truncated row that stays 3 more; blank and duplicate rows go.  Of
equally cheap audits the least by ASCII is taken.

Rows are ordered by turn (null first), then role, then the md5 of role and text, so
equal rows stand together.  An empty role is legal nowhere.  A null role or text is one space (a null conv_id or turn
too, in the damage's checksum); null conv_ids are one conversation.  A repeated row
is a duplicate.  A conversation without rows has an empty audit.  An empty table
gives no rows, and extra columns are not read.  A hot conversation is one string of a
letter a row, and one stream in the replay; all else of it is dealt by turns.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, slices

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns of a part of a signature, as a power of two; steps of the recursion's depth.
PART, DEPTH = 9, 100
#: A letter is 4 * role + fault behind "A".
ROLES, FAULTS = "sua", ("none", "truncated", "duplicate", "blank")
NONE, CUT, AGAIN, BLANK = range(4)

# states of (s?(ua)+)?: nothing yet, after s, user's turn over, assistant's turn over
START, SYSTEM, USER, DONE = range(4)
#: The state behind a role (s, u, a), where it is legal; the role that is due.
_NEXT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): DONE, (DONE, 1): USER}
_DUE = (1, 1, 2, 1)
_FAR = sys.maxsize >> 2


def _codes(signature: str) -> bytes:
    return bytes(ord(c) - 65 for c in signature)


def solve(signature: str) -> tuple[int, str]:
    """The least cost of a signature and the least audit of that cost.

    ``best(i, state)`` is what the rows from i on cost; it is remembered in four
    bytes a state, and asked from the end on, so that the recursion stays shallow."""
    rows = _codes(signature)
    n = len(rows)
    known = array("q", [-1]) * (4 * (n + 1))

    def after(i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(letter, cost, row, state) of the edits that use up a row, in ASCII order."""
        if i == n:
            return []
        role, fault = divmod(rows[i], 4)
        out = [("D", DELETE, i + 1, state)]
        if fault in (NONE, CUT):
            more = TRUNCATED if fault == CUT else 0
            if (state, role) in _NEXT:
                out.append(("K", more, i + 1, _NEXT[state, role]))
            out.append(("R", REROLE + more, i + 1, _NEXT[state, _DUE[state]]))
        return out

    def best(i: int, state: int) -> int:
        if known[4 * i + state] < 0:
            # each state's cheapest way on, then up to two inserts around the turns
            ways = [min((c + best(j, s) for _, c, j, s in after(i, x)), default=0 if x in (START, DONE) else _FAR) for x in range(4)]
            for _ in range(3):
                ways = [min(w, INSERT + ways[_NEXT[x, _DUE[x]]]) for x, w in enumerate(ways)]
            for x, w in enumerate(ways):
                known[4 * i + x] = w
        return known[4 * i + state]

    for i in range(n, -1, -DEPTH):
        best(i, START)
    cost, audit, i, state = best(0, START), bytearray(), 0, START
    while not (i == n and state in (START, DONE)):
        left, inserted = best(i, state), ("I", INSERT, i, _NEXT[state, _DUE[state]])
        for letter, c, j, s in sorted([*after(i, state), inserted]):
            if c + best(j, s) == left:
                audit += letter.encode()
                i, state = j, s
                break
    return cost, audit.decode()


def counts(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose roles may not follow."""
    rows = _codes(signature)
    faults = [r & 3 for r in rows]
    roles = [r >> 2 for r in rows]
    legal = {(0, 1), (1, 2), (2, 1)}
    return faults.count(BLANK), faults.count(AGAIN), faults.count(CUT), sum((a, b) not in legal for a, b in zip(roles, roles[1:], strict=False))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows harmed by the checksum of their
    ids; dropped ones have no copies."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _tie(role: Column, text: Column) -> Column:
    """Orders rows of a turn, and is the same for equal rows only."""
    return F.concat(role, F.lit("\0"), F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, signature) of rows with copies; a conversation of dropped
    rows has an empty signature.

    Equal rows of a turn are one row with a number of copies first.  A part holds
    512 turns, or the rows without a turn of like role and digest."""
    role, there = F.substring("role", 1, 1), F.col("copies") > 0
    initial = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    ended = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    fault = F.when(ended == "", BLANK).when(F.substring(ended, -1, 1).isin(".", "!", "?"), NONE).otherwise(CUT)
    when = lambda c: F.when(there, c)
    facts = rows.select("conv_id", when(F.col("turn")).alias("turn"), when(_tie(F.col("role"), F.col("text"))).alias("tie"), when(F.length("role")).alias("n_role"), when(initial).alias("initial"), when(fault).alias("fault"), "copies")
    equal = facts.groupBy("conv_id", "turn", "tie", "n_role", "initial", "fault").agg(F.sum("copies").alias("copies"))
    place = F.row_number().over(Window.partitionBy("conv_id", "tie").orderBy(F.col("turn").asc_nulls_first()))
    letter = lambda f: F.char(F.lit(65) + 4 * F.col("initial") + f)
    again = letter(F.when(F.col("fault") == BLANK, BLANK).otherwise(AGAIN))
    first = F.when(F.col("place") == 1, letter(F.col("fault"))).otherwise(again)
    letters = F.when(F.col("copies") > 0, F.concat(first, F.repeat(again, (F.col("copies") - 1).cast("int")))).otherwise("")
    part = F.struct(F.shiftright("turn", PART).alias("turns"), F.when(F.col("turn").isNull(), F.expr("substring(tie, 1, n_role + 3)")).alias("ties"))
    own = equal.withColumn("place", place).select("conv_id", part.alias("part"), "turn", "tie", letters.alias("letters"))
    row = F.struct("turn", "tie", "letters")
    joined = lambda c, x: F.array_join(F.transform(F.array_sort(c), lambda r: r[x]), "")
    least, most = F.min("turn").alias("least"), F.max("turn").alias("most")
    parts = own.groupBy("conv_id", "part").agg(joined(F.collect_list(row), "letters").alias("letters"), F.size(F.collect_set("turn")).alias("turns"), least, most)
    whole = parts.groupBy("conv_id").agg(joined(F.collect_list(F.struct("part", "letters")), "letters").alias("signature"), F.sum("turns").alias("turns"), F.min("least").alias("least"), F.max("most").alias("most"))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    return whole.select("conv_id", gaps.alias("gaps"), "signature")


_SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def solved(found: DataFrame) -> DataFrame:
    """Each distinct signature with its counts, its cost and its audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(s, *counts(s), *solve(s)) for s in batch.column(0).to_pylist()]
            yield _batch(rows, _SOLVED)

    return found.select("signature").distinct().mapInArrow(run, _SOLVED)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, {"long": pa.int64(), "string": pa.string()}[k]) for c, k in zip(cols, kinds, strict=True)], list(names))


def audits(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of
    conversations with copies."""
    found = durable(signatures(conversations))
    return found.join(solved(found), "signature").drop("signature")


def _replayed(rows: DataFrame, found: DataFrame, columns: list[str], schema: str, run) -> DataFrame:
    """The rows of each conversation behind its audit, as a sorted stream."""
    nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    heads = found.select("conv_id", F.lit(0).alias("kind"), nothing("turn", "long"), nothing("tie", "string"), nothing("role", "string"), nothing("text", "string"), nothing("copies", "int"), *columns)
    kinds = dict(found.dtypes)
    own = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", _tie(F.col("role"), F.col("text")).alias("tie"), "role", "text", "copies", *[nothing(c, kinds[c]) for c in columns])
    stream = heads.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "tie")
    return stream.select("conv_id", "kind", "turn", "role", "text", "copies", *columns).mapInArrow(run, schema)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, list[tuple]]]:
    """(head, []) where a conversation begins and (None, turns that are next in
    the repaired conversation) for each of its rows; what is inserted behind the last
    row comes before the next head.  A turn is (edit, turn, role, text)."""
    audit, at, state = "", 0, START
    initial = {"s": 0, "u": 1, "a": 2}
    name = ("system", "user", "assistant")

    def step(row: dict | None) -> list[tuple]:
        """The turns of the edits up to the one that uses up the row."""
        nonlocal at, state
        out = []
        while at < len(audit):
            edit, due = audit[at], _DUE[state]
            if edit != "I" and row is None:
                raise ValueError("an audit is longer than its conversation")
            at += 1
            if edit == "D":
                return out
            role = initial.get(row["role"][:1]) if edit == "K" else due
            state = _NEXT[state, role]
            out.append((edit, row["turn"] if edit != "I" else None, row["role"] if edit == "K" else name[due], row["text"] if edit != "I" else ""))
            if edit != "I":
                return out
        if row is not None:
            raise ValueError("a conversation is longer than its audit")
        return out

    begun = False
    for batch in slices(batches):
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if begun:
                    yield None, step(None)
                audit, at, state, begun = row["audit"], 0, START, True
                yield row, []
            else:
                for _ in range(row["copies"]):
                    yield None, step(row)
    if begun:
        yield None, step(None)


def repaired(conversations: DataFrame, harm: bool = False) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the repaired conversations' rows
    from place 0 on, as they are or harmed first; inserted rows have no turn."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    whole = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role"), word("text"), F.lit(1).alias("copies"))
    rows = damaged(conversations) if harm else whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, out, size = None, 0, [], 0
        for head, turns in _edits(batches):
            if head:
                conv, place = head["conv_id"], 0
            for edit, turn, role, text in turns:
                out.append((conv, place, edit, turn, role, text))
                place, size = place + 1, size + len(text)
            if len(out) >= 5000 or size > 4_000_000:
                yield _batch(out, schema)
                out, size = [], 0
        if out:
            yield _batch(out, schema)

    schema = "conv_id long, place long, edit string, turn long, role string, text string"
    return _replayed(rows, audits(rows), ["audit"], schema, run)


_FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
DIGEST_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Each conversation's faults after the damage, its audit, and the digest of
    the repaired ``role:text`` lines."""
    rows = damaged(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, some, out = None, hashlib.sha256(), False, []
        for new, turns in _edits(batches):
            if new:
                if head:
                    out.append((*[head[c] for c in ("conv_id", *_FOUND)], digest.hexdigest()))
                head, digest, some = new, hashlib.sha256(), False
                if len(out) >= 5000:
                    yield _batch(out, DIGEST_SCHEMA)
                    out = []
            for _, _, role, text in turns:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                some = True
        if head:
            out.append((*[head[c] for c in ("conv_id", *_FOUND)], digest.hexdigest()))
        if out:
            yield _batch(out, DIGEST_SCHEMA)

    return _replayed(rows, audits(rows), _FOUND, DIGEST_SCHEMA, run)

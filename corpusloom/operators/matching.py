"""Choosing edges in order under caps on how often their ends are used.

The rule is sequential: groups of a scope come one after another; each goes through
its edges in order, again and again with a higher cap, and takes an edge if both ends
are used less often than the cap allows, until its quota is met.  Ends count over all
groups of a scope.

It is followed over some edges of a scope first, a few times as many as are wanted, in
one task.  Then joins hold every edge against the times at which its ends were full: one
that would have been taken was missed, and the rule is followed again with those that
were missed.  Where none was missed, every other edge is refused each time its turn
comes, so the rule takes the same over all edges.  A task sees so many edges as follow
from what is wanted, not those of a scope.

A scope that wants too many for a task is worked off by rounds over all its edges: an
edge is taken as soon as it would be even if every undecided edge before it at its ends
were taken, and put off to the next cap as soon as the edges that are surely taken before
it fill one of its ends.  The first undecided edge of a scope is always decided, and what
does not meet is decided side by side.  Rounds are joins and windows over ends, so a
task sees the edges at one end, never those of a group or scope.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, dropped, kept, scratch

_OPEN, _PUT_OFF, _WON, _TAKEN = range(4)
_EDGE = ["scope", "g", "o", "a", "b"]
_GROUP = ["scope", "g"]
#: Digits of the order that rows of a group are counted by, before they are ranked.
_DIGITS = 3


#: Edges of a scope that one task follows the rule over at most; edges that it begins
#: with, for each that is wanted; wanted edges whose ends are broadcast.
_MOST, _BEGIN, _FEW = 1_000_000, 4, 100_000


def in_order(edges: DataFrame, quotas: DataFrame, caps: Sequence[int], most: int = _MOST) -> DataFrame:
    """(scope, g, o, a, b) of the edges that are taken.

    Groups are taken in the order of ``g``, edges of a group in that of ``o``,
    hexadecimal digests; quotas are (scope, g, quota).  An edge that comes twice is one.
    ``caps`` grow.  An edge whose ends are the same uses it twice.  Scopes of which a
    task would see more than ``most`` edges are worked off by rounds."""
    spark, folder = edges.sparkSession, scratch(edges.sparkSession)
    write = lambda df: kept(df, folder)
    turn = F.row_number().over(Window.partitionBy("scope").orderBy("g")) - 1
    groups = write(quotas.where("quota > 0").select(*_GROUP, F.col("quota").cast("long").alias("room"), turn.alias("turn")))
    edges = write(edges.join(groups, _GROUP).select("scope", "turn", "o", "a", "b", "room"))
    some, parts = write(_first(edges)), []
    while some.take(1):
        large = some.groupBy("scope").count().where(F.col("count") > most).select("scope")
        if large.take(1):
            own = edges.join(large, "scope", "left_semi").distinct().join(groups.select("scope", "turn", "g"), ["scope", "turn"])
            parts.append(_by_rounds(own, caps).join(groups, _GROUP).select("scope", "turn", "o", "a", "b"))
            some = write(some.join(large, "scope", "left_anti"))
            continue
        taken = write(_followed(some, caps))
        missed = write(_missed(edges.join(some.select("scope").distinct(), "scope", "left_semi"), some, taken, caps))
        again = missed.select("scope").distinct()
        parts.append(taken.join(again, "scope", "left_anti").drop("p"))
        some = write(some.join(again, "scope", "left_semi").unionByName(_first(missed)))
    got = cut(_all(parts, edges.drop("room").limit(0)).join(groups, ["scope", "turn"]).select(*_EDGE))
    dropped(spark, folder)
    return got


def _all(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    for df in parts:
        none = none.unionByName(df)
    return none


def _first(edges: DataFrame) -> DataFrame:
    """The first edges of each group, some times as many as it wants: up to the
    stretch of the order in which there are so many."""
    rows = edges.withColumn("stretch", F.conv(F.substring("o", 1, _DIGITS), 16, 10).cast("int"))
    group = ["scope", "turn"]
    counts = rows.groupBy(*group, "stretch").agg(F.count("*").alias("n"), F.first("room").alias("room"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = counts.withColumn("before", before).where(F.col("before") < _BEGIN * F.col("room")).groupBy(*group).agg(F.max("stretch").alias("upto"))
    return rows.join(F.broadcast(upto), group).where("stretch <= upto").drop("stretch", "upto")  # a row for each group


def _followed(edges: DataFrame, caps: Sequence[int]) -> DataFrame:
    """The rule taken literally over a scope's edges: those that are taken, with the
    pass ``p`` (counted over all groups) that takes them."""
    caps = list(caps)

    def follow(own: pd.DataFrame) -> pd.DataFrame:
        used, taken = Counter(), []
        own = own.drop_duplicates().sort_values(["turn", "o", "a", "b"])
        for turn, group in own.groupby("turn"):
            left, todo = int(group.room.iloc[0]), list(zip(group.o, group.a, group.b, strict=True))
            for k, cap in enumerate(caps):
                rest = []
                for o, a, b in todo:
                    if left and used[a] < cap and used[b] < cap:
                        used[a] += 1
                        used[b] += 1
                        left -= 1
                        taken.append((own.scope.iloc[0], turn, o, a, b, turn * len(caps) + k))
                    else:
                        rest.append((o, a, b))
                todo = rest
                if not left:
                    break
        return pd.DataFrame(taken, columns=["scope", "turn", "o", "a", "b", "p"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    return edges.groupBy("scope").applyInPandas(follow, ", ".join(f"{c} {kinds[c]}" for c in ("scope", "turn", "o", "a", "b")) + ", p int")


def _missed(edges: DataFrame, some: DataFrame, taken: DataFrame, caps: Sequence[int]) -> DataFrame:
    """The edges beside ``some`` that are not surely refused each time their turn
    comes, given what was taken: in some pass, before the group had enough, no end was
    full by an edge before."""
    few = taken.count() <= _FEW
    near = F.broadcast if few else (lambda df: df)
    now = F.struct("p", "o")
    # an end is full under a cap from the edge on that uses it as often
    ends = taken.select("scope", F.explode(F.array("a", "b")).alias("v"), now.alias("t")).groupBy("scope", "v").agg(F.sort_array(F.collect_list("t")).alias("t"))
    over = taken.groupBy("scope", "turn").agg(F.count("*").alias("n"), F.max(now).alias("over"))
    rows = edges.join(near(over), ["scope", "turn"], "left").withColumn("over", F.when(F.col("n") >= F.col("room"), F.col("over")))
    for v in ("a", "b"):
        rows = rows.join(near(ends.select("scope", F.col("v").alias(v), F.col("t").alias(f"t_{v}"))), ["scope", v], "left")
    passes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(cap).alias("cap")) for k, cap in enumerate(caps)])

    def is_open(x: Column) -> Column:
        at = F.struct((F.col("turn") * len(caps) + x.k).alias("p"), F.col("o"))
        full = lambda t: F.coalesce(F.get(t, x.cap - 1) < at, F.lit(False))
        return F.coalesce(at <= F.col("over"), F.lit(True)) & ~full("t_a") & ~full("t_b")

    rows = rows.where(F.exists(passes, is_open)).select(*edges.columns)
    key = ["scope", "turn", "o", "a", "b"]
    return rows.join(some.select(*key), key, "left_anti")


def _by_rounds(edges: DataFrame, caps: Sequence[int]) -> DataFrame:
    state = cut(edges.select(*_EDGE, "room", F.lit(0).alias("k"), F.lit(_OPEN).alias("state")))
    while state.where(F.col("state") != _TAKEN).take(1):
        state = cut(_settled(_decided(state, caps), len(caps)))
    return state.select(*_EDGE)


def _decided(state: DataFrame, caps: Sequence[int]) -> DataFrame:
    """Edges that surely are or are not taken under their group's cap."""
    end = lambda c, n: F.struct(F.col(c).alias("v"), F.lit(n).alias("w"))
    ends = state.withColumn("e", F.explode(F.when(F.col("a") == F.col("b"), F.array(end("a", 2))).otherwise(F.array(end("a", 1), end("b", 1)))))
    of = lambda *states: F.when(F.col("state").isin(*states), F.col("e.w")).otherwise(0)
    at, own = Window.partitionBy("scope", "e.v"), Window.partitionBy("scope", "e.v", "g")
    before = lambda w, order, x: F.coalesce(F.sum(x).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = lambda x: before(at, ("g", "o"), x)
    group = lambda x: before(own, ("o",), x)
    unsure, taken = of(_OPEN, _PUT_OFF, _WON), of(_TAKEN)
    # of groups before: what is taken and what might be; of its own: all that is taken
    sure = every(taken) - group(taken) + F.sum(taken).over(own) + group(of(_WON))
    might = every(unsure) - group(unsure) + group(of(_OPEN))
    ends = ends.withColumn("sure", sure).withColumn("most", F.col("sure") + might)
    both = ends.groupBy(*state.columns).agg(F.max("sure").alias("sure"), F.max("most").alias("most"))
    cap = F.array(*map(F.lit, caps))[F.col("k")]
    open_ = F.col("state") == _OPEN
    new = F.when(open_ & (F.col("most") < cap), _WON).when(open_ & (F.col("sure") >= cap), _PUT_OFF).otherwise(F.col("state"))
    return both.select(*_EDGE, "room", "k", new.alias("state"))


def _settled(state: DataFrame, n_caps: int) -> DataFrame:
    """Ends the pass of groups without open edges, or with enough won ones before
    the first open one: the first so many are taken, and the others go or wait for
    the next cap."""
    won, open_ = F.col("state") == _WON, F.col("state") == _OPEN
    rows = state.withColumn("bucket", F.conv(F.substring("o", 1, _DIGITS), 16, 10).cast("int"))
    counts = rows.groupBy(*_GROUP, "bucket").agg(F.count_if(won).alias("n"), F.min(F.when(open_, F.col("bucket"))).alias("first"), F.max(F.when(F.col("state") != _TAKEN, F.col("room"))).alias("left"))
    group = Window.partitionBy(*_GROUP)  # a row for each bucket
    counts = counts.select(*_GROUP, "bucket", "n", F.max("left").over(group).alias("left"), F.min("first").over(group).alias("first"), F.sum("n").over(group).alias("all"), F.coalesce(F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    sure = F.sum(F.when(F.col("bucket") < F.col("first"), F.col("n")).otherwise(0)).over(group)
    counts = counts.select(*_GROUP, "bucket", "before", "all", (F.col("first").isNull() | (sure >= F.col("left"))).alias("over"))
    place = F.col("before") + F.sum(won.cast("int")).over(Window.partitionBy(*_GROUP, "bucket").orderBy("o", "a", "b"))
    rows = rows.join(counts, [*_GROUP, "bucket"]).withColumn("place", place)
    left = F.col("room") - F.least("room", "all")
    ended = F.col("over") & (F.col("state") != _TAKEN)
    taken = ended & won & (F.col("place") <= F.col("room"))
    gone = ended & ~taken & ((left == 0) | (F.col("k") + 1 >= n_caps))
    new = F.when(taken, _TAKEN).when(ended, _OPEN).otherwise(F.col("state"))
    return rows.where(~gone).select(*_EDGE, F.when(ended, left).otherwise(F.col("room")).alias("room"), F.when(ended & ~taken, F.col("k") + 1).otherwise(F.col("k")).alias("k"), new.alias("state"))


def fitting(edges: DataFrame, used: DataFrame, scope: str, order: Sequence) -> DataFrame:
    """The edges (ends ``a`` and ``b``) that fit under their ``cap`` whatever is done
    with those before them: used (scope, v, n) and the edges before it leave room at
    both ends.  Edges with an end that is used up take no room."""
    for c in ("a", "b"):
        edges = edges.join(used.select(scope, F.col("v").alias(c), F.col("n").alias(f"n_{c}")), [scope, c], "left")
    edges = edges.na.fill(0, ["n_a", "n_b"]).where("greatest(n_a, n_b) < cap")
    end = lambda c: F.struct(F.col(c).alias("v"), F.col(f"n_{c}").alias("n"))
    ends = edges.withColumn("e", F.explode(F.array(end("a"), end("b"))))
    place = F.row_number().over(Window.partitionBy(scope, "e.v").orderBy(*order))
    ends = ends.withColumn("over", F.col("e.n") + place > F.col("cap"))
    return ends.groupBy(*edges.columns).agg(F.max("over").alias("over")).where(~F.col("over")).drop("over", "n_a", "n_b")

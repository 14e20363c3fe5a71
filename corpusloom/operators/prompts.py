"""Prompt rows: templates, cycling, partners, messages, validation, quotas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import META_TALK, strip, words
from .lineage import cut
from .ordered import hex_key, placed
from .pairs import shuffled

# Templates of our own.
STORY = "Write a story about {plot} in this style.\n\nSample:\n{sample}\n\nClose with the line THE END."
TUNING = "Write a long story in the manner of {author}, known for {title}."
GENERATION = "Imitate the style of {author} in {title}.\n\nSample:\n{sample}\n\nClose with the line THE END."
TARGET = "Author of the style: {author}\nBook: {title}\n\nWrite a polished short story about {plot} in this style.\nName neither author nor book.\nClose with the line THE END."
PREMISE = "Premise, not to be quoted:\n{plot}\n\nWrite one whole story that grows out of the premise.\nClose with the line THE END."
FEW_SHOT = "Examples of the style:\n{shots}\n\n{prompt}"
JUDGE = "Plot asked for: {plot}\n\nStory:\n{story}\n\nGive one digit from 0 to 9."


def filled(template: str, **values: Column) -> Column:
    """A template with its names filled in."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def asked_plot(prompt: Column) -> Column:
    """The plot of a story prompt: between ``about`` and ``in this style.``"""
    return F.trim(F.regexp_extract(prompt, r"(?s)about (.*?) in this style\.", 1))


def shot_prompt(mode: Column, prompt: Column, shots: Column) -> Column:
    """The prompt as it is, or after its shots."""
    return F.when(mode == "few_shot", filled(FEW_SHOT, shots=shots, prompt=prompt)).otherwise(prompt)


def seeded_places(df: DataFrame, name: str, key: str, group: str, seed: int = 42) -> DataFrame:
    """Keys with their place from 0 in a seeded order of each group."""
    own = df.select(group, key).withColumn("_o", shuffled(seed, key))
    return own.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy("_o", key)) - 1).cast("long")).drop("_o")


def cycle(prompts: DataFrame, chunks: DataFrame, factor: int, by: str) -> DataFrame:
    """(by, i, prompt, text): for each author (the column ``by``) of the chunks, i
    runs below factor times the prompts; prompts (p, prompt) and the author's chunks
    (by, c, text), numbered from 0, are each taken round and round."""
    n = prompts.agg(F.count("*").alias("n_prompts"))
    each = chunks.groupBy(by).agg(F.count("*").alias("n_chunks")).join(F.broadcast(n), how="cross")  # one row of totals
    rows = each.where("n_prompts > 0").select(by, "n_prompts", "n_chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_prompts") * factor - 1)).alias("i"))
    rows = rows.select(by, "i", (F.col("i") % F.col("n_prompts")).alias("p"), (F.col("i") % F.col("n_chunks")).alias("c"))
    return rows.join(prompts, "p").join(chunks, [by, "c"]).select(by, "i", "prompt", "text")


def zipped(left: DataFrame, right: DataFrame, place: str = "i") -> DataFrame:
    """Rows of two tables side by side by their place; what the longer one has
    more is left out."""
    return left.join(right, place)


def repeated(df: DataFrame, factor: int) -> DataFrame:
    """Each row so many times, with its copy's number."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))


def partners(rows: DataFrame, group: str, key: str, seed: int = 7) -> DataFrame:
    """Each row's partner in its group: another row, by a hashed offset.  Rows
    alone in their group have none."""
    own = Window.partitionBy(group)
    placed = rows.select(group, key, (F.row_number().over(own.orderBy(key)) - 1).alias("i"), F.count("*").over(own).alias("n")).where("n > 1")
    jump = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.col("n") - 1)
    aimed = placed.select(group, key, F.pmod(F.col("i") + 1 + jump, F.col("n")).alias("j"))
    return aimed.join(placed.select(group, F.col(key).alias("partner"), F.col("i").alias("j")), [group, "j"]).select(group, key, "partner")


def render_chat(messages: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text): messages in order, each under its role."""
    rows = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "role", "text"))).alias("m"))
    return rows.select(key, F.concat(F.array_join(F.transform("m", lambda m: F.concat(F.lit("[["), m.role, F.lit("]]\n"), m.text, F.lit("\n"))), ""), F.lit("[[end]]")).alias("text"))


def validated(text: Column) -> Column:
    """``ok``, or why an output is refused."""
    own = strip(text)
    return F.when(F.length(own) == 0, "empty").when(own.rlike(META_TALK), "meta").when(~F.endswith(own, F.lit("THE END.")), "no_end").otherwise("ok")


def checked(text: Column) -> Column:
    """``reason`` (as :func:`validated`) and ``n_words`` of an output; a refused
    one has 0 words."""
    reason = validated(text)
    return F.struct(reason.alias("reason"), F.when(reason == "ok", words(strip(text))).otherwise(F.lit(0).cast("long")).alias("n_words"))


def within_quota(candidates: DataFrame, done: DataFrame, quota: int, least: float) -> DataFrame:
    """Candidates (author, arrival, reason, score) that are taken: valid, scored
    high enough, and among the first so many that their author's done rows leave
    room for."""
    have = done.groupBy("author").agg(F.count("*").alias("have"))
    good = candidates.where((F.col("reason") == "ok") & (F.col("score") >= least)).join(have, "author", "left")
    place = F.row_number().over(Window.partitionBy("author").orderBy("arrival"))
    return good.withColumn("place", place).where(F.col("place") <= quota - F.coalesce("have", F.lit(0))).drop("place", "have")


def round_robin(chunks: DataFrame, tasks: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """Each task's chunk and another chunk to compare with: tasks (author, turn)
    take their author's chunks (author, key) in order, round and round; the other one
    is any but the chunk itself, by a hashed offset, or itself where it is alone."""
    own = Window.partitionBy("author")
    placed = chunks.select("author", key, (F.row_number().over(own.orderBy(key)) - 1).alias("i"), F.count("*").over(own).alias("n"))
    sizes = placed.select("author", "n").distinct()
    jump = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "author", F.col("turn").cast("string"))), 1, 8), 16, 10).cast("long"), F.greatest(F.col("n") - 1, F.lit(1)))
    aimed = tasks.join(sizes, "author").withColumn("i", F.col("turn") % F.col("n"))
    aimed = aimed.withColumn("j", F.when(F.col("n") > 1, (F.col("i") + 1 + jump) % F.col("n")).otherwise(F.col("i"))).drop("n")
    first, second = placed.select("author", "i", key), placed.select("author", F.col("i").alias("j"), F.col(key).alias("reference"))
    return aimed.join(first, ["author", "i"]).join(second, ["author", "j"]).drop("i", "j")


def generate(tasks: DataFrame, author_rows: Callable[[DataFrame, int], DataFrame], quota: int, least: float, rounds: int, done: DataFrame) -> DataFrame:
    """Rounds of generation (a caller's function of the tasks whose authors are
    below their quota, and the round), validation, scoring and quota, until the
    rounds end or every author's quota is met.  What a round takes is cut by a
    checkpoint."""
    for n in range(rounds):
        full = done.groupBy("author").count().where(F.col("count") >= quota)
        open_ = tasks.join(full, "author", "left_anti")
        if not open_.take(1):
            break
        taken = within_quota(author_rows(open_, n), done, quota, least)
        done = done.unionByName(cut(taken.select(*done.columns)))
    return done


def until_valid(tasks: DataFrame, ask: Callable[[DataFrame, int], DataFrame], valid: Column, rounds: int) -> DataFrame:
    """Asks again (a caller's function of the open tasks and the round) until an
    answer is valid: (task columns, reply, round).  After the last round, tasks without
    a valid answer have null ones.  For answers that are joins; services are asked by
    :func:`.calls.called`, inside the tasks."""
    keys, out = tasks.columns, None
    for n in range(rounds):
        good = cut(ask(tasks, n).where(valid).withColumn("round", F.lit(n)))
        out = good if out is None else out.unionByName(good)
        tasks = cut(tasks.join(good, keys, "left_anti"))
        if not tasks.take(1):
            break
    return tasks.withColumn("reply", F.lit(None).cast("string")).withColumn("round", F.lit(None).cast("int")).unionByName(out.select(*keys, "reply", "round"))


def dataset(done: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """The first rows up to a number, by arrival, in a seeded order: ``place``."""
    kept = placed(done, "_arrived", F.col("arrival"), "author").where(F.col("_arrived") < most).withColumn("_o", shuffled(seed, "author", "arrival"))
    return placed(kept, "place", hex_key(F.col("_o")), "_o").drop("_o", "_arrived")


def pending(tasks: DataFrame, processed: DataFrame, *keys: str) -> DataFrame:
    """Tasks that no processed row stands for."""
    return tasks.join(processed.select(*keys).distinct(), list(keys), "left_anti")


def training_authors(df: DataFrame) -> DataFrame:
    """Distinct authors of the author columns there are."""
    names = [c for c in ("author", "author1", "author2") if c in df.columns]
    return df.select(F.explode(F.array(*names)).alias("author")).where("author is not null").distinct()


def without_authors(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows of none of the excluded authors; rows without an author stay."""
    return rows.join(excluded, "author", "left_anti")


def step_columns(n: Column, per_device: Column, devices: int, accumulate: int, epochs: int, evaluations: int) -> dict[str, Column]:
    """Batch and step counts of training runs over n rows."""
    one = F.lit(1).cast("long")
    batch = (per_device * devices * accumulate).cast("long")
    steps = F.greatest(one, F.floor(n / batch))
    return {"batch": batch, "steps_per_epoch": steps, "total_steps": steps * epochs, "eval_steps": F.greatest(one, F.floor(steps * epochs / evaluations))}


def step_schedule(n: int, per_device: int, devices: int, accumulate: int, epochs: int, evaluations: int) -> dict[str, int]:
    """The same of one run."""
    batch = per_device * devices * accumulate
    steps = max(1, n // batch)
    return {"batch": batch, "steps_per_epoch": steps, "total_steps": steps * epochs, "eval_steps": max(1, steps * epochs // evaluations)}


def batch_size(context: Column, split: Column) -> Column:
    """Rows encoded at once: many for short contexts, else by the number in a
    split's name (2000 where there is none)."""
    digits = F.regexp_replace(split, "[^0-9]", "")
    size = F.when(F.length(digits) > 0, digits.cast("long")).otherwise(2000)
    return F.when(F.contains(context, F.lit("Short")), 1024).when(size <= 1000, 32).otherwise(16).cast("long")


def with_prefix(model: Column, text: Column) -> Column:
    """The prefix that one model asks for (its name is a fixed value)."""
    return F.when(F.contains(F.lower(model), F.lit("nomic-embed-text-v1.5")), F.concat(F.lit("classification: "), text)).otherwise(text)


def file_name(name: Column) -> Column:
    """A name without slashes and blanks."""
    return F.translate(name, "/ ", "-_")

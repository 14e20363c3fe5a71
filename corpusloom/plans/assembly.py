"""Queries that put training rows together: metadata joins, the generation loop,
embeddings, and what is counted on the way."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import chunks as C
from ..operators import embeddings as E
from ..operators import calls, rewards
from ..operators import prompts as P
from ..operators import reports as R
from ..operators.lineage import scratch
from ..operators.pairs import shuffled
from ..registry import query
from ..sources.io import table
from ..streaming import generation, state
from ..streaming.quota import accepted
from .views import CHUNKS_SQL, chunks

_META = """books AS (SELECT source || '/' || lang AS book_id, CASE WHEN lang = 'de' THEN NULL ELSE source END AS author,
  CASE lang WHEN 'en' THEN ['Poetry', 'Fiction', 'History'] WHEN 'de' THEN ['History', 'Fiction'] WHEN 'fr' THEN ['Poetry'] ELSE NULL END AS subjects FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL)"""


def _books(spark, sf):
    """Books of the documents: of some languages they have no core subject, or
    no subjects at all."""
    some = table(spark, sf, "documents").where("source is not null and lang is not null").select("source", "lang").distinct()
    of = lambda *names: F.array(*map(F.lit, names))
    subjects = F.when(F.col("lang") == "en", of("Poetry", "Fiction", "History")).when(F.col("lang") == "de", of("History", "Fiction")).when(F.col("lang") == "fr", of("Poetry"))
    return some.select(F.concat_ws("/", "source", "lang").alias("book_id"), F.when(F.col("lang") != "de", F.col("source")).alias("author"), subjects.alias("subjects"))


@query(f"""WITH {CHUNKS_SQL}, {_META} SELECT c.doc_id, c.book_id, coalesce(b.author, 'Unknown') AS author_id, list_filter(b.subjects, lambda s: s IN ('Fiction', 'History'))[1] AS subject
FROM chunks c JOIN books b USING (book_id) WHERE len(list_filter(b.subjects, lambda s: s IN ('Fiction', 'History'))) > 0""")
def chunk_metadata_join(spark, sf):
    """Chunks of books without a core subject drop out."""
    return C.with_book_metadata(chunks(spark, sf).select("doc_id", "book_id", "author_id", "subject"), _books(spark, sf), ["Fiction", "History"])


@query("""SELECT doc_id, author, t AS title, 'genre' || substr(author, 4) AS genre FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' || source || chr(10) ELSE source END AS raw FROM documents) d
JOIN (SELECT unnest(['src1', 'src2', ' src3']) AS author, unnest(['One', 'Two', 'Three']) AS t) s ON s.author = raw OR (raw NOT IN ('src1', 'src2', ' src3') AND s.author = regexp_replace(raw, '^\\s+|\\s+\\z', '', 'g'))""")
def author_settings(spark, sf):
    """Configured columns of the chunks' authors; names match as they are, or
    else stripped."""
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "source", F.lit("\n"))).otherwise(F.col("source"))
    own = table(spark, sf, "documents").select("doc_id", raw.alias("author"), F.lit("old").alias("title"))
    settings = spark.createDataFrame([("src1", "One"), ("src2", "Two"), (" src3", "Three")], "author string, title string").withColumn("genre", F.concat(F.lit("genre"), F.substring("author", 4, 9)))
    return C.with_settings(own, settings).select("doc_id", "author", "title", "genre")


@query("SELECT source, lang, min(doc_id) AS \"index\", max(doc_id) AS doc_id, arg_max(coalesce(n_chars, 0), doc_id) AS n_chars FROM documents GROUP BY source, lang")
def keep_last_at_first_place(spark, sf):
    own = table(spark, sf, "documents").select("source", "lang", F.col("doc_id").alias("index"), "doc_id", F.coalesce("n_chars", F.lit(0).cast("long")).alias("n_chars"))
    return C.last_by_text(own, "source", "lang")


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, label FROM chunks WHERE label NOT IN (SELECT 'c' || CAST(2 * item_id AS VARCHAR) FROM benchmark) AND length(regexp_replace(translate(text, '*', ''), '^\\s+|\\s+\\z', '', 'g')) > 0 QUALIFY row_number() OVER (PARTITION BY book_id, regexp_replace(translate(text, '*', ''), '^\\s+|\\s+\\z', '', 'g') ORDER BY doc_id) = 1")
def blacklisted_labels(spark, sf):
    """Originals, without the labels of a blacklist."""
    black = table(spark, sf, "benchmark").select(F.concat(F.lit("c"), (2 * F.col("item_id")).cast("string")).alias("label"))
    return C.originals_and_refilled(chunks(spark, sf).withColumnRenamed("doc_id", "index"), black).where("not is_refilled").select(F.col("index").alias("doc_id"), "label")


@query("SELECT doc_id, coalesce(CASE lang WHEN 'en' THEN 'Poetry' WHEN 'fr' THEN 'Fiction' END, 'none') AS subject FROM documents")
def primary_subjects(spark, sf):
    one = lambda s: F.array(F.lit(s), F.lit("other"))
    subjects = F.when(F.col("lang") == "en", one("Poetry")).when(F.col("lang") == "fr", one("Fiction")).when(F.col("lang") == "de", F.array().cast("array<string>"))
    return table(spark, sf, "documents").select("doc_id", C.primary_subject(subjects, "none").alias("subject"))


@query("SELECT least_, count(*) FILTER (length(text) >= least_) AS n_texts FROM documents, (SELECT CAST(unnest([50, 100, 900, 1000, 2000]) AS BIGINT) AS least_) GROUP BY least_")
def minimum_lengths(spark, sf):
    """Texts that are as long as each step of the work asks for, at least."""
    sizes = [50, 100, 900, 1000, 2000]
    row = table(spark, sf, "documents").agg(*(F.count_if(F.length("text") >= n).alias(f"n{n}") for n in sizes))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("least_"), F.col(f"n{n}").alias("n_texts")) for n in sizes))).alias("x")).select("x.*")


@query("SELECT source, doc_id FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id % 97 = 0 AND source IS NOT NULL) OR source IS NULL")
def without_training_authors(spark, sf):
    own = table(spark, sf, "documents").select(F.col("source").alias("author"), "doc_id")
    return P.without_authors(own, P.training_authors(own.where("doc_id % 97 = 0"))).select(F.col("author").alias("source"), "doc_id")


@query("""WITH l AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark), r AS (SELECT text AS sample, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE lang = 'en')
SELECT i, l.text AS prompt, md5(sample) AS sample_md5 FROM l JOIN r USING (i)""")
def zip_to_the_shortest(spark, sf):
    """Prompts and samples side by side, as far as both go."""
    from ..operators.ordered import placed

    left = placed(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("prompt")), "i", F.col("item_id"))
    right = placed(table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.md5("text").alias("sample_md5")), "i", F.col("doc_id"))
    return P.zipped(left.drop("item_id"), right.drop("doc_id")).select("i", "prompt", "sample_md5")


@query("SELECT count(*) AS n_rows, count(*) FILTER (text IS NULL) AS n_missing, count(*) FILTER (length(text) < 100) AS n_short, count(*) FILTER (lang = 'en' AND length(text) >= 100) AS n_written FROM documents")
def running_counters(spark, sf):
    text = F.col("text")
    return R.counters(table(spark, sf, "documents"), n_missing=text.isNull(), n_short=F.length(text) < 100, n_written=(F.col("lang") == "en") & (F.length(text) >= 100))


@query("SELECT doc_id, CASE WHEN regexp_matches(trim(r), '^[0-9]$') THEN CAST(trim(r) AS INTEGER) / 10.0::DOUBLE END AS reward FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' ' || CAST(doc_id % 10 AS VARCHAR) || ' ' WHEN 1 THEN '10' WHEN 2 THEN 'x' WHEN 3 THEN '' ELSE CAST(doc_id % 10 AS VARCHAR) END AS r FROM documents)")
def judge_digits(spark, sf):
    own = (F.col("doc_id") % 10).cast("string")
    k = F.col("doc_id") % 5
    reply = F.when(k == 0, F.concat(F.lit(" "), own, F.lit(" "))).when(k == 1, "10").when(k == 2, "x").when(k == 3, "").otherwise(own)
    return table(spark, sf, "documents").select("doc_id", scores.digit(reply).alias("reward"))


_HASH = "CAST('0x' || substr(md5({}), 1, 7) AS BIGINT)"


def _hash(*parts):
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 7), 16, 10).cast("long")


@query(f"""WITH a AS (SELECT item_id, r, {_HASH.format("CAST(item_id AS VARCHAR) || ':' || CAST(r AS VARCHAR)")} % 25 AS x FROM benchmark, (SELECT unnest(generate_series(0, 5)) AS r)),
g AS (SELECT item_id, min(r) AS r FROM a WHERE x < 10 GROUP BY item_id)
SELECT b.item_id, CAST(a.x AS VARCHAR) AS reply, CAST(g.r AS INTEGER) AS round FROM benchmark b LEFT JOIN g USING (item_id) LEFT JOIN a ON a.item_id = g.item_id AND a.r = g.r""")
def retry_until_valid(spark, sf):
    """Asks a stub judge again, up to six times, until it answers one digit."""
    return _judged(spark, sf).select("item_id", "reply", F.when(F.col("reply").isNotNull(), F.col("tries") - 1).cast("int").alias("round"))


def _judged(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", F.col("item_id").cast("string").alias("request"))
    return calls.called(items, "request", _stub_judge, lambda reply: len(reply) == 1, 6)


def _stub_judge():
    """Answers some number; on every seventh request of a kind the line is down."""

    async def ask(request: str, n: int) -> str:
        x = int(hashlib.md5(f"{request}:{n}".encode()).hexdigest()[:7], 16)
        if x % 25 == 24:
            raise ConnectionError("no line")
        return str(x % 25)

    return ask


@query(f"""WITH a AS (SELECT item_id, r, {_HASH.format("CAST(item_id AS VARCHAR) || ':' || CAST(r AS VARCHAR)")} % 25 AS x FROM benchmark, (SELECT unnest(generate_series(0, 2)) AS r))
SELECT item_id, CAST(3 AS INTEGER) AS tries, CASE max(x) FILTER (r = 2) WHEN 24 THEN 'ConnectionError: no line' ELSE 'invalid reply' END AS error FROM a GROUP BY item_id HAVING min(x) >= 10""")
def unanswered_requests(spark, sf):
    """Requests that three tries did not answer, with their last error."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("item_id").cast("string").alias("request"))
    return calls.dead_letters(calls.called(items, "request", _stub_judge, lambda reply: len(reply) == 1, 3)).select("item_id", "tries", "error")


@query("""WITH r AS (SELECT source AS prompt, doc_id, round(0.6::DOUBLE * CASE WHEN length(trim(translate(coalesce(text, ''), chr(10) || chr(9) || chr(13), '   '))) = 0 THEN 0 ELSE (length(text) % 100) / 100.0::DOUBLE END + 0.3::DOUBLE * (doc_id % 10) / 10.0::DOUBLE, 9) AS reward FROM documents),
g AS (SELECT prompt, avg(reward) AS m, coalesce(stddev_samp(reward), 0) AS s FROM r GROUP BY prompt)
SELECT doc_id, reward, round(m, 9) AS group_mean, round(s, 9) AS group_std, round((reward - m) / (s + 0.0001::DOUBLE), 6) AS advantage FROM r JOIN g ON g.prompt IS NOT DISTINCT FROM r.prompt""")
def group_rewards(spark, sf):
    """Documents as completions of their source's prompt: a style reward in batches,
    a judge's digit, and how each lies among those of its prompt."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("prompt"), F.col("text").alias("completion"))
    own = rewards.with_rewards(docs, {"style": lambda: lambda prompts, texts, _: [len(t) % 100 / 100 for t in texts]}, 7)
    both = rewards.advantages(own, F.round(0.6 * F.col("style") + 0.3 * (F.col("doc_id") % 10) / 10, 9), "prompt")
    return both.select("doc_id", "reward", F.round("group_mean", 9).alias("group_mean"), F.round("group_std", 9).alias("group_std"), F.round("advantage", 6).alias("advantage"))


@query("SELECT doc_id, source AS author, lang AS title, 'genre ' || source || ' ' || lang AS genre FROM documents WHERE (source, lang) IN (SELECT (source, lang) FROM documents WHERE doc_id % 50 = 0)")
def titled_settings(spark, sf):
    """Chunks of the configured books, with their genre; an author's other books drop
    out."""
    own = table(spark, sf, "documents").select("doc_id", F.col("source").alias("author"), F.col("lang").alias("title"), F.lit("old").alias("genre"))
    settings = own.where("doc_id % 50 = 0").select("author", "title", F.concat_ws(" ", F.lit("genre"), "author", "title").alias("genre"))
    return C.with_titled_settings(own, settings).select("doc_id", "author", "title", "genre")


@query("""SELECT item_id, 'Author of the style: A' || chr(10) || 'Book: T' || chr(10) || chr(10) || 'Write a polished short story about ' || text || ' in this style.' || chr(10) || 'Name neither author nor book.' || chr(10) || 'Close with the line THE END.' AS target,
  'Premise, not to be quoted:' || chr(10) || text || chr(10) || chr(10) || 'Write one whole story that grows out of the premise.' || chr(10) || 'Close with the line THE END.' AS premise, trim(text) AS asked FROM benchmark""")
def target_prompts(spark, sf):
    """The templates for an author's style and for a dataset, and the plot that the
    first one asks for."""
    own = table(spark, sf, "benchmark").select("item_id", P.filled(P.TARGET, author=F.lit("A"), title=F.lit("T"), plot=F.col("text")).alias("target"), P.filled(P.PREMISE, plot=F.col("text")).alias("premise"))
    return own.withColumn("asked", P.asked_plot(F.col("target")))


@query("SELECT DISTINCT p_type AS task FROM part")
def resumed_stream(spark, sf):
    """Tasks of a stream that is stopped and started again, and whose first batch is
    replayed: each is finished once."""
    folder = scratch(spark)
    own = table(spark, sf, "part").select(F.col("p_type").alias("task"), "p_size")
    start = lambda: state.resumed(spark.readStream.schema("task string, p_size int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), lambda df: df, f"{folder}/out", f"{folder}/state", f"{folder}/log", "task", compact_every=3).awaitTermination()
    for part in range(3):
        own.where(F.col("p_size") % 3 == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        start()
    state.save(own.limit(0), 0, f"{folder}/state", "task")  # a batch that the base holds is left alone
    return state.written(spark, f"{folder}/out").select("task")


def _with_checkpoints(spark, work):
    """Work that cuts its lineage: the session needs a checkpoint folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark))
    return work()


#: Quota of an author, candidates of an author in a round, rounds.
QUOTA, EACH, ROUNDS = 6, 4, 5
_LOOP = f"""authors AS (SELECT DISTINCT source AS author FROM documents WHERE source IS NOT NULL),
turns AS (SELECT author, CAST(unnest(generate_series(0, {EACH * ROUNDS - 1})) AS BIGINT) AS turn FROM authors),
made AS (SELECT *, {_HASH.format("author || ':' || CAST(turn AS VARCHAR)")} AS h FROM turns),
have AS (SELECT source AS author, count(*) AS have FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source),
good AS (SELECT author, turn AS arrival, (h % 1000) / 1000.0::DOUBLE AS score, 500 + h % 900 AS n_words, row_number() OVER (PARTITION BY author ORDER BY turn) AS k FROM made WHERE h % 5 <> 0 AND (h % 1000) / 1000.0::DOUBLE >= 0.4697::DOUBLE),
taken AS (SELECT g.author, arrival, score, n_words FROM good g LEFT JOIN have USING (author) WHERE k <= {QUOTA} - coalesce(have, 0))"""


def _generated(spark, sf):
    """The loop with a stub generator: an author below the quota gets some
    candidates a round; every fifth is refused."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("author"))
    authors = docs.where("author is not null").select("author").distinct()
    before = docs.join(table(spark, sf, "labels").where("toxic = 1"), "doc_id").select("author", F.lit(-1).cast("long").alias("arrival"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"))

    def produce(tasks, n):
        turns = tasks.withColumn("arrival", F.explode(F.sequence(F.lit(n * EACH).cast("long"), F.lit(n * EACH + EACH - 1).cast("long"))))
        made = turns.withColumn("h", _hash("author", F.col("arrival").cast("string")))
        text = F.when(F.col("h") % 5 == 0, "As an AI, no").otherwise(F.concat(F.repeat(F.lit("word "), (498 + F.col("h") % 900).cast("int")), F.lit("THE END.")))
        own = made.withColumn("c", P.checked(text))
        return own.select("author", "arrival", "c.reason", ((F.col("h") % 1000) / 1000.0).alias("score"), "c.n_words")

    return _with_checkpoints(spark, lambda: P.generate(authors, produce, QUOTA, 0.4697, ROUNDS, before).where("arrival >= 0"))


@query(f"WITH {_LOOP} SELECT author, arrival, score, n_words FROM taken")
def generation_loop(spark, sf):
    return _generated(spark, sf)


@query(f"""WITH {_LOOP.replace("k <= " + str(QUOTA) + " - coalesce(have, 0)", "k <= " + str(QUOTA))} SELECT author, arrival, score FROM taken""")
def streamed_generation(spark, sf):
    """The loop as a stream of tasks, a round a file, stopped after two rounds and
    started again: the stub writer's line is down now and then, and every fifth story is
    refused."""
    folder = scratch(spark)
    authors = table(spark, sf, "documents").where("source is not null").select(F.col("source").alias("author")).distinct()
    schema = "author string, arrival long, request string"
    tasks = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for n in range(ROUNDS):
        turns = authors.withColumn("arrival", F.explode(F.sequence(F.lit(n * EACH).cast("long"), F.lit(n * EACH + EACH - 1).cast("long"))))
        turns.withColumn("request", F.concat_ws(":", "author", F.col("arrival").cast("string"))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if n in (1, ROUNDS - 1):
            generation.generated(tasks(), _stub_writer, _stub_critic, lambda reply: reply[:2] == "0.", f"{folder}/out", f"{folder}/log", QUOTA, 0.4697, tries=4).awaitTermination()
    return accepted(spark, f"{folder}/out", "author string, arrival long, text string, score double").select("author", "arrival", "score")


def _number(request: str) -> int:
    return int(hashlib.md5(request.encode()).hexdigest()[:7], 16)


def _stub_writer():
    async def ask(request: str, n: int) -> str:
        h = _number(request)
        if n < h % 3:
            raise ConnectionError("no line")
        return "As an AI, no" if h % 5 == 0 else f"A story of {h} words.\nTHE END."

    return ask


def _stub_critic():
    """Answers nonsense first, then the score of the request."""

    async def ask(request: str, n: int) -> str:
        return f"{_number(request.partition(chr(10))[0]) % 1000 / 1000:.3f}" if n else "what?"

    return ask


@query(f"WITH {_LOOP}, kept AS (SELECT *, row_number() OVER (ORDER BY arrival, author) AS n FROM taken), o AS (SELECT *, md5('42:' || author || ':' || CAST(arrival AS VARCHAR)) AS o FROM kept WHERE n <= 50) SELECT author, arrival, score, n_words, row_number() OVER (ORDER BY o) - 1 AS place FROM o")
def generated_dataset(spark, sf):
    """The first fifty rows that arrived, shuffled."""
    return P.dataset(_generated(spark, sf), 50)


@query(f"WITH {_LOOP} SELECT count(*) AS n_rows, coalesce(round(avg(score), 9), 0.0::DOUBLE) AS mean_score, coalesce(round(avg(n_words), 9), 0.0::DOUBLE) AS mean_words FROM taken")
def generated_means(spark, sf):
    return R.dataset_means(_generated(spark, sf))


@query("SELECT count(*) AS n_rows, coalesce(avg(n_chars), 0.0::DOUBLE) AS mean_score, 0.0::DOUBLE AS mean_words FROM documents WHERE length(text) < 0")
def means_of_nothing(spark, sf):
    """Means over the documents that are shorter than nothing."""
    none = table(spark, sf, "documents").where(F.length("text") < 0)
    return R.dataset_means(none.select(F.col("n_chars").cast("double").alias("score"), F.col("n_chars").alias("n_words")))


@query(f"""WITH {CHUNKS_SQL}, o AS (SELECT author_id AS author, doc_id, row_number() OVER (PARTITION BY author_id ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY author_id) AS n FROM chunks),
t AS (SELECT author, CAST(unnest(generate_series(0, 99)) AS BIGINT) AS turn FROM (SELECT DISTINCT author FROM o)),
a AS (SELECT t.author, turn, turn % n AS i, CASE WHEN n > 1 THEN (turn % n + 1 + {_HASH.format("'7:' || t.author || ':' || CAST(turn AS VARCHAR)").replace("1, 7", "1, 8")} % greatest(n - 1, 1)) % n ELSE turn % n END AS j FROM t JOIN (SELECT DISTINCT author, n FROM o) USING (author))
SELECT a.author, a.turn, x.doc_id, y.doc_id AS reference FROM a JOIN o x ON x.author = a.author AND x.i = a.i JOIN o y ON y.author = a.author AND y.i = a.j""")
def round_robin_chunks(spark, sf):
    """A hundred turns of each author over the author's chunks."""
    own = chunks(spark, sf).select(F.col("author_id").alias("author"), "doc_id")
    turns = own.select("author").distinct().withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))))
    return P.round_robin(own, turns, "doc_id")


_VECTORS = f"""texts AS (SELECT DISTINCT md5(coalesce(text, '')) AS key, coalesce(text, '') AS text FROM documents),
words AS (SELECT key, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS w FROM texts),
counts AS (SELECT key, {_HASH.format("w")} % 16 AS k, count(*) AS n FROM words GROUP BY ALL),
vectors AS (SELECT key, k, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS x FROM counts)"""


@query(f"WITH {_VECTORS} SELECT doc_id, CAST(k AS INTEGER) AS k, round(x, 9) AS x FROM documents d JOIN vectors v ON v.key = md5(coalesce(d.text, ''))")
def text_embeddings(spark, sf):
    """Distinct texts encoded once by the stub encoder; components above 0."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    own = E.with_embeddings(docs, E.encoded(docs, E.hashed_words))
    return own.select("doc_id", F.posexplode("embedding").alias("k", "x")).where("x > 0").withColumn("x", F.round("x", 9))


@query(f"""WITH {_VECTORS}, p AS (SELECT a.doc_id, md5(coalesce(a.text, '')) AS t, md5(coalesce(b.text, '')) AS r FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, CASE WHEN min(z) > 0 THEN round(sum(c), 9) END AS score FROM (
  SELECT p.doc_id, v.x * w.x AS c, 1 AS z FROM p JOIN vectors v ON v.key = t JOIN vectors w ON w.key = r AND w.k = v.k
  UNION ALL SELECT doc_id, 0.0, CAST(t IN (SELECT key FROM vectors) AND r IN (SELECT key FROM vectors) AS INTEGER) FROM p) GROUP BY doc_id""")
def reference_scores(spark, sf):
    """Each document's cosine to the next one, by the stub encoder."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("reference")), "doc_id")
    return E.scored(pairs, E.hashed_words).select("doc_id", F.round("score", 9).alias("score"))


#: Workers that documents are encoded by.
WORKERS = 16


@query("SELECT doc_id AS id, len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) AS n FROM documents")
def fanned_out_tasks(spark, sf):
    """Documents dealt to workers by their length; each worker encodes its own with
    the stub encoder, once loaded, and returns the words that it saw."""
    own = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def work(part):
        part["n"] = [int(v.sum()) for v in E.hashed_words()(part.text.tolist())] if len(part) else []
        return part[["id", "n"]]

    return E.fan_out(own, WORKERS, work, "id long, n long", F.length("text"), ("id",))


@query(f"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cost FROM documents), p AS (SELECT *, (row_number() OVER (ORDER BY cost DESC, doc_id) - 1) % {2 * WORKERS} AS t FROM d),
w AS (SELECT CAST(least(t, {2 * WORKERS - 1} - t) AS INTEGER) AS worker, count(*) AS n_tasks, CAST(sum(cost) AS BIGINT) AS cost FROM p GROUP BY 1)
SELECT worker, n_tasks, cost, cost <= 1.3::DOUBLE * avg(cost) OVER () AS even FROM w""")
def dealt_costs(spark, sf):
    """What each worker has to do, and whether it is within 1.3 of the mean."""
    own = table(spark, sf, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("cost"))
    sums = E.dealt(own, WORKERS, F.col("cost"), "doc_id").groupBy("worker").agg(F.count("*").alias("n_tasks"), F.sum("cost").alias("cost"))
    return sums.withColumn("even", F.col("cost") <= 1.3 * F.avg("cost").over(Window.partitionBy()))  # a row for each worker


@query("""SELECT item_id, 'Write a long story in the manner of A, known for T.' AS tuning, 'Imitate the style of A in T.' || chr(10) || chr(10) || 'Sample:' || chr(10) || text || chr(10) || chr(10) || 'Close with the line THE END.' AS generation,
  'Plot asked for: ' || text || chr(10) || chr(10) || 'Story:' || chr(10) || 'A story.' || chr(10) || chr(10) || 'Give one digit from 0 to 9.' AS judge FROM benchmark""")
def prompt_templates(spark, sf):
    """The templates for tuning, generation and judging."""
    a, t, text = F.lit("A"), F.lit("T"), F.col("text")
    return table(spark, sf, "benchmark").select("item_id", P.filled(P.TUNING, author=a, title=t).alias("tuning"), P.filled(P.GENERATION, author=a, title=t, sample=text).alias("generation"), P.filled(P.JUDGE, plot=text, story=F.lit("A story.")).alias("judge"))


@query("""SELECT item_id, plot FROM (SELECT item_id, p.plot, row_number() OVER (PARTITION BY item_id ORDER BY md5('3:' || CAST(item_id AS VARCHAR) || ':' || p.plot)) AS n FROM benchmark, (SELECT unnest(['a war', 'a feast', 'a voyage']) AS plot) p) WHERE n = 1""")
def random_plots(spark, sf):
    """One of some plots for each row, drawn by hash."""
    plots = F.array(*map(F.lit, ["a war", "a feast", "a voyage"]))
    own = table(spark, sf, "benchmark").select("item_id", F.explode(plots).alias("plot"))
    return own.groupBy("item_id").agg(F.min_by("plot", shuffled(3, "item_id", "plot")).alias("plot"))


@query("""WITH j AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'THE END.' || chr(10) ELSE '' END AS text FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ok' WHEN length(regexp_replace(text, '^\\s+|\\s+\\z', '', 'g')) = 0 THEN 'empty' WHEN ends_with(regexp_replace(text, '\\s+\\z', ''), 'THE END.') THEN 'ok' ELSE 'no_end' END AS reason,
  CASE WHEN doc_id % 2 = 0 THEN len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) ELSE 0 END AS n_words FROM j""")
def checked_outputs(spark, sf):
    """Why outputs are refused, and the words of those that are not."""
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "\nTHE END.\n").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", P.checked(text).alias("c")).select("doc_id", "c.reason", "c.n_words")


@query("SELECT CAST(p_partkey AS BIGINT) AS n, p_size AS per_device, p_size * 2 * 2 AS batch, greatest(1, p_partkey // (p_size * 4)) AS steps_per_epoch, greatest(1, p_partkey // (p_size * 4)) * 3 AS total_steps, greatest(1, greatest(1, p_partkey // (p_size * 4)) * 3 // 10) AS eval_steps FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def step_schedules(spark, sf):
    """Batches and steps of training runs of many sizes."""
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.col("p_size").cast("long").alias("per_device"))
    return own.select("n", "per_device", *(c.alias(k) for k, c in P.step_columns(F.col("n"), F.col("per_device"), 2, 2, 3, 10).items()))

"""Prompt and quality-gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prompts as ops
from ..operators.lineage import cut
from ..operators.splits import prompt_split as split_prompts
from ..registry import query
from ..sources.io import table
from .reporting import _STORY, stories
from .views import CHUNKS_SQL, chunks

_SPLIT = """ranked AS (SELECT prompt, row_number() OVER (ORDER BY md5('42:' || prompt), prompt) - 1 AS place FROM (SELECT DISTINCT text AS prompt FROM benchmark)),
split AS (SELECT prompt, place, CASE WHEN place < floor((SELECT count(*) FROM ranked) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM ranked)"""
_CYCLE = f"""WITH {CHUNKS_SQL}, {_SPLIT}, p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY place) - 1 AS p FROM split),
c AS (SELECT author_id, text, row_number() OVER (PARTITION BY author_id ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS c, count(*) OVER (PARTITION BY author_id) AS n_chunks FROM chunks WHERE length(text) >= 900),
n AS (SELECT split, count(*) AS n, count(*) * CASE split WHEN 'train' THEN 4 ELSE 10 END AS total FROM p GROUP BY split),
i AS (SELECT split, n, unnest(generate_series(0, total - 1)) AS i FROM n)
SELECT i.split, c.author_id, i.i, prompt, md5(text) AS text_md5 FROM i JOIN p ON p.split = i.split AND p.p = i.i % i.n JOIN c ON c.c = i.i % c.n_chunks"""


def _prompts(spark, sf):
    return split_prompts(table(spark, sf, "benchmark").select(F.col("text").alias("prompt")))


@query(f"WITH {_SPLIT} SELECT prompt, place, split FROM split")
def prompt_split_80_20(spark, sf):
    return _prompts(spark, sf)


@query(_CYCLE)
def prompt_cycle(spark, sf):
    """Every author's prompts with the author's own chunks (of 900 characters at
    least)."""
    own = chunks(spark, sf).where("length(text) >= 900")
    texts = ops.seeded_places(own, "c", "doc_id", "author_id").join(own.select("doc_id", F.md5("text").alias("text")), "doc_id").select("author_id", "c", "text")
    prompts, out = cut(_prompts(spark, sf)), []
    first = prompts.groupBy("split").agg(F.min("place").alias("first"))  # two rows
    prompts = prompts.join(F.broadcast(first), "split").withColumn("p", F.col("place") - F.col("first"))
    for split, factor in (("train", 4), ("test", 10)):
        one = prompts.where(F.col("split") == split).select("p", "prompt")
        out.append(ops.cycle(one, texts, factor, "author_id").select(F.lit(split).alias("split"), "author_id", "i", "prompt", F.col("text").alias("text_md5")))
    return out[0].unionByName(out[1])


@query(f"""WITH {CHUNKS_SQL}, o AS (SELECT author_id, doc_id, row_number() OVER (PARTITION BY author_id ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY author_id) AS n FROM chunks),
a AS (SELECT *, (i + 1 + CAST('0x' || substr(md5('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % (n - 1)) % n AS j FROM o WHERE n > 1)
SELECT a.author_id, a.doc_id, o.doc_id AS partner FROM a JOIN o ON o.author_id = a.author_id AND o.i = a.j""")
def round_robin_partner(spark, sf):
    return ops.partners(chunks(spark, sf), "author_id", "doc_id")


@query("SELECT item_id, copy, text FROM benchmark, (SELECT CAST(unnest(generate_series(0, 3)) AS INTEGER) AS copy)")
def repeated_targets(spark, sf):
    return ops.repeated(table(spark, sf, "benchmark").select("item_id", "text"), 4)


@query("SELECT conv_id, string_agg('[[' || role || ']]' || chr(10) || text || chr(10), '' ORDER BY turn) || '[[end]]' AS text FROM conversations GROUP BY conv_id")
def chat_template(spark, sf):
    return ops.render_chat(table(spark, sf, "conversations"), "conv_id", "turn")


_OUT = f"""{_STORY}, outs AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '  ' WHEN doc_id % 11 = 0 THEN 'As an ai, ' || text ELSE text END AS text FROM stories),
judged AS (SELECT doc_id, text, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN regexp_matches(text, '(?i)\\b(I am an AI assistant|As an AI|I specialize in)\\b') THEN 'meta' WHEN NOT ends_with(regexp_replace(text, '\\s+\\z', ''), 'THE END.') THEN 'no_end' ELSE 'ok' END AS reason FROM outs)"""


def _outputs(spark, sf):
    text = F.when(F.col("doc_id") % 9 == 0, "  ").when(F.col("doc_id") % 11 == 0, F.concat(F.lit("As an ai, "), "text")).otherwise(F.col("text"))
    return stories(spark, sf).select("doc_id", text.alias("text")).withColumn("reason", ops.validated(F.col("text")))


@query(f"WITH {_OUT} SELECT doc_id, reason FROM judged")
def validate_outputs(spark, sf):
    return _outputs(spark, sf).select("doc_id", "reason")


@query(f"""WITH {_OUT}, c AS (SELECT j.doc_id, d.source AS author, 0.3::DOUBLE + (doc_id % 70) / 100.0::DOUBLE AS score FROM judged j JOIN documents d USING (doc_id) WHERE reason = 'ok'),
have AS (SELECT source AS author, count(*) AS have FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source),
r AS (SELECT c.*, row_number() OVER (PARTITION BY author ORDER BY doc_id) AS place FROM c WHERE score >= 0.4697::DOUBLE)
SELECT author, doc_id FROM r LEFT JOIN have USING (author) WHERE place <= 6 - coalesce(have, 0)""")
def quota_gate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("author"))
    done = docs.join(table(spark, sf, "labels").where("toxic = 1"), "doc_id")
    own = _outputs(spark, sf).join(docs, "doc_id").select("author", F.col("doc_id").alias("arrival"), "reason", (0.3 + (F.col("doc_id") % 70) / 100.0).alias("score"))
    return ops.within_quota(own, done, 6, 0.4697).select("author", F.col("arrival").alias("doc_id"))


@query("""WITH t AS (SELECT DISTINCT o_orderstatus AS family, o_orderpriority AS status FROM orders), d AS (SELECT DISTINCT o_orderstatus AS family, o_orderpriority AS status FROM orders WHERE o_totalprice > 499000)
SELECT family, status FROM t ANTI JOIN d USING (family, status)""")
def resume_pending_tasks(spark, sf):
    own = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("family"), F.col("o_orderpriority").alias("status"), "o_totalprice")
    return ops.pending(own.select("family", "status").distinct(), own.where("o_totalprice > 499000"), "family", "status")


@query("SELECT DISTINCT c_name AS author FROM (SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' UNION ALL SELECT n_name FROM nation)")
def excluded_authors(spark, sf):
    own = table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_name").alias("author1"), F.lit(None).cast("string").alias("author2"))
    return ops.training_authors(own.unionByName(table(spark, sf, "nation").select(F.lit(None).cast("string").alias("author1"), F.col("n_name").alias("author2"))))


@query("SELECT item_id, 'Write a story about ' || text || ' in this style.' || chr(10) || chr(10) || 'Sample:' || chr(10) || 's' || CAST(item_id AS VARCHAR) || chr(10) || chr(10) || 'Close with the line THE END.' AS prompt, trim(text) AS plot FROM benchmark")
def story_prompts(spark, sf):
    own = table(spark, sf, "benchmark")
    prompt = ops.filled(ops.STORY, plot=F.col("text"), sample=F.concat(F.lit("s"), F.col("item_id").cast("string")))
    return own.select("item_id", prompt.alias("prompt")).withColumn("plot", ops.asked_plot(F.col("prompt")))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Examples of the style:' || chr(10) || 'shot' || chr(10) || chr(10) || text ELSE text END AS prompt FROM benchmark")
def shot_prompts(spark, sf):
    mode = F.when(F.col("item_id") % 2 == 0, "few_shot").otherwise("zero_shot")
    return table(spark, sf, "benchmark").select("item_id", ops.shot_prompt(mode, F.col("text"), F.lit("shot")).alias("prompt"))


@query("""SELECT p_partkey AS id, translate(p_name || '/' || p_type, '/ ', '-_') AS file, CASE WHEN p_type = 'SMALL' THEN 1024 WHEN p_size * 50 <= 1000 THEN 32 ELSE 16 END::BIGINT AS batch,
  CASE WHEN p_size % 2 = 0 THEN 'classification: ' || p_name ELSE p_name END AS text FROM part""")
def model_dependent_columns(spark, sf):
    context = F.when(F.col("p_type") == "SMALL", "Short").otherwise("Long")
    model = F.when(F.col("p_size") % 2 == 0, "x/Nomic-Embed-Text-v1.5").otherwise("other")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), ops.file_name(F.concat_ws("/", "p_name", "p_type")).alias("file"),
        ops.batch_size(context, F.concat(F.lit("size"), (F.col("p_size") * 50).cast("string"))).alias("batch"), ops.with_prefix(model, F.col("p_name")).alias("text"),
    )

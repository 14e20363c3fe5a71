"""Report and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import reports as ops
from ..registry import query
from ..sources.io import table
from .views import RESULTS_SQL, results

_STATS = "count(*) AS comparisons, round(avg(score), 4) AS mean, round(stddev_samp(score), 4) AS std, round(quantile_cont(score, 0.5), 4) AS median, round(min(score), 4) AS min, round(max(score), 4) AS max, round(quantile_cont(score, 0.25), 4) AS q25, round(quantile_cont(score, 0.75), 4) AS q75"


@query(f"WITH {RESULTS_SQL} SELECT model, split, status, pair_type, {_STATS} FROM results GROUP BY ALL")
def similarity_overall(spark, sf):
    return ops.overall(results(spark, sf))


@query(f"WITH {RESULTS_SQL} SELECT * EXCLUDE (min, max) FROM (SELECT model, split, status, pair_type, subject, {_STATS} FROM results GROUP BY ALL) WHERE comparisons >= 2")
def similarity_by_subject(spark, sf):
    return ops.by_subject(results(spark, sf))


@query(f"WITH {RESULTS_SQL} SELECT model, status, pair_type, {', '.join(f'round(quantile_cont(score, {p}), 6) AS {n}' for p, n in ((0.05, 'low'), (0.25, 'q25'), (0.5, 'median'), (0.75, 'q75'), (0.95, 'high')))}, round(greatest(0.0::DOUBLE, min(score) - 0.08::DOUBLE), 6) AS axis_low FROM results GROUP BY ALL")
def box_summary(spark, sf):
    return ops.box(results(spark, sf))


_PAIRS = """pairs AS (SELECT a.vec_id AS id1, b.vec_id AS id2, a.label AS l1, b.label AS l2, a.embedding AS v1, b.embedding AS v2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
scored AS (SELECT *, list_dot_product(v1::DOUBLE[], v2::DOUBLE[]) / sqrt(list_dot_product(v1::DOUBLE[], v1::DOUBLE[]) * list_dot_product(v2::DOUBLE[], v2::DOUBLE[])) AS c FROM pairs)"""


def _pairs(spark, sf):
    """Each vector beside the next one."""
    own = table(spark, sf, "embeddings")
    a = own.select(F.col("vec_id").alias("id1"), F.col("label").alias("l1"), F.col("embedding").alias("v1"))
    b = own.select((F.col("vec_id") - 1).alias("id1"), F.col("vec_id").alias("id2"), F.col("label").alias("l2"), F.col("embedding").alias("v2"))
    return a.join(b, "id1").withColumn("c", scores.cosine(F.col("v1"), F.col("v2")))


@query(f"WITH {_PAIRS} SELECT id1, id2, round(c, 9) AS cosine, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (c - 0.0597::DOUBLE) / (0.8192::DOUBLE - 0.0597::DOUBLE))), 9) AS scaled FROM scored")
def cosine_pairs(spark, sf):
    return _pairs(spark, sf).select("id1", "id2", F.round("c", 9).alias("cosine"), F.round(scores.rescale(F.col("c")), 9).alias("scaled"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 9) AS norm, k, round(embedding[k + 1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS x FROM embeddings, (SELECT CAST(unnest(generate_series(0, 63)) AS INTEGER) AS k)")
def normalised_vectors(spark, sf):
    own = table(spark, sf, "embeddings").select("vec_id", scores.normalised(F.col("embedding")).alias("v"))
    return own.select("vec_id", F.round(scores.dot(F.col("v"), F.col("v")), 9).alias("norm"), F.posexplode("v").alias("k", "x")).withColumn("x", F.round("x", 9))


_EVAL = "evals AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, 'Author_' || CAST(user_id % 4 AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN '' ELSE '_test' END AS split, CASE event_type WHEN 'click' THEN 'few_shot' WHEN 'view' THEN 'zero_shot' ELSE event_type END AS shot_mode, value / 100.0::DOUBLE AS raw FROM events)"


@query(f"WITH {_EVAL}, s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (raw - 0.0597::DOUBLE) / (0.8192::DOUBLE - 0.0597::DOUBLE))) AS scaled FROM evals) SELECT shot_mode, model, split, replace(split, '_test', '') AS author, round(avg(raw), 6) AS mean_raw, round(stddev_pop(raw), 6) AS std_raw, round(avg(scaled), 6) AS mean_scaled, round(stddev_pop(scaled), 6) AS std_scaled FROM s WHERE shot_mode IN ('zero_shot', 'few_shot') GROUP BY ALL")
def eval_summary(spark, sf):
    rows = table(spark, sf, "events").select(
        F.when(F.col("user_id") % 2 == 0, "m1").otherwise("m2").alias("model"), F.concat(F.lit("Author_"), (F.col("user_id") % 4).cast("string"), F.when(F.col("event_id") % 3 == 0, "").otherwise("_test")).alias("split"),
        F.when(F.col("event_type") == "click", "few_shot").when(F.col("event_type") == "view", "zero_shot").otherwise(F.col("event_type")).alias("shot_mode"), (F.col("value") / 100.0).alias("raw"),
    )
    return ops.evaluation_summary(rows.withColumn("scaled", scores.rescale(F.col("raw"))))


_RANK = "SELECT {0}, {0}_n, sum({0}_n) OVER (ORDER BY {0}) - ({0}_n - 1) / 2.0::DOUBLE AS r FROM (SELECT {0}, count(*) AS {0}_n FROM x GROUP BY {0})"


@query(f"WITH x AS (SELECT value AS a, round(l_quantity) AS b FROM events JOIN lineitem ON l_orderkey = event_id), ra AS ({_RANK.format('a')}), rb AS ({_RANK.format('b')}) SELECT count(*) AS n, round(corr(ra.r, rb.r), 9) AS spearman FROM x JOIN ra USING (a) JOIN rb USING (b)")
def spearman(spark, sf):
    both = table(spark, sf, "events").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("event_id"))
    return ops.spearman(both.select(F.col("value").alias("a"), F.round("l_quantity").alias("b")), "a", "b")


_STORY = """stories AS (SELECT doc_id, coalesce(text, '') || repeat(' word', CAST(doc_id % 1900 AS INTEGER)) || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'THE END.' WHEN 1 THEN ' The end!! ' WHEN 2 THEN 'THEEND' ELSE '' END || CASE doc_id % 5 WHEN 0 THEN chr(10) || chr(10) WHEN 1 THEN chr(9) || ' ' || chr(10) ELSE '' END AS text FROM documents),
counted AS (SELECT *, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS BIGINT) AS n FROM stories),
rewarded AS (SELECT *, CASE WHEN regexp_matches(regexp_replace(text, '\\s+\\z', ''), '(?i)THE\\s?END[.!]*\\z') THEN CASE WHEN length(trim(text)) = 0 OR n < 500 THEN 0.0::DOUBLE WHEN n < 1200 THEN n / 1200.0::DOUBLE WHEN n <= 1600 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - sqrt(greatest(n - 1600, 0) / 1500.0::DOUBLE)) END ELSE 0.0::DOUBLE END AS reward FROM counted)"""


def stories(spark, sf):
    """Documents padded to various lengths, with various ends."""
    from ..functions import text as T

    end = F.when(F.col("doc_id") % 4 == 0, "\nTHE END.").when(F.col("doc_id") % 4 == 1, " The end!! ").when(F.col("doc_id") % 4 == 2, "THEEND").otherwise("")
    after = F.when(F.col("doc_id") % 5 == 0, "\n\n").when(F.col("doc_id") % 5 == 1, "\t \n").otherwise("")
    own = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit(" word"), (F.col("doc_id") % 1900).cast("int")), end, after).alias("text"))
    return own.withColumn("n", T.words(F.col("text"))).withColumn("reward", scores.completeness(F.col("n"), F.col("text")))


@query(f"WITH {_STORY} SELECT doc_id, n AS n_words, round(reward, 9) AS reward FROM rewarded")
def completeness_reward(spark, sf):
    return stories(spark, sf).select("doc_id", F.col("n").alias("n_words"), F.round("reward", 9).alias("reward"))


@query(f"WITH {_STORY} SELECT doc_id, round(0.6::DOUBLE * ((doc_id % 11) / 10.0::DOUBLE) + 0.3::DOUBLE * ((doc_id % 10) / 10.0::DOUBLE) + 0.1::DOUBLE * reward, 9) AS reward FROM rewarded")
def weighted_reward(spark, sf):
    return stories(spark, sf).select("doc_id", F.round(scores.weighted((F.col("doc_id") % 11) / 10.0, (F.col("doc_id") % 10) / 10.0, F.col("reward")), 9).alias("reward"))


@query(f"""WITH {_STORY}, j AS (SELECT doc_id, text, doc_id % 10 AS base, doc_id % 3 <> 0 AS adheres, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+\\z', '', 'g')), lambda x: length(x) > 0) AS l FROM stories),
k AS (SELECT *, contains(lower(text), 'idiot') OR contains(lower(text), 'word w') AS named, CASE WHEN adheres THEN base ELSE base // 2 END AS s FROM j)
SELECT doc_id, CAST(CASE WHEN coalesce(l[len(l)], '') <> 'THE END.' THEN 0 WHEN named THEN least(s, 2) ELSE s END AS BIGINT) AS score FROM k""")
def judge_rules(spark, sf):
    return stories(spark, sf).select("doc_id", scores.judged(F.col("doc_id") % 10, F.col("doc_id") % 3 != 0, F.col("text"), F.lit("Idiot"), F.lit("Word W")).alias("score"))


@query(f"WITH {RESULTS_SQL} SELECT subject AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM results GROUP BY subject")
def value_counts(spark, sf):
    return ops.value_counts(results(spark, sf), "subject")


@query(f"WITH {RESULTS_SQL}, s AS (SELECT count(*) AS n FROM results GROUP BY subject), l AS (SELECT count(*) AS n FROM results GROUP BY pair_type) SELECT (SELECT max(n) - min(n) FROM s) AS subject_gap, (SELECT max(n) - min(n) FROM l) AS label_gap, (SELECT max(n) - min(n) <= count(*) FROM s) AND (SELECT max(n) - min(n) <= 1 FROM l) AS balanced")
def balance_report(spark, sf):
    return ops.balance(results(spark, sf).withColumnRenamed("pair_type", "label"))

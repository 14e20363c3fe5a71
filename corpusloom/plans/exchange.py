"""Queries through the sources and sinks: written, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lineage import scratch
from ..registry import query
from ..sources import io
from .views import RESULTS_SQL, catalog, results


@query("SELECT doc_id, text, lang FROM documents")
def json_roundtrip(spark, sf):
    own = io.table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("text", "lang")).alias("j"))
    return own.select("doc_id", F.from_json("j", "text string, lang string").alias("x")).select("doc_id", "x.text", "x.lang")


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_write_read(spark, sf):
    path = scratch(spark)
    own = io.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    io.write_lines(own.where("turn = 0"), path)
    io.write_lines(own.where("turn <> 0"), path, append=True)
    return io.read_lines(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT book_id, author, title, array_to_string(subjects, '|') AS subjects FROM (SELECT p_partkey AS book_id, 'a' AS author, p_name AS title, [p_type] AS subjects FROM part)")
def metadata_document(spark, sf):
    path = scratch(spark)
    own = io.table(spark, sf, "part").select(F.col("p_partkey").alias("book_id"), F.lit("a").alias("author"), F.col("p_name").alias("title"), F.array("p_type").alias("subjects"))
    io.write_metadata(own, path, {"source": "part"})
    return io.read_metadata(spark, path).select("book_id", "author", "title", F.array_join("subjects", "|").alias("subjects"))


@query(f"WITH {RESULTS_SQL} SELECT id, model, split, score FROM results WHERE split IN ('2', '4')")
def partitioned_splits(spark, sf):
    path = scratch(spark)
    io.write_splits(results(spark, sf), path)
    return io.read_split(spark, path, "2", "4").select("id", "model", "split", "score")


@query(f"WITH {RESULTS_SQL} SELECT id, model, score FROM results WHERE split = '3'")
def split_folder(spark, sf):
    path = scratch(spark)
    io.write_splits(results(spark, sf), path)
    return io.read_folder(spark, path, "3").select("id", "model", "score")


@query("SELECT split, row_number() OVER (ORDER BY CAST(split AS BIGINT)) AS place FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS split FROM part)")
def numeric_splits(spark, sf):
    own = io.table(spark, sf, "part").select(F.col("p_size").cast("string").alias("split"))
    return io.numeric_splits(own.unionByName(spark.createDataFrame([("other",)], "split string")))


@query(f"WITH {RESULTS_SQL} SELECT id, CASE WHEN subject = 'subject1' THEN NULL ELSE subject END AS subject, score FROM results")
def csv_append_read(spark, sf):
    path = scratch(spark)
    own = results(spark, sf).select("id", F.when(F.col("subject") == "subject1", "N/A").otherwise(F.col("subject")).alias("subject"), "score", "status")
    for status in ("Base", "FT"):
        io.append_csv(own.where(F.col("status") == status).drop("status"), path)
    return io.read_csv(spark, path, "id long, subject string, score double")


@query("SELECT 'm' || CAST(p_partkey AS VARCHAR) AS family, s AS status, CASE s WHEN 'Base' THEN p_name ELSE p_brand END AS path, 'm' || CAST(p_partkey AS VARCHAR) || '_' || s AS task FROM part, (SELECT unnest(['Base', 'FT']) AS s) WHERE s = 'Base' OR p_size > 25")
def model_tasks(spark, sf):
    own = io.table(spark, sf, "part")
    return io.model_tasks(own.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("family"), F.col("p_name").alias("base_path"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("ft_path")))


@query("SELECT doc_id, coalesce(text, '') AS chunk_text, '' AS refilled_text, CASE WHEN lang = 'en' THEN source WHEN lang = 'fr' THEN lang ELSE 'chunk_' || CAST(doc_id AS VARCHAR) END AS label, CASE WHEN lang = 'de' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS mask_ratio, CASE WHEN lang = 'es' THEN NULL ELSE source END AS author, CAST(NULL AS VARCHAR) AS title, CASE WHEN lang = 'en' THEN 'a|b' ELSE '' END AS subjects FROM documents")
def jsonl_defaults(spark, sf):
    """Documents as JSON lines that lack keys here and there, read with defaults."""
    d, path = io.table(spark, sf, "documents"), scratch(spark)
    when = lambda lang, c: F.when(F.col("lang") == lang, c)
    raw = d.select(F.col("doc_id").alias("book_id"), F.col("text").alias("chunk_text"), when("en", F.col("source")).alias("chunk_label"), when("fr", F.col("lang")).alias("label"), when("de", F.lit(0.5)).alias("mask_ratio"), F.col("doc_id").alias("index"), F.when(F.col("lang") != "es", F.col("source")).alias("author"), when("en", F.array(F.lit("a"), F.lit("b"))).alias("subjects"))
    io.write_lines(raw, path)
    lines = io.read_lines(spark, path, "book_id long, chunk_text string, chunk_label string, label string, mask_ratio double, index long, author string, subjects array<string>")
    return io.with_defaults(lines).select(F.col("book_id").alias("doc_id"), "chunk_text", "refilled_text", "label", "mask_ratio", "author", "title", F.array_join("subjects", "|").alias("subjects"))


@query("SELECT DISTINCT task FROM (SELECT p_type AS task FROM part WHERE p_size < 3 UNION ALL SELECT p_type FROM part WHERE p_brand = 'Brand#4' UNION ALL SELECT p_brand FROM part WHERE p_size = 7)")
def resume_state(spark, sf):
    """Finished names, saved in two steps and read back."""
    own, path = io.table(spark, sf, "part"), scratch(spark)
    name = lambda c: F.col(c).alias("task")
    io.save_completed(own.where("p_size < 3").select(name("p_type")), path)
    io.save_completed(io.add_completed(own.where("p_brand = 'Brand#4'").select(name("p_type")), own.where("p_size = 7").select(name("p_brand"))), path)
    return io.completed(spark, path)


_FILES = "files AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE coalesce(text, '') END AS text FROM documents)"


def _written(spark, sf):
    """Documents as files, but for some; and all documents' file names."""
    docs, path = io.table(spark, sf, "documents"), scratch(spark)
    name = F.concat(F.lit("Poe, E_[The Raven]: "), F.coalesce("source", F.lit("none")), F.lit("/100% of %3A book="), F.col("doc_id").cast("string"), F.lit(".txt"))
    named = docs.select("doc_id", name.alias("filename"), F.coalesce("text", F.lit("")).alias("text"))
    io.write_texts(named.where("doc_id % 7 <> 3"), path)
    return named.drop("text"), path


@query(f"WITH {_FILES} SELECT doc_id, md5(text) AS text_md5 FROM files WHERE text IS NOT NULL")
def text_files_read(spark, sf):
    """A file for each document, of just its text, read back by a name that has
    brackets, colons, blanks and escapes."""
    named, path = _written(spark, sf)
    return io.read_texts(spark, named, path).select("doc_id", F.md5("text").alias("text_md5"))


@query(f"WITH {_FILES} SELECT doc_id FROM files WHERE text IS NULL")
def missing_text_files(spark, sf):
    named, path = _written(spark, sf)
    return io.missing_files(spark, named, path).select("doc_id")


@query(f"WITH {RESULTS_SQL} SELECT id, model, score FROM results")
def dataset_write_read(spark, sf):
    path = scratch(spark)
    io.write_dataset(results(spark, sf).select("id", "model", "score"), path)
    return spark.read.parquet(path)


@query(f"WITH {RESULTS_SQL} SELECT model, count(*) AS n FROM results GROUP BY model")
def report_write_read(spark, sf):
    path = scratch(spark)
    io.write_report(results(spark, sf).groupBy("model").agg(F.count("*").alias("n")), path)
    return io.read_csv(spark, path, "model string, n long")


@query("SELECT 'm' || CAST(p_partkey AS VARCHAR) AS family, s AS status, CASE s WHEN 'Base' THEN p_name ELSE p_brand END AS path FROM part, (SELECT unnest(['Base', 'FT']) AS s) WHERE s = 'Base' OR p_size > 25")
def model_config_file(spark, sf):
    """Models of a JSON list, as tasks."""
    own, path = io.table(spark, sf, "part"), scratch(spark)
    models = own.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("family"), F.col("p_name").alias("base_path"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("ft_path"), F.lit("Short").alias("context"))
    io.write_list(models, path)
    return io.model_tasks(io.read_model_config(spark, path)).select("family", "status", "path")


@query("""WITH c AS (SELECT source AS author, doc_id, coalesce(text, '') AS text, 0.3::DOUBLE + (doc_id % 70) / 100.0::DOUBLE AS score FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY doc_id) AS place FROM c WHERE score >= 0.4697::DOUBLE AND length(trim(text)) > 0)
SELECT author, doc_id FROM r WHERE place <= 10""")
def streaming_quota_gate(spark, sf):
    from ..streaming.quota import accepted, gate

    folder = scratch(spark)
    docs = io.table(spark, sf, "documents")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0, "\nTHE END.").otherwise(""))
    rows = docs.select(F.col("source").alias("author"), F.col("doc_id").alias("arrival"), text.alias("text"), (0.3 + (F.col("doc_id") % 70) / 100.0).alias("score"))
    rows.write.parquet(f"{folder}/in")
    schema = "author string, arrival long, text string, score double"
    gate(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state", 10, 0.4697).awaitTermination()
    return accepted(spark, f"{folder}/out", schema).select("author", F.col("arrival").alias("doc_id"))

"""Views of the data folder in the shapes the operators take.

Each view stands beside the DuckDB text of the same rows, which the oracles
start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import table

CORE = ["ECONOMY", "LARGE", "MEDIUM", "PROMO"]
CORE_SQL = "('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO')"

CATALOG_SQL = """catalog AS (
  SELECT DISTINCT p.p_partkey AS book_id, p.p_name AS title, s.s_name AS author, p.p_type AS subject,
    CAST(p.p_size AS BIGINT) AS downloads, CASE WHEN p.p_brand IN ('Brand#1', 'Brand#2') THEN 'fr' ELSE 'en' END AS language
  FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey),
targets AS (SELECT DISTINCT p.p_name AS title, s.s_name AS author FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE p.p_brand = 'Brand#3' AND p.p_type = 'SMALL'),
links AS (SELECT DISTINCT l_partkey AS book_id, CASE l_returnflag WHEN 'A' THEN 'Plain Text' WHEN 'N' THEN 'text/html' ELSE 'epub' END AS kind FROM lineitem WHERE l_linestatus = 'F')"""


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """(book_id, title, author, subject, downloads, language), one row for each
    author of a book."""
    part = table(spark, sf, "part")
    links = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    return (
        links.join(part, "p_partkey")
        .join(table(spark, sf, "supplier"), "s_suppkey")
        .select(
            F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.col("s_name").alias("author"), F.col("p_type").alias("subject"),
            F.col("p_size").cast("long").alias("downloads"), F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "fr").otherwise("en").alias("language"), F.col("p_brand").alias("brand"),
        )
    )


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """(title, author) of the wanted books."""
    return catalog(spark, sf).where("brand = 'Brand#3' and subject = 'SMALL'").select("title", "author").distinct()


def links(spark: SparkSession, sf: str) -> DataFrame:
    """(book_id, kind): the forms a book can be had in."""
    kind = F.when(F.col("l_returnflag") == "A", "Plain Text").when(F.col("l_returnflag") == "N", "text/html").otherwise("epub")
    return table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_partkey").alias("book_id"), kind.alias("kind")).distinct()


CHUNKS_SQL = """chunks AS (
  SELECT doc_id, coalesce(text, '') AS text, source AS author_id, source || '/' || lang AS book_id,
    'subject' || CAST(CAST(substr(source, 4) AS BIGINT) % 4 AS VARCHAR) AS subject,
    CAST(doc_id % 10 AS DOUBLE) / 10 AS mask_ratio, 'c' || CAST(doc_id // 10 AS VARCHAR) AS label,
    CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') ELSE reverse(coalesce(text, '')) END AS refilled
  FROM documents)"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks of books, each with a refilled text at a ratio."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select(
        "doc_id", text.alias("text"), F.col("source").alias("author_id"), F.concat_ws("/", "source", "lang").alias("book_id"),
        F.concat(F.lit("subject"), (F.substring("source", 4, 9).cast("long") % 4).cast("string")).alias("subject"),
        ((F.col("doc_id") % 10).cast("double") / 10).alias("mask_ratio"), F.concat(F.lit("c"), F.floor(F.col("doc_id") / 10).cast("string")).alias("label"),
        F.when(F.col("doc_id") % 7 == 0, text).otherwise(F.reverse(text)).alias("refilled"),
    )


RESULTS_SQL = """results AS (
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'model a' ELSE 'model b' END AS model,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Base' ELSE 'FT' END AS status, substr(o_orderpriority, 1, 1) AS split,
    CASE WHEN o_custkey % 3 = 0 THEN 'same' ELSE 'cross' END AS pair_type, 'subject' || CAST(o_custkey % 5 AS VARCHAR) AS subject,
    o_totalprice / 500000.0::DOUBLE AS score FROM orders)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as scored pairs of models and splits."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "model a").otherwise("model b").alias("model"),
        F.when(F.col("o_orderkey") % 2 == 0, "Base").otherwise("FT").alias("status"), F.substring("o_orderpriority", 1, 1).alias("split"),
        F.when(F.col("o_custkey") % 3 == 0, "same").otherwise("cross").alias("pair_type"), F.concat(F.lit("subject"), (F.col("o_custkey") % 5).cast("string")).alias("subject"),
        (F.col("o_totalprice") / 500000.0).alias("score"),
    )

"""Readers and writers: Parquet, JSON, JSON lines, text and CSV.

Splits are one table with a ``split`` column that files are partitioned by, so
reading a split prunes the others.  Rewriting never deletes inputs.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import HEAD, LIST_HEAD, LIST_TAIL, TAIL, JsonDocument, TextFiles


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _records(spark: SparkSession, path: str) -> DataFrame | None:
    """The records (a column ``value``) of a JSON document with one a line, as
    :func:`write_metadata` and :func:`write_list` write it, by byte ranges; of another
    layout none."""
    lines = spark.read.text(path)
    first = [r.value for r in lines.limit(2).collect()]
    rest = lines.where(~F.col("value").isin(HEAD, TAIL, LIST_HEAD, LIST_TAIL, "") & ~F.col("value").startswith('{"summary": '))
    whole = len(first) == 2 and first[0] == LIST_HEAD and first[1].startswith('{"') and first[1].rstrip(",").endswith("}")
    return rest.select(F.regexp_replace("value", ",$", "").alias("value")) if whole or first[1:] == [HEAD] else None


def _read_document(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    records = _records(spark, path)
    if records is None:
        return (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=True)
    if schema:
        return records.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    # inferred from all records, in their tasks
    encoder = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    return DataFrame(spark._jsparkSession.read().json(getattr(records._jdf, "as")(encoder)), spark)


def read_jdbc(spark: SparkSession, url: str, relation: str, key: str, parts: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A database's table, or query in brackets with a name, in parts of about as many
    rows: the database counts an integer key in ranges, and the parts' bounds follow the
    counts, so a key with gaps and hot ranges is cut evenly.  Rows without a key are a
    part of their own; every part is read by one task, with its bounds in the query."""
    ask = lambda sql: spark.read.jdbc(url, f"({sql}) q", properties=properties)
    least, most = ask(f"SELECT MIN({key}) AS a, MAX({key}) AS b FROM {relation}").first()
    if least is None:
        return spark.read.jdbc(url, relation, properties=properties)

    def counted(start: int, end: int) -> list[tuple[int, int, int]]:
        """(start, end, rows) of ranges of the keys, 64 for each part at most."""
        width = (end - start) // (64 * parts) + 1
        rows = ask(f"SELECT r, COUNT(*) AS n FROM (SELECT ({key} - ({start})) / {width} AS r FROM {relation} WHERE {key} >= {start} AND {key} < {end}) x GROUP BY r").collect()
        return sorted((start + int(r) * width, min(end, start + (int(r) + 1) * width), n) for r, n in rows)

    ranges = counted(least, most + 1)
    share = sum(n for *_, n in ranges) / parts
    while any(n > share and b - a > 1 for a, b, n in ranges):  # a hot range is counted again, finer
        ranges = [x for a, b, n in ranges for x in (counted(a, b) if n > share and b - a > 1 else [(a, b, n)])]
    cuts, n, whole = [], 0, 0
    for start, _, more in ranges:
        if n and whole + more / 2 >= share * (len(cuts) + 1) and len(cuts) < parts - 1:
            cuts.append(start)
            n = 0
        n, whole = n + more, whole + more
    bounds = [None, *cuts, None]
    where = [" AND ".join(f"{key} {op} {x}" for op, x in ((">=", a), ("<", b)) if x is not None) or f"{key} IS NOT NULL" for a, b in zip(bounds, bounds[1:], strict=False)]
    return spark.read.jdbc(url, relation, predicates=[*where, f"{key} IS NULL"], properties=properties)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Book records of a JSON document: the ``books`` list of a wrapper object,
    or the document itself where it is a list of records.  A document with a record
    a line is read by byte ranges, one of another layout by a single task."""
    doc = _read_document(spark, path, None)
    return doc.select(F.explode("books").alias("book")).select("book.*") if "books" in doc.columns else doc


def _write_document(df: DataFrame, path: str, **options: str) -> None:
    register(df.sparkSession)
    records = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    records.write.format("jsondocument").options(**options).mode("overwrite").save(path)


def write_metadata(df: DataFrame, path: str, summary: dict) -> None:
    """Records and a summary as one JSON document, put together from the tasks'
    parts; rows keep their order."""
    _write_document(df, path, summary=json.dumps(summary, ensure_ascii=False))


def register(spark: SparkSession) -> None:
    """Make this library's file formats known to a session."""
    for source in (TextFiles, JsonDocument):
        spark.dataSource.register(source)


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines; malformed lines are skipped, or fail where ``strict``."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, non-ASCII characters as they are."""
    df.write.mode("append" if append else "overwrite").json(path)


def with_defaults(raw: DataFrame, index: str = "index", book: str = "book_id") -> DataFrame:
    """Refilled chunks with defaults for what is missing: empty texts, no
    subjects, ratio 0, and a label from ``chunk_label``, then ``label``, then
    ``chunk_`` and the row's index.  Author and title stay null."""
    have = lambda c, kind="string": F.col(c).cast(kind) if c in raw.columns else F.lit(None).cast(kind)
    return raw.select(
        *(F.coalesce(have(c), F.lit("")).alias(c) for c in ("chunk_text", "refilled_text")),
        *(have(c).alias(c) for c in ("author", "title")),
        F.coalesce(have("subjects", "array<string>"), F.array().cast("array<string>")).alias("subjects"),
        have(book, "long").alias("book_id"),
        F.coalesce(have("mask_ratio", "double"), F.lit(0.0)).alias("mask_ratio"),
        F.coalesce(have("chunk_label"), have("label"), F.concat(F.lit("chunk_"), have(index))).alias("label"),
    )


@F.pandas_udf(T.StringType())
def _lenient(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else b.decode("utf-8", "ignore"))


def _files(spark: SparkSession, folder: str, contents: bool) -> DataFrame:
    register(spark)
    return spark.read.format("textfiles").option("contents", "yes" if contents else "no").load(folder)


def read_texts(spark: SparkSession, metadata: DataFrame, folder: str) -> DataFrame:
    """Metadata rows with their files' whole texts; rows without a file drop
    out, and bytes that are no UTF-8 are left out."""
    return metadata.join(_files(spark, folder, True), "filename").withColumn("text", _lenient("content")).drop("content")


def write_texts(df: DataFrame, folder: str) -> None:
    """A file for each row (filename, text), of just the text's bytes; names may be
    paths below the folder and are kept as they are."""
    register(df.sparkSession)
    df.select("filename", "text").write.format("textfiles").mode("overwrite").save(folder)


def missing_files(spark: SparkSession, metadata: DataFrame, folder: str) -> DataFrame:
    """Metadata rows whose file is not there; contents are not read."""
    return metadata.join(_files(spark, folder, False).select("filename"), "filename", "left_anti")


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table of splits, partitioned by ``split``."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, *splits: str) -> DataFrame:
    """Some splits of a table, or all."""
    df = spark.read.option("basePath", path).parquet(path).withColumn("split", F.col("split").cast("string"))
    return df.where(F.col("split").isin(*splits)) if splits else df


def read_folder(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split by its folder alone; the name of the split is no column then."""
    return spark.read.parquet(f"{path}/split={split}")


def numeric_splits(df: DataFrame) -> DataFrame:
    """Names of the all-digit splits in numeric order, or, where there are none,
    of all splits in lexical order, with their place."""
    names = df.select(F.col("split").cast("string").alias("split")).distinct()
    number = F.col("split").rlike("^[0-9]+$")
    flagged = names.select("split", number.alias("number"), F.max(number).over(Window.partitionBy()).alias("any"))
    kept = flagged.where("number = any")
    return kept.select("split", F.row_number().over(Window.orderBy(F.when(F.col("number"), F.col("split").try_cast("long")), "split")).cast("long").alias("place"))


def write_dataset(df: DataFrame, path: str) -> None:
    """A dataset without splits."""
    df.write.mode("overwrite").parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to a CSV table, each file with its header."""
    df.write.mode("append").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table; ``N/A`` is null."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="N/A")


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def model_tasks(config: DataFrame) -> DataFrame:
    """One row for each model to run: a base model, and its fine-tuned form
    where there is one."""
    tasks = F.array(F.struct(F.lit("Base").alias("status"), F.col("base_path").alias("path")), F.struct(F.lit("FT").alias("status"), F.col("ft_path").alias("path")))
    return config.select("family", F.explode(tasks).alias("t")).select("family", "t.status", "t.path", F.concat_ws("_", "family", "t.status").alias("task")).where("path is not null")


def write_list(df: DataFrame, path: str) -> None:
    """A table as one JSON list, put together from the tasks' parts."""
    _write_document(df, path)


def read_model_config(spark: SparkSession, path: str) -> DataFrame:
    """Models (family, base_path, ft_path, context) of a JSON list."""
    return _read_document(spark, path, "family string, base_path string, ft_path string, context string")


def save_completed(names: DataFrame, path: str) -> None:
    """Add finished names to a state table, which may hold a name twice."""
    names.select("task").write.mode("append").parquet(path)


def completed(spark: SparkSession, path: str) -> DataFrame:
    """The finished names of a state table, each once."""
    return spark.read.schema("task string").parquet(path).distinct()


def add_completed(done: DataFrame, names: DataFrame) -> DataFrame:
    """The set of finished names with some more."""
    return done.unionByName(names.select(*done.columns)).distinct()

"""Every query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

from corpusloom import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df, q = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    assert sorted((c, KINDS[k]) for c, k in df.dtypes) == sorted((c, str(k)) for c, k in zip(q.columns, q.types, strict=True))
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(q.fetchall(), q.columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    """Sequential builders, whose draws no SQL follows: the queries of their
    totals say what has to hold; here, that they give rows, the same each time."""
    df = registry.QUERIES[name](spark, SF)
    first, second = rows([tuple(r) for r in df.collect()], df.columns), rows([tuple(r) for r in df.collect()], df.columns)
    assert first and first == second and f"{name.removesuffix('_selection')}_totals" in registry.ORACLES


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

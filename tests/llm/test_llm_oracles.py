"""The operators' queries against their DuckDB oracles, on the smallest tables."""

import duckdb
import pytest

from corpusloom.llm import queries

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, q = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted((c, KINDS[k]) for c, k in df.dtypes) == sorted((c, str(k)) for c, k in zip(q.columns, q.types, strict=True))
    order = [q.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in q.fetchall())

"""Queries with SQL give the same rows in Spark and DuckDB."""

from pathlib import Path

import pytest

from quire.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    places = [[d[0] for d in cursor.description].index(c) for c in columns]
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got and got == sorted((tuple(r[k] for k in places) for r in cursor.fetchall()), key=repr)

"""Every query with SQL gives the same rows in Spark and DuckDB."""

from pathlib import Path

import pytest

from quire import queries

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(value, 9) if isinstance(value, float) else value


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    cursor = duck.execute(queries.SQL[name])
    places = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert rows(got) == rows([[r[k] for k in places] for r in cursor.fetchall()])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows_without_sql(spark, name):
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0


def test_fixtures_tell_wrong_versions_apart(spark):
    from pyspark.sql import functions as F

    from quire.functions.geometry import iou
    from quire.operators import layout

    boxes = queries.filtered(spark, str(DATA.parent / "sf0.01"))
    kept = layout.suppress(boxes).count()
    a, b = boxes.alias("a"), boxes.alias("b")
    better = (F.col("b.score") > F.col("a.score")) | ((F.col("b.score") == F.col("a.score")) & (F.col("b.raw_ord") < F.col("a.raw_ord")))
    box = [F.struct(*[F.col(f"{t}.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]) for t in "ab"]
    anti = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & better & (iou(*box) >= 0.9), "left_anti").count()
    assert kept != anti


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).count() > 0

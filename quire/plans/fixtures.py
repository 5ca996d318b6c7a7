"""Page-shaped relations projected from the test tables, in SQL that both Spark
and DuckDB evaluate alike (whole numbers first, then a cast to double)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    "boxes": """
SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS page_id, o_orderkey % 10 AS raw_ord, (o_orderkey * 7) % 22 AS label_id,
       CAST((o_orderkey * o_orderkey * 37 + o_orderkey * 11) % 101 AS DOUBLE) / 100 AS score,
       CAST(floor((o_orderkey % 10) / 5) AS DOUBLE) * 300 AS x1, CAST((o_orderkey % 5) * 5 AS DOUBLE) AS y1,
       CAST(floor((o_orderkey % 10) / 5) AS DOUBLE) * 300 + 200 AS x2, CAST((o_orderkey % 5) * 5 + 100 AS DOUBLE) AS y2
FROM orders""",
    "raw_boxes": """
SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS page_id, CAST(o_orderkey % 10 AS INT) AS raw_ord,
       CAST((o_orderkey * 7) % 24 AS DOUBLE) - 1.5 AS label_value,
       CAST((o_orderkey * 37 + 11) % 101 AS DOUBLE) / 100 AS score,
       CAST((o_orderkey * 13) % 700 AS DOUBLE) - 50 AS x1, CAST((o_orderkey * 17) % 900 AS DOUBLE) - 60 AS y1,
       CAST((o_orderkey * 13) % 700 + (o_orderkey * 7) % 90 AS DOUBLE) - 55 AS x2,
       CAST((o_orderkey * 17) % 900 + (o_orderkey * 3) % 80 AS DOUBLE) - 62 AS y2,
       CAST(CASE WHEN o_orderkey % 30 < 10 THEN NULL WHEN o_orderkey % 30 < 20 THEN 7 ELSE -1 END AS INT) AS n_valid,
       600 AS page_w, 800 AS page_h
FROM orders""",
    "lines": """
SELECT CAST(floor(event_id / 20) AS BIGINT) AS page_id, event_id AS line_ord,
       CAST((event_id * 53) % 450 AS DOUBLE) AS x1, CAST((event_id * 31) % 97 AS DOUBLE) AS y1,
       CAST((event_id * 53) % 450 + 40 AS DOUBLE) AS x2, CAST((event_id * 31) % 97 + 8 AS DOUBLE) AS y2
FROM events""",
    "heaps": """
SELECT CAST(floor(event_id / 20) AS BIGINT) AS page_id, event_id AS line_ord,
       CAST((event_id * event_id * 13 + event_id * 7) % 181 AS DOUBLE) AS x1, CAST((event_id * event_id * 29 + event_id * 5) % 97 AS DOUBLE) AS y1,
       CAST((event_id * event_id * 13 + event_id * 7) % 181 + 40 AS DOUBLE) AS x2, CAST((event_id * event_id * 29 + event_id * 5) % 97 + 8 AS DOUBLE) AS y2
FROM events""",
    "steps": """
SELECT CAST(floor(event_id / 16) AS BIGINT) AS seq_id, event_id % 16 AS step,
       CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 99 END AS token_id,
       CAST((event_id * 29) % 64 AS DOUBLE) / 64 AS prob
FROM events""",
    "regions_nested": """
SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS page_id, o_orderkey % 10 AS raw_ord, (o_orderkey * 7) % 20 AS label_id,
       CAST((o_orderkey % 5) * 40 AS DOUBLE) AS x1, CAST((o_orderkey % 3) * 10 AS DOUBLE) AS y1,
       CAST((o_orderkey % 5) * 40 + 60 + (o_orderkey * 29) % 300 AS DOUBLE) AS x2,
       CAST((o_orderkey % 3) * 10 + 30 + (o_orderkey * 17) % 80 AS DOUBLE) AS y2
FROM orders""",
    "rec_lines": """
SELECT conv_id AS region_id, turn AS line_ord, role, text, CAST(((conv_id * 13 + turn * 7) % 11) AS DOUBLE) / 10 AS confidence
FROM conversations""",
    "line_texts": """
SELECT CAST(floor(event_id / 20) AS BIGINT) AS page_id, event_id AS line_ord,
       CASE WHEN event_id % 13 = 0 THEN '  ' ELSE concat(' ', event_type, ' ', CAST(event_id AS STRING)) END AS text,
       CAST((event_id * 3) % 11 AS DOUBLE) / 10 AS confidence
FROM events""",
    "page_sizes": """
SELECT p_partkey AS page_id, CAST(1 + (p_partkey * 37) % 3000 AS INT) AS w, CAST(1 + (p_partkey * 101) % 4000 AS INT) AS h
FROM part""",
    "images": """
SELECT p_partkey AS page_id, CAST(3 + p_partkey % 6 AS INT) AS w, CAST(3 + p_partkey % 5 AS INT) AS h, CAST(p_partkey * 13 % 256 AS INT) AS base,
       CAST(p_partkey % 3 AS INT) AS ink
FROM part""",
    "formula_steps": """
SELECT o_orderkey AS seq_id, CAST((o_orderkey * 31) % 60 AS BIGINT) AS a, CAST((o_orderkey * 17) % 50 AS BIGINT) AS b,
       CAST((o_orderkey * 7) % 45 AS BIGINT) AS c, CAST((o_orderkey * 3) % 30 AS BIGINT) AS d
FROM orders""",
}
TABLES = ("orders", "events", "conversations", "part", "embeddings", "documents")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture over the tables of a folder."""
    sql = FIXTURES[name]
    table = sql.rsplit("FROM ", 1)[1].strip()
    return spark.sql(sql.rsplit("FROM ", 1)[0] + "FROM {source}", source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_fixtures(sql: str, *names: str) -> str:
    """DuckDB SQL with fixtures as its first common table expressions."""
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n]}\n)" for n in names)
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    return f"WITH {recursive}{ctes}{sql.replace('RECURSIVE', '')}"

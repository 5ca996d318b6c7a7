"""Queries over the test tables, one per operator, and the SQL they must equal.

In the SQL, `,` begins further common table expressions behind the fixtures.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import ClassConfig, PageConfig
from quire.functions import geometry, pixels
from quire.functions.text import byte_level_letters, byte_level_text, is_blank, utrim
from quire.labels import FORMULA, LABELS, MULTI_LINE, SINGLE_LINE, TEXT, label_name, label_table
from quire.operators import assign, decode, layout, lines, markdown
from quire.plans import recognise
from quire.plans.fixtures import fixture, with_fixtures
from quire.sources import vocabulary

BOX = ("x1", "y1", "x2", "y2")
SYMBOLS = ["a", "b", "c"]
TOKENS = [*(f"<{k}>" for k in range(23)), *(chr(97 + k % 26) if k % 3 else "Ġ" for k in range(27))]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *fixtures: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_fixtures(sql, *fixtures) if fixtures else sql
        return f

    return add


def names_sql(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in sorted(names)) + ")"


LABEL_SQL = "list_extract([" + ", ".join(f"'{x}'" for x in LABELS) + "], CAST(label_id AS INT) + 1)"
IOU_SQL = """(CASE WHEN greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0) <= 0 THEN 0
  ELSE greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)
  / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1)
     - greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)) END)"""
FILTERED_SQL = f""",
filtered AS (SELECT *, {LABEL_SQL} AS label FROM boxes WHERE score >= 0.4 AND label_id < 20)"""
NMS_SQL = f"""{FILTERED_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, raw_ord) AS rk FROM filtered),
nms AS RECURSIVE (
  SELECT page_id, CAST(1 AS BIGINT) AS rk, [{{'raw_ord': raw_ord, 'score': score, 'label': label, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM ranked WHERE rk = 1
  UNION ALL
  SELECT n.page_id, r.rk, CASE WHEN len(list_filter(n.kept, lambda k: {IOU_SQL.format(a="k", b="r")} >= 0.9)) > 0 THEN n.kept
    ELSE list_append(n.kept, {{'raw_ord': r.raw_ord, 'score': r.score, 'label': r.label, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) END
  FROM nms n JOIN ranked r ON r.page_id = n.page_id AND r.rk = n.rk + 1),
last AS (SELECT page_id, max(rk) AS rk FROM nms GROUP BY page_id),
survivors AS (
  SELECT page_id, k.raw_ord AS raw_ord, k.score AS score, k.label AS label, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2,
         row_number() OVER (PARTITION BY page_id ORDER BY k.score DESC, k.raw_ord) - 1 AS nms_rank
  FROM (SELECT page_id, unnest(kept) AS k FROM nms JOIN last USING (page_id, rk)))"""
ORDERED_SQL = """,
sorted AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, line_ord) AS rk FROM lines),
folded AS RECURSIVE (
  SELECT page_id, CAST(1 AS BIGINT) AS rk, [{'line_ord': line_ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS kept FROM sorted WHERE rk = 1
  UNION ALL
  SELECT f.page_id, s.rk, list_concat(list_append(f.kept[1:p.at], {'line_ord': s.line_ord, 'x1': s.x1, 'y1': s.y1, 'x2': s.x2, 'y2': s.y2}), f.kept[p.at + 1:])
  FROM folded f JOIN sorted s ON s.page_id = f.page_id AND s.rk = f.rk + 1,
  LATERAL (SELECT coalesce(list_max(list_filter(range(1, len(f.kept) + 1), lambda j: NOT (abs(f.kept[j].y1 - s.y1) < 10 AND s.x1 < f.kept[j].x1))), 0) AS at) p),
top AS (SELECT page_id, max(rk) AS rk FROM folded GROUP BY page_id),
ordered AS (
  SELECT page_id, k.line_ord AS line_ord, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2, CAST(i - 1 AS INT) AS line_idx
  FROM (SELECT page_id, unnest(kept) AS k, unnest(range(1, len(kept) + 1)) AS i FROM folded JOIN top USING (page_id, rk)))"""
ASSIGNED_SQL = """,
assigned AS (
  SELECT page_id, line_ord, raw_ord FROM (
    SELECT l.page_id, l.line_ord, r.raw_ord,
           row_number() OVER (PARTITION BY l.page_id, l.line_ord ORDER BY (r.x2 - r.x1) * (r.y2 - r.y1), r.raw_ord) AS rn
    FROM lines l JOIN regions_nested r ON l.page_id = r.page_id
     AND (l.x1 + l.x2) / 2 >= r.x1 AND (l.x1 + l.x2) / 2 <= r.x2 AND (l.y1 + l.y2) / 2 >= r.y1 AND (l.y1 + l.y2) / 2 <= r.y2) q
  WHERE rn = 1)"""


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.filter_boxes(fixture(spark, sf_dir, "boxes")).withColumn("label", label_name(F.col("label_id")))


# layout


@query(f"{FILTERED_SQL} SELECT page_id, raw_ord, label_id, label, score FROM filtered", "boxes")
def layout_filter(spark, sf_dir):
    """Score threshold, known labels, their names."""
    return filtered(spark, sf_dir).select("page_id", "raw_ord", "label_id", "label", "score")


@query(
    f""",
kept AS (SELECT page_id, raw_ord, CASE WHEN label_value < 0 THEN 0 ELSE CAST(trunc(label_value) AS INT) END AS label_id, score,
                least(greatest(x1, 0), 600) AS x1, least(greatest(y1, 0), 800) AS y1, least(greatest(x2, 0), 600) AS x2, least(greatest(y2, 0), 800) AS y2
         FROM raw_boxes WHERE (n_valid IS NULL OR n_valid < 0 OR raw_ord < n_valid) AND score >= 0.5 AND label_value < 20)
SELECT page_id, raw_ord, label_id, {LABEL_SQL} AS label, score, x1, y1, x2, y2 FROM kept WHERE x2 > x1 AND y2 > y1""",
    "raw_boxes",
)
def layout_clamp(spark, sf_dir):
    """Raw model rows to boxes on the page."""
    return layout.filter_raw(fixture(spark, sf_dir, "raw_boxes"), 0.5)


@query(f"{NMS_SQL} SELECT page_id, raw_ord, score, label, nms_rank FROM survivors", "boxes")
def layout_nms(spark, sf_dir):
    """A1, G1, O2: greedy suppression."""
    return layout.suppress(filtered(spark, sf_dir)).select("page_id", "raw_ord", "score", "label", "nms_rank")


def _class_filter(name: str, classes: ClassConfig) -> None:
    wanted = names_sql(classes.enabled) if classes.enabled else "('')"

    def run(spark, sf_dir):
        return layout.keep_classes(filtered(spark, sf_dir), classes.enabled).select("page_id", "raw_ord", "label")

    run.__name__ = name
    query(f"{FILTERED_SQL} SELECT page_id, raw_ord, label FROM filtered WHERE label IN {wanted}", "boxes")(run)


for _name, _classes in (("class_filter_basic", ClassConfig.basic()), ("class_filter_all", ClassConfig.all()), ("class_filter_none", ClassConfig.none())):
    _class_filter(_name, _classes)


@query(f"{NMS_SQL} SELECT page_id, raw_ord, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, nms_rank) - 1 AS region_idx FROM survivors", "boxes")
def region_order(spark, sf_dir):
    """O1: reading order of regions."""
    return layout.reading_order(layout.suppress(filtered(spark, sf_dir))).select("page_id", "raw_ord", "region_idx")


@query(
    f", l AS (SELECT unnest(range(0, 20)) AS label_id) SELECT DISTINCT CAST(b.label_id AS INT) AS label_id, {LABEL_SQL.replace('label_id', 'b.label_id')} AS label, "
    f"{LABEL_SQL.replace('label_id', 'b.label_id')} IN {names_sql(TEXT)} AS is_text, {LABEL_SQL.replace('label_id', 'b.label_id')} IN {names_sql(SINGLE_LINE)} AS is_single_line "
    "FROM boxes b JOIN l ON l.label_id = b.label_id",
    "boxes",
)
def label_groups(spark, sf_dir):
    """The label dimension, of the labels in use."""
    used = fixture(spark, sf_dir, "boxes").select(F.col("label_id").cast("int").alias("label_id")).distinct()
    return label_table(spark).join(used, "label_id")


@query(
    f"{FILTERED_SQL} SELECT page_id, bool_or(label IN {names_sql(TEXT)}) AS needs_recognition, bool_or(label IN {names_sql(MULTI_LINE)}) AS needs_detection, "
    "bool_or(label = 'formula') AS needs_formulas FROM filtered WHERE score >= 0.8 GROUP BY page_id",
    "boxes",
)
def class_needs(spark, sf_dir):
    """The branches that the classes found on each page need."""
    cases = [(x, ClassConfig.none().with_enabled(x, True)) for x in LABELS]
    needs = spark.createDataFrame(
        [(n, c.needs_recognition(), c.needs_detection(), c.needs_formulas()) for n, c in cases], "label string, recognition boolean, detection boolean, formulas boolean"
    )
    found = filtered(spark, sf_dir).where("score >= 0.8").select("page_id", "label").join(F.broadcast(needs), "label")
    return found.groupBy("page_id").agg(*[F.bool_or(c).alias(f"needs_{c}") for c in ("recognition", "detection", "formulas")])


@query(
    f"{NMS_SQL} SELECT label, count(*) AS n, min(score) AS least, max(score) AS most FROM survivors GROUP BY label",
    "boxes",
)
def region_counts(spark, sf_dir):
    """Counts and extremes of regions by class."""
    kept = layout.suppress(filtered(spark, sf_dir))
    return kept.groupBy("label").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query(
    f"{NMS_SQL} SELECT page_id, raw_ord, CASE label WHEN 'paragraph_title' THEN [220, 20, 60] WHEN 'text' THEN [30, 30, 200] WHEN 'formula' THEN [0, 150, 0] ELSE [70, 130, 180] END[1] AS red, "
    "CASE label WHEN 'paragraph_title' THEN 20 WHEN 'text' THEN 30 WHEN 'formula' THEN 150 ELSE 130 END AS green, CASE label WHEN 'paragraph_title' THEN 60 WHEN 'text' THEN 200 WHEN 'formula' THEN 0 ELSE 180 END AS blue FROM survivors",
    "boxes",
)
def region_colours(spark, sf_dir):
    """The colour that each region is drawn with."""
    from quire.sources.pages import colour_of

    table = spark.createDataFrame([(x, *colour_of(x)[::-1]) for x in LABELS], "label string, red int, green int, blue int")
    return layout.suppress(filtered(spark, sf_dir)).join(F.broadcast(table), "label").select("page_id", "raw_ord", "red", "green", "blue")


# lines


@query(f"{ORDERED_SQL} SELECT page_id, line_ord, line_idx FROM ordered", "lines")
def line_order(spark, sf_dir):
    """Reading order of lines."""
    return lines.reading_order(fixture(spark, sf_dir, "lines")).select("page_id", "line_ord", "line_idx")


@query(" SELECT page_id, line_ord FROM (SELECT *, line_ord % 20 AS contour_ord FROM lines) WHERE contour_ord < 7", "lines")
def candidate_cap(spark, sf_dir):
    """A limit per page in order of discovery."""
    rows = fixture(spark, sf_dir, "lines").withColumn("contour_ord", F.col("line_ord") % 20)
    return lines.cap_candidates(rows, 7).select("page_id", "line_ord")


def quads(spark, sf_dir) -> DataFrame:
    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    return fixture(spark, sf_dir, "lines").withColumn("quad", F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners]))


@query(" SELECT page_id, line_ord, least(x2 - x1, y2 - y1) AS side FROM lines", "lines")
def quad_short_side(spark, sf_dir):
    """The shortest edge of a quad."""
    return quads(spark, sf_dir).select("page_id", "line_ord", geometry.short_side(F.col("quad")).alias("side"))


@query(" SELECT page_id, line_ord, (x2 - x1) * (y2 - y1) AS area, (x2 - x1) * (y2 - y1) AS turn FROM lines", "lines")
def quad_area(spark, sf_dir):
    """Signed area of a quad, area of its box and a cross product."""
    q = F.col("quad")
    turn = geometry.cross(F.get(q, F.lit(0)), F.get(q, F.lit(1)), F.get(q, F.lit(2)))
    return quads(spark, sf_dir).select("page_id", "line_ord", geometry.signed_area(q).alias("area"), turn.alias("turn"))


@query(" SELECT page_id, line_ord, 2 * (x2 - x1) + 2 * (y2 - y1) AS perimeter FROM lines", "lines")
def quad_perimeter(spark, sf_dir):
    """Perimeter of a quad."""
    return quads(spark, sf_dir).select("page_id", "line_ord", geometry.perimeter(F.col("quad")).alias("perimeter"))


@query(
    " SELECT page_id, line_ord, round(x1 - d, 6) AS x1, round(y1 - d, 6) AS y1, round(x2 + d, 6) AS x2, round(y2 + d, 6) AS y2 "
    "FROM (SELECT *, (x2 - x1) * (y2 - y1) * 1.4 / (2 * (x2 - x1 + y2 - y1)) AS d FROM lines)",
    "lines",
)
def quad_unclip_rect(spark, sf_dir):
    """A rectangle grown by its area and perimeter."""
    grown = geometry.unclip_box(*[F.col(c) for c in BOX])
    return fixture(spark, sf_dir, "lines").select("page_id", "line_ord", *[F.round(g, 6).alias(c) for g, c in zip(grown, BOX, strict=True)])


@query(
    " SELECT page_id, line_ord, least(x1 * 2.5, 1000) AS x1, least(y1 * 4.0, 300) AS y1, least(x2 * 2.5, 1000) AS x2, least(y2 * 4.0, 300) AS y2 FROM lines",
    "lines",
)
def map_to_page(spark, sf_dir):
    """Quads of the detector's map on the page, clamped."""
    box = geometry.quad_to_page(F.col("quad"), F.lit(400), F.lit(75), F.lit(1000), F.lit(300))
    return quads(spark, sf_dir).select("page_id", "line_ord", *[b.alias(c) for b, c in zip(box, BOX, strict=True)])


@query(
    """ SELECT page_id, line_ord, least(x1 * 2.5, 1000) AS x1, least(y1 * 4.0, 300) AS y1, least(x2 * 2.5, 1000) AS x2, least(y2 * 4.0, 300) AS y2, score FROM (
  SELECT *, line_ord % 20 AS contour_ord, CAST((line_ord * 7) % 10 AS DOUBLE) / 10 AS score, line_ord % 6 AS n_points FROM lines)
WHERE contour_ord < 3000 AND n_points >= 4 AND score >= 0.4 AND least(x2 - x1, y2 - y1) >= 5
  AND least(x2 * 2.5, 1000) - least(x1 * 2.5, 1000) >= 1 AND least(y2 * 4.0, 300) - least(y1 * 4.0, 300) >= 1""",
    "lines",
)
def quad_filters(spark, sf_dir):
    """Candidate quads to page boxes."""
    rows = quads(spark, sf_dir).withColumns(
        {
            "contour_ord": F.col("line_ord") % 20,
            "score": ((F.col("line_ord") * 7) % 10).cast("double") / 10,
            "n_points": F.col("line_ord") % 6,
            "map_w": F.lit(400),
            "map_h": F.lit(75),
            "page_w": F.lit(1000),
            "page_h": F.lit(300),
        }
    )
    kept = lines.filter_quads(rows).withColumn("contour_ord", F.col("line_ord"))
    return lines.quads_to_boxes(kept).select("page_id", "line_ord", *BOX, "score")


#: Rectangles of whole sides, turned as 3 to 4: corners are whole too.
TURNED_SQL = """, r AS (SELECT page_id, line_ord, x1 + 30 AS x, y1 AS y, 5 * (1 + line_ord % 9) AS w, 5 * (1 + line_ord % 4) AS h FROM lines),
turned AS (
  SELECT page_id, line_ord, w, h, [x, x + w / 5 * 4, x + w / 5 * 4 - h / 5 * 3, x - h / 5 * 3] AS qx, [y, y + w / 5 * 3, y + w / 5 * 3 + h / 5 * 4, y + h / 5 * 4] AS qy FROM r)"""


def turned_quads(spark, sf_dir) -> DataFrame:
    x, y, k = F.col("x1") + 30, F.col("y1"), F.col("line_ord")
    a, b = (1 + k % 9), (1 + k % 4)  # fifths of the sides
    corners = [(x, y), (x + 4 * a, y + 3 * a), (x + 4 * a - 3 * b, y + 3 * a + 4 * b), (x - 3 * b, y + 4 * b)]
    quad = F.array(*[F.struct(p.cast("double").alias("x"), q.cast("double").alias("y")) for p, q in corners])
    return fixture(spark, sf_dir, "lines").select("page_id", "line_ord", quad.alias("quad"))


@query(
    TURNED_SQL + " SELECT page_id, line_ord, CAST(least(w, h) AS DOUBLE) AS side, CAST(w * h AS DOUBLE) AS area, CAST(2 * (w + h) AS DOUBLE) AS perimeter, CAST(w * h AS DOUBLE) AS turn, "
    "least(greatest(list_min(qx) * 2.5, 0), 1000) AS x1, least(greatest(list_min(qy) * 4.0, 0), 300) AS y1, "
    "least(greatest(list_max(qx) * 2.5, 0), 1000) AS x2, least(greatest(list_max(qy) * 4.0, 0), 300) AS y2 FROM turned",
    "lines",
)
def quad_turned(spark, sf_dir):
    """Measures and page boxes of quads that aren't axis-parallel."""
    q = F.col("quad")
    turn = geometry.cross(F.get(q, F.lit(0)), F.get(q, F.lit(1)), F.get(q, F.lit(2)))
    box = geometry.quad_to_page(q, F.lit(400), F.lit(75), F.lit(1000), F.lit(300))
    measures = {"side": geometry.short_side(q), "area": geometry.signed_area(q), "perimeter": geometry.perimeter(q), "turn": turn}
    return turned_quads(spark, sf_dir).select("page_id", "line_ord", *[m.alias(n) for n, m in measures.items()], *[b.alias(c) for b, c in zip(box, BOX, strict=True)])


# assignment and crops


@query(f"{ASSIGNED_SQL} SELECT * FROM assigned", "lines", "regions_nested")
def assign_lines(spark, sf_dir):
    """Lines to their smallest region."""
    return assign.assign_lines(fixture(spark, sf_dir, "lines"), fixture(spark, sf_dir, "regions_nested"), "line_ord", "raw_ord")


CROPS_SQL = f"""{ASSIGNED_SQL},
crops AS (
  SELECT r.page_id, r.raw_ord AS region_idx, l.line_ord AS line_idx, l.line_ord IS NULL AS is_fallback,
         coalesce(l.x1, r.x1) AS x1, coalesce(l.y1, r.y1) AS y1, coalesce(l.x2, r.x2) AS x2, coalesce(l.y2, r.y2) AS y2,
         row_number() OVER (PARTITION BY r.page_id ORDER BY r.raw_ord, l.line_ord) - 1 AS crop_idx
  FROM regions_nested r LEFT JOIN (SELECT a.raw_ord, l.* FROM assigned a JOIN lines l USING (page_id, line_ord)) l ON l.page_id = r.page_id AND l.raw_ord = r.raw_ord)"""


def nested_crops(spark, sf_dir) -> DataFrame:
    regions = fixture(spark, sf_dir, "regions_nested").withColumn("label", label_name(F.col("label_id"))).withColumnRenamed("raw_ord", "region_idx")
    own = fixture(spark, sf_dir, "lines").withColumnRenamed("line_ord", "line_idx")
    return assign.crops(regions, own)


@query(f"{CROPS_SQL} SELECT page_id, crop_idx, region_idx, line_idx, is_fallback, x1, y1, x2, y2 FROM crops", "lines", "regions_nested")
def crops_with_fallback(spark, sf_dir):
    """A crop per line, else the whole region."""
    return nested_crops(spark, sf_dir).select("page_id", "crop_idx", "region_idx", "line_idx", "is_fallback", *BOX)


@query(
    """ SELECT page_id, raw_ord, x, y, greatest(least(CAST(trunc(x2) AS BIGINT) + 8, 400) - x, 1) AS w, greatest(least(CAST(trunc(y2) AS BIGINT) + 8, 110) - y, 1) AS h
FROM (SELECT *, greatest(CAST(trunc(x1) AS BIGINT) - 8, 0) AS x, greatest(CAST(trunc(y1) AS BIGINT) - 8, 0) AS y FROM boxes)""",
    "boxes",
)
def crop_windows(spark, sf_dir):
    """Pixel windows with padding."""
    rows = fixture(spark, sf_dir, "boxes").withColumns({"page_w": F.lit(400), "page_h": F.lit(110)})
    return assign.with_windows(rows, 8).select("page_id", "raw_ord", *[F.col(c).cast("long").alias(c) for c in "xywh"])


@query(
    """, widths AS (SELECT page_id, CAST(least(greatest(round(48.0::DOUBLE * w / h), 1), 3200) AS INT) AS width, page_id % 7 AS grp FROM page_sizes),
batches AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY grp ORDER BY width, page_id) - 1) / 8) AS INT) AS batch_no FROM widths)
SELECT page_id, width, batch_no, max(width) OVER (PARTITION BY grp, batch_no) AS pad_width FROM batches""",
    "page_sizes",
)
def width_batches(spark, sf_dir):
    """Crops sorted by width, in batches padded to their widest."""
    rows = fixture(spark, sf_dir, "page_sizes").select("page_id", geometry.recognition_width(F.col("w"), F.col("h")).alias("width"), (F.col("page_id") % 7).alias("grp"))
    return assign.width_batches(rows, "page_id", "grp", 8).select("page_id", "width", "batch_no", "pad_width")


# sizes


@query(
    """ SELECT page_id, CAST(greatest(round(w * ratio / 32), 1) * 32 AS INT) AS rw, CAST(greatest(round(h * ratio / 32), 1) * 32 AS INT) AS rh FROM (
  SELECT *, CASE WHEN greatest(w, h) * r0 > 1280 THEN 1280.0::DOUBLE / greatest(w, h) ELSE r0 END AS ratio FROM (
    SELECT *, CASE WHEN least(w, h) < 736 THEN 736.0::DOUBLE / least(w, h) ELSE 1.0::DOUBLE END AS r0 FROM page_sizes))""",
    "page_sizes",
)
def det_resize(spark, sf_dir):
    """Detector input sizes."""
    w, h = geometry.det_size(F.col("w"), F.col("h"))
    return fixture(spark, sf_dir, "page_sizes").select("page_id", w.alias("rw"), h.alias("rh"))


@query(" SELECT page_id, CAST(least(greatest(round(48.0::DOUBLE * w / h), 1), 3200) AS INT) AS width FROM page_sizes", "page_sizes")
def rec_width(spark, sf_dir):
    """Recogniser input widths."""
    return fixture(spark, sf_dir, "page_sizes").select("page_id", geometry.recognition_width(F.col("w"), F.col("h")).alias("width"))


@query(" SELECT page_id, 800.0::DOUBLE / h AS scale_h, 800.0::DOUBLE / w AS scale_w FROM page_sizes", "page_sizes")
def scale_factor(spark, sf_dir):
    """Layout scale factors."""
    h, w = geometry.scale_factor(F.col("w"), F.col("h"))
    return fixture(spark, sf_dir, "page_sizes").select("page_id", h.alias("scale_h"), w.alias("scale_w"))


@query(
    """ SELECT page_id, fw, fh, CAST(floor((384 - fw) / 2) AS INT) AS fx, CAST(floor((384 - fh) / 2) AS INT) AS fy FROM (
  SELECT page_id, CAST(least(greatest(round(w * s), 1), 384) AS INT) AS fw, CAST(least(greatest(round(h * s), 1), 384) AS INT) AS fh
  FROM (SELECT *, least(384.0::DOUBLE / w, 384.0::DOUBLE / h) AS s FROM page_sizes))""",
    "page_sizes",
)
def formula_fit(spark, sf_dir):
    """Size and place of a formula on its square."""
    fit = geometry.formula_fit(F.col("w"), F.col("h"))
    return fixture(spark, sf_dir, "page_sizes").select("page_id", *[c.alias(n) for c, n in zip(fit, ("fw", "fh", "fx", "fy"), strict=True)])


# decoding


@query(
    """, marked AS (SELECT *, lag(token_id, 1, 0) OVER (PARTITION BY seq_id ORDER BY step) AS before FROM steps),
kept AS (SELECT *, token_id BETWEEN 1 AND 3 AND token_id <> before AS keep FROM marked)
SELECT seq_id, coalesce(string_agg(substr('abc', token_id, 1), '' ORDER BY step) FILTER (WHERE keep), '') AS text,
       round(coalesce(avg(prob) FILTER (WHERE keep), 0), 9) AS confidence FROM kept GROUP BY seq_id""",
    "steps",
)
def ctc_decode(spark, sf_dir):
    """Collapse over a relation of steps."""
    symbols = F.broadcast(vocabulary.symbol_table(spark, SYMBOLS))
    out = decode.ctc_steps(fixture(spark, sf_dir, "steps"), symbols)
    return out.select("seq_id", "text", F.round("confidence", 9).alias("confidence"))


def step_arrays(spark, sf_dir) -> DataFrame:
    grouped = fixture(spark, sf_dir, "steps").groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("step", "token_id", "prob"))).alias("s"))
    return grouped.select("seq_id", F.transform("s", lambda x: x["token_id"].cast("long")).alias("token_ids"), F.transform("s", lambda x: x["prob"]).alias("token_probs"))


@query(SQL["ctc_decode"])
def ctc_arrays(spark, sf_dir):
    """The same collapse over arrays."""
    return decode.ctc(step_arrays(spark, sf_dir), SYMBOLS).select("seq_id", "text", F.round("confidence", 9).alias("confidence"))


@query(
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS class_id FROM embeddings"""
)
def ctc_argmax(spark, sf_dir):
    """A4, A5: the first largest class of a step."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("probs", F.array("embedding"))
    return decode.compact(rows).select("vec_id", F.get("token_ids", F.lit(0)).alias("class_id"))


@query(
    """, seqs AS (SELECT seq_id, [a, b, c, d] AS ids FROM formula_steps),
cut AS (SELECT seq_id, CASE WHEN list_position(ids, 2) > 0 THEN ids[1:list_position(ids, 2) - 1] ELSE ids END AS ids FROM seqs)
SELECT seq_id, list_filter(ids, lambda t: t >= 23 AND t < 50) AS ids FROM cut""",
    "formula_steps",
)
def formula_tokens(spark, sf_dir):
    """Formula ids up to the end mark."""
    rows = fixture(spark, sf_dir, "formula_steps").select("seq_id", F.array("a", "b", "c", "d").alias("ids"))
    return rows.select("seq_id", decode.formula_ids(F.col("ids"), len(TOKENS)).alias("ids"))


@query(
    """, seqs AS (SELECT seq_id, [a, b, c, d] AS ids FROM formula_steps),
cut AS (SELECT seq_id, CASE WHEN list_position(ids, 2) > 0 THEN ids[1:list_position(ids, 2) - 1] ELSE ids END AS ids FROM seqs),
kept AS (SELECT seq_id, list_filter(ids, lambda t: t >= 23 AND t < 50) AS ids FROM cut),
texts AS (SELECT seq_id, array_to_string(list_transform(ids, lambda t: CASE WHEN (t - 23) % 3 = 0 THEN ' ' ELSE chr(CAST(97 + (t - 23) % 26 AS INT)) END), '') AS latex FROM kept)
SELECT seq_id, latex, CASE WHEN trim(latex) = '' THEN '' ELSE '$$' || chr(10) || trim(latex) || chr(10) || '$$' END AS content FROM texts""",
    "formula_steps",
)
def formula_text(spark, sf_dir):
    """Formula ids to LaTeX and its Markdown."""
    rows = fixture(spark, sf_dir, "formula_steps").select("seq_id", F.array("a", "b", "c", "d").alias("token_ids"))
    return decode.formula(rows, TOKENS).select("seq_id", "latex", markdown.formula_markdown(F.col("latex")).alias("content"))


ASCII = r"^[\x00-\x7F]*"


@query(
    f"SELECT conv_id, turn, text, regexp_extract(text, '{ASCII}') || CASE WHEN strlen(text) > strlen(regexp_extract(text, '{ASCII}')) THEN chr(65533) ELSE '' END AS cut FROM conversations"
)
def bpe_decode(spark, sf_dir):
    """Byte-level letters of whole texts to texts, and those up to within the first
    letter of several bytes, where what is broken is replaced."""
    plain = F.length(F.regexp_extract("text", ASCII, 0))
    within = plain + F.greatest(F.octet_length(F.substring("text", plain + 1, F.lit(1))) - 1, F.lit(0))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", byte_level_letters(F.col("text")).alias("letters"), within.alias("n"))
    cut = F.substring("letters", F.lit(1), F.col("n"))
    return rows.select("conv_id", "turn", byte_level_text(F.col("letters")).alias("text"), byte_level_text(cut).alias("cut"))


# text and Markdown

TRIM_SQL = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(f" SELECT region_id, line_ord, {TRIM_SQL} AS text FROM rec_lines WHERE confidence >= 0.3 AND length({TRIM_SQL}) > 0", "rec_lines")
def rec_filter(spark, sf_dir):
    """Confidence and blank filters, trimmed text."""
    return markdown.keep_recognised(fixture(spark, sf_dir, "rec_lines"), 0.3).select("region_id", "line_ord", "text")


REGION_SQL = f"""
SELECT region_id, label, CASE label WHEN 'doc_title' THEN '# ' || string_agg(text, ' ' ORDER BY line_ord)
       WHEN 'paragraph_title' THEN '## ' || string_agg(text, ' ' ORDER BY line_ord) ELSE string_agg(text, chr(10) ORDER BY line_ord) END AS content
FROM (SELECT region_id, line_ord, {TRIM_SQL} AS text, CASE region_id % 3 WHEN 0 THEN 'doc_title' WHEN 1 THEN 'paragraph_title' ELSE 'text' END AS label
      FROM rec_lines WHERE confidence >= 0.2 AND length({TRIM_SQL}) > 0) GROUP BY region_id, label"""


def contents(spark, sf_dir) -> DataFrame:
    label = F.when(F.col("region_id") % 3 == 0, "doc_title").when(F.col("region_id") % 3 == 1, "paragraph_title").otherwise("text")
    rows = markdown.keep_recognised(fixture(spark, sf_dir, "rec_lines"), 0.2).withColumn("label", label)
    return markdown.region_markdown(rows, ["region_id"], "line_ord")


@query(REGION_SQL, "rec_lines")
def region_markdown(spark, sf_dir):
    """Ordered lines to a region's Markdown."""
    return contents(spark, sf_dir).select("region_id", "label", "content")


@query(
    f""", r AS ({REGION_SQL})
SELECT CAST(floor(region_id / 4) AS BIGINT) AS page_id, string_agg(content, chr(10) || chr(10) ORDER BY region_id) AS markdown
FROM r WHERE content <> '' GROUP BY 1""",
    "rec_lines",
)
def document_markdown(spark, sf_dir):
    """Paragraphs to documents."""
    paragraphs = contents(spark, sf_dir).withColumn("page_id", F.floor(F.col("region_id") / 4)).withColumnRenamed("region_id", "para_idx")
    return markdown.documents(paragraphs)


@query("SELECT doc_id, length(text) = 0 AS blank, length(text) AS chars FROM documents")
def text_trim(spark, sf_dir):
    """Trimming whole texts loses nothing but white space at the ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inner = F.length(utrim(F.concat(F.lit(" 　\t"), F.col("text"), F.lit("\u0085 \n")))) + F.length("text") - F.length(utrim(F.col("text")))
    return docs.select("doc_id", is_blank(F.col("text")).alias("blank"), inner.cast("long").alias("chars"))


# whole pages

PAGE_SQL = f"""{NMS_SQL},
regions AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, nms_rank) - 1 AS region_idx FROM survivors WHERE label IN {names_sql(ClassConfig.all().enabled)}),
text_regions AS (SELECT * FROM regions WHERE label IN {names_sql(TEXT)}){ORDERED_SQL},
owned AS (
  SELECT page_id, line_idx, line_ord, region_idx, lx1 AS x1 FROM (
    SELECT l.page_id, l.line_idx, l.line_ord, l.x1 AS lx1, r.region_idx,
           row_number() OVER (PARTITION BY l.page_id, l.line_idx ORDER BY (r.x2 - r.x1) * (r.y2 - r.y1), r.region_idx) AS rn
    FROM ordered l JOIN text_regions r ON l.page_id = r.page_id
     AND (l.x1 + l.x2) / 2 >= r.x1 AND (l.x1 + l.x2) / 2 <= r.x2 AND (l.y1 + l.y2) / 2 >= r.y1 AND (l.y1 + l.y2) / 2 <= r.y2) WHERE rn = 1),
texts AS (
  SELECT r.page_id, r.region_idx, r.label, o.line_idx, trim(coalesce(t.text, 'region ' || r.region_idx)) AS text, coalesce(t.confidence, 1) AS confidence
  FROM text_regions r LEFT JOIN owned o ON o.page_id = r.page_id AND o.region_idx = r.region_idx LEFT JOIN line_texts t ON t.page_id = o.page_id AND t.line_ord = o.line_ord),
contents AS (
  SELECT page_id, region_idx, CASE label WHEN 'doc_title' THEN '# ' || string_agg(text, ' ' ORDER BY line_idx)
         WHEN 'paragraph_title' THEN '## ' || string_agg(text, ' ' ORDER BY line_idx) ELSE string_agg(text, chr(10) ORDER BY line_idx) END AS content
  FROM texts WHERE confidence >= 0.2 AND text <> '' GROUP BY page_id, region_idx, label),
paragraphs AS (
  SELECT r.page_id, r.region_idx AS para_idx, r.label AS paragraph_type, r.x1, r.y1, r.x2, r.y2, coalesce(c.content, '') AS content
  FROM regions r LEFT JOIN contents c USING (page_id, region_idx))"""


def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages behind the models, over recorded rows: boxes, lines and their texts."""
    config = PageConfig(ClassConfig.all()).with_recognition_threshold(0.2)
    regions = recognise.regions_of(filtered(spark, sf_dir), config)
    ordered = lines.reading_order(fixture(spark, sf_dir, "lines"))
    texts = fixture(spark, sf_dir, "line_texts")

    def recorded(crops: DataFrame) -> DataFrame:
        met = assign.within_page(crops, texts, "line_ord")
        return met.withColumn("text", F.coalesce("text", F.concat(F.lit("region "), F.col("region_idx").cast("string")))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))

    return recognise.paragraphs_of(regions, recognise.text_contents(regions, ordered, recorded, config, ("line_ord",)))


_PAGES = ("boxes", "lines", "line_texts")


@query(f"{PAGE_SQL} SELECT page_id, para_idx, paragraph_type, x1, y1, x2, y2, content FROM paragraphs", *_PAGES)
def page_pipeline(spark, sf_dir):
    """Recorded model rows to paragraphs."""
    box = [F.get("bbox", F.lit(k)).cast("double").alias(c) for k, c in enumerate(BOX)]
    return page_paragraphs(spark, sf_dir).select("page_id", "para_idx", "paragraph_type", *box, "content")


@query(
    f"{PAGE_SQL} SELECT page_id, string_agg(content, chr(10) || chr(10) ORDER BY para_idx) AS markdown FROM paragraphs WHERE content <> '' GROUP BY page_id",
    *_PAGES,
)
def page_documents(spark, sf_dir):
    """A11 over the page pipeline: one Markdown document per page."""
    return markdown.documents(page_paragraphs(spark, sf_dir))


@query(f"{PAGE_SQL} SELECT page_id, paragraph_type, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM paragraphs GROUP BY page_id, paragraph_type", *_PAGES)
def page_report(spark, sf_dir):
    """Paragraphs per page and type."""
    from quire.sources.pages import report

    return report(page_paragraphs(spark, sf_dir))


# vocabulary


@query(
    """, v AS (SELECT DISTINCT CAST(a AS INT) AS token_id, 'v' || a AS token FROM formula_steps), m AS (SELECT * FROM v WHERE token_id % 5 <> 0
UNION ALL SELECT token_id, 'added' || token_id FROM v WHERE token_id % 5 = 0) SELECT token_id, token FROM m""",
    "formula_steps",
)
def vocab_overlay(spark, sf_dir):
    """A vocabulary with added tokens, ids checked."""
    ids = fixture(spark, sf_dir, "formula_steps").select(F.col("a").cast("int").alias("token_id")).distinct()
    vocab = ids.select("token_id", F.concat(F.lit("v"), F.col("token_id").cast("string")).alias("token"))
    added = ids.where("token_id % 5 = 0").select("token_id", F.concat(F.lit("added"), F.col("token_id").cast("string")).alias("token"))
    return vocabulary.overlay_vocabulary(vocab, added)


@query(
    """, v AS (SELECT DISTINCT CAST(a AS INT) AS id FROM formula_steps)
SELECT id, CASE id % 7 WHEN 0 THEN ' ' WHEN 1 THEN chr(12288) WHEN 2 THEN '' WHEN 3 THEN chr(9) || id ELSE 'token' || id || ' ' END AS symbol FROM v""",
    "formula_steps",
)
def vocab_files(spark, sf_dir):
    """Symbols, white space among them, written as a file and read back in its order."""
    from quire.sources.store import shared_folder

    k = F.col("a").cast("int")
    other = F.concat(F.lit("token"), k.cast("string"), F.lit(" "))
    token = F.when(k % 7 == 0, " ").when(k % 7 == 1, "\u3000").when(k % 7 == 2, "").when(k % 7 == 3, F.concat(F.lit("\t"), k.cast("string"))).otherwise(other)
    path = f"{shared_folder(spark)}/vocabulary-{uuid.uuid4().hex}"
    vocabulary.write_vocabulary(fixture(spark, sf_dir, "formula_steps").select(k.alias("token_id"), token.alias("token")).distinct(), path)
    return vocabulary.read_symbol_table(spark, path)


# pixels: shapes by SQL over pairs of points, contours by SQL over the drawn boxes


def _points(spark, sf_dir, name: str = "lines") -> DataFrame:
    rows = fixture(spark, sf_dir, name)
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_ord", "x1", "y1"))).alias("points"))
    return pages.repartition(spark.sparkContext.defaultParallelism)  # few bytes, but much work


def _shape(spark, sf_dir, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = [[{"x": float(x), "y": float(y)} for x, y in work(np.array([(p["x1"], p["y1"]) for p in ps]))] for ps in batch.column("points").to_pylist()]
            kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, kind)], names=["page_id", "corners"])

    return _points(spark, sf_dir).mapInArrow(run, "page_id long, corners array<struct<x:double,y:double>>")


HULL_SQL = """, p AS (SELECT DISTINCT page_id, x1 AS x, y1 AS y FROM lines),
edges AS (
  SELECT a.page_id, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy
  FROM p a JOIN p b ON a.page_id = b.page_id AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (
    SELECT 1 FROM p c WHERE c.page_id = a.page_id AND (
      (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
      OR (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0
        AND ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 OR (c.x - b.x) * (a.x - b.x) + (c.y - b.y) * (a.y - b.y) < 0)))
)
"""


@query(
    HULL_SQL + " SELECT DISTINCT page_id, ax AS x, ay AS y FROM edges UNION SELECT page_id, min(x), min(y) FROM p GROUP BY page_id HAVING count(*) = 1",
    "lines",
)
def convex_hull(spark, sf_dir):
    """Hull corners of a page's points."""
    corners = _shape(spark, sf_dir, pixels.convex_hull).select("page_id", F.explode("corners").alias("c"))
    return corners.select("page_id", "c.x", "c.y")


#: Corners of the smallest rectangle, grown by d on every side; of one point, four times that.
CORNERS_SQL = """, turned AS (
  SELECT e.page_id, e.ax, e.ay, (qx - ax) / sqrt((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)) AS ux, (qy - ay) / sqrt((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)) AS uy,
         min((qx - ax) * x + (qy - ay) * y) / sqrt((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)) AS u1, max((qx - ax) * x + (qy - ay) * y) / sqrt((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)) AS u2,
         min((qx - ax) * y - (qy - ay) * x) / sqrt((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)) AS v1, max((qx - ax) * y - (qy - ay) * x) / sqrt((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)) AS v2
  FROM edges e JOIN p ON e.page_id = p.page_id GROUP BY e.page_id, ax, ay, qx, qy
), best AS (
  SELECT *, CASE WHEN least(u2 - u1, v2 - v1) < 1e-6 THEN 0 ELSE (u2 - u1) * (v2 - v1) * {ratio} / (2 * (u2 - u1 + v2 - v1)) END AS d
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round((u2 - u1) * (v2 - v1), 6), ax, ay) AS rn FROM turned) WHERE rn = 1
), corners AS (
  SELECT page_id, unnest([(u1 - d) * ux - (v1 - d) * uy, (u2 + d) * ux - (v1 - d) * uy, (u2 + d) * ux - (v2 + d) * uy, (u1 - d) * ux - (v2 + d) * uy]) AS x,
         unnest([(u1 - d) * uy + (v1 - d) * ux, (u2 + d) * uy + (v1 - d) * ux, (u2 + d) * uy + (v2 + d) * ux, (u1 - d) * uy + (v2 + d) * ux]) AS y FROM best
  UNION ALL SELECT page_id, min(x), unnest([min(y), min(y), min(y), min(y)]) FROM p GROUP BY page_id HAVING count(*) = 1)
SELECT page_id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM corners"""


def _corners(found: DataFrame) -> DataFrame:
    corners = found.select("page_id", F.explode("corners").alias("c"))
    return corners.select("page_id", *[(F.round(f"c.{a}", 3) + F.lit(0.0)).alias(a) for a in ("x", "y")])


@query(HULL_SQL + CORNERS_SQL.format(ratio=0), "lines")
def min_area_quad(spark, sf_dir):
    """The corners of the smallest rectangle around a page's points."""
    return _corners(_shape(spark, sf_dir, pixels.min_area_quad))


@query(HULL_SQL + CORNERS_SQL.format(ratio=pixels.UNCLIP), "lines")
def quad_unclip(spark, sf_dir):
    """The corners of that rectangle, turned as it is, when it is grown."""
    return _corners(_shape(spark, sf_dir, lambda p: pixels.unclip(pixels.min_area_quad(p))))


#: Small images: channel c of the pixel (x, y).  With ink 0 an image is flat but for a
#: dark block, with 1 all flat, with 2 full of colour.
PIXELS_SQL = """,
px AS (
  SELECT page_id, w, h, x, y, c,
         CASE ink WHEN 0 THEN CASE WHEN x BETWEEN 1 AND w - 2 AND y BETWEEN 1 AND h - 2 THEN (base + c * 5) % 90 ELSE 250 END
                  WHEN 1 THEN base ELSE (base + y * 29 + x * 17 + c * 71 + x * y * 7) % 256 END AS v
  FROM (SELECT *, unnest(range(3)) AS c FROM (SELECT *, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM images))))"""


def _images(rows: DataFrame, *keep: str) -> DataFrame:
    """(page_id, w, h, data): the bytes of each image, row by row."""
    w, h, base = F.col("w"), F.col("h"), F.col("base")

    def value(i):
        c, x = i % 3, (i / 3).cast("int") % w
        y = ((i / 3).cast("int") / w).cast("int")
        block = F.when((x >= 1) & (x <= w - 2) & (y >= 1) & (y <= h - 2), (base + c * 5) % 90).otherwise(250)
        return F.when(F.col("ink") == 0, block).when(F.col("ink") == 1, base).otherwise((base + y * 29 + x * 17 + c * 71 + x * y * 7) % 256)

    return rows.select("page_id", "w", "h", *keep, F.transform(F.sequence(F.lit(0), w * h * 3 - 1), value).alias("data"))


#: Images that a step of Python works on at once.
IMAGES = 2000


def _imaged(spark, sf_dir, work: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str], kind: str) -> DataFrame:
    """(page_id, place, names): arrays that `work` makes of images (n, height, width, 3) of
    one size, n flat rows each or a list of them, a row a place."""
    import pyarrow as pa

    arrow = {"double": pa.float64(), "int": pa.int32()}[kind]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, IMAGES):
                part = batch.slice(at, IMAGES)
                pages, w, h = (part.column(c).to_numpy(zero_copy_only=False) for c in ("page_id", "w", "h"))
                data = part.column("data").flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
                ends = np.cumsum(3 * w.astype(np.int64) * h)
                for size in np.unique(np.column_stack([h, w]), axis=0).tolist():
                    own = np.flatnonzero((h == size[0]) & (w == size[1]))
                    n = 3 * size[0] * size[1]
                    found = work(data[(ends[own] - n)[:, None] + np.arange(n)].reshape(-1, *size, 3))
                    rows = [[np.ravel(x) for x in found[c]] for c in names]
                    sizes = np.array([len(x) for x in rows[0]])
                    places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    columns = [pa.array(np.repeat(pages[own], sizes), pa.int64()), pa.array(places, pa.int32()), *(pa.array(np.concatenate(r), arrow) for r in rows)]
                    yield pa.RecordBatch.from_arrays(columns, names=["page_id", "place", *names])

    rows = fixture(spark, sf_dir, "images").repartition(spark.sparkContext.defaultParallelism)  # few bytes, but much work
    return _images(rows).mapInArrow(run, "page_id long, place int, " + ", ".join(f"{n} {kind}" for n in names))


def _each(work: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], list[np.ndarray]]:
    return lambda images: [work(image) for image in images]


def resize_sql(source: str, to_w: str, to_h: str, sizes: str | None = None) -> str:
    """Triangle resampling of rows (page_id, w, h, x, y, c, v) as a weighted join; `sizes`
    has the columns that to_w and to_h name."""
    sizes = sizes or f"(SELECT DISTINCT page_id, w, h FROM {source})"

    def weights(axis: str, size: str, to: str) -> str:
        return (
            f"SELECT page_id, i, j, wt / sum(wt) OVER (PARTITION BY page_id, i) AS wt FROM (SELECT page_id, i, j, greatest(0, 1 - abs(j + 0.5::DOUBLE - (i + 0.5::DOUBLE) * {size} / n) / greatest({size}::DOUBLE / n, 1)) AS wt "
            f"FROM (SELECT page_id, {size}, n, i, unnest(range({size})) AS j FROM (SELECT page_id, {size}, {to} AS n, unnest(range({to})) AS i FROM {sizes}))) WHERE wt > 0"
        )

    return f""",
{source}_wx AS ({weights('x', 'w', to_w)}),
{source}_wy AS ({weights('y', 'h', to_h)}),
{source}_resized AS (
  SELECT s.page_id, a.i AS x, b.i AS y, c, CAST(least(greatest(floor(sum(v * a.wt * b.wt) + 0.5 + 1e-9), 0), 255) AS INT) AS v
  FROM {source} s JOIN {source}_wx a ON a.page_id = s.page_id AND a.j = s.x JOIN {source}_wy b ON b.page_id = s.page_id AND b.j = s.y GROUP BY s.page_id, a.i, b.i, c)"""


@query(PIXELS_SQL + resize_sql("px", "7", "4") + " SELECT page_id, CAST((y * 7 + x) * 3 + c AS INT) AS place, v FROM px_resized", "images")
def image_resize(spark, sf_dir):
    """Triangle resampling, up in one direction and down in the other, pixel by pixel."""
    return _imaged(spark, sf_dir, lambda images: {"v": pixels.resize_all(images, 7, 4)}, ["v"], "int")


@query(
    PIXELS_SQL
    + """,
scaled AS (SELECT *, CAST(v AS FLOAT) / CAST(255 AS FLOAT) AS s, CAST([0.485, 0.456, 0.406][c + 1] AS FLOAT) AS mean, CAST([0.229, 0.224, 0.225][c + 1] AS FLOAT) AS std FROM px)
SELECT page_id, CAST((c * h + y) * w + x AS INT) AS place, CAST(s AS DOUBLE) AS layout, CAST((s - mean) / std AS DOUBLE) AS detection,
       CAST((s - CAST(0.5 AS FLOAT)) / CAST(0.5 AS FLOAT) AS DOUBLE) AS recognition FROM scaled""",
    "images",
)
def image_planes(spark, sf_dir):
    """Channels first, scaled and normalised for each model."""
    return _imaged(spark, sf_dir, lambda images: {"layout": _each(pixels.planes)(images), "detection": _each(pixels.det_planes)(images), "recognition": _each(pixels.rec_planes)(images)}, ["layout", "detection", "recognition"], "double")


MARGIN_SQL = (
    PIXELS_SQL
    + """,
gray AS (SELECT page_id, w, h, x, y, 0 AS c, CAST(floor(sum(v * [0.0722, 0.7152, 0.2126][c + 1]::DOUBLE) + 1e-9) AS INT) AS v FROM px GROUP BY page_id, w, h, x, y),
stretched AS (SELECT *, min(v) OVER (PARTITION BY page_id) AS low, max(v) OVER (PARTITION BY page_id) AS high FROM gray),
dark AS (
  SELECT page_id, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2
  FROM stretched WHERE high > low AND CAST(v - low AS FLOAT) / CAST(high - low AS FLOAT) * CAST(255 AS FLOAT) < CAST(200 AS FLOAT) GROUP BY page_id),
margin AS (
  SELECT g.page_id, coalesce(x2 - x1 + 1, w) AS w, coalesce(y2 - y1 + 1, h) AS h, x - coalesce(x1, 0) AS x, y - coalesce(y1, 0) AS y, c, v
  FROM gray g LEFT JOIN dark d USING (page_id) WHERE d.page_id IS NULL OR x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2)"""
)


@query(MARGIN_SQL + " SELECT page_id, CAST(y * w + x AS INT) AS place, v FROM margin", "images")
def image_margin(spark, sf_dir):
    """Luma, and the box of what is dark once the contrast is stretched."""
    return _imaged(spark, sf_dir, lambda images: {"v": _each(pixels.crop_margin)(pixels.gray(images))}, ["v"], "int")


@query(
    MARGIN_SQL
    + """,
fitted AS (
  SELECT *, CAST(least(12, greatest(1, floor(w * s + 0.5))) AS BIGINT) AS to_w, CAST(least(12, greatest(1, floor(h * s + 0.5))) AS BIGINT) AS to_h
  FROM (SELECT DISTINCT page_id, w, h, least(12.0::DOUBLE / w, 12.0::DOUBLE / h) AS s FROM margin))"""
    + resize_sql("margin", "to_w", "to_h", "fitted")
    + """
SELECT f.page_id, CAST(py * 12 + p AS INT) AS place, round((coalesce(v, 255) / 255.0::DOUBLE - 0.7931) / 0.1738, 4) AS v
FROM (SELECT page_id, to_w, to_h, p, unnest(range(12)) AS py FROM (SELECT page_id, to_w, to_h, unnest(range(12)) AS p FROM fitted)) f
LEFT JOIN margin_resized r ON r.page_id = f.page_id AND r.x = p - (12 - to_w) // 2 AND r.y = py - (12 - to_h) // 2""",
    "images",
)
def image_formula(spark, sf_dir):
    """Margin, fit, white canvas and normalisation of a formula's image (on 12 x 12)."""
    found = _imaged(spark, sf_dir, lambda images: {"v": pixels.formula_inputs(images, side=12)}, ["v"], "double")
    return found.select("page_id", "place", F.round("v", 4).alias("v"))


@query(
    """, sized AS (SELECT page_id % 11 AS grp, page_id, CAST(least(greatest(floor(48.0::DOUBLE * w / h + 0.5), 1), 3200) AS INT) AS width FROM images),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY grp ORDER BY width, page_id) - 1) // 8 AS batch FROM sized),
padded AS (SELECT *, max(width) OVER (PARTITION BY grp, batch) AS pad_width FROM numbered)
SELECT grp, page_id, width, pad_width, 3 * 48 * (pad_width - width) AS zeros FROM padded""",
    "images",
)
def image_batches(spark, sf_dir):
    """Recognition batches of images, padded with zeros to the widest."""
    import pyarrow as pa

    kinds = {"grp": pa.int64(), "page_id": pa.int64(), "width": pa.int32(), "pad_width": pa.int32(), "zeros": pa.int64()}

    def run(batches):
        for batch in batches:
            out = []
            for grp, own in zip(batch.column("grp").to_pylist(), batch.column("ps").to_pylist(), strict=True):
                ps = sorted(own, key=lambda p: p["page_id"])
                crops = [np.array(p["data"], np.uint8).reshape(p["h"], p["w"], 3) for p in ps]
                for places, x in pixels.rec_batches(crops, 8):
                    for k, padded in zip(places, x, strict=True):
                        width = pixels.rec_width(ps[k]["w"], ps[k]["h"])
                        out.append((grp, ps[k]["page_id"], width, x.shape[3], int((padded[:, :, width:] == 0).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    rows = fixture(spark, sf_dir, "images").withColumns({"grp": F.col("page_id") % 11, "width": geometry.recognition_width(F.col("w"), F.col("h"))})
    dealt = assign.batch_numbers(rows, "page_id", "grp", 8).repartition("grp", "batch_no")
    grouped = _images(dealt, "grp", "batch_no").groupBy("grp", "batch_no").agg(F.collect_list(F.struct("page_id", "w", "h", "data")).alias("ps"))
    return grouped.mapInArrow(run, "grp long, page_id long, width int, pad_width int, zeros long")


@query(
    f"{NMS_SQL}, regions AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, nms_rank) - 1 AS region_idx FROM survivors), "
    "own AS (SELECT page_id, region_idx, greatest(x1 - 8, 0) AS x, greatest(y1 - 8, 0) AS y, least(x2 + 8, 600) AS r, least(y2 + 8, 800) AS b FROM regions WHERE label = 'formula') "
    "SELECT page_id, region_idx, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(r - x AS BIGINT) AS w, CAST(b - y AS BIGINT) AS h FROM own",
    "boxes",
)
def formula_windows(spark, sf_dir):
    """F8, P10: the windows of a page's formulas, with their padding."""
    regions = recognise.regions_of(filtered(spark, sf_dir), PageConfig(ClassConfig.all()))
    own = regions.where(F.col("label") == FORMULA).withColumns({"page_w": F.lit(600), "page_h": F.lit(800)})
    return assign.with_windows(own, recognise.FORMULA_PADDING).select("page_id", "region_idx", "x", "y", "w", "h")


#: Boxes of a page's lines, drawn one over the other on a map of 512 x 128: which touch
#: (also at a corner), the gaps that they enclose, and every contour's place in order.
CONTOUR_SQL = """,
b AS (SELECT page_id, CAST(x1 AS BIGINT) AS x, CAST(y1 AS BIGINT) AS y, row_number() OVER (PARTITION BY page_id ORDER BY line_ord) - 1 AS k FROM lines),
near AS (SELECT p.page_id, p.k, q.k AS j FROM b p JOIN b q ON p.page_id = q.page_id AND abs(p.x - q.x) <= 40 AND abs(p.y - q.y) <= 8),
reach AS RECURSIVE (
  SELECT page_id, k, j FROM near UNION SELECT r.page_id, r.k, n.j FROM reach r JOIN near n ON n.page_id = r.page_id AND n.k = r.j),
owner AS (SELECT page_id, k, min(j) AS shape FROM reach GROUP BY page_id, k),
outer_points AS (
  SELECT page_id, shape, unnest([x, x + 39, x, x + 39]) AS x, unnest([y, y, y + 7, y + 7]) AS y, min(y * 1000 + x - 1) OVER (PARTITION BY page_id, shape) AS start
  FROM b JOIN owner USING (page_id, k)),
covered AS (SELECT page_id, x, y + unnest(range(8)) AS y FROM b),
steps AS (SELECT *, CASE WHEN x <= max(x) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 40 THEN 0 ELSE 1 END AS opens FROM covered),
runs AS (
  SELECT page_id, y, min(x) AS a, max(x) + 39 AS c
  FROM (SELECT *, sum(opens) OVER (PARTITION BY page_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS run FROM steps) GROUP BY page_id, y, run),
gaps AS (
  SELECT page_id, y, before + 1 AS a, a - 1 AS c FROM (SELECT *, lag(c) OVER (PARTITION BY page_id, y ORDER BY a) AS before FROM runs) WHERE before IS NOT NULL),
reaches AS (SELECT page_id, y, min(a) AS a, max(c) AS c FROM runs GROUP BY page_id, y),
open_gaps AS RECURSIVE (
  SELECT g.page_id, g.y, g.a, g.c FROM gaps g JOIN (SELECT unnest([-1, 1]) AS d) s ON true LEFT JOIN reaches r ON r.page_id = g.page_id AND r.y = g.y + s.d
  WHERE r.y IS NULL OR g.a < r.a OR g.c > r.c
  UNION
  SELECT g.page_id, g.y, g.a, g.c FROM open_gaps o JOIN gaps g ON g.page_id = o.page_id AND abs(g.y - o.y) = 1 AND g.a <= o.c AND o.a <= g.c),
holes AS (SELECT * FROM gaps EXCEPT SELECT * FROM open_gaps),
joined AS RECURSIVE (
  SELECT page_id, y, a, c, y * 1000 + a AS other FROM holes
  UNION
  SELECT h.page_id, h.y, h.a, h.c, j.other FROM joined j JOIN holes h ON h.page_id = j.page_id AND abs(h.y - j.y) = 1 AND h.a <= j.c AND j.a <= h.c),
hole AS (SELECT page_id, y, a, c, min(other) AS first FROM joined GROUP BY page_id, y, a, c),
hole_points AS (
  SELECT page_id, 1000000 + first AS shape, unnest([a - 1, c + 1]) AS x, y, first - 1 AS start FROM hole
  UNION ALL
  SELECT h.page_id, 1000000 + first, unnest([greatest(h.a, r.a), least(h.c, r.c)]), r.y, first - 1
  FROM hole h JOIN runs r ON r.page_id = h.page_id AND abs(r.y - h.y) = 1 AND r.a <= h.c AND h.a <= r.c),
shape_points AS (SELECT * FROM outer_points UNION ALL SELECT * FROM hole_points),
ends AS (SELECT page_id, shape, y, start, unnest([min(x), max(x)]) AS x FROM shape_points GROUP BY page_id, shape, y, start),
p AS (SELECT DISTINCT page_id, shape, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM ends),
contour AS (SELECT page_id, shape, row_number() OVER (PARTITION BY page_id ORDER BY start) - 1 AS line_ord FROM (SELECT DISTINCT page_id, shape, start FROM ends)),
edges AS (
  SELECT a.page_id, a.shape, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy
  FROM p a JOIN p b ON a.page_id = b.page_id AND a.shape = b.shape AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (
    SELECT 1 FROM p c WHERE c.page_id = a.page_id AND c.shape = a.shape AND (
      (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
      OR (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0
        AND ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 OR (c.x - b.x) * (a.x - b.x) + (c.y - b.y) * (a.y - b.y) < 0)))),
rectangles AS (
  SELECT page_id, shape, ax, ay, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy,
         min(dx * x + dy * y) / sqrt(dx * dx + dy * dy) AS u1, max(dx * x + dy * y) / sqrt(dx * dx + dy * dy) AS u2,
         min(dx * y - dy * x) / sqrt(dx * dx + dy * dy) AS v1, max(dx * y - dy * x) / sqrt(dx * dx + dy * dy) AS v2
  FROM edges JOIN p USING (page_id, shape) GROUP BY page_id, shape, ax, ay, dx, dy),
quads AS (
  SELECT page_id, shape, u2 - u1 AS w, v2 - v1 AS h, (u2 - u1) * (v2 - v1) * 1.4 / (2 * (u2 - u1 + v2 - v1)) AS d, ux, uy, u1, u2, v1, v2,
         [u1 * ux - v1 * uy, u2 * ux - v1 * uy, u2 * ux - v2 * uy, u1 * ux - v2 * uy] AS qx, [u1 * uy + v1 * ux, u2 * uy + v1 * ux, u2 * uy + v2 * ux, u1 * uy + v2 * ux] AS qy
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id, shape ORDER BY round((u2 - u1) * (v2 - v1), 6), ax, ay) AS rn FROM rectangles) WHERE rn = 1),
placed AS (
  SELECT *, list_transform(qx, lambda v: CAST(floor(v - left_ + 0.5) AS BIGINT)) AS cx, list_transform(qy, lambda v: CAST(floor(v - top_ + 0.5) AS BIGINT)) AS cy
  FROM (SELECT *, least(greatest(floor(list_min(qx)), 0), 511) AS left_, least(greatest(floor(list_min(qy)), 0), 127) AS top_,
               least(greatest(ceil(list_max(qx)), 0), 511) AS right_, least(greatest(ceil(list_max(qy)), 0), 127) AS bottom_ FROM quads)),
cells AS (
  SELECT page_id, shape, i, unnest(range(0, CAST(bottom_ - top_ AS BIGINT) + 1)) AS j, left_, top_, cx, cy
  FROM (SELECT *, unnest(range(0, CAST(right_ - left_ AS BIGINT) + 1)) AS i FROM placed)),
sides AS (
  SELECT page_id, shape, CAST(left_ + i AS BIGINT) AS px, CAST(top_ + j AS BIGINT) AS py,
         list_transform([1, 2, 3, 4], lambda s: (cx[s % 4 + 1] - cx[s]) * (j - cy[s]) - (cy[s % 4 + 1] - cy[s]) * (i - cx[s])) AS t FROM cells),
inside AS (
  SELECT s.page_id, s.shape, px, py, coalesce(arg_max(CAST(CAST(0.5 + CAST(k % 5 AS DOUBLE) / 10 AS FLOAT) AS DOUBLE), k), 0) AS value
  FROM sides s LEFT JOIN b ON b.page_id = s.page_id AND px BETWEEN b.x AND b.x + 39 AND py BETWEEN b.y AND b.y + 7
  WHERE list_min(t) >= 0 OR list_max(t) <= 0 GROUP BY s.page_id, s.shape, px, py),
scored AS (SELECT page_id, shape, avg(value) AS score FROM inside GROUP BY page_id, shape),
found AS (
  SELECT page_id, line_ord, score, least(greatest(2 * list_min(gx), 0), 1024) AS x1, least(greatest(2 * list_min(gy), 0), 256) AS y1,
         least(greatest(2 * list_max(gx), 0), 1024) AS x2, least(greatest(2 * list_max(gy), 0), 256) AS y2
  FROM (SELECT *, [(u1 - d) * ux - (v1 - d) * uy, (u2 + d) * ux - (v1 - d) * uy, (u2 + d) * ux - (v2 + d) * uy, (u1 - d) * ux - (v2 + d) * uy] AS gx,
               [(u1 - d) * uy + (v1 - d) * ux, (u2 + d) * uy + (v1 - d) * ux, (u2 + d) * uy + (v2 + d) * ux, (u1 - d) * uy + (v2 + d) * ux] AS gy FROM quads)
  JOIN scored USING (page_id, shape) JOIN contour USING (page_id, shape)
  WHERE least(w, h) >= 3 AND score >= 0.4 AND least(w, h) + 2 * d >= 5)"""


DETECTED_SQL = (
    CONTOUR_SQL
    + ORDERED_SQL.replace("FROM lines", "FROM (SELECT * FROM found WHERE x2 - x1 >= 1 AND y2 - y1 >= 1)")
    + " SELECT page_id, line_idx, round(o.x1, 4) AS x1, round(o.y1, 4) AS y1, round(o.x2, 4) AS x2, round(o.y2, 4) AS y2, round(score, 6) AS score FROM ordered o JOIN found USING (page_id, line_ord)"
)


#: Score maps that are worked on at once.
MAPS = 32


def _detected(spark, sf_dir, name: str) -> DataFrame:
    from quire.sources import models

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, MAPS):
                part = batch.slice(at, MAPS)
                scores = np.zeros((part.num_rows, 128, 512), np.float32)
                for page, points in enumerate(part.column("points").to_pylist()):
                    for k, p in enumerate(points):
                        y, x = int(p["y1"]), int(p["x1"])
                        scores[page, y : y + 8, x : x + 40] = 0.5 + (k % 5) / 10
                yield models.quad_batches(part.column("page_id").to_numpy(), scores, 1024, 256)

    kept = lines.filter_quads(_points(spark, sf_dir, name).mapInArrow(run, models.QUAD_RAW))
    ordered = lines.reading_order(lines.quads_to_boxes(kept.withColumn("quad", F.col("grown"))))
    return ordered.select("page_id", "line_idx", *[F.round(c, 4).alias(c) for c in BOX], F.round("score", 6).alias("score"))


@query(DETECTED_SQL, "lines")
def detect_lines(spark, sf_dir):
    """Drawn score maps to lines in reading order."""
    return _detected(spark, sf_dir, "lines")


@query(DETECTED_SQL.replace("FROM lines", "FROM heaps"), "heaps")
def detect_heaps(spark, sf_dir):
    """The same of boxes that lie on each other: shapes with holes, turned quads."""
    return _detected(spark, sf_dir, "heaps")

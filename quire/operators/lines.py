"""Text lines: detector quads to boxes in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import quad_to_page, short_side

MAX_CANDIDATES = 3000
MIN_SIDE = 3.0
BOX_THRESHOLD = 0.4
Y_TOLERANCE = 10


def cap_candidates(quads: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """The first candidates of each page in order of discovery."""
    return quads.where(F.col("contour_ord") < most)


def filter_quads(quads: DataFrame, threshold: float = BOX_THRESHOLD, min_side: float = MIN_SIDE) -> DataFrame:
    """Candidates by contour points, side and score (before growing)."""
    kept = cap_candidates(quads).where("n_points >= 4")
    return kept.where(~(short_side(F.col("quad")) < min_side)).where(~(F.col("score") < F.lit(threshold).cast(quads.schema["score"].dataType)))


def quads_to_boxes(grown: DataFrame, min_side: float = MIN_SIDE) -> DataFrame:
    """Grown quads to page boxes of a pixel at least."""
    kept = grown.where(~(short_side(F.col("quad")) < min_side + 2))
    x1, y1, x2, y2 = quad_to_page(F.col("quad"), F.col("map_w"), F.col("map_h"), F.col("page_w"), F.col("page_h"))
    boxes = kept.select("page_id", F.col("contour_ord").alias("line_ord"), "score", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return boxes.where("not (x2 - x1 < 1.0) and not (y2 - y1 < 1.0)")


def reading_order(lines: DataFrame, tolerance: float = Y_TOLERANCE) -> DataFrame:
    """Adds line_idx.

    Lines are sorted by top, left, line_ord; then each in turn moves left past
    lines whose top is within the tolerance and whose left is further right, up
    to the first that isn't.  That is no total order, hence a fold per page: a
    line goes behind the last one it can't pass.
    """
    rest = [c for c in lines.columns if c not in ("page_id", "y1", "x1", "line_ord", "line_idx")]
    pages = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("y1", "x1", "line_ord", *rest))).alias("lines"))

    def insert(done, c):
        stays = F.transform(done, lambda k, i: F.when((F.abs(c["y1"] - k["y1"]) < tolerance) & (c["x1"] < k["x1"]), F.lit(0)).otherwise(i + 1))
        at = F.coalesce(F.array_max(stays), F.lit(0))
        return F.concat(F.slice(done, F.lit(1), at), F.array(c), F.slice(done, at + 1, F.size(done)))

    folded = F.aggregate("lines", F.filter("lines", lambda _: F.lit(False)), insert)
    out = pages.select("page_id", F.posexplode(folded).alias("line_idx", "l"))
    return out.select("page_id", "line_idx", *[F.col("l").getField(c).alias(c) for c in ("line_ord", "x1", "y1", *rest)])

"""Layout boxes: raw model rows to ordered regions.

Every relation carries its ordinal (raw_ord, nms_rank, region_idx): rows have no
order of their own.  Nothing crosses pages; page_id is the only shuffle key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import clamp, iou
from quire.labels import LABELS, is_in, label_name

IOU = 0.9


def like(df: DataFrame, column: str, value: float):
    """A literal of a column's own type: float columns compare as floats."""
    return F.lit(value).cast(df.schema[column].dataType)


def filter_raw(raw: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Model rows to boxes: valid prefix, score, known label, clamped, not empty.

    A null or negative n_valid keeps all rows.  A label value is truncated; NaN
    and negative ones are class 0.
    """
    kept = raw.where("n_valid is null or n_valid < 0 or raw_ord < n_valid")
    kept = kept.where(~(F.col("score") < like(raw, "score", threshold)))
    value = F.col("label_value")
    kept = kept.where(F.isnan(value) | (value < len(LABELS)))
    label_id = F.when(F.isnan(value) | (value < 0), F.lit(0)).otherwise(value.cast("int"))
    boxes = kept.select(
        "page_id",
        "raw_ord",
        label_id.alias("label_id"),
        label_name(label_id).alias("label"),
        "score",
        *[clamp(F.col(c), F.col(f"page_{c[0].replace('x', 'w').replace('y', 'h')}")).cast(raw.schema[c].dataType).alias(c) for c in ("x1", "y1", "x2", "y2")],
    )
    return boxes.where("x2 > x1 and y2 > y1")


def filter_boxes(boxes: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Score and known-label filters on rows that already have a label_id."""
    return boxes.where(~(F.col("score") < like(boxes, "score", threshold))).where(F.col("label_id") < len(LABELS))


def suppress(boxes: DataFrame, threshold: float = IOU) -> DataFrame:
    """Greedy suppression per page, whatever the class: in order of score, then
    raw_ord, a box stays unless it overlaps one that stayed.  Adds nms_rank."""
    rest = [c for c in boxes.columns if c not in ("page_id", "score", "raw_ord")]
    first = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(-F.col("score")).alias("__first")
    rows = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(first, "raw_ord", "score", *rest))).alias("boxes"))
    none = F.filter("boxes", lambda _: F.lit(False))
    kept = F.aggregate("boxes", none, lambda k, c: F.when(F.exists(k, lambda b: iou(b, c) >= threshold), k).otherwise(F.concat(k, F.array(c))))
    out = rows.select("page_id", F.posexplode(kept).alias("nms_rank", "b"))
    return out.select("page_id", "nms_rank", *[F.col("b").getField(c).alias(c) for c in ("raw_ord", "score", *rest)])


def keep_classes(boxes: DataFrame, enabled: set[str]) -> DataFrame:
    """Boxes of enabled classes; above `suppress`, as a box of a disabled class still suppresses."""
    return boxes.where(is_in(F.col("label"), enabled))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Adds region_idx: by top, left, then nms_rank."""
    by = Window.partitionBy("page_id").orderBy("y1", "x1", "nms_rank")
    return boxes.withColumn("region_idx", F.row_number().over(by) - 1)

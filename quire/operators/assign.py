"""Lines to regions, and the crops to recognise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import area, centre, crop_window, inside

BOX = ("x1", "y1", "x2", "y2")


def within_page(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join on page_id and a numeric key that is dealt by page_id alone.

    The key's equality is written as a difference, which stays a residual of the
    join: sides that are dealt by page already need no further shuffle, and a
    page's rows are few.
    """
    other = right.select(F.col("page_id").alias("__page"), F.col(key).alias("__key"), *[c for c in right.columns if c not in ("page_id", key)])
    return left.join(other, (F.col("page_id") == F.col("__page")) & (F.col(key) - F.col("__key") == 0), how).drop("__page", "__key")


def assign_lines(lines: DataFrame, regions: DataFrame, line: str = "line_idx", region: str = "region_idx", keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, line, region, kept line columns): each line's smallest region that
    holds its centre.

    Ties go to the lower region; a line in no region is dropped.  An equi-join on
    the page with the range test as its residual; the choice is a min aggregate
    within what the join has dealt.
    """
    a = lines.select("page_id", line, centre(F.col("x1"), F.col("x2")).alias("cx"), centre(F.col("y1"), F.col("y2")).alias("cy"), F.struct(line, *keep).alias("own"))
    b = regions.select(F.col("page_id").alias("__page"), region, *[F.col(c).alias(f"r{c}") for c in BOX])
    box = [F.col(f"r{c}") for c in BOX]
    met = a.join(b, (F.col("page_id") == F.col("__page")) & inside(F.col("cx"), F.col("cy"), *box))
    best = met.groupBy("page_id", line).agg(F.min(F.struct(area(*box).alias("area"), F.col(region).alias("region"), "own")).alias("best"))
    return best.select("page_id", line, F.col("best.region").alias(region), *[F.col("best.own").getField(c).alias(c) for c in keep])


def crops(regions: DataFrame, lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One crop per line in its region, or the whole region where it has none.

    Adds crop_idx in order of region, then line; `keep` are further line columns.
    """
    assigned = assign_lines(lines, regions, keep=(*BOX, *keep))
    assigned = assigned.select("page_id", "region_idx", "line_idx", *keep, *[F.col(c).alias(f"l{c}") for c in BOX])
    met = within_page(regions, assigned, "region_idx")
    by = Window.partitionBy("page_id").orderBy("region_idx", "line_idx")
    return met.select(
        "page_id",
        (F.row_number().over(by) - 1).alias("crop_idx"),
        "region_idx",
        "label",
        "line_idx",
        F.col("line_idx").isNull().alias("is_fallback"),
        *[F.coalesce(f"l{c}", c).alias(c) for c in BOX],
        *keep,
    )


def with_windows(boxes: DataFrame, padding: int = 0) -> DataFrame:
    """Adds the pixel window x, y, w, h of each box on its page (page_w, page_h)."""
    x, y, w, h = crop_window(*[F.col(c) for c in BOX], F.col("page_w"), F.col("page_h"), padding)
    return boxes.select("*", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


#: Keys of a block: crops of a group and width are numbered block by block.
BLOCK = 100_000


def batch_numbers(sizes: DataFrame, key: str, group: str, batch: int) -> DataFrame:
    """Adds batch_no: within a group, crops are sorted by width, then key, and cut into batches.

    A task numbers the crops of one width and block of keys; those before it are a sum of
    counts, so no group has to fit in a task.
    """
    own = ["__group", "__width", "__block"]
    rows = sizes.withColumns({"__group": F.col(group), "__width": F.col("width"), "__block": F.floor(F.col(key) / BLOCK)})
    former = Window.partitionBy("__group").orderBy("__width", "__block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*own).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(former), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(*own).orderBy(key)) - 1
    numbered = rows.withColumn("__place", place).join(before, own)
    return numbered.withColumn("batch_no", F.floor((F.col("__before") + F.col("__place")) / batch).cast("int")).drop(*own, "__place", "__before")


def width_batches(sizes: DataFrame, key: str, group: str, batch: int) -> DataFrame:
    """Crops in recognition batches: (group, key, width, batch_no, pad_width); each batch
    is padded to its widest."""
    rows = batch_numbers(sizes, key, group, batch)
    return rows.withColumn("pad_width", F.max("width").over(Window.partitionBy(group, "batch_no")))

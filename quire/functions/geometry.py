"""Box and quad arithmetic as Column expressions.

A box is four columns x1, y1, x2, y2, or a struct of them; a quad is an array of
four structs (x, y).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DET_SHORT, DET_HARD, DET_LONG, DET_STEP = 736, 4000, 1280, 32
REC_HEIGHT, REC_WIDTH = 48, 3200
FORMULA_SIDE = 384
LAYOUT_SIDE = 800


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; 0 where they don't meet."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / (box_area(a) + box_area(b) - inter))


def box_area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def centre(a: Column, b: Column) -> Column:
    return (a + b) / 2


def inside(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a point lies in a box, edges included."""
    return (x >= x1) & (x <= x2) & (y >= y1) & (y <= y2)


def clamp(v: Column, most: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))


def det_size(w: Column, h: Column, longest: int = DET_LONG) -> tuple[Column, Column]:
    """(width, height) to which a page is resized for line detection.

    The short side is raised to 736; a long side over the limit overrides that;
    sides are rounded to multiples of 32, 32 at least.
    """
    longest = min(DET_HARD, max(DET_SHORT, longest))
    short, long = F.least(w, h), F.greatest(w, h)
    ratio = F.when(short < DET_SHORT, F.lit(float(DET_SHORT)) / short).otherwise(F.lit(1.0))
    ratio = F.when(long * ratio > longest, F.lit(float(longest)) / long).otherwise(ratio)

    def side(v: Column) -> Column:
        return (F.greatest(F.round(v * ratio / DET_STEP), F.lit(1.0)) * DET_STEP).cast("int")

    return side(w), side(h)


def recognition_width(w: Column, h: Column) -> Column:
    """Width of a crop scaled to the recogniser's height, 1 to 3200."""
    return F.least(F.greatest(F.round(F.lit(float(REC_HEIGHT)) * w / h), F.lit(1.0)), F.lit(float(REC_WIDTH))).cast("int")


def formula_fit(w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """(width, height, left, top) of a formula centred on its square input."""
    scale = F.least(F.lit(float(FORMULA_SIDE)) / w, F.lit(float(FORMULA_SIDE)) / h)

    def side(v: Column) -> Column:
        return F.least(F.greatest(F.round(v * scale), F.lit(1.0)), F.lit(float(FORMULA_SIDE))).cast("int")

    return side(w), side(h), F.floor((F.lit(FORMULA_SIDE) - side(w)) / 2).cast("int"), F.floor((F.lit(FORMULA_SIDE) - side(h)) / 2).cast("int")


def scale_factor(w: Column, h: Column) -> tuple[Column, Column]:
    """The layout model's (height, width) scale factors."""
    return F.lit(float(LAYOUT_SIDE)) / h, F.lit(float(LAYOUT_SIDE)) / w


def crop_window(x1: Column, y1: Column, x2: Column, y2: Column, page_w: Column, page_h: Column, padding: int = 0) -> tuple[Column, Column, Column, Column]:
    """(x, y, w, h) in whole pixels: truncated, padded, clamped to the page, 1 at least."""

    def low(v: Column, most: Column) -> Column:
        return F.least(F.greatest(v.cast("long") - padding, F.lit(0)), F.greatest(most - 1, F.lit(0)))

    def high(v: Column, most: Column) -> Column:
        return F.least(F.greatest(v.cast("long") + padding, F.lit(0)), most)

    x, y = low(x1, page_w), low(y1, page_h)
    return x, y, F.greatest(high(x2, page_w) - x, F.lit(1)), F.greatest(high(y2, page_h) - y, F.lit(1))


def cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _edges(quad: Column) -> list[tuple[Column, Column]]:
    return [(F.get(quad, F.lit(k)), F.get(quad, F.lit((k + 1) % 4))) for k in range(4)]


def edge_lengths(quad: Column) -> list[Column]:
    return [F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])) for a, b in _edges(quad)]


def short_side(quad: Column) -> Column:
    return F.least(*edge_lengths(quad))


def perimeter(quad: Column) -> Column:
    a, b, c, d = edge_lengths(quad)
    return a + b + c + d


def signed_area(quad: Column) -> Column:
    """Shoelace formula; positive where the corners turn counter-clockwise."""
    terms = [a["x"] * b["y"] - b["x"] * a["y"] for a, b in _edges(quad)]
    return (terms[0] + terms[1] + terms[2] + terms[3]) / 2


def unclip_box(x1: Column, y1: Column, x2: Column, y2: Column, ratio: float = 1.4) -> tuple[Column, Column, Column, Column]:
    """A rectangle grown on every side by its area x ratio / perimeter."""
    w, h = x2 - x1, y2 - y1
    d = F.when(2 * (w + h) < 1e-6, F.lit(0.0)).otherwise(w * h * ratio / (2 * (w + h)))
    return x1 - d, y1 - d, x2 + d, y2 + d


def quad_to_page(quad: Column, map_w: Column, map_h: Column, page_w: Column, page_h: Column) -> tuple[Column, Column, Column, Column]:
    """The axis-parallel page box of a quad on the detector's map, clamped."""

    def values(axis: str, scale: Column, most: Column) -> Column:
        return F.transform(quad, lambda p: clamp(p[axis] * scale, most))

    xs, ys = values("x", page_w / map_w, page_w), values("y", page_h / map_h, page_h)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)

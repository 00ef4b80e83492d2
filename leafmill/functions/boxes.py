"""Box predicates and measures as Column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Left, top, right, bottom."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center_x(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def center_y(self) -> Column:
        return (self.y0 + self.y1) / 2


def box(prefix: str = "", suffix: str = "") -> Box:
    """The box in columns ``{prefix}x0{suffix}`` and so on."""
    return Box(*[F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1")])


def is_valid(b: Box) -> Column:
    return (b.x0 < b.x1) & (b.y0 < b.y1)


def is_inside(a: Box, b: Box) -> Column:
    """a lies completely in b (borders may touch)."""
    return (a.x0 >= b.x0) & (a.y0 >= b.y0) & (a.x1 <= b.x1) & (a.y1 <= b.y1)


def intersects(a: Box, b: Box) -> Column:
    """Interiors meet; touching borders do not count."""
    return (a.x1 > b.x0) & (a.x0 < b.x1) & (a.y1 > b.y0) & (a.y0 < b.y1)


def intersection_area(a: Box, b: Box) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w < 0) | (h < 0), F.lit(0.0)).otherwise((w * h).cast("double"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def iou(a: Box, b: Box) -> Column:
    inter = intersection_area(a, b)
    return F.when((a.area == 0) | (b.area == 0), F.lit(0.0)).otherwise(inter / (a.area + b.area - inter))


def overlap_in_own(a: Box, b: Box) -> Column:
    """Share of a's area covered by b."""
    return _ratio(intersection_area(a, b), a.area)


def overlap_in_smaller(a: Box, b: Box) -> Column:
    return _ratio(intersection_area(a, b), F.least(a.area, b.area))


def smaller_if_overlapping(a: Box, b: Box, ratio: float) -> Column:
    """The smaller box (a on ties) as a struct when the overlap exceeds ``ratio`` of it, else null."""
    as_struct = [F.struct(*[v.alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), x)]) for x in (a, b)]
    return F.when(overlap_in_smaller(a, b) > ratio, F.when(a.area <= b.area, as_struct[0]).otherwise(as_struct[1]))


def x_projection_overlap(a: Box, b: Box) -> Column:
    """Share of a's width that lies over b."""
    shared = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    return F.when(shared < 0, F.lit(0.0)).otherwise(_ratio(shared, a.width))


def _axis_overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    shared = F.greatest(F.lit(0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))
    smaller = F.least(hi_a - lo_a, hi_b - lo_b)
    return F.when(smaller > 0, shared / smaller).otherwise(F.lit(0.0))


def y_overlap_in_smaller(a: Box, b: Box) -> Column:
    """Shared height over the smaller height; 0 when a box is flat."""
    return _axis_overlap(a.y0, a.y1, b.y0, b.y1)


def x_overlap_in_smaller(a: Box, b: Box) -> Column:
    return _axis_overlap(a.x0, a.x1, b.x0, b.x1)


def relative_position(a: Box, b: Box) -> Column:
    """Struct of flags: b ends left of a / starts right of a / ends above a / starts below a."""
    return F.struct(
        (b.x1 < a.x0).alias("left"),
        (a.x1 < b.x0).alias("right"),
        (b.y1 < a.y0).alias("bottom"),
        (a.y1 < b.y0).alias("top"),
    )


def edge_distance(a: Box, b: Box) -> Column:
    """Gap between the boxes: 0 when they meet, else the straight line between nearest edges or corners."""
    dx = F.greatest(F.lit(0), a.x0 - b.x1, b.x0 - a.x1)
    dy = F.greatest(F.lit(0), a.y0 - b.y1, b.y0 - a.y1)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def center_distance(a: Box, b: Box) -> Column:
    dx, dy = a.center_x - b.center_x, a.center_y - b.center_y
    return F.sqrt(dx * dx + dy * dy)


def relative_box(child: Box, parent: Box) -> Column:
    """Child box in the parent's unit square, clamped to [0, 1], three decimals."""
    w, h = F.greatest(parent.width, F.lit(1)), F.greatest(parent.height, F.lit(1))

    def unit(v: Column) -> Column:
        return F.round(F.least(F.greatest(v.cast("double"), F.lit(0.0)), F.lit(1.0)), 3)

    return F.struct(
        unit((child.x0 - parent.x0) / w).alias("x0"),
        unit((child.y0 - parent.y0) / h).alias("y0"),
        unit((child.x1 - parent.x0) / w).alias("x1"),
        unit((child.y1 - parent.y0) / h).alias("y1"),
    )


def normalized_int_box(points: Column, width: Column, height: Column) -> Column:
    """A list of coordinates (x0,y0,x1,y1 or a polygon x,y,x,y,…) as an integer box inside the image.

    Low corner floored, high corner raised, clamped to the image; null when nothing is left.
    """
    xs = F.filter(points, lambda v, i: i % 2 == 0)
    ys = F.filter(points, lambda v, i: i % 2 == 1)

    def clamp(v: Column, top: Column) -> Column:
        return F.greatest(F.lit(0), F.least(v, top)).cast("int")

    x0, x1 = clamp(F.floor(F.array_min(xs)), width), clamp(F.ceil(F.array_max(xs)), width)
    y0, y1 = clamp(F.floor(F.array_min(ys)), height), clamp(F.ceil(F.array_max(ys)), height)
    fits = ((F.size(points) == 4) | (F.size(points) >= 8)) & (x0 < x1) & (y0 < y1)
    return F.when(fits, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def is_small_picture(b: Box, page_width: Column, page_height: Column) -> Column:
    """Width or height under a tenth of the page, or area under a hundredth."""
    w, h = b.width / page_width, b.height / page_height
    return (w > 0) & (h > 0) & ((w < 0.1) | (h < 0.1) | (w * h < 0.01))

"""Column expressions over boxes: four integer columns, closed coordinates.

``box("a")`` names the columns of one side of a join; every function returns a Column, so
predicates stay inside generated code and are pushed as join conditions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(alias: str = "") -> Box:
    dot = f"{alias}." if alias else ""
    return Box(*(F.col(dot + c) for c in ("x1", "y1", "x2", "y2")))


def box_of(value: Column) -> Box:
    """The box held by a struct with fields x1, y1, x2, y2."""
    return Box(*(value[c] for c in ("x1", "y1", "x2", "y2")))


def width(a: Box) -> Column:
    return a.x2 - a.x1


def height(a: Box) -> Column:
    return a.y2 - a.y1


def area(a: Box) -> Column:
    return width(a) * height(a)


def centre_x(a: Box) -> Column:
    return (a.x1 + a.x2) / F.lit(2.0)


def centre_y(a: Box) -> Column:
    return (a.y1 + a.y2) / F.lit(2.0)


def floor_centre(a: Box) -> tuple[Column, Column]:
    """Integer centre, rounded down also below zero."""
    return F.floor(centre_x(a)).cast("int"), F.floor(centre_y(a)).cast("int")


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0)
    return F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    return F.coalesce(F.try_divide(inter.cast("double"), area(a) + area(b) - inter), F.lit(0.0))


def contained_share(inner: Box, outer: Box) -> Column:
    """Share of the inner box within the outer one; 0 for an empty inner box."""
    return F.coalesce(F.try_divide(intersection(inner, outer).cast("double"), area(inner)), F.lit(0.0))


def is_contained(inner: Box, outer: Box, share: float = 0.8) -> Column:
    return (area(inner) > 0) & (contained_share(inner, outer) >= share)


def is_strictly_contained(inner: Box, outer: Box, margin: int = 5, share: float = 0.85) -> Column:
    """Smaller, inside the outer box shrunk by a margin, and mostly covered by it."""
    clear = (inner.x1 >= outer.x1 + margin) & (inner.y1 >= outer.y1 + margin) & (inner.x2 <= outer.x2 - margin) & (inner.y2 <= outer.y2 - margin)
    return (area(outer) > area(inner)) & clear & (intersection(inner, outer) > 0) & (contained_share(inner, outer) >= share)


def is_inside(inner: Box, outer: Box, slack: int = 2) -> Column:
    return (inner.x1 >= outer.x1 - slack) & (inner.y1 >= outer.y1 - slack) & (inner.x2 <= outer.x2 + slack) & (inner.y2 <= outer.y2 + slack)


def hybrid_overlap(a: Box, b: Box) -> Column:
    """Largest of IoU and the covered shares of both boxes."""
    inter = intersection(a, b).cast("double")
    union = area(a) + area(b) - inter + F.lit(1e-6)
    share = lambda size: F.coalesce(F.try_divide(inter, size), F.lit(0.0))
    return F.greatest(inter / union, share(area(a)), share(area(b)))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    return F.coalesce(F.try_divide(intersection(a, b).cast("double"), F.least(area(a), area(b))), F.lit(0.0))


def _gap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(F.lit(0), lo2 - hi1, lo1 - hi2)


def edge_gap(a: Box, b: Box) -> Column:
    """0 for overlapping boxes, else the larger of the horizontal and vertical gaps."""
    return F.when(intersection(a, b) > 0, F.lit(0)).otherwise(F.greatest(_gap(a.x1, a.x2, b.x1, b.x2), _gap(a.y1, a.y2, b.y1, b.y2)))


def are_close(a: Box, b: Box, gap: int) -> Column:
    return (_gap(a.x1, a.x2, b.x1, b.x2) <= gap) & (_gap(a.y1, a.y2, b.y1, b.y2) <= gap)


def centre_distance(a: Box, b: Box) -> Column:
    return F.hypot(centre_x(a) - centre_x(b), centre_y(a) - centre_y(b))


def share_columns(a: Box, b: Box) -> Column:
    """Their horizontal extents touch or overlap."""
    return (a.x2 >= b.x1) & (b.x2 >= a.x1)


def share_rows(a: Box, b: Box) -> Column:
    return (a.y2 >= b.y1) & (b.y2 >= a.y1)


def label_distance(label: Box, target: Box) -> Column:
    """struct(distance, position) of a label seen from its target: the gap if it lies above,
    left, right or below within the same columns or rows, in that order; else the distance of
    the centres, as 'other'."""
    cases = [
        ((label.y2 <= target.y1) & share_columns(label, target), target.y1 - label.y2, "above"),
        ((label.x2 <= target.x1) & share_rows(label, target), target.x1 - label.x2, "left"),
        ((label.x1 >= target.x2) & share_rows(label, target), label.x1 - target.x2, "right"),
        ((label.y1 >= target.y2) & share_columns(label, target), label.y1 - target.y2, "below"),
    ]
    out = F.struct(centre_distance(label, target).alias("distance"), F.lit("other").alias("position"))
    for test, gap, name in reversed(cases):
        out = F.when(test, F.struct(gap.cast("double").alias("distance"), F.lit(name).alias("position"))).otherwise(out)
    return out


def row_overlap(a: Box, b: Box) -> Column:
    """Vertical overlap over the smaller height; 0 where that is not positive."""
    shared = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    low = F.least(height(a), height(b))
    return F.when((low > 0) & (shared > 0), shared.cast("double") / low).otherwise(F.lit(0.0))


def union_box(a: Box, b: Box) -> Column:
    return F.struct(F.least(a.x1, b.x1).alias("x1"), F.least(a.y1, b.y1).alias("y1"), F.greatest(a.x2, b.x2).alias("x2"), F.greatest(a.y2, b.y2).alias("y2"))


def union_aggregates() -> list[Column]:
    """The bounding box of a group, as four aggregates."""
    return [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]


def fill_ratio() -> Column:
    """Aggregate: areas of the members over the area of their bounding box (may exceed 1)."""
    hull = (F.max("x2") - F.min("x1")) * (F.max("y2") - F.min("y1"))
    return F.sum(area(box())).cast("double") / F.greatest(F.lit(1), hull)


def has_point(a: Box, x: Column, y: Column) -> Column:
    return F.coalesce(x.between(a.x1, a.x2) & y.between(a.y1, a.y2), F.lit(False))


def has_centre_of(outer: Box, inner: Box) -> Column:
    return has_point(outer, centre_x(inner), centre_y(inner))


def touches(a: Box, b: Box) -> Column:
    return share_columns(a, b) & share_rows(a, b)


def covers(outer: Box, inner: Box) -> Column:
    return (outer.x1 <= inner.x1) & (outer.y1 <= inner.y1) & (outer.x2 >= inner.x2) & (outer.y2 >= inner.y2)


def from_list(bounds: Column) -> Column:
    """struct box from [x1, y1, x2, y2] or, where that is not ordered, [x, y, w, h]."""
    at = lambda i: F.try_element_at(bounds, F.lit(i + 1))
    corners = (at(2) > at(0)) & (at(3) > at(1))
    return F.struct(
        at(0).alias("x1"), at(1).alias("y1"),
        F.when(corners, at(2)).otherwise(at(0) + at(2)).alias("x2"),
        F.when(corners, at(3)).otherwise(at(1) + at(3)).alias("y2"),
    )


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def relative_centre(a: Box, image_width: Column, image_height: Column) -> tuple[Column, Column]:
    """Centre as shares of the image; the middle where the image size is unknown."""
    known = (F.coalesce(image_width, F.lit(0)) != 0) & (F.coalesce(image_height, F.lit(0)) != 0)
    pick = lambda c, size: F.when(known, c / size).otherwise(F.lit(0.5))
    return pick(centre_x(a), image_width), pick(centre_y(a), image_height)


def looks_like_icon(name: Column, a: Box, max_height: int = 48, aspect: float = 1.6) -> Column:
    return (F.length(name) > 2) & (height(a) <= max_height) & (width(a) < aspect * height(a))


def scale(image_height: Column, base: int = 1080) -> Column:
    return F.greatest(F.lit(1.0), image_height / F.lit(float(base)))


def to_content(screen: Column, offset: Column, factor: Column) -> Column:
    return F.try_divide(screen - offset, factor)


def to_yolo(a: Box, image_width: Column, image_height: Column) -> list[Column]:
    """Normalised centre and size."""
    return [
        (centre_x(a) / image_width).alias("cx"), (centre_y(a) / image_height).alias("cy"),
        (width(a) / image_width).alias("w"), (height(a) / image_height).alias("h"),
    ]


def percent_to_pixel(x: Column, y: Column, w: Column, h: Column, image_width: Column, image_height: Column) -> Box:
    """Percent boxes in pixels, clipped to the image."""
    px = lambda v, size: F.round(v / 100.0 * size).cast("int")
    clip = lambda v, size: F.greatest(F.lit(0), F.least(v, size.cast("int")))
    return Box(clip(px(x, image_width), image_width), clip(px(y, image_height), image_height), clip(px(x + w, image_width), image_width), clip(px(y + h, image_height), image_height))

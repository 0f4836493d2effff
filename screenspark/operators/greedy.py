"""Order-dependent suppression and matching, as folds over the boxes of one screen.

A screen holds a bounded number of boxes, so each is collected into one array and folded by
``aggregate`` inside generated code; screens spread over tasks by their id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Preference among types where boxes of different types compete.
TYPE_RANK = {"button": 5, "input_field": 5, "checkbox": 4, "icon": 3, "text": 3, "divider": 2, "block": 1, "unknown": 0}


def fold(df: DataFrame, by: list[str], order: list[Column], clash: Callable[[Column, Column], Column]) -> DataFrame:
    """Keeps the rows that clash with no earlier kept one, in the given order."""
    columns = df.columns
    rest = [c for c in columns if c not in by]
    rows = F.sort_array(F.collect_list(F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *rest)))
    keep = lambda kept, c: F.when(F.exists(kept, lambda k: clash(k, c)), kept).otherwise(F.array_append(kept, c))
    grouped = df.groupBy(*by).agg(rows.alias("_rows"))
    kept = grouped.select(*by, F.explode(F.aggregate("_rows", F.filter("_rows", lambda r: F.lit(False)), keep)).alias("_r"))
    return kept.select(*[F.col(c) if c in by else F.col(f"_r.{c}").alias(c) for c in columns])


def suppress(df: DataFrame, by: list[str], threshold: float = 0.5, score: str = "confidence", order: str = "elem_id") -> DataFrame:
    """Non-maximum suppression: by score, a box stays if its IoU with all kept is below the
    threshold.  Ties follow ``order``."""
    return fold(df, by, [-F.col(score), F.col(order)], lambda k, c: G.iou(G.box_of(k), G.box_of(c)) >= threshold)


def type_rank(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TYPE_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0))


def suppress_across_types(df: DataFrame, by: list[str], threshold: float = 0.4, share: float = 0.75, child: float = 0.2) -> DataFrame:
    """Suppression over all types of a screen.  Order: has a caption, type rank, confidence.
    A kept box suppresses those that overlap it more than the threshold, and those that one
    of the two contains, except a block around something else and boxes of very different
    size."""

    def clash(k: Column, c: Column) -> Column:
        a, b = G.box_of(k), G.box_of(c)
        within, around = G.is_contained(b, a, share), G.is_contained(a, b, share)
        spare_within = ((k["visual_type"] == "block") & (c["visual_type"] != "block")) | (G.area(b) < G.area(a) * child)
        spare_around = ((c["visual_type"] == "block") & (k["visual_type"] != "block")) | (G.area(a) < G.area(b) * child)
        return (G.iou(a, b) > threshold) | F.when(within, ~spare_within).when(around, ~spare_around).otherwise(F.lit(False))

    order = [-F.when(F.coalesce(F.col("text"), F.lit("")) != "", 1).otherwise(0), -type_rank(F.col("visual_type")), -F.col("confidence"), F.col("elem_id")]
    return fold(df, by, order, clash)


def drop_near_duplicates(df: DataFrame, by: list[str], tolerance: int = 5, threshold: float = 0.3) -> DataFrame:
    """A box goes if all edges lie within the tolerance of a kept one, or it has the same
    caption and overlaps it.  A kept box without a caption takes that of the first such box."""

    def near(a: G.Box, b: G.Box) -> Column:
        return F.greatest(F.abs(a.x1 - b.x1), F.abs(a.x2 - b.x2), F.abs(a.y1 - b.y1), F.abs(a.y2 - b.y2)) <= tolerance

    def clash(k: Column, c: Column) -> Column:
        a, b = G.box_of(k), G.box_of(c)
        return near(a, b) | ((F.coalesce(c["text"], F.lit("")) != "") & (k["text"] == c["text"]) & (G.iou(a, b) > threshold))

    # Captions come first in the order, so a box that takes one never stands before its giver.
    order = [-F.when(F.coalesce(F.col("text"), F.lit("")) != "", 1).otherwise(0), -F.col("confidence"), F.col("elem_id")]
    return fold(df, by, order, clash)


def match(pairs: DataFrame, by: list[str], left: str, right: str, score: str) -> DataFrame:
    """Greedy one-to-one matching: pairs by descending score (ties by left, right), each taken
    if both sides are free."""
    chosen = fold(pairs.select(*by, left, right, score), by, [-F.col(score), F.col(left), F.col(right)], lambda k, c: (k[left] == c[left]) | (k[right] == c[right]))
    return chosen


def assign(pairs: DataFrame, by: list[str], left: str, right: str, distance: str) -> DataFrame:
    """Each left row, in order, takes the nearest right row that is still free."""
    rows = F.sort_array(F.collect_list(F.struct(left, distance, right)))

    def take(kept: Column, c: Column) -> Column:
        taken = F.exists(kept, lambda k: (k[left] == c[left]) | (k[right] == c[right]))
        return F.when(taken, kept).otherwise(F.array_append(kept, c))

    grouped = pairs.groupBy(*by).agg(rows.alias("_rows"))
    kept = grouped.select(*by, F.explode(F.aggregate("_rows", F.filter("_rows", lambda r: F.lit(False)), take)).alias("_r"))
    return kept.select(*by, *[F.col(f"_r.{c}").alias(c) for c in (left, right, distance)])

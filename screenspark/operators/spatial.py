"""Spatial joins within a screen: an equi-join on the screen with a predicate on the boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

Predicate = Callable[[G.Box, G.Box], Column]


def pairs(left: DataFrame, right: DataFrame, on: str, test: Predicate, extra: Column | None = None) -> DataFrame:
    """Rows of left (as ``a``) and right (as ``b``) of one screen whose boxes pass the test."""
    condition = (F.col(f"a.{on}") == F.col(f"b.{on}")) & test(G.box("a"), G.box("b"))
    return left.alias("a").join(right.alias("b"), condition if extra is None else condition & extra)


def self_pairs(df: DataFrame, on: str, test: Predicate, order: str = "elem_id") -> DataFrame:
    """Each unordered pair of a screen once."""
    return pairs(df, df, on, test, F.col(f"a.{order}") < F.col(f"b.{order}"))


def without(left: DataFrame, right: DataFrame, on: str, test: Predicate, extra: Column | None = None) -> DataFrame:
    """Rows of left that no row of right on the same screen passes the test with."""
    condition = (F.col(f"a.{on}") == F.col(f"b.{on}")) & test(G.box("a"), G.box("b"))
    return left.alias("a").join(right.alias("b"), condition if extra is None else condition & extra, "left_anti")


def parent(df: DataFrame, on: str, inside: Predicate, largest: bool = False) -> DataFrame:
    """(on, elem_id, parent_id): the smallest (or largest) box that contains each box; the
    first of equals; boxes without one are left out."""
    found = pairs(df, df, on, inside, F.col("a.elem_id") != F.col("b.elem_id"))
    size = G.area(G.box("b"))
    key = F.struct((-size if largest else size).alias("size"), F.col("b.elem_id").alias("elem_id"))
    return found.groupBy(F.col(f"a.{on}").alias(on), F.col("a.elem_id").alias("elem_id")).agg(F.min_by(F.col("b.elem_id"), key).alias("parent_id"))


def hit_test(df: DataFrame, on: str, x: Column, y: Column) -> DataFrame:
    """(on, elem_id): the smallest box at a point of each screen."""
    at = df.where(G.has_point(G.box(), x, y))
    return at.groupBy(on).agg(F.min_by("elem_id", F.struct(G.area(G.box()).alias("size"), "elem_id")).alias("elem_id"))


def beside(df: DataFrame, reference: DataFrame, on: str, direction: str) -> DataFrame:
    """Rows beyond the edge of the reference box of their screen, with ``offset``: how far
    their centre is off the reference's, across the direction."""
    a, b = G.box("a"), G.box("b")
    tests = {
        "right": (G.centre_x(a) > b.x2, G.centre_y(a) - G.centre_y(b)),
        "left": (G.centre_x(a) < b.x1, G.centre_y(a) - G.centre_y(b)),
        "below": (G.centre_y(a) > b.y2, G.centre_x(a) - G.centre_x(b)),
        "above": (G.centre_y(a) < b.y1, G.centre_x(a) - G.centre_x(b)),
    }
    test, offset = tests[direction]
    found = pairs(df, reference, on, lambda *_: test, F.col("a.elem_id") != F.col("b.elem_id"))
    return found.select("a.*", F.abs(offset).alias("offset"))


def nearest(left: DataFrame, right: DataFrame, on: str, limit: float) -> DataFrame:
    """(on, elem_id, near_id, distance, position): the nearest label of each box, if nearer
    than the limit; labels may serve several boxes."""
    gap = G.label_distance(G.box("b"), G.box("a"))
    found = pairs(left, right, on, lambda *_: F.lit(True), F.col("a.elem_id") != F.col("b.elem_id"))
    near = found.select(F.col(f"a.{on}").alias(on), F.col("a.elem_id").alias("elem_id"), F.col("b.elem_id").alias("near_id"), gap.alias("g")).where(F.col("g.distance") < limit)
    best = near.groupBy(on, "elem_id").agg(F.min(F.struct("g.distance", "near_id", "g.position")).alias("m"))
    return best.select(on, "elem_id", "m.near_id", "m.distance", "m.position")


def claim_texts(texts: DataFrame, boxes: DataFrame, on: str, threshold: float = 0.3, share: float = 0.7) -> DataFrame:
    """(on, text_id, elem_id): the smallest box that overlaps or contains each text."""
    found = pairs(texts, boxes, on, lambda a, b: (G.iou(a, b) > threshold) | G.is_contained(a, b, share))
    key = F.struct(G.area(G.box("b")).alias("size"), F.col("b.elem_id").alias("elem_id"))
    return found.groupBy(F.col(f"a.{on}").alias(on), F.col("a.elem_id").alias("text_id")).agg(F.min_by(F.col("b.elem_id"), key).alias("elem_id"))


def keep_smaller(df: DataFrame, on: str, overlap: float = 0.9) -> DataFrame:
    """Drops a region that mostly overlaps a smaller one of its screen."""
    return without(df, df, on, lambda a, b: G.hybrid_overlap(a, b) > overlap, G.area(G.box("b")) < G.area(G.box("a")))

"""Joining what several detectors and readers say about one screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as X
from . import spatial


def absorb_texts(regions: DataFrame, texts: DataFrame, on: str, share: float = 0.8) -> DataFrame:
    """(on, elem_id, text): regions with the texts that lie within them, in the texts' order;
    a region that lies within a text itself is left out.  A text may serve several regions."""
    clear = spatial.without(regions, texts, on, lambda a, b: (G.contained_share(a, b) > share) & (G.contained_share(b, a) <= share))
    inside = spatial.pairs(clear, texts, on, lambda a, b: G.contained_share(b, a) > share)
    words = inside.groupBy(F.col(f"a.{on}").alias(on), F.col("a.elem_id").alias("elem_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("b.elem_id").alias("o"), F.col("b.text").alias("t")))).alias("w"))
    joined = F.array_join(F.transform("w", lambda w: w["t"]), " ")
    return clear.select(on, "elem_id").join(words, [on, "elem_id"], "left").select(on, "elem_id", X.present(joined).alias("text"))


def free_texts(regions: DataFrame, texts: DataFrame, on: str, share: float = 0.8) -> DataFrame:
    """Texts that no region absorbs."""
    return spatial.without(texts, regions, on, lambda a, b: G.contained_share(a, b) > share)


def prefer(own: DataFrame, external: DataFrame, on: str, overlap: float = 0.5) -> DataFrame:
    """All external boxes, and the own ones that none of them overlaps."""
    kept = spatial.without(own, external, on, lambda a, b: G.overlap_of_smaller(a, b) > overlap)
    return kept.withColumn("origin", F.lit("own")).unionByName(external.withColumn("origin", F.lit("external")), allowMissingColumns=True)


def crowded(boxes: DataFrame, texts: DataFrame, on: str, share: float = 0.7, least: int = 2) -> DataFrame:
    """(on, elem_id, n): boxes that hold several texts and want a second look."""
    found = spatial.pairs(boxes, texts, on, lambda a, b: G.is_contained(b, a, share))
    return found.groupBy(F.col(f"a.{on}").alias(on), F.col("a.elem_id").alias("elem_id")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def fragments(elements: DataFrame, on: str, least: int = 8, shortest: int = 3, overlap: float = 0.3) -> DataFrame:
    """(on, anchor_id, elem_id): captions of several words, and elements in their rows whose
    caption is a part of theirs.  Paths and bars ("A > B") are no anchors."""
    named = elements.withColumn("norm", X.normal(F.coalesce("text", F.lit(""))))
    anchors = named.where((F.length("norm") >= least) & F.contains("norm", F.lit(" ")) & ~F.col("norm").rlike(r" [>›»|/] "))
    parts = named.where(F.length("norm") >= shortest)
    test = (F.col("a.elem_id") != F.col("b.elem_id")) & F.contains(F.col("a.norm"), F.col("b.norm"))
    found = spatial.pairs(anchors, parts, on, lambda a, b: G.row_overlap(a, b) >= overlap, test)
    return found.select(F.col(f"a.{on}").alias(on), F.col("a.elem_id").alias("anchor_id"), F.col("b.elem_id").alias("elem_id"))


def neighbour_hint(elements: DataFrame, on: str) -> DataFrame:
    """(on, elem_id, hint): below or right of the first element near above or to the left."""
    a, b = G.box("a"), G.box("b")
    (ax, ay), (bx, by) = G.floor_centre(a), G.floor_centre(b)
    above = (F.abs(ax - bx) < 50) & (b.y2 < a.y1) & (a.y1 - b.y2 < 100)
    left = (F.abs(ay - by) < 30) & (b.x2 < a.x1) & (a.x1 - b.x2 < 100)
    near = spatial.pairs(elements, elements, on, lambda *_: above | left, F.col("a.elem_id") != F.col("b.elem_id"))
    name = F.coalesce(F.concat(F.lit("'"), X.present(F.col("b.text")), F.lit("'")), F.col("b.elem_id").cast("string"))
    hint = F.concat(F.when(above, "below ").otherwise("right of "), name)
    return near.groupBy(F.col(f"a.{on}").alias(on), F.col("a.elem_id").alias("elem_id")).agg(F.min_by(hint, F.col("b.elem_id")).alias("hint"))


def shortlist(ranked: DataFrame, pool: DataFrame, on: str, most: int = 8, least: int = 3) -> DataFrame:
    """(on, elem_id, pick): the best-scored elements, padded from the screen to at least a few."""
    scored = ranked.where(F.col("place") <= most).select(on, "elem_id", F.lit(0).alias("tier"), F.col("place").cast("long").alias("place"))
    rest = pool.select(on, "elem_id").join(scored, [on, "elem_id"], "left_anti").select(on, "elem_id", F.lit(1).alias("tier"), F.col("elem_id").cast("long").alias("place"))
    w = Window.partitionBy(on)
    picked = scored.unionByName(rest).withColumns({"pick": F.row_number().over(w.orderBy("tier", "place")), "n": F.count_if(F.col("tier") == 0).over(w)})
    return picked.where((F.col("tier") == 0) | (F.col("n") == 0) | (F.col("pick") <= least)).select(on, "elem_id", "pick")


def category(kind: Column, editable: Column, clickable: Column) -> Column:
    """One of five groups, by the first that fits of the type and role."""
    is_ = lambda words: F.lower(kind).rlike(words)
    return (
        F.when(is_("input|edit|textfield|combo|search|spin|slider") | editable, "input")
        .when(is_("icon|image|symbol|glyph"), "icon")
        .when(is_("button|check|radio|toggle|switch|tab|menu|link|item") | clickable, "button")
        .when(is_("container|group|panel|pane|window|list|tree|toolbar|root"), "container")
        .otherwise("text")
    )

"""Rows, columns, lines and reading order of a screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G


def islands(df: DataFrame, by: list[str], order: list[Column], starts: Column, name: str) -> DataFrame:
    """Numbers runs of rows: ``starts`` says, next to the row before, where a run begins."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn(name, F.sum((first | F.coalesce(starts, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rows(df: DataFrame, by: list[str], tolerance: int = 10, columns: bool = False) -> DataFrame:
    """Adds ``row_id`` (or ``column_id``): boxes chained while their centres are no further
    apart than the tolerance."""
    centre = F.floor(G.centre_x(G.box()) if columns else G.centre_y(G.box()))
    order = [centre, F.col("elem_id")]
    gap = centre - F.lag(centre).over(Window.partitionBy(*by).orderBy(*order))
    return islands(df, by, order, gap > tolerance, "column_id" if columns else "row_id")


def lines(df: DataFrame, by: list[str], overlap: float = 0.5, gap: int = 12) -> DataFrame:
    """Adds ``line_id`` and ``run_id``: boxes in a line overlap the one before vertically, in
    order of their centres; runs of a line are cut at wide gaps."""
    w = Window.partitionBy(*by).orderBy(G.centre_y(G.box()), "x1", "elem_id")
    before = G.Box(*(F.lag(c).over(w) for c in ("x1", "y1", "x2", "y2")))
    lined = islands(df, by, [G.centre_y(G.box()), F.col("x1"), F.col("elem_id")], G.row_overlap(G.box(), before) < overlap, "line_id")
    order = [F.col("x1"), F.col("elem_id")]
    left = F.lag("x2").over(Window.partitionBy(*by, "line_id").orderBy(*order))
    return islands(lined, [*by, "line_id"], order, F.col("x1") - left > gap, "run_id")


def reading_order(df: DataFrame, by: list[str], ratio: float = 0.6, least: int = 4) -> DataFrame:
    """Adds ``reading_pos`` from 0: bands of boxes whose centre lies within a tolerance of
    the band's first box (the first such band counts), bands from top to bottom, boxes of a
    band from left to right."""
    others = [c for c in df.columns if c not in by]
    heights = F.greatest(F.lit(1), F.col("y2") - F.col("y1"))
    row = F.struct(G.centre_y(G.box()).alias("cy"), F.col("x1").alias("left"), F.col("elem_id").alias("id"), F.struct(*others).alias("item"))
    grouped = df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("items"), F.greatest(F.lit(float(least)), ratio * F.percentile(heights, 0.5)).alias("tol"))
    # Anchors of the bands, in order of creation, which is from top to bottom.
    anchors = F.aggregate(
        "items", F.array().cast("array<double>"), lambda acc, r: F.when(F.exists(acc, lambda a: F.abs(r["cy"] - a) <= F.col("tol")), acc).otherwise(F.array_append(acc, r["cy"]))
    )
    banded = grouped.withColumn("anchors", anchors)
    placed = F.transform(
        "items",
        lambda r: F.struct(
            F.array_position(F.transform("anchors", lambda a: F.abs(r["cy"] - a) <= F.col("tol")), True).alias("band"), r["left"].alias("left"), r["cy"].alias("cy"), r["id"].alias("id"), r["item"].alias("item")
        ),
    )
    return banded.select(*by, F.posexplode(F.sort_array(placed)).alias("reading_pos", "p")).select(*by, *[F.col(f"p.item.{c}").alias(c) for c in others], F.col("reading_pos").cast("long"))


def resequence(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``new_id``: E1, E2, ... in reading order."""
    return reading_order(df, by).withColumn("new_id", F.concat(F.lit("E"), (F.col("reading_pos") + 1).cast("string")))


def cuts(df: DataFrame, by: list[str], gap: int = 12) -> DataFrame:
    """(by, cut, at): middles of the horizontal gaps between neighbouring texts of a box."""
    w = Window.partitionBy(*by).orderBy("x1", "elem_id")
    right = F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = df.withColumn("_right", right).where(F.col("x1") - F.col("_right") >= gap)
    return found.select(*by, "elem_id", ((F.col("x1") + F.col("_right")) / 2.0).alias("at"))


def slices(df: DataFrame, parts: Column) -> DataFrame:
    """Cuts each box into equal parts along its longer side."""
    b = G.box()
    wide = G.width(b) >= G.height(b)
    size = F.when(wide, G.width(b)).otherwise(G.height(b))
    step = lambda k: F.floor(size * k / parts).cast("int")
    each = df.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    lo, hi = step(F.col("part")), step(F.col("part") + 1)
    return each.withColumns(
        {
            "x1": F.when(wide, b.x1 + lo).otherwise(b.x1), "x2": F.when(wide, b.x1 + hi).otherwise(b.x2),
            "y1": F.when(wide, b.y1).otherwise(b.y1 + lo), "y2": F.when(wide, b.y2).otherwise(b.y1 + hi),
        }
    )


def groups(leaves: DataFrame, by: list[str], tolerance: int = 10) -> DataFrame:
    """(by, kind, n, members): rows and columns of two or more of the leaves with one parent, and
    grids: two or more rows that stand in the same two or more columns, one leaf in each.

    A row meets columns as a set; rows with one set are a grid, by an equality of sets, so
    rows need not be compared with each other.  Members of a row are from left to right, those
    of a column from top to bottom, those of a grid row by row.  A leaf is in one row, one
    column and one grid at most."""
    placed = rows(rows(leaves, by, tolerance), by, tolerance, columns=True)
    cx, cy = F.floor(G.centre_x(G.box())), F.floor(G.centre_y(G.box()))
    names = lambda c: F.transform(F.sort_array(c), lambda m: m["id"])
    across, down = F.collect_list(F.struct(cx.alias("at"), F.col("elem_id").alias("id"))), F.collect_list(F.struct(cy.alias("at"), F.col("elem_id").alias("id")))
    in_rows = placed.groupBy(*by, "row_id").agg(across.alias("met"), F.sort_array(F.collect_set("column_id")).alias("columns"))
    kind = lambda df, name, members: df.select(*by, F.lit(name).alias("kind"), F.size(members).alias("n"), members.alias("members")).where("n >= 2")
    found_rows = kind(in_rows, "row", names(F.col("met")))
    found_columns = kind(placed.groupBy(*by, "column_id").agg(down.alias("met")), "column", names(F.col("met")))
    full = in_rows.where((F.size("columns") >= 2) & (F.size("columns") == F.size("met")))
    blocks = full.groupBy(*by, "columns").agg(F.sort_array(F.collect_list(F.struct("row_id", names(F.col("met")).alias("ids")))).alias("rows")).where("size(rows) >= 2")
    grids = kind(blocks, "grid", F.flatten(F.transform("rows", lambda r: r["ids"])))
    return found_rows.unionByName(found_columns).unionByName(grids)


def tree_order(df: DataFrame, edges: DataFrame, on: str = "state_id") -> DataFrame:
    """Adds ``reading_pos`` from 0: the children of every node in reading order, each followed by
    what it holds, so a container is never mixed with its neighbours."""
    from . import tours

    placed = df.join(edges.where("parent_id is not null").select(on, "elem_id", F.col("parent_id").alias("_parent")), [on, "elem_id"], "left")
    sides = reading_order(placed, [on, "_parent"]).withColumnRenamed("reading_pos", "_side")
    own = [F.col("_own")] if "parent_id" in df.columns else []
    walked = tours.placed((sides.withColumn("_own", F.col("parent_id")) if own else sides).withColumn("parent_id", F.col("_parent")), None, on, [F.col("_side"), F.col("elem_id")])
    return walked.select(*[F.col("_own" if own and c == "parent_id" else c).alias(c) for c in df.columns], F.col("pre_order").alias("reading_pos"))


def corners(x: Column, y: Column, name: Column) -> list[Column]:
    """Aggregates: which of the points of a group stand for its corners; of equal ones the first."""
    nearest = lambda key: F.min_by(name, F.struct(key, name))
    furthest = lambda key: F.max_by(name, F.struct(key, -name))
    return [nearest(x + y).alias("top_left"), nearest(y - x).alias("top_right"), furthest(x + y).alias("bottom_right"), furthest(y - x).alias("bottom_left")]

"""Queries of reading order, rows, lines and cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elements, layout, tree
from .registry import over, query
from .spatial_queries import EDGES, smallest_parents
from .views import boxes, captions

_CY = "(y1+y2)/2.0"

_READ = f"""
, tol AS (SELECT state_id, greatest(4.0, 0.6*median(greatest(1, y2-y1))) AS tol FROM boxes GROUP BY state_id),
ranked AS (SELECT b.state_id, b.elem_id, b.x1, {_CY} AS cy, t.tol, row_number() OVER (PARTITION BY b.state_id ORDER BY {_CY}, b.x1, b.elem_id) AS rn FROM boxes b JOIN tol t ON b.state_id = t.state_id),
banded AS (
  SELECT state_id, elem_id, x1, cy, rn, 1 AS band, [cy] AS anchors FROM ranked WHERE rn = 1
  UNION ALL
  SELECT n.state_id, n.elem_id, n.x1, n.cy, n.rn,
    CASE WHEN len(list_filter(b.anchors, lambda a: abs(n.cy - a) <= n.tol)) > 0 THEN list_position(list_transform(b.anchors, lambda a: abs(n.cy - a) <= n.tol), true) ELSE len(b.anchors) + 1 END,
    CASE WHEN len(list_filter(b.anchors, lambda a: abs(n.cy - a) <= n.tol)) > 0 THEN b.anchors ELSE list_append(b.anchors, n.cy) END
  FROM banded b JOIN ranked n ON n.state_id = b.state_id AND n.rn = b.rn + 1),
placed AS (SELECT state_id, elem_id, row_number() OVER (PARTITION BY state_id ORDER BY band, x1, cy, elem_id) - 1 AS reading_pos FROM banded)"""


@query("reading_order", over(f"{_READ} SELECT state_id, elem_id, reading_pos FROM placed", recursive=True))
def reading_order(spark, sf):
    return layout.reading_order(boxes(spark, sf), ["state_id"]).select("state_id", "elem_id", "reading_pos")


@query("id_resequence", over(f"{_READ} SELECT state_id, elem_id, 'E' || CAST(reading_pos + 1 AS VARCHAR) AS new_id FROM placed", recursive=True))
def id_resequence(spark, sf):
    return layout.resequence(boxes(spark, sf), ["state_id"]).select("state_id", "elem_id", "new_id")


def _chain(axis: str, name: str) -> str:
    c = f"floor(({axis}1+{axis}2)/2.0)"
    return f"""SELECT state_id, elem_id, sum(start) OVER (PARTITION BY state_id ORDER BY c, elem_id ROWS UNBOUNDED PRECEDING) AS {name} FROM (
      SELECT state_id, elem_id, c, CASE WHEN c - lag(c) OVER (PARTITION BY state_id ORDER BY c, elem_id) <= 10 THEN 0 ELSE 1 END AS start FROM (SELECT *, {c} AS c FROM boxes))"""


@query("row_groups", over(_chain("y", "row_id")))
def row_groups(spark, sf):
    return layout.rows(boxes(spark, sf), ["state_id"]).select("state_id", "elem_id", "row_id")


@query("column_groups", over(_chain("x", "column_id")))
def column_groups(spark, sf):
    return layout.rows(boxes(spark, sf), ["state_id"], columns=True).select("state_id", "elem_id", "column_id")


@query(
    "line_runs",
    over(f"""
    , o AS (SELECT *, lag(y1) OVER w AS py1, lag(y2) OVER w AS py2, {_CY} AS cy FROM boxes WINDOW w AS (PARTITION BY state_id ORDER BY {_CY}, x1, elem_id)),
    s AS (SELECT *, CASE WHEN py1 IS NOT NULL AND least(y2, py2) > greatest(y1, py1) AND (least(y2,py2)-greatest(y1,py1))/CAST(least(y2-y1, py2-py1) AS DOUBLE) >= 0.5 THEN 0 ELSE 1 END AS start FROM o),
    l AS (SELECT *, sum(start) OVER (PARTITION BY state_id ORDER BY cy, x1, elem_id ROWS UNBOUNDED PRECEDING) AS line_id FROM s),
    g AS (SELECT *, CASE WHEN x1 - lag(x2) OVER (PARTITION BY state_id, line_id ORDER BY x1, elem_id) <= 12 THEN 0 ELSE 1 END AS cut FROM l)
    SELECT state_id, elem_id, line_id, sum(cut) OVER (PARTITION BY state_id, line_id ORDER BY x1, elem_id ROWS UNBOUNDED PRECEDING) AS run_id FROM g"""),
)
def line_runs(spark, sf):
    return layout.lines(boxes(spark, sf), ["state_id"]).select("state_id", "elem_id", "line_id", "run_id")


@query(
    "line_texts",
    over(
        f"""
    , t AS (SELECT * FROM captions WHERE text IS NOT NULL),
    o AS (SELECT *, lag(y1) OVER w AS py1, lag(y2) OVER w AS py2, {_CY} AS cy FROM t WINDOW w AS (PARTITION BY state_id ORDER BY {_CY}, x1, elem_id)),
    s AS (SELECT *, CASE WHEN py1 IS NOT NULL AND least(y2, py2) > greatest(y1, py1) AND (least(y2,py2)-greatest(y1,py1))/CAST(least(y2-y1, py2-py1) AS DOUBLE) >= 0.5 THEN 0 ELSE 1 END AS start FROM o),
    l AS (SELECT *, sum(start) OVER (PARTITION BY state_id ORDER BY cy, x1, elem_id ROWS UNBOUNDED PRECEDING) AS line_id FROM s)
    SELECT state_id, line_id, string_agg(text, ' ' ORDER BY x1, elem_id) AS line, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(avg(confidence), 6) AS confidence FROM l GROUP BY state_id, line_id""",
        "captions",
    ),
)
def line_texts(spark, sf):
    lined = layout.lines(captions(spark, sf).where("text is not null"), ["state_id"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x1", "elem_id", "text"))), lambda t: t["text"]), " ")
    return lined.groupBy("state_id", "line_id").agg(joined.alias("line"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(
    "text_split_cuts",
    over("""SELECT state_id, elem_id, (x1 + r)/2.0 AS at FROM (SELECT *, max(x2) OVER (PARTITION BY state_id ORDER BY x1, elem_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM boxes WHERE visual_type = 'text') WHERE x1 - r >= 12"""),
)
def text_split_cuts(spark, sf):
    return layout.cuts(boxes(spark, sf).where("visual_type = 'text'"), ["state_id"])


@query(
    "even_split",
    over("""SELECT state_id, elem_id, part, CASE WHEN w >= h THEN x1 + CAST(floor(w*part/3.0) AS INT) ELSE x1 END AS x1, CASE WHEN w >= h THEN y1 ELSE y1 + CAST(floor(h*part/3.0) AS INT) END AS y1,
      CASE WHEN w >= h THEN x1 + CAST(floor(w*(part+1)/3.0) AS INT) ELSE x2 END AS x2, CASE WHEN w >= h THEN y2 ELSE y1 + CAST(floor(h*(part+1)/3.0) AS INT) END AS y2
      FROM (SELECT *, x2-x1 AS w, y2-y1 AS h FROM boxes WHERE visual_type = 'button') CROSS JOIN (SELECT unnest([0,1,2]) AS part)"""),
)
def even_split(spark, sf):
    return layout.slices(boxes(spark, sf).where("visual_type = 'button'"), F.lit(3)).select("state_id", "elem_id", "part", "x1", "y1", "x2", "y2")


@query(
    "limit_text_first",
    over("SELECT state_id, elem_id FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY CASE WHEN visual_type = 'text' AND coalesce(text,'') <> '' THEN 0 ELSE 1 END, confidence DESC, elem_id) AS n FROM captions) WHERE n <= 3", "captions"),
)
def limit_text_first(spark, sf):
    """The limit is the operator: the first elements of each screen."""
    return elements.text_first(captions(spark, sf), 3).select("state_id", "elem_id")


@query(
    "merge_group",
    over(
        """SELECT state_id, hint, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max(confidence) AS confidence, min(elem_id) AS elem_id,
      arg_min(text, -length(text)*1000 + elem_id) FILTER (WHERE text IS NOT NULL) AS text,
      arg_min(visual_type, CASE visual_type WHEN 'text' THEN 1000 ELSE 0 END + elem_id) AS visual_type FROM captions GROUP BY state_id, hint""",
        "captions",
    ),
)
def merge_group(spark, sf):
    df = captions(spark, sf).withColumn("interactable", F.col("visual_type") != "text")
    return elements.merge_group(["state_id", "hint"], df).drop("interactable")


def _chained(axis: str, name: str) -> str:
    c = f"floor(({axis}1+{axis}2)/2.0)"
    return f"""SELECT *, sum(start_{name}) OVER (PARTITION BY state_id, pid ORDER BY {c}, elem_id ROWS UNBOUNDED PRECEDING) AS {name}"""


def _starts(axis: str, name: str) -> str:
    c = f"floor(({axis}1+{axis}2)/2.0)"
    return f"CASE WHEN {c} - lag({c}) OVER (PARTITION BY state_id, pid ORDER BY {c}, elem_id) <= 10 THEN 0 ELSE 1 END AS start_{name}"


@query(
    "layout_groups",
    over(f"""{EDGES}, leaf AS (SELECT b.*, coalesce(e.parent_id, 0) AS pid FROM boxes b LEFT JOIN edges e ON e.state_id = b.state_id AND e.elem_id = b.elem_id WHERE NOT EXISTS (SELECT 1 FROM edges p WHERE p.state_id = b.state_id AND p.parent_id = b.elem_id)),
      r AS ({_chained("y", "row_id")} FROM (SELECT *, {_starts("y", "row_id")} FROM leaf)), c AS ({_chained("x", "column_id")} FROM (SELECT *, {_starts("x", "column_id")} FROM r)),
      p AS (SELECT *, floor((x1+x2)/2.0) AS cx, floor((y1+y2)/2.0) AS cy FROM c),
      met AS (SELECT state_id, pid, row_id, count(*) AS n, count(DISTINCT column_id) AS k, array_to_string(list_sort(list(DISTINCT column_id)), ',') AS cols, string_agg(CAST(elem_id AS VARCHAR), ',' ORDER BY cx, elem_id) AS ids FROM p GROUP BY state_id, pid, row_id)
      SELECT state_id, pid AS parent_id, 'row' AS kind, n, ids AS members FROM met WHERE n >= 2
      UNION ALL SELECT state_id, pid, 'column', count(*), string_agg(CAST(elem_id AS VARCHAR), ',' ORDER BY cy, elem_id) FROM p GROUP BY state_id, pid, column_id HAVING count(*) >= 2
      UNION ALL SELECT state_id, pid, 'grid', sum(n), string_agg(ids, ',' ORDER BY row_id) FROM met WHERE k >= 2 AND k = n GROUP BY state_id, pid, cols HAVING count(*) >= 2"""),
)
def layout_groups(spark, sf):
    """Rows, columns and grids of the leaves with one parent; 0 stands for the root."""
    df, edges = boxes(spark, sf), smallest_parents(spark, sf)
    leaves = tree.leaves(df, edges).join(edges.select("state_id", "elem_id", "parent_id"), ["state_id", "elem_id"], "left").withColumn("parent_id", F.coalesce("parent_id", F.lit(0)))
    found = layout.groups(leaves, ["state_id", "parent_id"])
    return found.withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))

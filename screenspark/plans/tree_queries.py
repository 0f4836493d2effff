"""Queries of tours, nested trees and labels from accessibility trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import harvest, tours
from .registry import over, query
from .spatial_queries import _UP, EDGES, smallest_parents
from .views import boxes, captions

_WALK = """, kid AS (SELECT b.*, e.parent_id, row_number() OVER (PARTITION BY b.state_id, e.parent_id ORDER BY {order}) AS r FROM {nodes} b LEFT JOIN edges e ON e.state_id = b.state_id AND e.elem_id = b.elem_id),
  walk AS (SELECT state_id, elem_id, [r] AS key FROM kid WHERE parent_id IS NULL UNION ALL SELECT k.state_id, k.elem_id, list_append(w.key, k.r) FROM walk w JOIN kid k ON k.state_id = w.state_id AND k.parent_id = w.elem_id),
  ordered AS (SELECT state_id, elem_id, len(key) - 1 AS depth, row_number() OVER (PARTITION BY state_id ORDER BY key) - 1 AS pre_order FROM walk)"""


@query(
    "tree_intervals",
    over(
        f"""{_UP}{_WALK.format(order='b.y1, b.x1, b.elem_id', nodes='boxes')}, held AS (SELECT state_id, ancestor_id AS elem_id, count(*) AS n FROM up GROUP BY state_id, ancestor_id)
      SELECT o.state_id, o.elem_id, o.depth, o.pre_order, o.pre_order + coalesce(h.n, 0) AS last FROM ordered o LEFT JOIN held h ON h.state_id = o.state_id AND h.elem_id = o.elem_id""",
        recursive=True,
    ),
)
def tree_intervals(spark, sf):
    return tours.placed(boxes(spark, sf).select("state_id", "elem_id", "x1", "y1"), smallest_parents(spark, sf)).select("state_id", "elem_id", "depth", "pre_order", "last")


@query(
    "nested_tree",
    over(
        f"""{EDGES}, named AS (SELECT state_id, elem_id, x1, y1, x2, y2, visual_type, text FROM captions WHERE (state_id + elem_id) % 9 <> 0),
      asked AS (SELECT state_id, elem_id FROM edges UNION SELECT state_id, parent_id FROM edges),
      node AS (SELECT * FROM named UNION ALL SELECT a.state_id, a.elem_id, 0, 0, 0, 0, 'unknown', NULL FROM asked a WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.state_id = a.state_id AND n.elem_id = a.elem_id))
      {_WALK.format(order='b.y1, b.x1, b.elem_id', nodes='node')},
      told AS (SELECT o.*, lead(depth) OVER (PARTITION BY o.state_id ORDER BY pre_order) AS next, '{{"id":"' || CAST(n.elem_id AS VARCHAR) || '","bounds":[' || concat_ws(',', n.x1, n.y1, n.x2, n.y2) || '],"visual_type":"' || visual_type || '"' || CASE WHEN text IS NULL THEN '' ELSE ',"text":"' || text || '"' END AS own FROM ordered o JOIN node n ON n.state_id = o.state_id AND n.elem_id = o.elem_id),
      joined AS (SELECT state_id, string_agg(own || CASE WHEN next > depth THEN ',"children":[' ELSE '}}' || repeat(']}}', depth - coalesce(next, 0)) || CASE WHEN next IS NULL THEN '' ELSE ',' END END, '' ORDER BY pre_order) AS inside FROM told GROUP BY state_id),
      tops AS (SELECT n.state_id, count(*) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM node n JOIN ordered o ON o.state_id = n.state_id AND o.elem_id = n.elem_id WHERE depth = 0 GROUP BY n.state_id)
      SELECT j.state_id, CASE WHEN n = 1 THEN inside ELSE '{{"id":"ROOT","bounds":[' || concat_ws(',', x1, y1, x2, y2) || '],"role":"group","visual_type":"unknown","children":[' || inside || ']}}' END AS hierarchy FROM joined j JOIN tops t ON t.state_id = j.state_id""",
        "captions",
        recursive=True,
    ),
)
def nested_tree(spark, sf):
    """Every ninth element is known to the tree alone."""
    known = captions(spark, sf).where("(state_id + elem_id) % 9 <> 0").select("state_id", "elem_id", "x1", "y1", "x2", "y2", "visual_type", "text")
    fields = [F.col("elem_id").cast("string").alias("id"), F.array("x1", "y1", "x2", "y2").alias("bounds"), F.col("visual_type"), F.col("text")]
    return tours.nested(known, smallest_parents(spark, sf), fields)


_NODES = """, n AS (SELECT b.state_id, b.elem_id, e.parent_id, CASE WHEN part_id % 4 = 0 THEN '' ELSE ' Name' || CAST(part_id % 3 AS VARCHAR) || ' ' END AS name, ['Button', 'Text', 'Image', 'Edit', 'Pane', 'CheckBox'][(b.state_id + b.elem_id) % 6 + 1] AS control_type,
    x1 + (b.elem_id * 7) % 23 AS x1, y1, x2 + (b.elem_id * 7) % 23 AS x2, y2, (b.state_id + b.elem_id) % 13 <> 0 AS visible FROM boxes b LEFT JOIN edges e ON e.state_id = b.state_id AND e.elem_id = b.elem_id)"""


def _accessible(spark, sf):
    """Boxes as nodes: some without a name or hidden, some of one name, moved a little."""
    b = boxes(spark, sf).join(smallest_parents(spark, sf).select("state_id", "elem_id", "parent_id"), ["state_id", "elem_id"], "left")
    kinds = F.array(*map(F.lit, ["Button", "Text", "Image", "Edit", "Pane", "CheckBox"]))
    moved = (F.col("elem_id") * 7) % 23
    name = F.when(F.col("part_id") % 4 == 0, "").otherwise(F.concat(F.lit(" Name"), (F.col("part_id") % 3).cast("string"), F.lit(" ")))
    place = ((F.col("state_id") + F.col("elem_id")) % 6).cast("int")
    return b.select("state_id", "elem_id", "parent_id", name.alias("name"), kinds[place].alias("control_type"), (F.col("x1") + moved).alias("x1"), "y1", (F.col("x2") + moved).alias("x2"), "y2", ((F.col("state_id") + F.col("elem_id")) % 13 != 0).alias("visible"))


@query(
    "accessibility_labels",
    over(
        f"""{EDGES}{_NODES}{_WALK.format(order='b.elem_id', nodes='n')},
      raw AS (SELECT n.*, trim(name) AS said, o.pre_order, CAST(round_even((x1 - 10) * 1.5, 0) AS INT) AS rx1, CAST(round_even((y1 - 10) * 1.5, 0) AS INT) AS ry1, CAST(round_even((x2 - 10) * 1.5, 0) AS INT) AS rx2, CAST(round_even((y2 - 10) * 1.5, 0) AS INT) AS ry2 FROM n JOIN ordered o ON o.state_id = n.state_id AND o.elem_id = n.elem_id),
      cut AS (SELECT *, greatest(0, rx1) AS bx1, greatest(0, ry1) AS by1, least(450, rx2) AS bx2, least(225, ry2) AS by2 FROM raw),
      fit AS (SELECT *, visible AND bx2 - bx1 >= 4 AND by2 - by1 >= 4 AND greatest(0, bx2 - bx1) * greatest(0, by2 - by1) >= 0.5 * greatest(0, rx2 - rx1) * greatest(0, ry2 - ry1) AS fits, said <> '' OR control_type IN ('Image', 'Edit', 'ComboBox') AS tells FROM cut),
      down AS (
        SELECT state_id, elem_id, fits AND tells AS is_element, CAST(NULL AS INT) AS holder, CASE WHEN fits AND tells THEN [{{id: elem_id, said: lower(said), x1: bx1, y1: by1, x2: bx2, y2: by2}}] ELSE [] END AS above FROM fit WHERE parent_id IS NULL
        UNION ALL SELECT f.state_id, f.elem_id, k.yes, d.above[-1].id, CASE WHEN k.yes THEN list_append(d.above, {{id: f.elem_id, said: lower(f.said), x1: f.bx1, y1: f.by1, x2: f.bx2, y2: f.by2}}) ELSE d.above END
        FROM down d JOIN fit f ON f.state_id = d.state_id AND f.parent_id = d.elem_id,
          LATERAL (SELECT f.fits AND f.tells AND NOT (f.said <> '' AND len(list_filter(d.above, lambda k: k.said = lower(f.said) AND f.bx1 >= k.x1 - 2 AND f.by1 >= k.y1 - 2 AND f.bx2 <= k.x2 + 2 AND f.by2 <= k.y2 + 2)) > 0) AS yes) k),
      el AS (SELECT f.*, d.holder, 'E' || CAST(row_number() OVER (PARTITION BY f.state_id ORDER BY pre_order) AS VARCHAR) AS elem_key,
        control_type IN ('Button', 'CheckBox') AND said <> '' AS acts, length(said) > 2 AND by2 - by1 <= 48 AND bx2 - bx1 < 1.6 * (by2 - by1) AS small FROM fit f JOIN down d ON d.state_id = f.state_id AND d.elem_id = f.elem_id WHERE d.is_element)
      SELECT e.state_id, e.elem_id, e.elem_key, p.elem_key AS parent_key, e.bx1 AS x1, e.by1 AS y1, e.bx2 AS x2, e.by2 AS y2, CASE WHEN e.acts AND e.small OR e.control_type = 'Image' THEN 'icon' WHEN e.acts THEN lower(e.control_type) WHEN e.control_type = 'Text' AND e.said <> '' THEN 'text' ELSE 'block' END AS visual_type,
        CASE WHEN e.acts OR e.control_type = 'Text' THEN e.said END AS text, CASE WHEN e.acts AND NOT e.small THEN lower(e.control_type) END AS role_word, CASE WHEN e.acts AND e.small THEN 'icon-only?' END AS review
      FROM el e LEFT JOIN el p ON p.state_id = e.state_id AND p.elem_id = e.holder""",
        recursive=True,
    ),
)
def accessibility_labels(spark, sf):
    return harvest.labels(_accessible(spark, sf), (10, 10, 300, 150), (450, 225)).drop("control_type")


@query("accessibility_names", over("SELECT state_id, array_to_string(list_sort(list(DISTINCT 'Name' || CAST(part_id % 3 AS VARCHAR)) FILTER (WHERE part_id % 4 <> 0)), '|') AS names FROM boxes GROUP BY state_id"))
def accessibility_names(spark, sf):
    named = harvest.all_names(_accessible(spark, sf))
    return named.select("state_id", F.when(F.size("names") > 0, F.array_join("names", "|")).alias("names"))

"""Queries of geometry, filters, spatial joins, suppression and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import elements, greedy, spatial, tree
from . import registry as Q
from .registry import over, query
from .views import boxes, captions, truth

PAIR = "SELECT a.state_id, a.elem_id AS a_id, b.elem_id AS b_id"
JOIN = "FROM boxes a JOIN boxes b ON a.state_id = b.state_id"


def pair_ids(df, *more):
    return df.select(F.col("a.state_id"), F.col("a.elem_id").alias("a_id"), F.col("b.elem_id").alias("b_id"), *more)


@query("iou_pairs", over(f"{PAIR}, round({Q.iou('a', 'b')}, 6) AS iou {JOIN} AND a.elem_id < b.elem_id WHERE {Q.iou('a', 'b')} > 0.3"))
def iou_pairs(spark, sf):
    df = boxes(spark, sf)
    return pair_ids(spatial.self_pairs(df, "state_id", lambda a, b: G.iou(a, b) > 0.3), F.round(G.iou(G.box("a"), G.box("b")), 6).alias("iou"))


@query("containment_pairs", over(f"{PAIR} {JOIN} AND a.elem_id <> b.elem_id WHERE {Q.contained('a', 'b')} >= 0.8"))
def containment_pairs(spark, sf):
    df = boxes(spark, sf)
    return pair_ids(spatial.pairs(df, df, "state_id", G.is_contained, F.col("a.elem_id") != F.col("b.elem_id")))


@query("strict_containment_pairs", over(f"{PAIR} {JOIN} WHERE {Q.strictly('a', 'b')}"))
def strict_containment_pairs(spark, sf):
    df = boxes(spark, sf)
    return pair_ids(spatial.pairs(df, df, "state_id", G.is_strictly_contained))


@query("inside_with_slack_pairs", over(f"{PAIR} {JOIN} AND a.elem_id <> b.elem_id WHERE a.x1 >= b.x1-2 AND a.y1 >= b.y1-2 AND a.x2 <= b.x2+2 AND a.y2 <= b.y2+2"))
def inside_with_slack_pairs(spark, sf):
    df = boxes(spark, sf)
    return pair_ids(spatial.pairs(df, df, "state_id", G.is_inside, F.col("a.elem_id") != F.col("b.elem_id")))


@query("overlap_min_pairs", over(f"{PAIR} {JOIN} AND a.elem_id < b.elem_id WHERE CAST({Q.inter('a', 'b')} AS DOUBLE)/least({Q.area('a')},{Q.area('b')}) > 0.7"))
def overlap_min_pairs(spark, sf):
    return pair_ids(spatial.self_pairs(boxes(spark, sf), "state_id", lambda a, b: G.overlap_of_smaller(a, b) > 0.7))


@query(
    "hybrid_overlap_pairs",
    over(f"{PAIR} {JOIN} AND a.elem_id < b.elem_id WHERE greatest({Q.inter('a', 'b')}/({Q.area('a')}+{Q.area('b')}-{Q.inter('a', 'b')}+1e-6), {Q.contained('a', 'b')}, {Q.contained('b', 'a')}) > 0.9"),
)
def hybrid_overlap_pairs(spark, sf):
    return pair_ids(spatial.self_pairs(boxes(spark, sf), "state_id", lambda a, b: G.hybrid_overlap(a, b) > 0.9))


_GAP = "greatest(greatest(0, b.x1-a.x2, a.x1-b.x2), greatest(0, b.y1-a.y2, a.y1-b.y2))"


@query("edge_gap_pairs", over(f"{PAIR}, CASE WHEN {Q.inter('a', 'b')} > 0 THEN 0 ELSE {_GAP} END AS gap {JOIN} AND a.elem_id < b.elem_id WHERE {_GAP} <= 5"))
def edge_gap_pairs(spark, sf):
    return pair_ids(spatial.self_pairs(boxes(spark, sf), "state_id", lambda a, b: G.are_close(a, b, 5)), G.edge_gap(G.box("a"), G.box("b")).alias("gap"))


@query("centre_distance_pairs", over(f"{PAIR}, round(sqrt(pow((a.x1+a.x2-b.x1-b.x2)/2.0,2)+pow((a.y1+a.y2-b.y1-b.y2)/2.0,2)), 6) AS distance {JOIN} AND a.elem_id < b.elem_id"))
def centre_distance_pairs(spark, sf):
    return pair_ids(spatial.self_pairs(boxes(spark, sf), "state_id", lambda *_: F.lit(True)), F.round(G.centre_distance(G.box("a"), G.box("b")), 6).alias("distance"))


@query(
    "row_overlap_pairs",
    over(f"{PAIR}, round((least(a.y2,b.y2)-greatest(a.y1,b.y1))/CAST(least(a.y2-a.y1,b.y2-b.y1) AS DOUBLE), 6) AS share {JOIN} AND a.elem_id < b.elem_id WHERE least(a.y2,b.y2) > greatest(a.y1,b.y1)"),
)
def row_overlap_pairs(spark, sf):
    return pair_ids(spatial.self_pairs(boxes(spark, sf), "state_id", lambda a, b: G.row_overlap(a, b) > 0), F.round(G.row_overlap(G.box("a"), G.box("b")), 6).alias("share"))


@query("touching_pairs", over(f"{PAIR} {JOIN} AND a.elem_id < b.elem_id WHERE a.x2 >= b.x1 AND b.x2 >= a.x1 AND a.y2 >= b.y1 AND b.y2 >= a.y1"))
def touching_pairs(spark, sf):
    return pair_ids(spatial.self_pairs(boxes(spark, sf), "state_id", G.touches))


@query(
    "fill_ratio",
    over("SELECT state_id, visual_type, round(sum((x2-x1)*(y2-y1))/CAST(greatest(1,(max(x2)-min(x1))*(max(y2)-min(y1))) AS DOUBLE), 6) AS fill, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM boxes GROUP BY state_id, visual_type"),
)
def fill_ratio(spark, sf):
    return boxes(spark, sf).groupBy("state_id", "visual_type").agg(F.round(G.fill_ratio(), 6).alias("fill"), *G.union_aggregates())


@query(
    "size_filter",
    over("""SELECT state_id, elem_id FROM boxes WHERE confidence >= 0.3 AND ((x2-x1)*(y2-y1) >= 1500 OR visual_type = 'text') AND x2-x1 >= 10 AND y2-y1 >= 10
      AND (greatest(x2-x1,y2-y1)/CAST(greatest(least(x2-x1,y2-y1),1) AS DOUBLE) <= 8 OR visual_type IN ('divider','text'))"""),
)
def size_filter(spark, sf):
    df = boxes(spark, sf).withColumn("source", F.lit("test"))
    return elements.size_filter(df, least_area=1500, aspect=8.0).select("state_id", "elem_id")


@query(
    "validity_issues",
    over("""SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([
      CASE WHEN NOT ((x1+x2)/2.0/300 BETWEEN 0 AND 1 AND (y1+y2)/2.0/150 BETWEEN 0 AND 1 AND (x2-x1)/300.0 BETWEEN 0 AND 1 AND (y2-y1)/150.0 BETWEEN 0 AND 1) THEN 'outside' END,
      CASE WHEN (x2-x1)/300.0 < 0.01 OR (y2-y1)/150.0 < 0.01 THEN 'tiny' END, CASE WHEN (x2-x1)/300.0 > 0.9 OR (y2-y1)/150.0 > 0.9 THEN 'huge' END], lambda i: i IS NOT NULL)) AS issue FROM boxes) GROUP BY issue"""),
)
def validity_issues(spark, sf):
    return elements.validity(boxes(spark, sf), 300, 150).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("rect_search", over("SELECT state_id, elem_id FROM boxes WHERE x2 >= 50 AND 120 >= x1 AND y2 >= 30 AND 60 >= y1"))
def rect_search(spark, sf):
    rect = G.Box(*(F.lit(v) for v in (50, 30, 120, 60)))
    return boxes(spark, sf).where(G.touches(G.box(), rect)).select("state_id", "elem_id")


@query("type_search", over("SELECT state_id, elem_id FROM captions WHERE visual_type = 'button' AND contains(lower(text), 'ring')", "captions"))
def type_search(spark, sf):
    return captions(spark, sf).where((F.col("visual_type") == "button") & F.contains(F.lower("text"), F.lit("ring"))).select("state_id", "elem_id")


@query("hit_test_smallest", over("SELECT state_id, elem_id FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY (x2-x1)*(y2-y1), elem_id) AS n FROM boxes WHERE 100 BETWEEN x1 AND x2 AND 60 BETWEEN y1 AND y2) WHERE n = 1"))
def hit_test_smallest(spark, sf):
    return spatial.hit_test(boxes(spark, sf), "state_id", F.lit(100), F.lit(60))


@query("within_bounds", over("SELECT a.state_id, a.elem_id FROM boxes a JOIN boxes b ON a.state_id = b.state_id AND b.elem_id = 1 WHERE (a.x1+a.x2)/2.0 BETWEEN b.x1 AND b.x2 AND (a.y1+a.y2)/2.0 BETWEEN b.y1 AND b.y2"))
def within_bounds(spark, sf):
    df = boxes(spark, sf)
    return spatial.pairs(df, df.where("elem_id = 1"), "state_id", lambda a, b: G.has_centre_of(b, a)).select("a.state_id", "a.elem_id")


for _name, _test, _axis in (
    ("right_of", "(a.x1+a.x2)/2.0 > b.x2", "y"), ("left_of", "(a.x1+a.x2)/2.0 < b.x1", "y"), ("below", "(a.y1+a.y2)/2.0 > b.y2", "x"), ("above", "(a.y1+a.y2)/2.0 < b.y1", "x"),
):

    @query(
        _name,
        over(f"SELECT a.state_id, a.elem_id, abs((a.{_axis}1+a.{_axis}2)/2.0-(b.{_axis}1+b.{_axis}2)/2.0) AS off_axis FROM boxes a JOIN boxes b ON a.state_id = b.state_id AND b.elem_id = 1 AND a.elem_id <> 1 WHERE {_test}"),
    )
    def beside(spark, sf, direction=_name.removesuffix("_of")):
        df = boxes(spark, sf)
        return spatial.beside(df, df.where("elem_id = 1"), "state_id", direction).select("state_id", "elem_id", F.col("offset").alias("off_axis"))


_PARENT = """SELECT state_id, elem_id, parent_id FROM (SELECT a.state_id, a.elem_id, b.elem_id AS parent_id,
  row_number() OVER (PARTITION BY a.state_id, a.elem_id ORDER BY {order}, b.elem_id) AS n {join} AND a.elem_id <> b.elem_id WHERE {test}) WHERE n = 1"""
SMALLEST = _PARENT.format(order=Q.area("b"), join=JOIN, test=Q.strictly("a", "b"))


def smallest_parents(spark, sf):
    return spatial.parent(boxes(spark, sf), "state_id", G.is_strictly_contained)


@query("parent_smallest", over(SMALLEST))
def parent_smallest(spark, sf):
    return smallest_parents(spark, sf)


LARGEST_TEST = f"{Q.area('b')} > {Q.area('a')} AND {Q.contained('a', 'b')} >= 0.7"


def largest_parents(spark, sf):
    test = lambda a, b: (G.area(b) > G.area(a)) & G.is_contained(a, b, 0.7)
    return spatial.parent(boxes(spark, sf), "state_id", test, largest=True)


@query("parent_largest", over(_PARENT.format(order=f"-{Q.area('b')}", join=JOIN, test=LARGEST_TEST)))
def parent_largest(spark, sf):
    return largest_parents(spark, sf)


EDGES = f", edges AS ({SMALLEST})"


@query("leaf_nodes", over(f"{EDGES} SELECT b.state_id, b.elem_id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.state_id = b.state_id AND e.parent_id = b.elem_id)"))
def leaf_nodes(spark, sf):
    return tree.leaves(boxes(spark, sf), smallest_parents(spark, sf)).select("state_id", "elem_id")


@query(
    "root_synthesis",
    over(f"""{EDGES} SELECT state_id, count(*) AS n_top, CASE WHEN count(*) = 1 THEN CAST(min(elem_id) AS VARCHAR) ELSE 'ROOT' END AS root_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2
      FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.state_id = b.state_id AND e.elem_id = b.elem_id) GROUP BY state_id"""),
)
def root_synthesis(spark, sf):
    return tree.roots(boxes(spark, sf), smallest_parents(spark, sf))


_UP = f"""{EDGES}, up AS (SELECT state_id, elem_id, parent_id AS ancestor_id, CAST(1 AS BIGINT) AS distance FROM edges
  UNION ALL SELECT u.state_id, u.elem_id, e.parent_id, u.distance + 1 FROM up u JOIN edges e ON e.state_id = u.state_id AND e.elem_id = u.ancestor_id)"""


@query("ancestors", over(f"{_UP} SELECT state_id, elem_id, ancestor_id, distance FROM up", recursive=True))
def ancestors(spark, sf):
    return tree.ancestors(smallest_parents(spark, sf))


@query("depth_map", over(f"{_UP} SELECT b.state_id, b.elem_id, coalesce(max(u.distance), 0) AS depth FROM boxes b LEFT JOIN up u ON u.state_id = b.state_id AND u.elem_id = b.elem_id GROUP BY b.state_id, b.elem_id", recursive=True))
def depth_map(spark, sf):
    return tree.depths(boxes(spark, sf), smallest_parents(spark, sf))


@query(
    "xpath",
    over(
        f"""{_UP}, named AS (SELECT state_id, elem_id, '/' || visual_type || '[@id=''' || CAST(elem_id AS VARCHAR) || ''']' AS step FROM boxes),
        chain AS (SELECT u.state_id, u.elem_id, string_agg(n.step, '' ORDER BY u.distance DESC) AS prefix FROM up u JOIN named n ON n.state_id = u.state_id AND n.elem_id = u.ancestor_id GROUP BY u.state_id, u.elem_id)
        SELECT n.state_id, n.elem_id, coalesce(c.prefix, '') || n.step AS path FROM named n LEFT JOIN chain c ON c.state_id = n.state_id AND c.elem_id = n.elem_id""",
        recursive=True,
    ),
)
def xpath(spark, sf):
    return tree.paths(boxes(spark, sf), smallest_parents(spark, sf))


@query(
    "tree_edits",
    over(f"""{EDGES}, big AS ({_PARENT.format(order="-" + Q.area("b"), join=JOIN, test=LARGEST_TEST)})
      SELECT coalesce(a.state_id, b.state_id) AS state_id, coalesce(a.elem_id, b.elem_id) AS elem_id, 'set_parent' AS op, CAST(a.parent_id AS VARCHAR) AS old, CAST(b.parent_id AS VARCHAR) AS new
      FROM edges a FULL JOIN big b ON a.state_id = b.state_id AND a.elem_id = b.elem_id WHERE a.parent_id IS DISTINCT FROM b.parent_id"""),
)
def tree_edits(spark, sf):
    return tree.edits(smallest_parents(spark, sf), largest_parents(spark, sf))


# --- suppression ------------------------------------------------------------------------


@query(
    "nms_per_type",
    over(Q.fold_sql("boxes", "state_id, visual_type", "confidence DESC, elem_id", f"{Q.iou('k', 'n')} >= 0.2", "elem_id, x1, y1, x2, y2") + " SELECT state_id, visual_type, u.elem_id AS elem_id FROM (SELECT state_id, visual_type, unnest(kept) AS u FROM final)", recursive=True),
)
def nms_per_type(spark, sf):
    kept = greedy.suppress(boxes(spark, sf), ["state_id", "visual_type"], threshold=0.2)
    return kept.select("state_id", "visual_type", "elem_id")


_CROSS = f"""({Q.iou("k", "n")} > 0.4 OR CASE
  WHEN {Q.contained("n", "k")} >= 0.75 THEN NOT ((k.visual_type = 'block' AND n.visual_type <> 'block') OR {Q.area("n")} < {Q.area("k")}*0.2)
  WHEN {Q.contained("k", "n")} >= 0.75 THEN NOT ((n.visual_type = 'block' AND k.visual_type <> 'block') OR {Q.area("k")} < {Q.area("n")}*0.2) ELSE false END)"""


@query(
    "cross_type_nms",
    over(
        Q.fold_sql("captions", "state_id", "CASE WHEN coalesce(text, '') <> '' THEN 0 ELSE 1 END, CASE visual_type WHEN 'button' THEN 0 WHEN 'input_field' THEN 0 ELSE 2 END, confidence DESC, elem_id", _CROSS, "elem_id, x1, y1, x2, y2, visual_type")
        + " SELECT state_id, u.elem_id AS elem_id FROM (SELECT state_id, unnest(kept) AS u FROM final)",
        "captions", recursive=True,
    ),
)
def cross_type_nms(spark, sf):
    return greedy.suppress_across_types(captions(spark, sf), ["state_id"]).select("state_id", "elem_id")


@query(
    "near_duplicates",
    over(
        Q.fold_sql(
            "captions", "state_id", "CASE WHEN coalesce(text, '') <> '' THEN 0 ELSE 1 END, confidence DESC, elem_id",
            f"(greatest(abs(k.x1-n.x1), abs(k.x2-n.x2), abs(k.y1-n.y1), abs(k.y2-n.y2)) <= 20 OR (coalesce(n.text, '') <> '' AND coalesce(k.text = n.text, false) AND {Q.iou('k', 'n')} > 0.3))",
            "elem_id, x1, y1, x2, y2, text",
        )
        + " SELECT state_id, u.elem_id AS elem_id FROM (SELECT state_id, unnest(kept) AS u FROM final)",
        "captions", recursive=True,
    ),
)
def near_duplicates(spark, sf):
    return greedy.drop_near_duplicates(captions(spark, sf), ["state_id"], tolerance=20).select("state_id", "elem_id")


_CLAIM = f"SELECT state_id, text_id, elem_id FROM (SELECT a.state_id, a.elem_id AS text_id, b.elem_id AS elem_id, row_number() OVER (PARTITION BY a.state_id, a.elem_id ORDER BY {Q.area('b')}, b.elem_id) AS n {JOIN} WHERE a.visual_type = 'text' AND b.visual_type <> 'text' AND ({Q.iou('a', 'b')} > 0.3 OR {Q.contained('a', 'b')} >= 0.7)) WHERE n = 1"


@query("text_claim", over(_CLAIM))
def text_claim(spark, sf):
    df = boxes(spark, sf)
    return spatial.claim_texts(df.where("visual_type = 'text'"), df.where("visual_type <> 'text'"), "state_id")


@query(
    "region_keep_smaller",
    over(f"SELECT a.state_id, a.elem_id FROM boxes a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE a.state_id = b.state_id AND {Q.area('b')} < {Q.area('a')} AND greatest({Q.inter('a', 'b')}/({Q.area('a')}+{Q.area('b')}-{Q.inter('a', 'b')}+1e-6), {Q.contained('a', 'b')}, {Q.contained('b', 'a')}) > 0.9)"),
)
def region_keep_smaller(spark, sf):
    return spatial.keep_smaller(boxes(spark, sf), "state_id").select("state_id", "elem_id")


@query("gap_join", over(f"SELECT a.state_id, a.elem_id FROM boxes a WHERE a.visual_type = 'text' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.visual_type <> 'text' AND a.state_id = b.state_id AND {Q.iou('a', 'b')} > 0.3)"))
def gap_join(spark, sf):
    df = boxes(spark, sf)
    return spatial.without(df.where("visual_type = 'text'"), df.where("visual_type <> 'text'"), "state_id", lambda a, b: G.iou(a, b) > 0.3).select("state_id", "elem_id")


@query(
    "absorbed_texts",
    over(
        f"""SELECT a.state_id, a.elem_id FROM captions a WHERE a.visual_type <> 'text' OR NOT EXISTS (SELECT 1 FROM captions b WHERE a.state_id = b.state_id AND b.visual_type NOT IN ('text','block')
          AND coalesce(b.text,'') <> '' AND lower(trim(a.text)) = lower(trim(b.text)) AND {Q.contained("a", "b")} >= 0.7)""",
        "captions",
    ),
)
def absorbed_texts(spark, sf):
    return elements.absorbed_texts(captions(spark, sf)).select("state_id", "elem_id")


_DISTANCE = """CASE WHEN b.y2 <= a.y1 AND b.x2 >= a.x1 AND a.x2 >= b.x1 THEN a.y1-b.y2 WHEN b.x2 <= a.x1 AND b.y2 >= a.y1 AND a.y2 >= b.y1 THEN a.x1-b.x2
  WHEN b.x1 >= a.x2 AND b.y2 >= a.y1 AND a.y2 >= b.y1 THEN b.x1-a.x2 WHEN b.y1 >= a.y2 AND b.x2 >= a.x1 AND a.x2 >= b.x1 THEN b.y1-a.y2
  ELSE sqrt(pow((a.x1+a.x2-b.x1-b.x2)/2.0,2)+pow((a.y1+a.y2-b.y1-b.y2)/2.0,2)) END"""


@query(
    "label_knn",
    over(f"""SELECT state_id, elem_id, near_id, round(d, 6) AS distance FROM (SELECT a.state_id, a.elem_id, b.elem_id AS near_id, {_DISTANCE} AS d,
      row_number() OVER (PARTITION BY a.state_id, a.elem_id ORDER BY {_DISTANCE}, b.elem_id) AS n {JOIN} AND a.elem_id <> b.elem_id WHERE a.visual_type <> 'text' AND b.visual_type = 'text' AND {_DISTANCE} < 50) WHERE n = 1"""),
)
def label_knn(spark, sf):
    df = boxes(spark, sf)
    found = spatial.nearest(df.where("visual_type <> 'text'"), df.where("visual_type = 'text'"), "state_id", 50)
    return found.select("state_id", "elem_id", "near_id", F.round("distance", 6).alias("distance"))


@query(
    "label_association",
    over(
        f", near AS (SELECT a.state_id, a.elem_id, b.elem_id AS near_id, {_DISTANCE} AS d {JOIN} AND a.elem_id <> b.elem_id WHERE a.visual_type <> 'text' AND b.visual_type = 'text' AND {_DISTANCE} < 50)"
        + Q.fold_sql("near", "state_id", "elem_id, d, near_id", "k.elem_id = n.elem_id OR k.near_id = n.near_id", "elem_id, near_id")
        + " SELECT state_id, u.elem_id AS elem_id, u.near_id AS near_id FROM (SELECT state_id, unnest(kept) AS u FROM final)",
        recursive=True,
    ),
)
def label_association(spark, sf):
    df = boxes(spark, sf)
    gap = G.label_distance(G.box("b"), G.box("a"))
    near = spatial.pairs(df.where("visual_type <> 'text'"), df.where("visual_type = 'text'"), "state_id", lambda *_: gap["distance"] < 50, F.col("a.elem_id") != F.col("b.elem_id"))
    rows = near.select(F.col("a.state_id").alias("state_id"), F.col("a.elem_id").alias("elem_id"), F.col("b.elem_id").alias("near_id"), gap["distance"].alias("distance"))
    return greedy.assign(rows, ["state_id"], "elem_id", "near_id", "distance").drop("distance")


@query(
    "best_iou_score",
    over(f"SELECT state_id, elem_id, score FROM (SELECT a.state_id, a.elem_id, b.confidence AS score, row_number() OVER (PARTITION BY a.state_id, a.elem_id ORDER BY {Q.iou('a', 'b')} DESC, b.elem_id DESC) AS n FROM gt a JOIN boxes b ON a.state_id = b.state_id WHERE {Q.iou('a', 'b')} >= 0.5) WHERE n = 1", "gt"),
)
def best_iou_score(spark, sf):
    near = spatial.pairs(truth(spark, sf), boxes(spark, sf), "state_id", lambda a, b: G.iou(a, b) >= 0.5)
    return near.groupBy(F.col("a.state_id").alias("state_id"), F.col("a.elem_id").alias("elem_id")).agg(F.max_by(F.col("b.confidence"), F.struct(G.iou(G.box("a"), G.box("b")), F.col("b.elem_id"))).alias("score"))


@query("yolo_normalise", over("SELECT state_id, elem_id, round((x1+x2)/2.0/400, 6) AS cx, round((y1+y2)/2.0/200, 6) AS cy, round((x2-x1)/400.0, 6) AS w, round((y2-y1)/200.0, 6) AS h FROM boxes"))
def yolo_normalise(spark, sf):
    df = boxes(spark, sf).select("state_id", "elem_id", *G.to_yolo(G.box(), F.lit(400.0), F.lit(200.0)))
    return df.select("state_id", "elem_id", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query("floor_centres", over("SELECT state_id, elem_id, CAST(floor((x1+x2-300)/2.0) AS INT) AS cx, CAST(floor((y1+y2-300)/2.0) AS INT) AS cy FROM boxes"))
def floor_centres(spark, sf):
    moved = G.Box(*(c - 150 for c in G.box()))
    cx, cy = G.floor_centre(moved)
    return boxes(spark, sf).select("state_id", "elem_id", cx.alias("cx"), cy.alias("cy"))

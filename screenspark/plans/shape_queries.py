"""Queries of merges, trees in reading order, roles, prompts and short notations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import specs
from ..operators import layout, merging, prompts, tree
from . import registry as Q
from .registry import over, query
from .spatial_queries import EDGES, smallest_parents
from .views import boxes, captions, table

def _dist(a: str, b: str) -> str:
    return f"(CASE WHEN {Q.inter(a, b)} > 0 THEN 0 ELSE greatest(0, {a}.x1-{b}.x2, {b}.x1-{a}.x2, {a}.y1-{b}.y2, {b}.y1-{a}.y2) END)"


@query(
    "suppress_and_join",
    over(
        Q.fold_sql("boxes", "state_id, visual_type", "confidence DESC, elem_id", f"{Q.iou('k', 'n')} >= 0.5", "elem_id, x1, y1, x2, y2, confidence")
        + f"""
    , kept1 AS (SELECT state_id, visual_type, u.elem_id AS elem_id, u.x1 AS x1, u.y1 AS y1, u.x2 AS x2, u.y2 AS y2, u.confidence AS confidence FROM (SELECT state_id, visual_type, unnest(kept) AS u FROM final)),
    ord AS (SELECT *, row_number() OVER (PARTITION BY state_id, visual_type ORDER BY confidence DESC, elem_id) AS rk FROM kept1),
    seeds AS (SELECT state_id, visual_type, rk, [{{elem_id: elem_id, x1: x1, y1: y1, x2: x2, y2: y2}}] AS s, elem_id AS own FROM ord WHERE rk = 1
      UNION ALL SELECT n.state_id, n.visual_type, n.rk,
        CASE WHEN len(list_filter(f.s, lambda k: {_dist('k', 'n')} < 5)) > 0 THEN f.s ELSE list_append(f.s, {{elem_id: n.elem_id, x1: n.x1, y1: n.y1, x2: n.x2, y2: n.y2}}) END,
        CASE WHEN len(list_filter(f.s, lambda k: {_dist('k', 'n')} < 5)) > 0 THEN list_filter(f.s, lambda k: {_dist('k', 'n')} < 5)[1].elem_id ELSE n.elem_id END
      FROM seeds f JOIN ord n ON n.state_id = f.state_id AND n.visual_type = f.visual_type AND n.rk = f.rk + 1)
    SELECT o.state_id, o.visual_type, s.own AS elem_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(avg(CAST(confidence AS DOUBLE)), 6) AS confidence, count(*) AS members
    FROM ord o JOIN seeds s ON s.state_id = o.state_id AND s.visual_type = o.visual_type AND s.rk = o.rk GROUP BY o.state_id, o.visual_type, s.own""",
        recursive=True,
    ),
)
def suppress_and_join(spark, sf):
    return merging.suppress_and_join(boxes(spark, sf), ["state_id", "visual_type"]).withColumn("confidence", F.round("confidence", 6))


@query("merge_close")
def merge_close(spark, sf):
    return merging.merge_close(boxes(spark, sf), ["state_id"])


_RANK = "CASE visual_type WHEN 'button' THEN 5 WHEN 'input_field' THEN 5 ELSE 3 END"


@query(
    "apply_group_merges",
    over(
        f""", el AS (SELECT *, visual_type = 'button' AS interactable, elem_id % 2 AS group_id FROM captions), g AS (SELECT state_id, group_id FROM el WHERE elem_id % 3 <> 0 GROUP BY state_id, group_id HAVING count(*) >= 2 AND sum(CASE WHEN interactable THEN 1 ELSE 0 END) < 2),
      m AS (SELECT el.* FROM el JOIN g ON el.state_id = g.state_id AND el.group_id = g.group_id WHERE el.elem_id % 3 <> 0)
      SELECT state_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, arg_max(text, length(text)*1000 - elem_id) AS text, arg_max(visual_type, ({_RANK})*1000 - elem_id) AS visual_type, min(elem_id) AS elem_id FROM m GROUP BY state_id, group_id
      UNION ALL SELECT state_id, x1, y1, x2, y2, text, visual_type, elem_id FROM el WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.state_id = el.state_id AND m.elem_id = el.elem_id)""",
        "captions",
    ),
)
def apply_group_merges(spark, sf):
    df = captions(spark, sf).withColumn("interactable", F.col("visual_type") == "button")
    groups = df.where("elem_id % 3 <> 0").select("state_id", "elem_id", (F.col("elem_id") % 2).alias("group_id"))
    return merging.apply_groups(df, groups).select("state_id", "x1", "y1", "x2", "y2", "text", "visual_type", "elem_id")


@query(
    "review_merges",
    over(", c AS (SELECT state_id, row_number() OVER (PARTITION BY state_id ORDER BY elem_id) AS i, elem_id, visual_type FROM boxes) SELECT DISTINCT a.state_id, a.elem_id AS elem_id, b.elem_id AS other_id FROM c a JOIN c b ON a.state_id = b.state_id AND b.elem_id = a.elem_id + 1 AND a.visual_type = b.visual_type"),
)
def review_merges(spark, sf):
    """Neighbours, named in both orders, may merge where they are of one type."""
    df = boxes(spark, sf)
    pair = F.array(F.array("elem_id", F.col("elem_id") + 1), F.array(F.col("elem_id") + 1, F.col("elem_id")))
    proposed = df.select("state_id", F.explode(pair).alias("ids"))
    candidates = df.groupBy("state_id", "visual_type").agg(F.collect_list("elem_id").alias("ids")).select("state_id", "ids")
    return merging.review_merges(proposed, candidates).select("state_id", F.col("ids")[0].alias("elem_id"), F.col("ids")[1].alias("other_id"))


# --- trees ------------------------------------------------------------------------------

_ORDER = """, kid AS (SELECT b.*, e.parent_id, row_number() OVER (PARTITION BY b.state_id, e.parent_id ORDER BY b.y1, b.x1, b.elem_id) AS r FROM boxes b LEFT JOIN edges e ON e.state_id = b.state_id AND e.elem_id = b.elem_id),
  walk AS (SELECT state_id, elem_id, [r] AS key FROM kid WHERE parent_id IS NULL UNION ALL SELECT k.state_id, k.elem_id, list_append(w.key, k.r) FROM walk w JOIN kid k ON k.state_id = w.state_id AND k.parent_id = w.elem_id)"""


@query("pre_order", over(f"{EDGES}{_ORDER} SELECT state_id, elem_id, len(key) - 1 AS depth, row_number() OVER (PARTITION BY state_id ORDER BY key, elem_id) - 1 AS pre_order FROM walk", recursive=True))
def pre_order(spark, sf):
    return tree.child_order(boxes(spark, sf), smallest_parents(spark, sf))


def _by_siblings(sql: str) -> str:
    return sql.replace("state_id", "state_id, pid").replace("b.state_id, pid = t.state_id, pid", "b.state_id = t.state_id AND b.pid = t.pid").replace("n.state_id, pid = b.state_id, pid", "n.state_id = b.state_id AND n.pid = b.pid").replace("b.state_id, pid,", "b.state_id, b.pid,").replace("n.state_id, pid,", "n.state_id, n.pid,").replace("BY b.state_id, pid ", "BY b.state_id, b.pid ")


def _sibling_sql() -> str:
    from .layout_queries import _READ

    placed = _by_siblings(_READ).replace("FROM boxes", "FROM sib")
    return f"""{EDGES}, sib AS (SELECT b.*, coalesce(e.parent_id, 0) AS pid FROM boxes b LEFT JOIN edges e ON e.state_id = b.state_id AND e.elem_id = b.elem_id){placed},
      walk AS (SELECT state_id, elem_id, [reading_pos] AS key FROM placed WHERE pid = 0 UNION ALL SELECT k.state_id, k.elem_id, list_append(w.key, k.reading_pos) FROM walk w JOIN placed k ON k.state_id = w.state_id AND k.pid = w.elem_id)
      SELECT state_id, elem_id, row_number() OVER (PARTITION BY state_id ORDER BY key, elem_id) - 1 AS reading_pos FROM walk"""


@query("tree_reading_order", over(_sibling_sql(), recursive=True))
def tree_reading_order(spark, sf):
    return layout.tree_order(boxes(spark, sf), smallest_parents(spark, sf)).select("state_id", "elem_id", "reading_pos")


@query(
    "sibling_rows",
    over(f"""{EDGES}, leaf AS (SELECT b.*, coalesce(e.parent_id, 0) AS pid, floor((y1+y2)/2.0) AS c FROM boxes b LEFT JOIN edges e ON e.state_id = b.state_id AND e.elem_id = b.elem_id WHERE NOT EXISTS (SELECT 1 FROM edges p WHERE p.state_id = b.state_id AND p.parent_id = b.elem_id)),
      g AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY state_id, pid ORDER BY c, elem_id) <= 10 THEN 0 ELSE 1 END AS start FROM leaf),
      r AS (SELECT state_id, pid, elem_id, sum(start) OVER (PARTITION BY state_id, pid ORDER BY c, elem_id ROWS UNBOUNDED PRECEDING) AS row_id FROM g)
      SELECT state_id, pid AS parent_id, row_id, count(*) AS n FROM r GROUP BY state_id, pid, row_id HAVING count(*) >= 2"""),
)
def sibling_rows(spark, sf):
    """Rows of two or more leaves with one parent; 0 stands for the root."""
    df, edges = boxes(spark, sf), smallest_parents(spark, sf)
    placed = tree.leaves(df, edges).join(edges, ["state_id", "elem_id"], "left").withColumn("parent_id", F.coalesce("parent_id", F.lit(0)))
    return layout.rows(placed, ["state_id", "parent_id"]).groupBy("state_id", "parent_id", "row_id").agg(F.count("*").alias("n")).where("n >= 2")


@query("corners", over("SELECT state_id, arg_min(elem_id, x1 + y1 + elem_id/1000.0) AS top_left, arg_min(elem_id, y1 - x1 + elem_id/1000.0) AS top_right, arg_max(elem_id, x1 + y1 - elem_id/1000.0) AS bottom_right, arg_max(elem_id, y1 - x1 - elem_id/1000.0) AS bottom_left FROM boxes GROUP BY state_id"))
def corners(spark, sf):
    return boxes(spark, sf).groupBy("state_id").agg(*layout.corners(F.col("x1"), F.col("y1"), F.col("elem_id")))


# --- roles, names and prompts -------------------------------------------------------------


@query("assigned_roles", over("SELECT state_id, elem_id, CASE visual_type WHEN 'button' THEN 'Button' WHEN 'input_field' THEN 'EditText' ELSE CASE WHEN regexp_matches(lower(coalesce(text, '')), 'login|sign|submit|cancel|ok|next|back') THEN 'Button' ELSE 'TextView' END END AS role FROM captions", "captions"))
def assigned_roles(spark, sf):
    return captions(spark, sf).select("state_id", "elem_id", prompts.role(F.col("visual_type"), F.col("text")).alias("role"))


@query(
    "label_hints",
    over("SELECT a.state_id, a.elem_id, coalesce(a.label, trim(a.text)) AS label, CASE WHEN a.visual_type = 'input_field' AND b.text IS NOT NULL THEN b.text ELSE a.hint END AS hint FROM captions a LEFT JOIN captions b ON b.state_id = a.state_id AND b.elem_id = a.elem_id - 1", "captions"),
)
def label_hints(spark, sf):
    df = captions(spark, sf)
    labels = df.select("state_id", "elem_id", (F.col("elem_id") - 1).alias("label_id"))
    return prompts.with_labels(df, labels).select("state_id", "elem_id", "label", "hint")


@query(
    "child_captions",
    over(f"{EDGES}, kids AS (SELECT e.state_id, e.parent_id, arg_min(trim(c.text), c.elem_id) AS child FROM captions c JOIN edges e ON e.state_id = c.state_id AND e.elem_id = c.elem_id WHERE c.visual_type = 'text' AND trim(c.text) <> '' GROUP BY e.state_id, e.parent_id) SELECT c.state_id, c.elem_id, coalesce(trim(c.text), k.child, '') AS caption FROM captions c LEFT JOIN kids k ON k.state_id = c.state_id AND k.parent_id = c.elem_id", "captions"),
)
def child_captions(spark, sf):
    return prompts.captions(captions(spark, sf), smallest_parents(spark, sf))


@query(
    "element_properties",
    over("SELECT state_id, elem_id, CASE WHEN text IS NULL THEN 9 ELSE 10 END AS n, x1 || ',' || y1 || ',' || x2 || ',' || y2 AS bbox, coalesce(text, hint) AS found, 'none' AS missing FROM captions", "captions"),
)
def element_properties(spark, sf):
    df = captions(spark, sf)
    fields, other = prompts.properties(df), F.create_map(F.lit("Text"), F.col("hint"))
    read = lambda name: prompts.read_property(fields, other, name, F.lit("none"))
    return df.select("state_id", "elem_id", F.size(fields).alias("n"), read("BBOX").alias("bbox"), read("text").alias("found"), read("locators.xpath").alias("missing"))


_LINE = """elem_id || ': ' || visual_type || coalesce(' "' || text || '"', '') || ' [' || CASE WHEN (x1+x2)/2.0/400 < 0.33 THEN 'left' WHEN (x1+x2)/2.0/400 > 0.66 THEN 'right' ELSE 'center' END || '-' || CASE WHEN (y1+y2)/2.0/200 < 0.33 THEN 'top' WHEN (y1+y2)/2.0/200 > 0.66 THEN 'bottom' ELSE 'middle' END || ', ' || CASE WHEN (x2-x1)*(y2-y1)/80000.0 < 0.01 THEN 'small' WHEN (x2-x1)*(y2-y1)/80000.0 > 0.1 THEN 'large' ELSE 'medium' END || ']'"""


@query("element_lines", over(f"SELECT state_id, string_agg({_LINE}, chr(10) ORDER BY elem_id) AS lines FROM captions GROUP BY state_id", "captions"))
def element_lines(spark, sf):
    line = F.struct("elem_id", prompts.element_line(400.0, 200.0).alias("line"))
    rows = captions(spark, sf).groupBy("state_id").agg(F.sort_array(F.collect_list(line)).alias("r"))
    return rows.select("state_id", F.array_join(F.transform("r", lambda r: r["line"]), "\n").alias("lines"))


@query("made_labels", over("SELECT state_id, count(*) AS n_elements, count(text) AS n_with_text, sum(CASE WHEN visual_type <> 'text' THEN 1 ELSE 0 END) AS n_interactive, count(DISTINCT visual_type) AS types FROM captions GROUP BY state_id", "captions"))
def made_labels(spark, sf):
    return prompts.training_labels(captions(spark, sf))


@query("prompt_sizes", over("SELECT state_id, count(*) AS lines FROM captions GROUP BY state_id", "captions"))
def prompt_sizes(spark, sf):
    return prompts.prompt_lines(captions(spark, sf)).select("state_id", F.size(F.split("prompt", "\n")).alias("lines"))


@query("device_pixels", over("SELECT state_id, elem_id, CAST(round_even(least(1.0, greatest(0.0, x2/300.0)) * 1920, 0) AS INT) AS px, CAST(round_even(least(1.0, greatest(0.0, y2/150.0)) * 1080, 0) AS INT) AS py FROM boxes"))
def device_pixels(spark, sf):
    return boxes(spark, sf).select("state_id", "elem_id", *prompts.to_device(F.col("x2") / 300.0, F.col("y2") / 150.0, F.lit(1920), F.lit(1080)))


# --- short notations, written from columns and read back ------------------------------------


@query("region_strings", over("SELECT state_id, elem_id, CASE WHEN elem_id % 4 > 0 THEN x1 END AS x1, CASE WHEN elem_id % 4 > 0 THEN y1 END AS y1, CASE WHEN elem_id % 4 > 0 THEN x2 END AS x2, CASE WHEN elem_id % 4 > 0 THEN y2 END AS y2 FROM boxes"))
def region_strings(spark, sf):
    """Regions written in three ways; every fourth is empty and no region."""
    df = boxes(spark, sf)
    text = F.when(F.col("elem_id") % 4 == 0, F.format_string("%d,%d,%d,%d", "x2", "y1", "x1", "y2")).when(F.col("elem_id") % 2 == 0, F.format_string("bounds(%d.2, %d, %d, %d.0)", "x1", "y1", "x2", "y2")).otherwise(F.format_string("%d,%d,%d,%d", "x1", "y1", "x2", "y2"))
    return df.select("state_id", "elem_id", specs.region(text).alias("r")).select("state_id", "elem_id", "r.*")


@query("time_strings", "SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity * 60 + 1.5 WHEN 2 THEN l_quantity / 1000.0 ELSE 3600 + l_quantity END), 6) AS secs FROM lineitem GROUP BY l_orderkey, l_linenumber")
def time_strings(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    k = F.col("l_linenumber") % 4
    text = F.when(k == 0, F.concat(q, F.lit("s"))).when(k == 1, F.concat(q, F.lit(" min 1.5 secs"))).when(k == 2, F.concat(q, F.lit("ms"))).otherwise(F.concat(F.lit("1:00:"), F.lpad(q, 2, "0")))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", specs.seconds(text).alias("secs"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("secs"), 6).alias("secs"))


@query(
    "column_specs",
    "SELECT c_custkey, 2 AS n, c_mktsegment AS name, c_custkey % 2 = 0 AS flag, c_custkey AS whole, CAST(NULL AS VARCHAR) AS problem FROM customer",
)
def column_specs(spark, sf):
    c = table(spark, sf, "customer")
    text = F.concat("c_mktsegment", F.lit("[roles="), F.when(F.col("c_custkey") % 2 == 0, "on").otherwise("No"), F.lit(", n.k="), F.col("c_custkey").cast("string"), F.lit("] , plain"))
    items = c.select("c_custkey", specs.split_specs(text).alias("items")).select("c_custkey", F.size("items").alias("n"), specs.spec(F.col("items")[0]).alias("s"))
    value = lambda i: specs.scalar(F.col("s.switches")[i]["value"])
    return items.select("c_custkey", "n", "s.name", value(0)["flag"].alias("flag"), value(1)["whole"].alias("whole"), "s.problem")


@query(
    "edit_answers",
    over("SELECT state_id, elem_id, CASE elem_id % 4 WHEN 0 THEN 'retype' WHEN 1 THEN 'delete' WHEN 2 THEN 'merge' ELSE 'role' END AS op, CAST(elem_id AS VARCHAR) AS target, CASE elem_id % 4 WHEN 2 THEN 1 ELSE 0 END AS others, CASE elem_id % 4 WHEN 0 THEN visual_type WHEN 3 THEN 'Button' END AS value FROM boxes"),
)
def edit_answers(spark, sf):
    """A model's lists of edits, some fenced, some cut off in their second item."""
    df, k, e = boxes(spark, sf), F.col("elem_id") % 4, F.col("elem_id").cast("string")
    one = (
        F.when(k == 0, F.format_string('{"op": "retype", "id": "%s", "type": "%s"}', e, "visual_type")).when(k == 1, F.format_string('{"op": "Delete", "id": "%s"}', e))
        .when(k == 2, F.format_string('{"op": "merge", "ids": ["%s", "x"]}', e)).otherwise(F.format_string('{"op": "role", "id": "%s", "role": "Button"}', e))
    )
    bad = F.lit('{"op": "merge", "ids": ["only"]}')
    answer = F.when(F.col("state_id") % 2 == 0, F.concat(F.lit("```json\n["), one, F.lit(", "), bad, F.lit("]\n```"))).otherwise(F.concat(F.lit("["), one, F.lit(', {"op": "sp')))
    return df.select("state_id", "elem_id", F.explode(specs.tree_edits(answer)).alias("t")).select("state_id", "elem_id", "t.op", "t.target", F.coalesce(F.size("t.ids"), F.lit(0)).alias("others"), "t.value")


@query("layout_answers", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS title FROM customer")
def layout_answers(spark, sf):
    body = F.concat(F.lit('{"title": "'), "c_mktsegment", F.lit('", "rows": [1]}'))
    k = F.col("c_custkey") % 3
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise(F.substring(body, 1, 12))
    return table(spark, sf, "customer").select("c_custkey", F.get_json_object(specs.layout_object(answer), "$.title").alias("title"))


# --- expressions over boxes and names ---------------------------------------------------------


@query("icon_like", over("SELECT state_id, elem_id FROM captions WHERE length(hint) > 2 AND y2 - y1 <= 48 AND x2 - x1 < 1.6 * (y2 - y1)", "captions"))
def icon_like(spark, sf):
    return captions(spark, sf).where(G.looks_like_icon(F.col("hint"), G.box())).select("state_id", "elem_id")


@query("percent_boxes", over("SELECT state_id, elem_id, least(greatest(CAST(round(x1/4.0/100*400) AS INT), 0), 400) AS x1, least(greatest(CAST(round(y1/2.0/100*200) AS INT), 0), 200) AS y1, least(greatest(CAST(round(x2/4.0/100*400) AS INT), 0), 400) AS x2, least(greatest(CAST(round(y2/2.0/100*200) AS INT), 0), 200) AS y2 FROM boxes"))
def percent_boxes(spark, sf):
    """Boxes as percent of a screen of 400 by 200, and back."""
    b, w, h = G.box(), F.lit(400), F.lit(200)
    back = G.percent_to_pixel(b.x1 / 4.0, b.y1 / 2.0, (b.x2 - b.x1) / 4.0, (b.y2 - b.y1) / 2.0, w, h)
    return boxes(spark, sf).select("state_id", "elem_id", *[c.alias(n) for c, n in zip(back, ("x1", "y1", "x2", "y2"), strict=True)])


@query("content_places", over("SELECT state_id, elem_id, round((x1 - 10) / 1.25, 6) AS cx, round((y1 - 20) / 1.25, 6) AS cy FROM boxes"))
def content_places(spark, sf):
    return boxes(spark, sf).select("state_id", "elem_id", F.round(G.to_content(F.col("x1"), F.lit(10), F.lit(1.25)), 6).alias("cx"), F.round(G.to_content(F.col("y1"), F.lit(20), F.lit(1.25)), 6).alias("cy"))


@query("covering_pairs", over(f"SELECT a.state_id, a.elem_id AS outer_id, b.elem_id AS inner_id FROM boxes a JOIN boxes b ON a.state_id = b.state_id AND a.elem_id <> b.elem_id WHERE a.x1 <= b.x1 AND a.y1 <= b.y1 AND a.x2 >= b.x2 AND a.y2 >= b.y2"))
def covering_pairs(spark, sf):
    from ..operators import spatial

    df = boxes(spark, sf)
    held = spatial.pairs(df, df, "state_id", G.covers, F.col("a.elem_id") != F.col("b.elem_id"))
    return held.select(F.col("a.state_id").alias("state_id"), F.col("a.elem_id").alias("outer_id"), F.col("b.elem_id").alias("inner_id"))


@query("image_states", "SELECT c_custkey, lower(replace(c_mktsegment, ' ', '_')) || '__main_' || CAST(c_custkey AS VARCHAR) AS state_id, lower(replace(c_mktsegment, ' ', '_')) AS app, 'step' AS step_group, regexp_replace(lower(c_mktsegment), '[^a-z]', '', 'g') AS class_key FROM customer")
def image_states(spark, sf):
    from ..functions import text as X

    c = table(spark, sf, "customer")
    image = F.concat("c_mktsegment", F.lit("-Main "), F.col("c_custkey").cast("string"), F.lit(".PNG"))
    state = X.state_id_of(image)
    return c.select("c_custkey", state.alias("state_id"), X.app_of(state).alias("app"), X.group_of(F.concat(F.lit("step_"), F.col("c_custkey").cast("string"))).alias("step_group"), X.class_key(F.col("c_mktsegment")).alias("class_key"))


@query("class_types", over("SELECT state_id, elem_id, CASE elem_id % 3 WHEN 0 THEN 'checkbox' WHEN 1 THEN 'container' ELSE 'unknown' END AS from_class, CASE visual_type WHEN 'input_field' THEN 'input_field' ELSE visual_type END AS from_shape FROM boxes"))
def class_types(spark, sf):
    name = F.when(F.col("elem_id") % 3 == 0, "Toggle").when(F.col("elem_id") % 3 == 1, "list_item").otherwise("gauge")
    return boxes(spark, sf).select("state_id", "elem_id", prompts.class_type(name).alias("from_class"), prompts.shape_type(F.col("visual_type")).alias("from_shape"))

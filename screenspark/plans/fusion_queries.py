"""Queries of fusion, shortlists, answers, edits, datasets and twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers
from ..functions import text as X
from ..operators import elements, fusion, tree
from . import registry as Q
from .language_queries import _SAID, ranked
from .registry import over, query
from .spatial_queries import EDGES, JOIN, LARGEST_TEST, _PARENT, largest_parents, smallest_parents
from .views import boxes, captions, table, truth

_IN = Q.contained


@query(
    "region_text_fusion",
    over(
        f"""SELECT a.state_id, a.elem_id, string_agg(b.text, ' ' ORDER BY b.elem_id) AS text FROM captions a LEFT JOIN captions b ON a.state_id = b.state_id AND b.visual_type = 'text' AND b.text IS NOT NULL AND {_IN("b", "a")} > 0.8
      WHERE a.visual_type <> 'text' AND NOT EXISTS (SELECT 1 FROM captions t WHERE t.state_id = a.state_id AND t.visual_type = 'text' AND t.text IS NOT NULL AND {_IN("a", "t")} > 0.8 AND {_IN("t", "a")} <= 0.8) GROUP BY a.state_id, a.elem_id""",
        "captions",
    ),
)
def region_text_fusion(spark, sf):
    df = captions(spark, sf)
    return fusion.absorb_texts(df.where("visual_type <> 'text'"), df.where("visual_type = 'text' and text is not null"), "state_id")


@query("free_texts", over(f"SELECT a.state_id, a.elem_id FROM boxes a WHERE a.visual_type = 'text' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.visual_type <> 'text' AND a.state_id = b.state_id AND {_IN('a', 'b')} > 0.8)"))
def free_texts(spark, sf):
    df = boxes(spark, sf)
    return fusion.free_texts(df.where("visual_type <> 'text'"), df.where("visual_type = 'text'"), "state_id").select("state_id", "elem_id")


_SMALL = f"CAST({Q.inter('a', 'b')} AS DOUBLE)/least({Q.area('a')},{Q.area('b')})"


@query(
    "prefer_external",
    over(f"SELECT state_id, elem_id, 'own' AS origin FROM boxes a WHERE visual_type = 'text' AND NOT EXISTS (SELECT 1 FROM gt b WHERE b.elem_id % 2 = 0 AND a.state_id = b.state_id AND {_SMALL} > 0.5) UNION ALL SELECT state_id, elem_id, 'external' FROM gt WHERE elem_id % 2 = 0", "gt"),
)
def prefer_external(spark, sf):
    return fusion.prefer(boxes(spark, sf).where("visual_type = 'text'"), truth(spark, sf).where("elem_id % 2 = 0"), "state_id").select("state_id", "elem_id", "origin")


@query("crowded_boxes", over(f"SELECT a.state_id, a.elem_id, count(*) AS n {JOIN} WHERE a.visual_type <> 'text' AND b.visual_type = 'text' AND {_IN('b', 'a')} >= 0.7 GROUP BY a.state_id, a.elem_id HAVING count(*) >= 2"))
def crowded_boxes(spark, sf):
    df = boxes(spark, sf)
    return fusion.crowded(df.where("visual_type <> 'text'"), df.where("visual_type = 'text'"), "state_id")


@query(
    "caption_fragments",
    over("SELECT a.state_id, a.elem_id AS anchor_id, b.elem_id AS elem_id FROM captions a JOIN captions b ON a.state_id = b.state_id AND a.elem_id <> b.elem_id WHERE length(lower(a.text)) >= 8 AND a.text LIKE '% %' AND length(b.text) >= 3 AND contains(lower(a.text), lower(b.text)) AND least(a.y2,b.y2) > greatest(a.y1,b.y1) AND (least(a.y2,b.y2)-greatest(a.y1,b.y1))/CAST(least(a.y2-a.y1,b.y2-b.y1) AS DOUBLE) >= 0.3", "captions"),
)
def caption_fragments(spark, sf):
    return fusion.fragments(captions(spark, sf), "state_id")


_FX, _FY = "(({0}.x1+{0}.x2)//2)", "(({0}.y1+{0}.y2)//2)"
_ABOVE = f"abs({_FX.format('a')}-{_FX.format('b')}) < 50 AND b.y2 < a.y1 AND a.y1-b.y2 < 100"
_LEFT = f"abs({_FY.format('a')}-{_FY.format('b')}) < 30 AND b.x2 < a.x1 AND a.x1-b.x2 < 100"


@query(
    "neighbour_hints",
    over(f"SELECT a.state_id, a.elem_id, arg_min(CASE WHEN {_ABOVE} THEN 'below ' ELSE 'right of ' END || coalesce('''' || b.text || '''', CAST(b.elem_id AS VARCHAR)), b.elem_id) AS hint FROM captions a JOIN captions b ON a.state_id = b.state_id AND a.elem_id <> b.elem_id WHERE ({_ABOVE}) OR ({_LEFT}) GROUP BY a.state_id, a.elem_id", "captions"),
)
def neighbour_hints(spark, sf):
    return fusion.neighbour_hint(captions(spark, sf), "state_id")


@query(
    "shortlist",
    over(
        f"""{_SAID}, s AS (SELECT state_id, elem_id, 0 AS tier, place FROM ranked WHERE desc_id = 2 AND place <= 8),
      u AS (SELECT * FROM s UNION ALL SELECT c.state_id, c.elem_id, 1, c.elem_id FROM captions c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.state_id = c.state_id AND s.elem_id = c.elem_id)),
      k AS (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY tier, place) AS pick, sum(1 - tier) OVER (PARTITION BY state_id) AS n FROM u)
      SELECT state_id, elem_id, pick FROM k WHERE tier = 0 OR n = 0 OR pick <= 3""",
        "captions",
    ),
)
def shortlist(spark, sf):
    """The limits are the operator: a few candidates for each screen."""
    return fusion.shortlist(ranked(spark, sf).where("desc_id = 2"), captions(spark, sf), "state_id")


@query("categories", over("SELECT state_id, elem_id, CASE visual_type WHEN 'input_field' THEN 'input' WHEN 'button' THEN 'button' ELSE 'text' END AS category FROM boxes"))
def categories(spark, sf):
    df = elements.flags(boxes(spark, sf))
    return df.select("state_id", "elem_id", fusion.category(F.concat_ws(" ", "visual_type", F.lit("")), F.col("editable"), F.col("clickable")).alias("category"))


@query(
    "model_answers",
    over(
        """SELECT state_id, elem_id, CASE elem_id % 4 WHEN 0 THEN CAST(elem_id AS VARCHAR) END AS elem_key, CASE WHEN elem_id % 4 <= 1 THEN CASE elem_id % 4 WHEN 0 THEN round(CAST(confidence AS DOUBLE), 2) ELSE 0.0 END END AS confidence,
      CASE elem_id % 4 WHEN 2 THEN 'FAILED' WHEN 3 THEN 'PASSED' END AS verdict, CASE elem_id % 4 WHEN 3 THEN 'PASSED' END AS yes_no, CASE elem_id % 4 WHEN 2 THEN CASE WHEN state_id % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS n_suggestions FROM boxes"""
    ),
)
def model_answers(spark, sf):
    """Answers written from boxes: an id, no id, a list (whole or cut off) with a verdict, a yes."""
    df, k, e = boxes(spark, sf), F.col("elem_id") % 4, F.col("elem_id").cast("string")
    one = F.format_string('{"op": "merge", "id": "%s"}', e)
    listed = F.when(F.col("state_id") % 2 == 0, F.concat(F.lit("PASSED but then FAILED ```json\n["), one, F.lit(", "), one, F.lit("]```"))).otherwise(F.concat(F.lit("FAILED ["), one, F.lit(', {"op": "sp')))
    a = (
        F.when(k == 0, F.format_string('Sure: {"id": "id=%s", "confidence": %s, "reason": "label"} done', e, F.round(F.col("confidence").cast("double"), 2).cast("string")))
        .when(k == 1, F.lit('{"id": "None", "confidence": "high"}')).when(k == 2, listed).otherwise(F.lit("The answer is Yes. PASSED"))
    )
    said = df.select("state_id", "elem_id", k.alias("k"), a.alias("a")).withColumn("e", answers.element_answer(F.col("a")))
    n = F.when(F.col("k") == 2, F.size(answers.suggestions(F.col("a"), "op: string, id: string"))).otherwise(0)
    own = F.col("k") <= 1
    return said.select("state_id", "elem_id", F.when(own, F.col("e.id")).alias("elem_key"), F.when(own, F.col("e.confidence")).alias("confidence"), answers.failed_first(F.col("a")).alias("verdict"), answers.yes_or_no(F.col("a")).alias("yes_no"), n.alias("n_suggestions"))


@query(
    "edit_scores",
    over(f"""{EDGES}, big AS ({_PARENT.format(order="-" + Q.area("b"), join=JOIN, test=LARGEST_TEST)}), p AS (SELECT state_id % 10 AS app, * FROM edges), g AS (SELECT state_id % 10 AS app, * FROM big)
      SELECT app, tp, n_pred, n_true, round(tp/CAST(n_pred AS DOUBLE), 6) AS precision, round(tp/CAST(n_true AS DOUBLE), 6) AS recall FROM (SELECT app, (SELECT count(*) FROM p JOIN g ON p.state_id = g.state_id AND p.elem_id = g.elem_id AND p.parent_id = g.parent_id WHERE p.app = a.app) AS tp,
      (SELECT count(*) FROM p WHERE p.app = a.app) AS n_pred, (SELECT count(*) FROM g WHERE g.app = a.app) AS n_true FROM (SELECT unnest(range(10)) AS app) a) WHERE n_pred > 0"""),
)
def edit_scores(spark, sf):
    app = lambda df: df.withColumn("app", F.col("state_id") % 10)
    out = tree.edit_scores(app(smallest_parents(spark, sf)), app(largest_parents(spark, sf)), ["state_id", "elem_id", "parent_id"], ["app"]).where("n_pred > 0")
    return out.select("app", "tp", "n_pred", "n_true", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "apply_tree_edits",
    over(
        f"""{EDGES}, live AS (SELECT b.state_id, b.elem_id, e.parent_id, CASE WHEN b.elem_id % 3 = 0 THEN 'edited' ELSE b.visual_type END AS role, b.elem_id % 5 = 0 AS gone FROM boxes b LEFT JOIN edges e ON b.state_id = e.state_id AND b.elem_id = e.elem_id),
      up AS (SELECT state_id, elem_id, parent_id AS at, 1 AS d FROM live WHERE parent_id IS NOT NULL UNION ALL SELECT u.state_id, u.elem_id, e.parent_id, u.d + 1 FROM up u JOIN live e ON e.state_id = u.state_id AND e.elem_id = u.at WHERE e.parent_id IS NOT NULL),
      near AS (SELECT u.state_id, u.elem_id, arg_min(u.at, u.d) AS parent_id FROM up u JOIN live a ON a.state_id = u.state_id AND a.elem_id = u.at AND NOT a.gone GROUP BY u.state_id, u.elem_id)
      SELECT l.state_id, l.elem_id, l.role, n.parent_id FROM live l LEFT JOIN near n ON n.state_id = l.state_id AND n.elem_id = l.elem_id WHERE NOT l.gone""",
        recursive=True,
    ),
)
def apply_tree_edits(spark, sf):
    df = boxes(spark, sf)
    nodes = df.select("state_id", "elem_id", F.col("visual_type").alias("role")).join(smallest_parents(spark, sf), ["state_id", "elem_id"], "left")
    ops = F.array(F.when(F.col("elem_id") % 3 == 0, F.struct(F.lit("set_role").alias("op"), F.lit("edited").alias("value"))), F.when(F.col("elem_id") % 5 == 0, F.struct(F.lit("delete").alias("op"), F.lit("").alias("value"))))
    changes = df.select("state_id", "elem_id", F.posexplode(F.array_compact(ops)).alias("ord", "o")).select("state_id", "elem_id", "ord", "o.*")
    return tree.apply_edits(nodes, changes)


@query("relation_tree", over(f"SELECT a.state_id, b.elem_id, min(a.elem_id) AS parent_id {JOIN} WHERE {Q.strictly('b', 'a')} GROUP BY a.state_id, b.elem_id"))
def relation_tree(spark, sf):
    from ..functions import geometry as G
    from ..operators import spatial

    df = boxes(spark, sf)
    held = spatial.pairs(df, df, "state_id", lambda a, b: G.is_strictly_contained(b, a))
    relations = held.select(F.col("a.state_id").alias("state_id"), F.lit("contains").alias("kind"), F.col("a.elem_id").alias("from_id"), F.col("b.elem_id").alias("to_id"))
    return tree.from_relations(relations)


@query("dataset_report", over("SELECT count(*) AS boxes, count(DISTINCT state_id) AS screens, (SELECT max(n) > 10*min(n) FROM (SELECT count(*) AS n FROM boxes GROUP BY visual_type)) AS imbalanced, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT unnest(['button','checkbox','icon','input_field','text']) AS c) WHERE c NOT IN (SELECT visual_type FROM boxes)) AS missing FROM boxes"))
def dataset_report(spark, sf):
    df = boxes(spark, sf)
    sizes = df.groupBy("visual_type").agg(F.count("*").alias("n")).agg((F.max("n") > 10 * F.min("n")).alias("imbalanced"), F.collect_set("visual_type").alias("have"))
    every = F.array(*map(F.lit, ("button", "checkbox", "icon", "input_field", "text")))
    total = df.agg(F.count("*").alias("boxes"), F.count_distinct("state_id").alias("screens"))
    return total.crossJoin(F.broadcast(sizes)).select("boxes", "screens", "imbalanced", F.array_join(F.array_except(every, "have"), ",").alias("missing"))


@query("image_label_pairs", over("SELECT coalesce(a.state_id, b.state_id) AS state_id, CASE WHEN a.state_id IS NULL THEN 'orphan' ELSE 'missing' END AS problem FROM (SELECT DISTINCT state_id FROM boxes WHERE state_id % 7 <> 0) a FULL JOIN (SELECT DISTINCT state_id FROM gt WHERE state_id % 5 <> 0) b ON a.state_id = b.state_id WHERE a.state_id IS NULL OR b.state_id IS NULL", "gt"))
def image_label_pairs(spark, sf):
    a = boxes(spark, sf).where("state_id % 7 <> 0").select("state_id", F.lit(True).alias("image")).distinct()
    b = truth(spark, sf).where("state_id % 5 <> 0").select("state_id", F.lit(True).alias("label")).distinct()
    both = a.join(b, "state_id", "full_outer").where("image is null or label is null")
    return both.select("state_id", F.when(F.col("image").isNull(), "orphan").otherwise("missing").alias("problem"))


@query("caption_votes", "SELECT app, reading, n FROM (SELECT source AS app, lower(lang) AS reading, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lower(lang)) AS k FROM documents GROUP BY source, lower(lang)) WHERE k = 1")
def caption_votes(spark, sf):
    counted = table(spark, sf, "documents").groupBy(F.col("source").alias("app"), X.normal(F.col("lang")).alias("reading")).agg(F.count("*").alias("n"))
    best = counted.groupBy("app").agg(F.min(F.struct((-F.col("n")).alias("m"), "reading", "n")).alias("b"))
    return best.select("app", "b.reading", "b.n")


@query("executor_twins", "WITH n AS (SELECT DISTINCT user_id, CASE WHEN event_id % 3 = 0 THEN 'u' || user_id ELSE 'u' || user_id || '[' || event_type || ']' END AS name FROM events) SELECT DISTINCT b.name AS base, v.name AS variant FROM n v JOIN n b ON b.user_id = v.user_id AND v.name LIKE b.name || '[%' AND b.name NOT LIKE '%]'")
def executor_twins(spark, sf):
    """Executors named by user and, for two of three events, by what they did."""
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    names = table(spark, sf, "events").select(F.when(F.col("event_id") % 3 == 0, user).otherwise(F.concat(user, F.lit("["), "event_type", F.lit("]"))).alias("name")).distinct()
    return elements.twins(names, "name")


@query("session_ages", "SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(CAST(round(s/60.0) AS INT) AS VARCHAR) || ' min ago' WHEN s < 86400 THEN CAST(CAST(round(s/3600.0) AS INT) AS VARCHAR) || ' h ago' ELSE CAST(CAST(round(s/86400.0) AS INT) AS VARCHAR) || ' d ago' END AS age FROM (SELECT event_id, epoch_us((SELECT max(ts) FROM events))//1000000 - epoch_us(ts)//1000000 AS s FROM events)")
def session_ages(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"))
    last = e.agg(F.max("s").alias("last"))
    return e.crossJoin(F.broadcast(last)).select("event_id", answers.relative_time(F.col("last") - F.col("s")).alias("age"))


#: Of each screen an answer with its captions, in which brackets and quotes stand in texts; cut
#: at another place for each caption.  The check knows where each item ends.
_CUT = """, item AS (SELECT state_id, elem_id, '{"id": ' || CAST(elem_id AS VARCHAR) || ', "text": "[' || coalesce(text, '') || '\\\\\\"}, {", "at": [' || CAST(x1 AS VARCHAR) || ', ' || CAST(y1 AS VARCHAR) || ']}' AS j FROM captions),
  placed AS (SELECT *, 11 + sum(length(j)) OVER w + 2 * (row_number() OVER w - 1) AS ends FROM item WINDOW w AS (PARTITION BY state_id ORDER BY elem_id)),
  whole AS (SELECT state_id, '{"edits": [' || string_agg(j, ', ' ORDER BY elem_id) || '], "n": "]"}' AS a FROM item GROUP BY state_id),
  cut AS (SELECT c.state_id, c.elem_id, w.a, 1 + (c.elem_id * 37 + c.state_id * 11) % length(w.a) AS n FROM captions c JOIN whole w ON w.state_id = c.state_id)"""


@query(
    "repaired_answers",
    over(
        f"""{_CUT} SELECT c.state_id, c.elem_id, CASE WHEN n = length(a) OR n < 11 THEN substring(a, 1, n) WHEN n >= max(p.ends) + 1 THEN substring(a, 1, CAST(max(p.ends) AS BIGINT) + 1) || '}}'
        ELSE substring(a, 1, CAST(coalesce(max(CASE WHEN p.ends <= n THEN p.ends END), 11) AS BIGINT)) || ']}}' END AS repaired FROM cut c JOIN placed p ON p.state_id = c.state_id GROUP BY c.state_id, c.elem_id, a, n""",
        "captions",
    ),
)
def repaired_answers(spark, sf):
    df = captions(spark, sf)
    item = F.concat(F.lit('{"id": '), F.col("elem_id").cast("string"), F.lit(', "text": "['), F.coalesce("text", F.lit("")), F.lit('\\\\\\"}, {", "at": ['), F.col("x1").cast("string"), F.lit(", "), F.col("y1").cast("string"), F.lit("]}"))
    listed = df.groupBy("state_id").agg(F.sort_array(F.collect_list(F.struct("elem_id", item.alias("j")))).alias("items"))
    whole = listed.select("state_id", F.concat(F.lit('{"edits": ['), F.array_join(F.transform("items", lambda i: i["j"]), ", "), F.lit('], "n": "]"}')).alias("a"))
    cut = df.select("state_id", "elem_id").join(whole, "state_id").withColumn("n", 1 + (F.col("elem_id") * 37 + F.col("state_id") * 11) % F.length("a"))
    return cut.select("state_id", "elem_id", answers.repaired(F.substring("a", F.lit(1), F.col("n").cast("int"))).alias("repaired"))

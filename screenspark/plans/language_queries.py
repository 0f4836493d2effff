"""Queries of captions, locators, descriptions and names."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import elements, locator
from .registry import over, query
from .views import captions, table

#: Locators that the queries resolve on every screen.
LOCATORS = [
    (1, "text=ring"), (2, 'text="small ring" || role=button'), (3, "role=button text=bolt"), (4, "id=2"), (5, "hint=brand#1 || id=1"),
    (6, "text=nothing || text=widget role=text"), (7, "color=red role=input_field"), (8, 'role=button right_of=1 || role=text below=1'),
]
_LOC_ROWS = """, parts AS (SELECT * FROM (VALUES (1,0,1,0,'text','ring'),(2,0,1,0,'text','small ring'),(2,1,1,0,'role','button'),(3,0,2,0,'role','button'),(3,0,2,1,'text','bolt'),(4,0,1,0,'id','2'),
  (5,0,1,0,'hint','brand#1'),(5,1,1,0,'id','1'),(6,0,1,0,'text','nothing'),(6,1,2,0,'text','widget'),(6,1,2,1,'role','text'),(7,0,1,0,'role','input_field'),
  (8,0,2,0,'role','button'),(8,0,2,1,'right_of','1'),(8,1,2,0,'role','text'),(8,1,2,1,'below','1')) AS t(loc_id, alt, n_parts, part, strategy, val)),
  hits AS (SELECT p.*, c.state_id, c.elem_id, lower(coalesce(CASE strategy WHEN 'text' THEN c.text WHEN 'hint' THEN c.hint WHEN 'role' THEN c.role ELSE CAST(c.elem_id AS VARCHAR) END, '')) AS field
    FROM parts p CROSS JOIN captions c WHERE strategy IN ('text','hint','role','id')),
  found AS (SELECT *, CASE WHEN field = val THEN 1 ELSE 0 END AS exact FROM hits WHERE field = val OR (strategy IN ('text','hint') AND contains(field, val))),
  direct AS (SELECT loc_id, alt, n_parts, part, state_id, elem_id FROM (SELECT *, max(exact) OVER (PARTITION BY loc_id, alt, part, state_id) AS top FROM found) WHERE exact = top),
  near AS (SELECT p.loc_id, p.alt, p.n_parts, p.part, c.state_id, c.elem_id FROM parts p CROSS JOIN captions c JOIN captions r ON r.state_id = c.state_id AND CAST(r.elem_id AS VARCHAR) = p.val AND r.elem_id <> c.elem_id
    WHERE (strategy = 'right_of' AND (c.x1+c.x2)/2.0 > r.x2) OR (strategy = 'below' AND (c.y1+c.y2)/2.0 > r.y2)),
  matched AS (SELECT loc_id, state_id, alt, elem_id FROM (SELECT * FROM direct UNION ALL SELECT * FROM near) GROUP BY loc_id, state_id, alt, elem_id, n_parts HAVING count(DISTINCT part) = n_parts)"""

DESCRIPTIONS = [(1, "the small ring button"), (2, "red widget"), (3, "bolt field at the left"), (4, "purple elephant button"), (5, "ring")]


def locators(spark):
    return spark.createDataFrame(LOCATORS, "loc_id int, locator string")


@query("locator_matches", over(f"{_LOC_ROWS} SELECT loc_id, state_id, alt, elem_id FROM matched", "captions"))
def locator_matches(spark, sf):
    return locator.matches(locators(spark), captions(spark, sf))


@query(
    "locator_exactly_one",
    over(f"{_LOC_ROWS}, one AS (SELECT loc_id, state_id, alt, min(elem_id) AS elem_id FROM matched GROUP BY loc_id, state_id, alt HAVING count(*) = 1) SELECT loc_id, state_id, arg_min(elem_id, alt) AS elem_id, min(alt) AS alt FROM one GROUP BY loc_id, state_id", "captions"),
)
def locator_exactly_one(spark, sf):
    return locator.resolve(locators(spark), captions(spark, sf))


@query("locator_fallback_chain", over(f"{_LOC_ROWS} SELECT loc_id, state_id, alt, elem_id FROM (SELECT *, min(alt) OVER (PARTITION BY loc_id, state_id) AS f FROM matched) WHERE alt = f", "captions"))
def locator_fallback_chain(spark, sf):
    return locator.resolve_all(locators(spark), captions(spark, sf))


@query(
    "locator_parse",
    over(
        """, w AS (SELECT state_id, elem_id, 'hint="' || hint || ' x" role=' || role AS one, 'id=' || elem_id AS two, CASE WHEN text IS NOT NULL THEN 'text="' || text || '"' END AS three FROM captions)
      SELECT state_id, elem_id, 0 AS alt, one AS rendered FROM w UNION ALL SELECT state_id, elem_id, 1, two FROM w UNION ALL SELECT state_id, elem_id, 2, three FROM w WHERE three IS NOT NULL""",
        "captions",
    ),
)
def locator_parse(spark, sf):
    """Chains written from every element, with a switch that is no strategy; all come back as they
    were but for that.  Captions here have several words, so they are quoted."""
    df = captions(spark, sf)
    third = F.coalesce(F.concat(F.lit(' || text="'), "text", F.lit('"')), F.lit(" || color=blue"))
    made = F.concat(F.lit('Hint="'), "hint", F.lit(' x" role='), "role", F.lit(" color=red || id="), F.col("elem_id").cast("string"), third)
    parts = df.select("state_id", "elem_id", F.posexplode(locator.alternatives(made)).alias("alt", "parts"))
    return parts.select("state_id", "elem_id", "alt", locator.render(F.col("parts")).alias("rendered"))


#: What the descriptions above say, spelled out for the checking query.
_SAID = """, said AS (SELECT * FROM (VALUES (1, ['the','small','ring'], true, ' button pushbutton ', 0), (2, ['red','widget'], true, '', 0), (3, ['bolt','at','the'], true, ' inputfield textfield edittext ', 1),
  (4, ['purple','elephant'], true, ' button pushbutton ', 0), (5, ['ring'], true, '', 0)) AS t(desc_id, name, naming, kinds, places)),
  toks AS (SELECT *, regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9]+') AS tt, regexp_extract_all(lower(coalesce(hint,'')), '[a-z0-9]+') AS ht FROM captions),
  base AS (SELECT d.desc_id, c.state_id, c.elem_id, d.name, d.naming, d.kinds, d.places, list_concat(c.tt, c.ht) AS have, c.tt, c.ht, (c.x1+c.x2)/2.0/400 AS cx, replace(c.visual_type, '_', '') AS kind FROM said d CROSS JOIN toks c),
  counted AS (SELECT *, len(list_filter(name, lambda t: list_contains(have, t))) AS hits,
    len(list_filter(name, lambda t: NOT list_contains(have, t) AND len(list_filter(have, lambda e: contains(e, t))) > 0)) AS subs FROM base),
  named AS (SELECT *, 2.0*(hits + 0.7*subs)/len(name) + CASE WHEN naming AND (tt = name OR ht = name) THEN 0.5 ELSE 0 END AS ns,
    CASE WHEN kinds <> '' AND contains(kinds, ' ' || kind || ' ') THEN 1.0 ELSE 0 END + CASE WHEN places = 1 AND cx < 0.34 THEN 0.5 ELSE 0 END AS ks FROM counted),
  scored AS (SELECT desc_id, state_id, elem_id, ns + CASE WHEN naming AND ns = 0 THEN least(0.5*ks, 1.0) ELSE ks END AS score FROM named),
  ranked AS (SELECT desc_id, state_id, elem_id, round(score, 6) AS score, row_number() OVER (PARTITION BY desc_id, state_id ORDER BY round(score, 6) DESC, elem_id) AS place FROM scored WHERE score > 0)"""


def ranked(spark, sf):
    asked = captions(spark, sf).select("state_id").distinct().join(F.broadcast(spark.createDataFrame(DESCRIPTIONS, "desc_id int, description string")))
    said = locator.rank(asked, captions(spark, sf), width=F.lit(400), height=F.lit(200)).withColumn("score", F.round("score", 6))
    again = Window.partitionBy("desc_id", "state_id").orderBy(F.desc("score"), "elem_id")
    return said.withColumn("place", F.row_number().over(again))


@query("lexical_rank", over(f"{_SAID} SELECT desc_id, state_id, elem_id, score, place FROM ranked", "captions"))
def lexical_rank(spark, sf):
    return ranked(spark, sf)


@query(
    "lexical_confident",
    over(f"{_SAID} SELECT desc_id, state_id, elem_id, score FROM (SELECT *, lead(score) OVER (PARTITION BY desc_id, state_id ORDER BY place) AS second FROM ranked) WHERE place = 1 AND score >= 1.5 AND (second IS NULL OR round(score - second, 6) >= 0.5)", "captions"),
)
def lexical_confident(spark, sf):
    return locator.confident(ranked(spark, sf))


#: Chains in which a description decides among several matches, or is the last resort.
JUDGED = [(1, 'role=button || desc="the small ring button"'), (2, "role=text || desc=ring"), (3, 'hint=brand#1 || desc="red widget"')]


@query(
    "locator_arbitration",
    over(
        f"""{_SAID}, cand AS (SELECT 1 AS loc_id, 1 AS desc_id, state_id, elem_id FROM captions WHERE role = 'button' UNION ALL SELECT 2, 5, state_id, elem_id FROM captions WHERE role = 'text'
        UNION ALL SELECT 3, 2, state_id, elem_id FROM (SELECT *, max(CASE WHEN lower(hint) = 'brand#1' THEN 1 ELSE 0 END) OVER (PARTITION BY state_id) AS top FROM captions WHERE contains(lower(hint), 'brand#1')) WHERE top = CASE WHEN lower(hint) = 'brand#1' THEN 1 ELSE 0 END),
      sizes AS (SELECT loc_id, state_id, count(*) AS n, min(elem_id) AS elem_id FROM cand GROUP BY loc_id, state_id),
      within_ AS (SELECT c.loc_id, c.state_id, c.elem_id, r.score, row_number() OVER w AS place, lead(r.score) OVER w AS second FROM cand c JOIN ranked r ON r.desc_id = c.desc_id AND r.state_id = c.state_id AND r.elem_id = c.elem_id WINDOW w AS (PARTITION BY c.loc_id, c.state_id ORDER BY r.score DESC, c.elem_id)),
      judged AS (SELECT c.loc_id, c.state_id, w.elem_id, 0 AS alt FROM sizes c JOIN within_ w ON w.loc_id = c.loc_id AND w.state_id = c.state_id AND w.place = 1 WHERE c.n > 1 AND w.score >= 1.5 AND (w.second IS NULL OR round(w.score - w.second, 6) >= 0.5)),
      sure AS (SELECT desc_id, state_id, elem_id FROM (SELECT *, lead(score) OVER (PARTITION BY desc_id, state_id ORDER BY place) AS second FROM ranked) WHERE place = 1 AND score >= 1.5 AND (second IS NULL OR round(score - second, 6) >= 0.5)),
      every AS (SELECT loc_id, state_id, elem_id, 0 AS alt FROM sizes WHERE n = 1 UNION ALL SELECT * FROM judged UNION ALL SELECT CASE desc_id WHEN 1 THEN 1 WHEN 5 THEN 2 ELSE 3 END, state_id, elem_id, 1 FROM sure WHERE desc_id IN (1, 2, 5))
      SELECT loc_id, state_id, arg_min(elem_id, alt) AS elem_id, min(alt) AS alt FROM every GROUP BY loc_id, state_id""",
        "captions",
    ),
)
def locator_arbitration(spark, sf):
    asked = spark.createDataFrame(JUDGED, "loc_id int, locator string")
    return locator.resolve(asked, captions(spark, sf), width=F.lit(400), height=F.lit(200))


@query(
    "locator_explain",
    over(
        f"""{_LOC_ROWS}, tried AS (SELECT DISTINCT loc_id, alt, state_id FROM parts CROSS JOIN captions), counted AS (SELECT loc_id, state_id, alt, count(*) AS n, min(elem_id) AS elem_id FROM matched GROUP BY loc_id, state_id, alt),
      said AS (SELECT t.*, n, CASE WHEN n = 1 THEN elem_id END AS elem_id, min(CASE WHEN n = 1 THEN t.alt END) OVER (PARTITION BY t.loc_id, t.state_id) AS won FROM tried t LEFT JOIN counted c ON c.loc_id = t.loc_id AND c.alt = t.alt AND c.state_id = t.state_id)
      SELECT loc_id, state_id, alt, CASE WHEN n IS NULL THEN 'not found' WHEN n = 1 THEN 'ok' ELSE n || ' elements match' END AS outcome, elem_id FROM said WHERE won IS NULL OR alt <= won""",
        "captions",
    ),
)
def locator_explain(spark, sf):
    return locator.explain(locators(spark), captions(spark, sf)).drop("rendered")


@query(
    "constant_sweep",
    over(f"{_SAID}, grid AS (SELECT unnest([1.0, 1.5, 2.0, 2.5]) AS floor_) SELECT g.floor_ AS score_floor, a.desc_id, count(*) AS n FROM grid g JOIN ranked a ON a.place = 1 AND a.score >= g.floor_ GROUP BY g.floor_, a.desc_id", "captions"),
)
def constant_sweep(spark, sf):
    grid = spark.createDataFrame([(x,) for x in (1.0, 1.5, 2.0, 2.5)], "score_floor double")
    top = ranked(spark, sf).where("place = 1")
    return top.join(F.broadcast(grid), F.col("score") >= F.col("score_floor")).groupBy("score_floor", "desc_id").agg(F.count("*").alias("n"))


@query(
    "generated_locators",
    over(
        """SELECT state_id, elem_id, CASE WHEN text IS NULL THEN NULL WHEN n = 1 THEN text ELSE text || '[' || CAST(i - 1 AS VARCHAR) || ']' END AS text_locator, visual_type || '[' || CAST(k - 1 AS VARCHAR) || ']' AS type_locator,
      'bounds(' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ')' AS bounds_locator, 'point(' || ((x1+x2)//2) || ',' || ((y1+y2)//2) || ')' AS center_locator FROM (
      SELECT *, count(*) OVER (PARTITION BY state_id, text) AS n, row_number() OVER (PARTITION BY state_id, text ORDER BY elem_id) AS i, row_number() OVER (PARTITION BY state_id, visual_type ORDER BY elem_id) AS k FROM captions)""",
        "captions",
    ),
)
def generated_locators(spark, sf):
    df = elements.locators(captions(spark, sf))
    at = lambda k: F.try_element_at("locators", F.lit(k))
    return df.select("state_id", "elem_id", at("text").alias("text_locator"), at("type_index").alias("type_locator"), at("bounds").alias("bounds_locator"), at("center").alias("center_locator"))


@query(
    "default_locator",
    over(
        """SELECT state_id, elem_id, coalesce('text=' || CASE WHEN text LIKE '% %' THEN '"' || text || '"' ELSE text END, 'hint=' || CASE WHEN hint LIKE '% %' THEN '"' || hint || '"' ELSE hint END) || ' role=' || lower(role) || ' || id=' || elem_id AS locator FROM captions""",
        "captions",
    ),
)
def default_locator(spark, sf):
    made = elements.default_locator(F.col("text"), F.col("hint"), F.col("role"), F.col("elem_id"))
    return captions(spark, sf).select("state_id", "elem_id", made.alias("locator"))


@query("unique_captions", over("SELECT state_id, elem_id FROM (SELECT *, count(*) OVER (PARTITION BY state_id, lower(trim(text))) AS n FROM captions WHERE text IS NOT NULL) WHERE n = 1", "captions"))
def unique_captions(spark, sf):
    n = F.count(F.lit(1)).over(Window.partitionBy("state_id", F.lower(F.trim("text"))))
    return captions(spark, sf).where("text is not null").withColumn("n", n).where("n = 1").select("state_id", "elem_id")


@query(
    "unique_names",
    over("SELECT state_id, elem_id, clean || CASE WHEN n = 1 THEN '' ELSE '_' || CAST(n - 1 AS VARCHAR) END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY state_id, clean ORDER BY elem_id) AS n FROM (SELECT *, upper(replace(text, ' ', '_')) AS clean FROM captions WHERE text IS NOT NULL))", "captions"),
)
def unique_names(spark, sf):
    return elements.unique_names(captions(spark, sf).where("text is not null"), "text", ["state_id"], "elem_id").select("state_id", "elem_id", "unique_name")


@query(
    "role_inference",
    over(
        """SELECT state_id, elem_id, CASE WHEN visual_type = 'text' AND elem_id % 2 = 0 THEN 'text'
      WHEN r >= 3.0 AND h >= 22 THEN 'input_field' WHEN regexp_matches(lower(coalesce(text,'')), 'check|tick|toggle|radio|switch|selected') THEN 'checkbox'
      WHEN text IS NOT NULL AND w >= 82 AND r >= 1.3 THEN 'button' WHEN r <= 1.35 AND greatest(w,h) <= 78 THEN 'icon' WHEN text IS NOT NULL AND r >= 1.3 AND h >= 18 THEN 'button'
      WHEN greatest(w,h) <= 46 THEN 'icon' WHEN text IS NOT NULL THEN 'button' ELSE 'icon' END AS role FROM (SELECT *, x2-x1 AS w, y2-y1 AS h, (x2-x1)/CAST(greatest(y2-y1,1) AS DOUBLE) AS r FROM captions)""",
        "captions",
    ),
)
def role_inference(spark, sf):
    raw = F.when(F.col("visual_type") == "text", "text").otherwise("icon")
    live = (F.col("elem_id") % 2 == 1) | (F.col("visual_type") != "text")
    made = elements.infer_role(raw, live, F.col("text"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1080))
    return captions(spark, sf).select("state_id", "elem_id", made.alias("role"))


@query("display_names", over("SELECT state_id, elem_id, coalesce(text, hint, '(' || visual_type || ')') AS name, lower(coalesce(text,'') || ' ' || hint) LIKE '%ring%' AND lower(coalesce(text,'') || ' ' || hint) LIKE '%brand%' AS found FROM captions", "captions"))
def display_names(spark, sf):
    df = captions(spark, sf)
    found = X.search_all_terms(F.lit("ring Brand"), F.coalesce("text", F.lit("")), F.col("hint"))
    return df.select("state_id", "elem_id", X.display_name(F.col("text"), F.col("label"), F.col("hint"), F.col("visual_type")).alias("name"), found.alias("found"))


@query("screen_vocabulary", over("SELECT state_id, count(DISTINCT t) AS n_tokens FROM (SELECT state_id, unnest(list_concat(regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9]+'), regexp_extract_all(lower(coalesce(hint,'')), '[a-z0-9]+'))) AS t FROM captions) GROUP BY state_id", "captions"))
def screen_vocabulary(spark, sf):
    return captions(spark, sf).groupBy("state_id").agg(F.size(X.vocabulary(F.col("text"), F.col("hint"))).alias("n_tokens"))


@query("norm_text", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) AS digest, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens FROM documents")
def norm_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(X.normal(F.regexp_replace("text", r"[ \t\n\r]+", " "))).alias("digest"), F.size(X.tokens(F.col("text"))).alias("n_tokens"))


@query("token_sequence", "SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' and the ')")
def token_sequence(spark, sf):
    needle = F.array(F.lit("and"), F.lit("the"))
    return table(spark, sf, "documents").where(X.has_sequence(X.tokens(F.col("text")), needle)).select("doc_id")


@query("html_links", "SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"')) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_links(spark, sf):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.size(links).alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))

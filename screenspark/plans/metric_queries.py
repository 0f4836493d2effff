"""Queries of detection, text and run metrics, statistics and benchmark steps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions import text as X
from ..operators import benchmark, elements, evaluate
from . import registry as Q
from .registry import over, query
from .spatial_queries import JOIN, LARGEST_TEST, SMALLEST, _PARENT, largest_parents, smallest_parents
from .views import boxes, captions, table, truth

_MATCH = (
    f", near AS (SELECT a.state_id, a.elem_id AS pred_id, b.elem_id AS gt_id, {Q.iou('a', 'b')} AS iou FROM boxes a JOIN gt b ON a.state_id = b.state_id WHERE {Q.iou('a', 'b')} >= 0.5)"
    + Q.fold_sql("near", "state_id", "iou DESC, pred_id, gt_id", "k.pred_id = n.pred_id OR k.gt_id = n.gt_id", "pred_id, gt_id, iou")
    + ", matched AS (SELECT state_id, u.pred_id AS pred_id, u.gt_id AS gt_id, u.iou AS iou FROM (SELECT state_id, unnest(kept) AS u FROM final))"
)
_SCREENS = """, p AS (SELECT state_id, count(*) AS n FROM boxes GROUP BY state_id), g AS (SELECT state_id, count(*) AS n FROM gt GROUP BY state_id), m AS (SELECT state_id, count(*) AS n, sum(iou) AS s FROM matched GROUP BY state_id),
  screens AS (SELECT coalesce(p.state_id, g.state_id) AS state_id, coalesce(m.n, 0) AS tp, coalesce(p.n, 0) - coalesce(m.n, 0) AS fp, coalesce(g.n, 0) - coalesce(m.n, 0) AS fn, coalesce(m.s, 0) AS iou_sum
    FROM p FULL JOIN g ON p.state_id = g.state_id LEFT JOIN m ON m.state_id = coalesce(p.state_id, g.state_id)),
  rated AS (SELECT *, CASE WHEN tp+fp = 0 THEN 0 ELSE tp/CAST(tp+fp AS DOUBLE) END AS pr, CASE WHEN tp+fn = 0 THEN 0 ELSE tp/CAST(tp+fn AS DOUBLE) END AS re FROM screens)"""


def matched(spark, sf):
    return evaluate.match_elements(boxes(spark, sf), truth(spark, sf))


def screens(spark, sf):
    return evaluate.screen_metrics(boxes(spark, sf), truth(spark, sf), matched(spark, sf))


@query("greedy_match", over(f"{_MATCH} SELECT state_id, pred_id, gt_id, round(iou, 6) AS iou FROM matched", "gt", recursive=True))
def greedy_match(spark, sf):
    return matched(spark, sf).withColumn("iou", F.round("iou", 6))


@query(
    "q_element_metrics",
    over(f"{_MATCH}{_SCREENS} SELECT state_id, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr+re = 0 THEN 0 ELSE 2*pr*re/(pr+re) END, 6) AS f1 FROM rated", "gt", recursive=True),
)
def q_element_metrics(spark, sf):
    return screens(spark, sf).select("state_id", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "detection_prf",
    over(
        f"""{_MATCH}{_SCREENS}, t AS (SELECT count(*) AS screens, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(iou_sum) AS s, avg(pr) AS mp, avg(re) AS mr FROM rated)
      SELECT screens, tp, fp, fn, round(tp/CAST(tp+fp AS DOUBLE), 6) AS precision, round(tp/CAST(tp+fn AS DOUBLE), 6) AS recall, round(tp/CAST(tp+fp+fn AS DOUBLE), 6) AS accuracy, round(s/tp, 6) AS mean_iou, round(mp, 6) AS mean_precision, round(mr, 6) AS mean_recall FROM t""",
        "gt", recursive=True,
    ),
)
def detection_prf(spark, sf):
    df = evaluate.pooled(screens(spark, sf))
    return df.select("screens", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy", "mean_iou", "mean_precision", "mean_recall")])


@query(
    "class_prf",
    over(
        f"""{_MATCH}, p AS (SELECT b.visual_type, count(m.pred_id) AS tp, count(*) - count(m.pred_id) AS fp FROM boxes b LEFT JOIN matched m ON m.state_id = b.state_id AND m.pred_id = b.elem_id GROUP BY b.visual_type),
      g AS (SELECT b.visual_type, count(*) - count(m.gt_id) AS fn, count(*) AS support FROM gt b LEFT JOIN matched m ON m.state_id = b.state_id AND m.gt_id = b.elem_id GROUP BY b.visual_type)
      SELECT p.visual_type, tp, fp, fn, support, round(tp/CAST(tp+fp AS DOUBLE), 6) AS precision, round(tp/CAST(tp+fn AS DOUBLE), 6) AS recall FROM p JOIN g ON p.visual_type = g.visual_type""",
        "gt", recursive=True,
    ),
)
def class_prf(spark, sf):
    df = evaluate.class_metrics(boxes(spark, sf), truth(spark, sf), matched(spark, sf))
    return df.select("visual_type", "tp", "fp", "fn", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "type_accuracy",
    over(
        f"""{_MATCH} SELECT g.visual_type, count(*) AS support, count(m.pred_id) AS found, count(CASE WHEN b.visual_type = g.visual_type THEN 1 END) AS typed, round(count(m.pred_id)/CAST(count(*) AS DOUBLE), 6) AS recall
      FROM gt g LEFT JOIN matched m ON m.state_id = g.state_id AND m.gt_id = g.elem_id LEFT JOIN boxes b ON b.state_id = m.state_id AND b.elem_id = m.pred_id GROUP BY g.visual_type""",
        "gt", recursive=True,
    ),
)
def type_accuracy(spark, sf):
    df = evaluate.type_accuracy(boxes(spark, sf), truth(spark, sf), matched(spark, sf))
    return df.select("visual_type", "support", "found", "typed", F.round("recall", 6).alias("recall"))


#: Every sentence of every text with the one that follows it.  The checking engine counts bytes
#: in distances, so there each of these letters becomes one byte that no text has.
_LETTERS = "éèÍÊñÄßÉêÇçíÈÑöüÖóÓäÜáúàô"
_BYTES = "".join(map(chr, [*range(1, 9), *range(14, 32)]))[: len(_LETTERS)]
_SENTENCES = f"SELECT doc_id, g, p, levenshtein(translate(p, '{_LETTERS}', '{_BYTES}'), translate(g, '{_LETTERS}', '{_BYTES}')) AS d FROM (SELECT doc_id, unnest(s[2:]) AS g, unnest(s[:-2]) AS p FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+') AS s FROM documents) WHERE len(s) > 1)"


def _text_pairs(spark, sf):
    """Every sentence of every text, as the reading of the one that follows it."""
    listed = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^.!?\n]+"), F.lit(0)).alias("s")).where("size(s) > 1")
    pairs = F.arrays_zip(F.expr("slice(s, 1, size(s) - 1)").alias("p"), F.expr("slice(s, 2, size(s) - 1)").alias("g"))
    return listed.select("doc_id", F.explode(pairs).alias("z")).select("doc_id", F.col("z.p").alias("pred_text"), F.col("z.g").alias("gt_text"))


@query(
    "ocr_metrics",
    f"""WITH u AS ({_SENTENCES}) SELECT count(*) AS comparisons, sum(length(g)) AS chars, sum(d) AS edits, sum(CASE WHEN lower(trim(p)) = lower(trim(g)) THEN 1 ELSE 0 END) AS exact,
        sum(len(list_filter(regexp_split_to_array(g, '\\s+'), lambda x: x <> ''))) AS words, round(sum(d)/CAST(sum(length(g)) AS DOUBLE), 6) AS cer FROM u""",
)
def ocr_metrics(spark, sf):
    df = evaluate.text_metrics(_text_pairs(spark, sf))
    return df.select("comparisons", "chars", "edits", "exact", "words", F.round("cer", 6).alias("cer"))


@query("ocr_distance", f"SELECT doc_id, count(*) AS sentences, sum(d) AS edits FROM ({_SENTENCES}) GROUP BY doc_id")
def ocr_distance(spark, sf):
    return _text_pairs(spark, sf).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(X.edit_distance(F.col("pred_text"), F.col("gt_text"))).alias("edits"))


@query("word_errors")
def word_errors(spark, sf):
    """Word edits of each text's sentences; SQL has no distance over words."""
    counted = _text_pairs(spark, sf).select("doc_id", F.size(X.words(F.col("gt_text"))).cast("long").alias("n"), X.word_distance("pred_text", "gt_text").alias("d"))
    sums = counted.groupBy("doc_id").agg(F.sum("n").alias("words"), F.sum("d").alias("word_edits"))
    return sums.select("*", F.round(F.try_divide(F.col("word_edits").cast("double"), "words"), 6).alias("wer"))


def _whole_text_pairs(spark, sf):
    """Every whole text, and the same without its first character."""
    return table(spark, sf, "documents").select("doc_id", F.expr("substring(text, 2)").alias("pred_text"), F.col("text").alias("gt_text"))


@query("text_similarity")
def text_similarity(spark, sf):
    return evaluate.similar_texts(_whole_text_pairs(spark, sf), 0.6).select("doc_id", F.round("similarity", 6).alias("similarity"))


@query("edit_script_counts")
def edit_script_counts(spark, sf):
    return _whole_text_pairs(spark, sf).select("doc_id", X.edit_counts("pred_text", "gt_text").alias("e")).select("doc_id", "e.*")


@query(
    "hierarchy_parent_accuracy",
    over(f""", small AS ({SMALLEST}), big AS ({_PARENT.format(order="-" + Q.area("b"), join=JOIN, test=LARGEST_TEST)})
      SELECT a.state_id, count(*) AS common, sum(CASE WHEN a.parent_id = b.parent_id THEN 1 ELSE 0 END) AS same_parent, round(avg(CASE WHEN a.parent_id = b.parent_id THEN 1.0 ELSE 0 END), 6) AS parent_accuracy
      FROM small a JOIN big b ON a.state_id = b.state_id AND a.elem_id = b.elem_id GROUP BY a.state_id"""),
)
def hierarchy_parent_accuracy(spark, sf):
    df = evaluate.hierarchy_metrics(smallest_parents(spark, sf), largest_parents(spark, sf))
    return df.withColumn("parent_accuracy", F.round("parent_accuracy", 6))


@query("locator_metrics", over("SELECT state_id, count(*) AS n, count(text) AS with_text, count(DISTINCT text) AS texts, round((count(text) - count(DISTINCT text))/CAST(count(*) AS DOUBLE), 6) AS repeat_rate FROM captions GROUP BY state_id", "captions"))
def locator_metrics(spark, sf):
    df = evaluate.locator_metrics(elements.locators(captions(spark, sf)))
    return df.select("state_id", "n", "with_text", "texts", F.round("repeat_rate", 6).alias("repeat_rate"))


@query("class_distribution", over("SELECT visual_type, count(*) AS n, round(count(*)/CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM boxes GROUP BY visual_type"))
def class_distribution(spark, sf):
    n = boxes(spark, sf).groupBy("visual_type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("visual_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


# --- two runs over the labelled documents: quality, and not toxic, as two executors --------

_RUNS = "WITH r AS (SELECT doc_id AS step, source AS app, quality = 1 AS a, toxic = 0 AS b FROM labels JOIN documents USING (doc_id))"


def _runs(spark, sf):
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return both.select(F.col("doc_id").alias("step"), F.col("source").alias("app"), (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))


@query("run_diff", f"{_RUNS} SELECT step, CASE WHEN a = b THEN 'identical' WHEN a THEN 'gain' ELSE 'loss' END AS change FROM r")
def run_diff(spark, sf):
    r = _runs(spark, sf)
    return evaluate.run_diff(r.select("step", F.col("a").alias("ok")), r.select("step", F.col("b").alias("ok")))


@query("per_app_rollup", f"{_RUNS} SELECT coalesce(app, 'all') AS app, count(*) AS steps, sum(CASE WHEN a THEN 1 ELSE 0 END) AS hits FROM r GROUP BY ROLLUP (app)")
def per_app_rollup(spark, sf):
    return _runs(spark, sf).rollup("app").agg(F.count("*").alias("steps"), F.count_if("a").alias("hits")).withColumn("app", F.coalesce("app", F.lit("all")))


_WILSON = "((h/n + 3.8416/2/n) {s} 1.96*sqrt(h/n*(1-h/n)/n + 3.8416/4/n/n)) / (1 + 3.8416/n)"


@query("wilson_ci", f"{_RUNS} SELECT app, round(greatest(0, {_WILSON.format(s='-')}), 6) AS low, round(least(1, {_WILSON.format(s='+')}), 6) AS high FROM (SELECT app, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) AS DOUBLE) AS h FROM r GROUP BY app)")
def wilson_ci(spark, sf):
    g = _runs(spark, sf).groupBy("app").agg(stats.wilson(F.count_if("a"), F.count("*")).alias("w"))
    return g.select("app", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


_DISCORD = f"{_RUNS.replace('WITH', 'WITH RECURSIVE')}, d AS (SELECT app, sum(CASE WHEN a AND NOT b THEN 1 ELSE 0 END) AS gain, sum(CASE WHEN b AND NOT a THEN 1 ELSE 0 END) AS loss FROM r GROUP BY app), terms AS (SELECT app, CAST(0 AS BIGINT) AS i, pow(0.5, gain+loss) AS term, gain+loss AS n, least(gain,loss) AS k FROM d UNION ALL SELECT app, i+1, term*(n-i)/(i+1), n, k FROM terms WHERE i < k), ps AS (SELECT app, CASE WHEN max(n) = 0 THEN 1.0 ELSE least(1.0, 2*sum(term)) END AS p FROM terms GROUP BY app)"


def _mcnemar(spark, sf):
    d = _runs(spark, sf).groupBy("app").agg(F.count_if(F.col("a") & ~F.col("b")).alias("gain"), F.count_if(F.col("b") & ~F.col("a")).alias("loss"))
    return d.select("app", "gain", "loss", stats.mcnemar(F.col("gain"), F.col("loss")).alias("p"))


@query("mcnemar_exact", f"{_DISCORD} SELECT d.app, d.gain, d.loss, round(p, 6) AS p FROM d JOIN ps ON d.app = ps.app")
def mcnemar_exact(spark, sf):
    return _mcnemar(spark, sf).withColumn("p", F.round("p", 6))


@query("holm_adjust", f"{_DISCORD}, o AS (SELECT app, p, (count(*) OVER () - row_number() OVER (ORDER BY p, app) + 1)*p AS s FROM ps) SELECT app, round(least(1.0, max(s) OVER (ORDER BY p, app ROWS UNBOUNDED PRECEDING)), 6) AS holm FROM o")
def holm_adjust(spark, sf):
    """One family: a row for each application."""
    p = _mcnemar(spark, sf).select("app", "p", F.lit(1).alias("family"))
    return stats.holm(p, "p", ["family"], "app").select("app", F.round("holm", 6).alias("holm"))


@query(
    "sign_flip_exact",
    f"{_RUNS}, c AS (SELECT lang, sum(CASE WHEN a THEN 1 ELSE 0 END - CASE WHEN b THEN 1 ELSE 0 END) AS d FROM r JOIN documents ON step = doc_id GROUP BY lang), n AS (SELECT *, row_number() OVER (ORDER BY lang) - 1 AS j FROM c), f AS (SELECT m.range AS m, sum(CASE WHEN (m.range >> n.j) & 1 = 1 THEN -d ELSE d END) AS s FROM range(16) m CROSS JOIN n GROUP BY m.range) SELECT (SELECT count(*) FROM c) AS clusters, round(avg(CASE WHEN abs(s) >= abs((SELECT sum(d) FROM c)) THEN 1.0 ELSE 0 END), 6) AS p_value, true AS exact FROM f",
)
def sign_flip_exact(spark, sf):
    lang = table(spark, sf, "documents").select(F.col("doc_id").alias("step"), "lang")
    c = _runs(spark, sf).join(lang, "step").groupBy("lang").agg((F.count_if("a") - F.count_if("b")).alias("d"))
    return stats.sign_flip(c, "d").withColumn("p_value", F.round("p_value", 6))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    c = _runs(spark, sf).groupBy("app").agg(F.count_if("a").alias("hits"), F.count("*").alias("n"))
    return stats.bootstrap(c, "hits", "n")


@query("zero_event_bound", f"{_RUNS} SELECT round(1 - pow(0.05, 1.0/count(DISTINCT app)), 6) AS bound FROM r")
def zero_event_bound(spark, sf):
    return _runs(spark, sf).agg(F.round(stats.zero_event_bound(F.count_distinct("app")), 6).alias("bound"))


@query("cost_weighted", f"{_RUNS} SELECT cost, app, round(sum(CASE WHEN NOT a THEN 1 ELSE 0 END + cost*CASE WHEN NOT b THEN 1 ELSE 0 END)/CAST(count(*) AS DOUBLE), 6) AS weighted FROM r CROSS JOIN (SELECT unnest([1,5,10,50]) AS cost) GROUP BY cost, app")
def cost_weighted(spark, sf):
    rows = _runs(spark, sf).withColumn("cost", F.explode(F.array(*map(F.lit, (1, 5, 10, 50)))))
    return rows.groupBy("cost", "app").agg(F.round(F.try_divide((F.count_if(~F.col("a")) + F.max("cost") * F.count_if(~F.col("b"))).cast("double"), F.count("*")), 6).alias("weighted"))


@query("run_summary", "WITH s AS (SELECT event_id, user_id % 4 AS executor, CASE WHEN event_type IN ('click','view') THEN 'action' ELSE 'verify' END AS kind, event_id % 5 = 0 AS negative, value > 20 AS ok, value FROM events) SELECT executor, count(*) AS steps, round(sum(CASE WHEN kind = 'action' AND ok THEN 1 ELSE 0 END)/CAST(sum(CASE WHEN kind = 'action' THEN 1 ELSE 0 END) AS DOUBLE), 6) AS click_rate, sum(CASE WHEN kind = 'verify' AND negative AND ok THEN 1 ELSE 0 END) AS false_passes, round(median(value), 6) AS median_latency FROM s GROUP BY executor")
def run_summary(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 4).alias("executor"), F.when(F.col("event_type").isin("click", "view"), "action").otherwise("verify").alias("kind"), (F.col("event_id") % 5 == 0).alias("negative"), (F.col("value") > 20).alias("hit"), (F.col("value") > 20).alias("passed"), F.col("value").alias("latency"))
    df = evaluate.summary(e, ["executor"])
    return df.select("executor", "steps", F.round("click_rate", 6).alias("click_rate"), "false_passes", F.round("median_latency", 6).alias("median_latency"))


# --- benchmark steps: an application is a customer ------------------------------------------

_APPS = ", named AS (SELECT c.*, o_custkey % 200 AS app FROM captions c JOIN orders ON c.state_id = o_orderkey WHERE c.text IS NOT NULL), uniq AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY state_id, lower(trim(text))) AS n FROM named) WHERE n = 1)"


def _steps(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("state_id"), (F.col("o_custkey") % 200).alias("app"))
    named = captions(spark, sf).where("text is not null").join(orders, "state_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("state_id", F.lower(F.trim("text"))))
    return named.withColumn("n", n).where("n = 1")


@query("unique_caption_steps", over(f"{_APPS} SELECT state_id, elem_id, 'text=\"' || text || '\"' AS locator, 'click the ''' || text || ''' ' || visual_type AS instruction FROM uniq", "captions"))
def unique_caption_steps(spark, sf):
    return _steps(spark, sf).select("state_id", "elem_id", F.format_string('text="%s"', "text").alias("locator"), F.format_string("click the '%s' %s", "text", "visual_type").alias("instruction"))


@query("dedupe_app", over(f"{_APPS} SELECT app, state_id, elem_id FROM (SELECT *, row_number() OVER (PARTITION BY app, lower(text), visual_type ORDER BY state_id, elem_id) AS k FROM uniq) WHERE k = 1", "captions"))
def dedupe_app(spark, sf):
    w = Window.partitionBy("app", F.lower("text"), "visual_type").orderBy("state_id", "elem_id")
    return _steps(spark, sf).withColumn("k", F.row_number().over(w)).where("k = 1").select("app", "state_id", "elem_id")


_ABSENT = "NOT EXISTS (SELECT 1 FROM uniq h WHERE h.state_id = s.state_id AND (contains(lower(h.text), p.caption) OR contains(p.caption, lower(h.text))))"


@query(
    "same_app_negatives",
    over(
        f"""{_APPS}, pool AS (SELECT DISTINCT app, lower(text) AS caption FROM uniq), s AS (SELECT DISTINCT app, state_id FROM uniq),
      lots AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY md5('42/' || app || '/' || caption), caption) AS rank FROM pool)
      SELECT state_id, caption FROM (SELECT s.state_id, p.caption, row_number() OVER (PARTITION BY s.state_id ORDER BY p.rank) AS n FROM s JOIN lots p ON p.app = s.app WHERE {_ABSENT}) WHERE n <= 2""",
        "captions",
    ),
)
def same_app_negatives(spark, sf):
    """Two captions of the same application that a screen neither has nor has a part of."""
    return benchmark.negatives(_steps(spark, sf), 42)


@query("near_miss", over(f"{_APPS}, pool AS (SELECT DISTINCT app, lower(text) AS caption, regexp_extract(lower(text), '[a-z0-9]+([^a-z0-9]*)$', 0) AS last FROM uniq), s AS (SELECT DISTINCT app, state_id FROM uniq) SELECT DISTINCT s.state_id, p.caption FROM s JOIN pool p ON p.app = s.app WHERE NOT EXISTS (SELECT 1 FROM uniq h WHERE h.state_id = s.state_id AND lower(h.text) = p.caption) AND EXISTS (SELECT 1 FROM uniq h WHERE h.state_id = s.state_id AND regexp_extract(lower(h.text), '[a-z0-9]+([^a-z0-9]*)$', 0) = p.last)", "captions"))
def near_miss(spark, sf):
    """Captions of the application that share the last word with one on the screen."""
    return benchmark.near_misses(_steps(spark, sf))

"""Queries of benchmark sets: splits, draws, counters, costs and waits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import specs
from ..functions import text as X
from ..operators import benchmark, locator, selection, steps
from ..streaming import wait
from .metric_queries import _APPS, _RUNS, _runs, _steps
from .registry import over, query
from .views import captions, table, truth

_LOT = "CAST(('0x' || substring(md5('{seed}/' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"


@query("dataset_split", f"SELECT o_orderkey AS state_id, CASE WHEN lot < 0.8 THEN 'train' WHEN lot < 0.9 THEN 'val' ELSE 'test' END AS part FROM (SELECT o_orderkey, {_LOT.format(seed=7, key='o_orderkey')} AS lot FROM orders)")
def dataset_split(spark, sf):
    states = table(spark, sf, "orders").select(F.col("o_orderkey").alias("state_id"))
    return benchmark.split(states, 7, "state_id", {"train": 0.8, "val": 0.1, "test": 0.1})


@query("seeded_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY md5('42/' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS place FROM orders")
def seeded_order(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("app"))
    return benchmark.permuted(orders, 42, "o_orderkey", ["app"]).select("o_orderkey", "place")


_STEP = "SELECT event_id, user_id, user_id % 4 AS executor, event_type, CASE WHEN event_type IN ('click','view') THEN 'action' ELSE 'verify' END AS kind, event_id % 5 = 0 AS negative, value > 20 AS ok, value FROM events"


def _results(spark, sf):
    ok = F.col("value") > 20
    return table(spark, sf, "events").select(
        "event_id", "user_id", (F.col("user_id") % 4).alias("executor"), "event_type", F.when(F.col("event_type").isin("click", "view"), "action").otherwise("verify").alias("kind"),
        (F.col("event_id") % 5 == 0).alias("negative"), ok.alias("hit"), ok.alias("passed"), F.col("value").alias("latency"),
    )


def _n(test: str, name: str) -> str:
    return f"sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS {name}"


@query(
    "step_counters",
    f"SELECT executor, {_n('kind = ' + repr('action'), 'clicks')}, {_n('kind = ' + repr('action') + ' AND ok', 'hit')}, {_n('kind = ' + repr('verify') + ' AND negative', 'absent')}, {_n('kind = ' + repr('verify') + ' AND negative AND ok', 'false_pass')}, {_n('kind = ' + repr('verify') + ' AND NOT negative', 'present')}, {_n('kind = ' + repr('verify') + ' AND NOT negative AND ok', 'present_pass')} FROM ({_STEP}) GROUP BY executor",
)
def step_counters(spark, sf):
    return benchmark.counters(_results(spark, sf), ["executor"])


@query(
    "step_costs",
    f"SELECT executor, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(max(CASE WHEN i = k // 2 + 1 THEN value END), 6) AS upper_median FROM (SELECT *, row_number() OVER (PARTITION BY executor, event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY executor, event_type) AS k FROM ({_STEP})) GROUP BY executor, event_type",
)
def step_costs(spark, sf):
    df = benchmark.costs(_results(spark, sf), ["executor", "event_type"])
    return df.select("executor", "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("upper_median", 6).alias("upper_median"))


_SHARE = "round(CAST(sum(CASE WHEN {test} AND {base} THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN {base} THEN 1 ELSE 0 END), 0), 4) AS {name}"
_WORDED = f"""SELECT ['original', 'terse', 'wordy'][event_id % 3 + 1] AS variant, user_id, kind, CASE WHEN negative THEN 'FAILED' ELSE 'PASSED' END AS expect, ok AS found, ok AND user_id % 3 <> 0 AS hit, value FROM ({_STEP})"""


@query(
    "paraphrase_summary",
    f"""SELECT variant, {_SHARE.format(test="hit", base="kind = 'action'", name="action_hit_rate")}, sum(CASE WHEN kind = 'action' THEN 1 ELSE 0 END) AS actions,
      {_SHARE.format(test="(CASE WHEN found THEN 'PASSED' ELSE 'FAILED' END) = expect", base="kind = 'verify'", name="verify_accuracy")}, sum(CASE WHEN kind = 'verify' THEN 1 ELSE 0 END) AS verifies,
      {_SHARE.format(test="found AND expect = 'FAILED'", base="kind = 'verify'", name="false_pass_rate")}, {_SHARE.format(test="hit", base="kind = 'verify' AND expect = 'PASSED'", name="strict_present")},
      sum(CASE WHEN kind = 'verify' AND expect = 'PASSED' THEN 1 ELSE 0 END) AS present, round(sum(value), 1) AS seconds_total, round(max(CASE WHEN i = k // 2 + 1 THEN value END), 4) AS median_latency
      FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY value) AS i, count(*) OVER (PARTITION BY variant) AS k FROM ({_WORDED})) GROUP BY variant""",
)
def paraphrase_summary(spark, sf):
    rows = _results(spark, sf)
    variant = F.array(*map(F.lit, ["original", "terse", "wordy"]))[(F.col("event_id") % 3).cast("int")]
    worded = rows.select(variant.alias("variant"), "kind", F.when(F.col("negative"), "FAILED").otherwise("PASSED").alias("expect"), F.col("hit").alias("found"), (F.col("hit") & (F.col("user_id") % 3 != 0)).alias("hit"), "latency")
    return benchmark.wording_summary(worded, ["variant"])


@query(
    "value_quantiles",
    "SELECT user_id % 10 AS g, count(*) AS n, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY user_id % 10",
)
def value_quantiles(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % 10).alias("g"), "value")
    got = selection.quantiles(rows, ["g"], "value", {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    return got.select("g", "n", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p99")])


@query("failed_steps", f"{_RUNS} SELECT app, CASE WHEN n > 8 THEN ids || ' and ' || CAST(n - 8 AS VARCHAR) || ' more' ELSE ids END AS ids FROM (SELECT app, count(*) AS n, string_agg(CAST(step AS VARCHAR), ', ' ORDER BY step) FILTER (WHERE k <= 8) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY step) AS k FROM r WHERE NOT a) GROUP BY app)")
def failed_steps(spark, sf):
    """A report names the first few; that limit is the feature."""
    return selection.first_ids(_runs(spark, sf).where("not a"), ["app"], "step").select("app", "ids")


@query("latest_per_user", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_per_user(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return benchmark.latest(rows, ["user_id", "event_type"], "event_id")


@query("label_filter_counts", f"{_RUNS} SELECT coalesce(app, 'all') AS app, {_n('a AND b', 'kept')}, {_n('a AND NOT b', 'unclean')}, {_n('NOT a', 'poor')} FROM r GROUP BY ROLLUP (app)")
def label_filter_counts(spark, sf):
    kind = F.when(~F.col("a"), "poor").when(F.col("b"), "kept").otherwise("unclean")
    counted = _runs(spark, sf).withColumn("kind", kind).rollup("app").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("kept", "unclean", "poor")])
    return counted.withColumn("app", F.coalesce("app", F.lit("all")))


@query("distinct_captions", over("SELECT state_id, text, min(elem_id) AS elem_id FROM captions WHERE text IS NOT NULL GROUP BY state_id, text", "captions"))
def distinct_captions(spark, sf):
    return captions(spark, sf).where("text is not null").groupBy("state_id", "text").agg(F.min("elem_id").alias("elem_id"))


@query("text_match")
def text_match(spark, sf):
    """Hints of the labelled boxes as detected texts, captions as the true ones."""
    shown = captions(spark, sf)
    detected = shown.select("state_id", "elem_id", F.regexp_replace("text", "i", "1").alias("text"))
    return benchmark.match_texts(detected, shown).withColumn("similarity", F.round("similarity", 6))


@query(
    "wait_until_gone",
    """SELECT user_id, CASE WHEN hit IS NULL THEN 'timeout' ELSE 'gone' END AS outcome, epoch_us(coalesce(hit, deadline)) AS at_us FROM (
      SELECT user_id, min(deadline) AS deadline, min(CASE WHEN event_type <> 'view' AND ts <= deadline THEN ts END) AS hit FROM (
        SELECT *, min(ts) OVER (PARTITION BY user_id) + INTERVAL 12 HOUR AS deadline FROM events) GROUP BY user_id)""",
)
def wait_until_gone(spark, sf):
    done = wait.first_gone(table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "view", 12 * 3600)
    return done.select("user_id", "outcome", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"))


@query(
    "wait_and_click",
    """SELECT user_id, epoch_us(ts) AS at_us, event_id AS x FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (
      SELECT *, min(ts) OVER (PARTITION BY user_id) + INTERVAL 12 HOUR AS deadline FROM events) WHERE event_type = 'purchase' AND ts <= deadline) WHERE n = 1""",
)
def wait_and_click(spark, sf):
    clicks = wait.wait_and_click(table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "purchase", F.col("event_id"), F.lit(0), 12 * 3600)
    return clicks.select("user_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "x")


# --- steps against screens -----------------------------------------------------------------


def _asked(spark, sf):
    """For every caption that is alone on its screen: a click on it by name and kind, every third
    with a target elsewhere; a check by name; a check for what no screen has; and one for a word
    that all hints have, which is only found where a screen has a single element."""
    steps_ = _steps(spark, sf)
    key = F.concat_ws("/", F.col("state_id").cast("string"), F.col("elem_id").cast("string"))
    own = F.concat_ws(" ", "text", F.regexp_replace("visual_type", "_", " "))
    asked = [("click", "action", "PASSED", own), ("own", "verify", "PASSED", F.col("text")), ("no", "verify", "FAILED", F.lit("purple elephant")), ("tie", "verify", "FAILED", F.lit("brand"))]
    said = F.explode(F.array(*[F.struct(F.concat(key, F.lit(f"/{n}")).alias("step"), F.lit(k).alias("kind"), F.lit(e).alias("expect"), d.alias("description")) for n, k, e, d in asked]))
    away = F.when(F.col("elem_id") % 3 == 0, 1000).otherwise(0)
    box = [(F.col(c) + away).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")]
    return steps_.select(said.alias("a"), "state_id", *box).select("a.step", "state_id", "a.kind", "a.expect", "a.description", *[f"t{c}" for c in ("x1", "y1", "x2", "y2")])


def _away(c: str) -> str:
    return f"{c} + CASE WHEN elem_id % 3 = 0 THEN 1000 ELSE 0 END AS t{c}"


_KINDS = "CASE visual_type WHEN 'button' THEN ' button pushbutton ' WHEN 'text' THEN ' text statictext label ' ELSE ' inputfield textfield edittext ' END"
_DONE = f"""{_APPS}, own AS (SELECT *, CAST(state_id AS VARCHAR) || '/' || CAST(elem_id AS VARCHAR) AS key, regexp_extract_all(lower(text), '[a-z0-9]+') AS name, {_away('x1')}, {_away('y1')}, {_away('x2')}, {_away('y2')} FROM uniq),
  asked AS (SELECT key || '/click' AS step, state_id, 'action' AS kind, 'PASSED' AS expect, name, {_KINDS} AS kinds, tx1, ty1, tx2, ty2 FROM own
    UNION ALL SELECT key || '/own', state_id, 'verify', 'PASSED', name, '', tx1, ty1, tx2, ty2 FROM own UNION ALL SELECT key || '/no', state_id, 'verify', 'FAILED', ['purple','elephant'], '', tx1, ty1, tx2, ty2 FROM own
    UNION ALL SELECT key || '/tie', state_id, 'verify', 'FAILED', ['brand'], '', tx1, ty1, tx2, ty2 FROM own),
  toks AS (SELECT state_id, elem_id, visual_type, x1, y1, x2, y2, regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9]+') AS tt, regexp_extract_all(lower(coalesce(hint,'')), '[a-z0-9]+') AS ht FROM captions),
  met AS (SELECT a.*, c.elem_id, c.x1, c.y1, c.x2, c.y2, c.tt, c.ht, replace(c.visual_type, '_', '') AS shape, list_concat(c.tt, c.ht) AS have FROM asked a JOIN toks c ON c.state_id = a.state_id),
  shared AS (SELECT *, 2.0*(len(list_filter(name, lambda t: list_contains(have, t))) + 0.7*len(list_filter(name, lambda t: NOT list_contains(have, t) AND len(list_filter(have, lambda e: contains(e, t))) > 0)))/len(name) + CASE WHEN tt = name OR ht = name THEN 0.5 ELSE 0 END AS ns, CASE WHEN contains(kinds, ' ' || shape || ' ') THEN 1.0 ELSE 0 END AS ks FROM met),
  scored AS (SELECT *, ns + CASE WHEN ns = 0 THEN least(0.5*ks, 1.0) ELSE ks END AS score FROM shared),
  places AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM scored WHERE score > 0 WINDOW w AS (PARTITION BY step ORDER BY score DESC, elem_id)),
  sure AS (SELECT * FROM places WHERE place = 1 AND score >= 1.5 AND (second IS NULL OR score - second >= 0.5)),
  found AS (SELECT a.step, a.kind, a.expect, s.elem_id, s.elem_id IS NOT NULL AND floor((s.x1+s.x2)/2.0) BETWEEN a.tx1 AND a.tx2 AND floor((s.y1+s.y2)/2.0) BETWEEN a.ty1 AND a.ty2 AS hit FROM asked a LEFT JOIN sure s ON s.step = a.step {{strict}})
  SELECT step, elem_id, hit, CASE WHEN kind = 'action' THEN hit ELSE (CASE WHEN elem_id IS NULL THEN 'FAILED' ELSE 'PASSED' END) = expect END AS passed FROM found"""


@query("described_steps", over(_DONE.format(strict=""), "captions"))
def described_steps(spark, sf):
    done = steps.described(_asked(spark, sf), captions(spark, sf), width=F.lit(400), height=F.lit(200))
    return done.select("step", "elem_id", "hit", "passed")


@query("exact_steps", over(_DONE.format(strict="AND (s.tt = s.name OR s.ht = s.name)"), "captions"))
def exact_steps(spark, sf):
    """The same, where only an element that reads exactly what is said counts."""
    done = steps.described(_asked(spark, sf), captions(spark, sf), width=F.lit(400), height=F.lit(200), strict=True)
    return done.select("step", "elem_id", "hit", "passed")


@query("paraphrased_steps", "SELECT event_id AS step, 'to ' || event_type AS description FROM events")
def paraphrased_steps(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("description"))
    mapping = rows.select("description").distinct().withColumn("paraphrase", F.concat(F.lit("to "), "description"))
    return steps.paraphrased(rows, mapping).select("step", "description")


@query("first_state_steps", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events WHERE event_type IN ('click', 'view') ORDER BY user_id LIMIT 3) AND event_type IN ('click', 'view')")
def first_state_steps(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("kind"))
    return steps.of_first_states(rows, 3, ["click", "view"], "user_id").select("event_id", "user_id")


@query("default_executors", "SELECT DISTINCT executor FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'screens-' || event_type WHEN 1 THEN 'screens+desc[lexical,slm]' || CASE WHEN event_id % 2 = 0 THEN '[verify=keyword]' ELSE '' END ELSE 'screens+desc[slm]' END AS executor FROM events) WHERE executor NOT LIKE '%[verify=%' AND (executor NOT LIKE '%+desc[%' OR executor LIKE '%+desc[lexical%')")
def default_executors(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id") % 3
    name = F.when(k == 0, F.concat(F.lit("screens-"), "event_type")).when(k == 1, F.concat(F.lit("screens+desc[lexical,slm]"), F.when(F.col("event_id") % 2 == 0, "[verify=keyword]").otherwise(""))).otherwise("screens+desc[slm]")
    return steps.default_rows(e.select(name.alias("executor")).distinct(), "screens")


@query(
    "refreshed_reads",
    over(
        """, n AS (SELECT g.state_id, g.elem_id, g.x1, g.y1, g.x2, g.y2, c.text FROM gt g JOIN captions c ON c.state_id = g.state_id AND c.elem_id = g.elem_id),
      q AS (SELECT c.*, CASE elem_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'element' ELSE 'screen' END AS refresh FROM captions c),
      r AS (SELECT q.state_id, q.elem_id, q.refresh, q.x1 AS ox1, n.x1 AS nx1, q.text AS ot, n.text AS nt, n.elem_id AS nid, CASE WHEN refresh = 'none' THEN 'old' WHEN refresh = 'element' AND n.elem_id IS NOT NULL AND q.x1 = n.x1 AND q.y1 = n.y1 AND q.x2 = n.x2 AND q.y2 = n.y2 AND coalesce(n.text, '') <> '' THEN 'region' ELSE 'screen' END AS source FROM q LEFT JOIN n ON n.state_id = q.state_id AND n.elem_id = q.elem_id)
      SELECT state_id, elem_id, CASE WHEN source = 'old' THEN ot ELSE nt END AS text, CASE WHEN source = 'old' THEN ox1 ELSE nx1 END AS x1, source FROM r WHERE source = 'old' OR nid IS NOT NULL""",
        "gt", "captions",
    ),
)
def refreshed_reads(spark, sf):
    old = captions(spark, sf)
    new = truth(spark, sf).select("state_id", "elem_id", "x1", "y1", "x2", "y2").join(old.select("state_id", "elem_id", "text"), ["state_id", "elem_id"])
    mode = F.when(F.col("elem_id") % 3 == 0, "none").when(F.col("elem_id") % 3 == 1, "element").otherwise("screen")
    return steps.refreshed(old, new, old.select("state_id", "elem_id", mode.alias("refresh"))).select("state_id", "elem_id", "text", "x1", "source")


@query("symbol_candidates", over("SELECT state_id, elem_id, y1 >= 0.08 * 200 AS named FROM captions WHERE text IS NULL AND (x2-x1)*(y2-y1) BETWEEN 200 AND 40000", "captions"))
def symbol_candidates(spark, sf):
    return steps.symbol_candidates(captions(spark, sf), 200).select("state_id", "elem_id", "named")


@query("converted_elements", over("SELECT state_id, elem_id, 'E' || CAST(row_number() OVER (PARTITION BY state_id ORDER BY elem_id) AS VARCHAR) AS elem_key, 'text' AS visual_type, 'reader' AS source FROM captions WHERE text IS NOT NULL", "captions"))
def converted_elements(spark, sf):
    made = steps.converted(captions(spark, sf).where("text is not null"), "reader", F.lit("text"), F.col("text"))
    return made.select("state_id", "elem_id", "elem_key", "visual_type", "source")


@query("printed_names", over("SELECT state_id, elem_id FROM captions WHERE text IS NOT NULL AND elem_id % 3 <> 2", "captions"))
def printed_names(spark, sf):
    """Readings that hold the name, or are one letter off; every third reads something else."""
    k, name = F.col("elem_id") % 3, F.col("text")
    reading = F.when(k == 0, F.concat(F.lit("?? | "), F.upper(name), F.lit("..."))).when(k == 1, F.concat(name, F.lit("z"))).otherwise("0000 | 1111")
    rows = captions(spark, sf).where("text is not null").withColumn("reading", reading)
    close = X.similarity(X.bare(name), X.bare(F.col("reading"))) >= 0.8
    return rows.where(specs.printed(name, F.col("reading"), close)).select("state_id", "elem_id")


@query("exact_names", over("SELECT a.state_id, a.elem_id, a.elem_id AS said_by FROM captions a WHERE len(regexp_extract_all(lower(coalesce(a.text, '')), '[a-z0-9]+')) > 0 UNION ALL SELECT b.state_id, b.elem_id, a.elem_id FROM captions a JOIN captions b ON b.state_id = a.state_id AND b.elem_id = a.elem_id + 1 WHERE len(regexp_extract_all(lower(coalesce(a.text, '')), '[a-z0-9]+')) > 0 AND regexp_extract_all(lower(coalesce(b.text, '')), '[a-z0-9]+') = regexp_extract_all(lower(a.text), '[a-z0-9]+')", "captions"))
def exact_names(spark, sf):
    """Elements that read exactly what the caption of one of them says: of the element itself
    and the next one of the screen."""
    df = captions(spark, sf)
    asked = df.select("state_id", F.col("elem_id").alias("said_by"), F.col("text").alias("said")).withColumn("elem_id", F.explode(F.array("said_by", F.col("said_by") + 1)))
    both = asked.join(df.select("state_id", "elem_id", "label", "text", "hint"), ["state_id", "elem_id"])
    return both.where(locator.exact_name(locator.describe(F.col("said")), F.col("label"), F.col("text"), F.col("hint"))).select("state_id", "elem_id", "said_by")

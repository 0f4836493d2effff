"""Queries of descriptions that go through tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade
from .metric_queries import _APPS, _steps
from .registry import over, query
from .views import captions


def _asked(spark, sf):
    """For every caption that is alone on its screen: what it reads; the same misspelt, alone,
    with a number and with a place; and what no screen has."""
    wrong = F.concat(F.lit("q"), F.substring("text", 2, 1000))
    said = [("own", F.col("text")), ("wrong", wrong), ("number", F.concat(wrong, F.lit(" 7"))), ("place", F.concat(wrong, F.lit(" at the left"))), ("none", F.lit("purple elephant"))]
    key = F.concat_ws("/", F.col("state_id").cast("string"), F.col("elem_id").cast("string"))
    each = F.explode(F.array(*[F.struct(F.concat(key, F.lit(f"/{n}")).alias("step"), d.alias("description")) for n, d in said]))
    return _steps(spark, sf).select(each.alias("a"), "state_id").select("a.step", "state_id", "a.description")


def _resolved(spark, sf):
    width, height = F.lit(400), F.lit(200)
    return cascade.resolve(_asked(spark, sf), captions(spark, sf), [cascade.lexical(width=width, height=height), cascade.spelling()], width=width, height=height)


_TIERS = f"""{_APPS}, own AS (SELECT state_id, CAST(state_id AS VARCHAR) || '/' || CAST(elem_id AS VARCHAR) AS key, regexp_extract_all(lower(text), '[a-z0-9]+') AS right_, regexp_extract_all('q' || lower(substring(text, 2)), '[a-z0-9]+') AS wrong FROM uniq),
  asked AS (SELECT key || '/own' AS step, state_id, right_ AS name, right_ AS named, false AS numbered, false AS lefts FROM own UNION ALL SELECT key || '/wrong', state_id, wrong, wrong, false, false FROM own
    UNION ALL SELECT key || '/number', state_id, list_append(wrong, '7'), list_append(wrong, '7'), true, false FROM own UNION ALL SELECT key || '/place', state_id, list_concat(wrong, ['at', 'the']), wrong, false, true FROM own
    UNION ALL SELECT key || '/none', state_id, ['purple', 'elephant'], ['purple', 'elephant'], false, false FROM own),
  toks AS (SELECT state_id, elem_id, text, hint, regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9]+') AS tt, regexp_extract_all(lower(coalesce(hint,'')), '[a-z0-9]+') AS ht, (x1+x2)/2.0/400 < 0.34 AS is_left FROM captions),
  met AS (SELECT a.*, c.elem_id, c.tt, c.ht, c.is_left, list_concat(c.tt, c.ht) AS have, c.text, c.hint, bool_or(c.is_left) OVER (PARTITION BY step) AS any_left FROM asked a JOIN toks c ON c.state_id = a.state_id),
  shared AS (SELECT *, 2.0*((len(list_filter(name, lambda t: list_contains(have, t))) + 0.7*len(list_filter(name, lambda t: NOT list_contains(have, t) AND NOT regexp_matches(t, '^[0-9]+$') AND len(list_filter(have, lambda e: contains(e, t))) > 0)))/len(name)) + CASE WHEN tt = name OR ht = name THEN 0.5 ELSE 0 END AS ns, CASE WHEN lefts AND is_left THEN 0.5 ELSE 0 END AS ks FROM met),
  scored AS (SELECT *, ns + CASE WHEN ns = 0 THEN least(0.5*ks, 1.0) ELSE ks END AS score FROM shared),
  places AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second, max(score) OVER (PARTITION BY step) AS top FROM scored WHERE score > 0 WINDOW w AS (PARTITION BY step ORDER BY score DESC, elem_id)),
  words AS (SELECT step, max(top) AS top, max(CASE WHEN place = 1 AND score >= 1.5 AND (second IS NULL OR score - second >= 0.5 - 1e-9) THEN elem_id END) AS sure, sum(CASE WHEN top - score < 0.5 - 1e-9 THEN 1 ELSE 0 END) AS tied FROM places GROUP BY step),
  one AS (SELECT a.*, w.sure, CASE WHEN w.sure IS NOT NULL THEN printf('score %.2f', w.top) WHEN w.top IS NULL THEN 'no element shares a token or a kind' WHEN w.top < 1.5 THEN printf('best score %.2f < 1.5', w.top) ELSE printf('tie at %.2f between %d candidates', w.top, CAST(w.tied AS BIGINT)) END AS said FROM asked a LEFT JOIN words w ON w.step = a.step),
  near AS (SELECT m.step, m.elem_id, min(least(CASE WHEN m.text IS NULL THEN 1000 ELSE levenshtein(lower(m.text), array_to_string(m.named, ' ')) END, CASE WHEN m.hint IS NULL THEN 1000 ELSE levenshtein(lower(m.hint), array_to_string(m.named, ' ')) END)) AS edits, any_value(length(array_to_string(m.named, ' '))) AS size, any_value(m.is_left) AS is_left, any_value(m.any_left) AS any_left, any_value(m.have) AS have
    FROM met m JOIN one o ON o.step = m.step WHERE o.sure IS NULL GROUP BY m.step, m.elem_id),
  fits AS (SELECT *, min(edits) OVER (PARTITION BY step) AS least_ FROM near WHERE edits * 4 <= size),
  best AS (SELECT step, any_value(least_) AS edits, count(*) AS n, min(elem_id) AS elem_id, bool_or(is_left) AS is_left, any_value(any_left) AS any_left, any_value(have) AS have FROM fits WHERE edits = least_ GROUP BY step),
  two AS (SELECT o.*, b.elem_id AS got, b.n, CASE WHEN b.n = 1 AND o.lefts AND b.any_left AND NOT b.is_left THEN 'outside the described position' WHEN b.n = 1 AND o.numbered AND NOT list_contains(b.have, '7') THEN 'without a number that is named' END AS verdict,
    CASE WHEN b.n IS NULL THEN 'no caption is near' WHEN b.n = 1 THEN printf('%d edits', b.edits) ELSE printf('%d captions at %d edits', b.n, b.edits) END AS spelt FROM one o LEFT JOIN best b ON b.step = o.step),
  done AS (SELECT step, state_id, CASE WHEN sure IS NOT NULL THEN sure WHEN n = 1 AND verdict IS NULL THEN got END AS elem_id, CASE WHEN sure IS NOT NULL THEN 'lexical' WHEN n = 1 AND verdict IS NULL THEN 'spelling' END AS tier,
    CASE WHEN sure IS NOT NULL THEN 'lexical: ' || said WHEN n = 1 AND verdict IS NULL THEN 'spelling: ' || spelt ELSE 'no confident match (lexical: ' || said || '; spelling: ' || CASE WHEN verdict IS NOT NULL THEN 'picked ' || CAST(got AS VARCHAR) || ' ' || verdict ELSE spelt END || ')' END AS reason,
    CASE WHEN sure IS NOT NULL THEN 0.0 ELSE 1.0 END AS cost FROM two)"""


@query("tiered_resolve", over(f"{_TIERS} SELECT step, state_id, elem_id, tier, reason, cost FROM done", "captions"))
def tiered_resolve(spark, sf):
    return _resolved(spark, sf)


@query("tier_counts", over(f"{_TIERS} SELECT coalesce(tier, 'none') AS tier, count(*) AS n, sum(cost) AS cost FROM done GROUP BY coalesce(tier, 'none')", "captions"))
def tier_counts(spark, sf):
    return cascade.by_tier(_resolved(spark, sf))

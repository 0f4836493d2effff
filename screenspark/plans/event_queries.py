"""Queries over events: waiting, staleness and sessions, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import stateful, wait
from .registry import query
from .views import table


@query(
    "wait_until_first",
    """SELECT user_id, CASE WHEN hit IS NULL THEN 'timeout' ELSE 'found' END AS outcome, epoch_us(coalesce(hit, deadline)) AS at_us FROM (
      SELECT user_id, min(deadline) AS deadline, min(CASE WHEN event_type = 'purchase' AND ts <= deadline THEN ts END) AS hit FROM (
        SELECT *, min(ts) OVER (PARTITION BY user_id) + INTERVAL 12 HOUR AS deadline FROM events) GROUP BY user_id)""",
)
def wait_until_first(spark, sf):
    done = wait.first_match(table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "purchase", 12 * 3600)
    return done.select("user_id", "outcome", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"))


@query(
    "stale_reads",
    """SELECT event_id, user_id FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'signup' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM events)
      WHERE event_type = 'view' AND s = 1""",
)
def stale_reads(spark, sf):
    kind = F.col("event_type")
    return wait.stale_reads(table(spark, sf, "events"), "user_id", "ts", kind == "click", kind == "view", kind == "signup").where("stale").select("event_id", "user_id")


@query(
    "session_counts",
    """SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
)
def session_counts(spark, sf):
    return wait.sessions(table(spark, sf, "events"), "user_id", "ts").select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")


_KIND = "CASE event_type WHEN 'click' THEN 'change' WHEN 'purchase' THEN 'move' WHEN 'view' THEN 'none' WHEN 'signup' THEN 'element' ELSE 'screen' END"
_READS = f"""WITH e AS (SELECT *, CAST(user_id AS VARCHAR) AS key, {_KIND} AS kind FROM events),
  a AS (SELECT *, last_value(CASE WHEN kind IN ('change', 'move') THEN value END IGNORE NULLS) OVER w AS now, last_value(CASE WHEN kind = 'move' THEN 0 WHEN kind IN ('element', 'screen') THEN 1 END IGNORE NULLS) OVER w AS still FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  b AS (SELECT *, CASE WHEN kind = 'none' THEN 'read' WHEN kind = 'element' AND still = 1 THEN 'element' WHEN kind IN ('element', 'screen') THEN 'screen' END AS source FROM a),
  c AS (SELECT *, last_value(CASE WHEN source = 'screen' THEN {{v: now}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS read FROM b)
  SELECT key, event_id AS id, source, CASE WHEN source = 'read' THEN read.v ELSE now END AS value FROM c WHERE source IS NOT NULL"""


def _kind():
    kinds = {"click": "change", "purchase": "move", "view": "none", "signup": "element"}
    return F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in kinds.items()], F.lit("screen"))


@query("guarded_reads", _READS)
def guarded_reads(spark, sf):
    return stateful.guarded_reads(table(spark, sf, "events"), "user_id", "ts", "event_id", _kind(), F.col("value"))


#: What a stream has decided when it has read all events: all that lies before the watermark.
_PASSED = "(SELECT max(ts) - INTERVAL 10 SECOND FROM events)"


@query("stream_guarded_reads", f"{_READS} AND ts <= {_PASSED}")
def stream_guarded_reads(spark, sf):
    """The same as a stream, run over all events there are."""
    events = stateful.table_stream(spark, f"{sf}/events.parquet")
    return stateful.run_to_end(stateful.guarded_reads_stream(events, "user_id", "ts", "event_id", _kind(), F.col("value")), stateful.shared_folder(spark))


def _stream_waits(outcome: str, test: str, x: str = "CAST(NULL AS BIGINT)") -> str:
    return f"""SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN hit IS NULL THEN 'timeout' ELSE '{outcome}' END AS outcome, epoch_us(coalesce(hit, deadline)) AS at_us, CASE WHEN hit IS NOT NULL THEN {x} END AS x FROM (
      SELECT user_id, min(deadline) AS deadline, min(CASE WHEN {test} AND ts <= deadline THEN ts END) AS hit, arg_min(event_id, ts) FILTER (WHERE {test} AND ts <= deadline) AS found FROM (
        SELECT *, min(ts) OVER (PARTITION BY user_id) + INTERVAL 12 HOUR AS deadline FROM events) GROUP BY user_id) WHERE coalesce(hit, deadline) <= {_PASSED}"""


@query("stream_waits", _stream_waits("found", "event_type = 'purchase'", "found"))
def stream_waits(spark, sf):
    """Waits for a purchase, with the event that ends them."""
    events = stateful.table_stream(spark, f"{sf}/events.parquet")
    done = stateful.run_to_end(stateful.waits(events, "user_id", "ts", F.col("event_type") == "purchase", 12 * 3600, x=F.col("event_id")), stateful.shared_folder(spark))
    return done.select("key", "outcome", "at_us", "x")


@query("stream_waits_gone", _stream_waits("gone", "event_type <> 'view'", "0"))
def stream_waits_gone(spark, sf):
    events = stateful.table_stream(spark, f"{sf}/events.parquet")
    done = stateful.run_to_end(stateful.waits(events, "user_id", "ts", F.col("event_type") == "view", 12 * 3600, gone=True), stateful.shared_folder(spark))
    return done.select("key", "outcome", "at_us", "x")

"""Waiting for an element: polls of a screen as a stream, one decision for each locator.

``first_match`` is the batch form: the first event of a key that fits within the timeout of
its first event.  ``wait_until`` is the same over a stream, with a state of one deadline a
key and an event-time timer; keys whose deadline passes without a match end as timeouts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def first_match(events: DataFrame, key: str, ts: str, fits: Column, timeout_seconds: float) -> DataFrame:
    """(key, outcome, at): 'found' at the first fitting event within the timeout, else
    'timeout' at the deadline."""
    start = F.min(ts).over(Window.partitionBy(key))
    deadline = start + F.make_dt_interval(secs=F.lit(float(timeout_seconds)))
    timed = events.select(key, F.col(ts).alias("ts"), fits.alias("fits"), deadline.alias("deadline"))
    hit = F.min(F.when(F.col("fits") & (F.col("ts") <= F.col("deadline")), F.col("ts")))
    done = timed.groupBy(key).agg(hit.alias("hit"), F.first("deadline").alias("deadline"))
    return done.select(key, F.when(F.col("hit").isNotNull(), "found").otherwise("timeout").alias("outcome"), F.coalesce("hit", "deadline").alias("at"))


def first_gone(events: DataFrame, key: str, ts: str, fits: Column, timeout_seconds: float) -> DataFrame:
    """(key, outcome, at): 'gone' at the first poll within the timeout at which the element is
    not there, else 'timeout' at the deadline.  A poll without an answer (NULL) tells nothing."""
    done = first_match(events, key, ts, F.coalesce(~fits, F.lit(False)), timeout_seconds)
    return done.withColumn("outcome", F.when(F.col("outcome") == "found", "gone").otherwise(F.col("outcome")))


def wait_and_click(events: DataFrame, key: str, ts: str, fits: Column, x: Column, y: Column, timeout_seconds: float) -> DataFrame:
    """(key, at, x, y): a click at the first fitting poll within the timeout, where the element
    was then; keys that time out have none."""
    found = first_match(events, key, ts, fits, timeout_seconds).where("outcome = 'found'").select(key, "at")
    rows = events.where(fits).select(key, F.col(ts).alias("at"), x.alias("x"), y.alias("y"))
    return rows.join(found, [key, "at"]).groupBy(key, "at").agg(F.min(F.struct("x", "y")).alias("p")).select(key, "at", "p.x", "p.y")


def wait_until(events: DataFrame, key: str, ts: str, fits: Column, timeout_seconds: float, delay: str = "10 seconds", keep_seconds: float = 86_400) -> DataFrame:
    """Stream of (key, outcome, at); events later than the watermark's delay are dropped.  A key
    is decided once: what comes after the decision is ignored until ``keep_seconds`` after the
    deadline, when the key is forgotten and a further event opens a new wait."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), fits.alias("fits")).withWatermark("ts", delay)
    limit_ms, keep_ms = int(timeout_seconds * 1000), int(keep_seconds * 1000)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = lambda what, ms: pd.DataFrame({"key": [group[0]], "outcome": [what], "at": [pd.Timestamp(ms, unit="ms", tz="UTC").tz_localize(None)]})
        deadline, done = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            if done:
                state.remove()
                return
            yield out("timeout", deadline)
            done = True
        else:
            seen = pd.concat(list(frames))
            ms = seen["ts"].astype("datetime64[ms]").astype("int64")
            if deadline is None:
                deadline = int(ms.min()) + limit_ms
            good = ms[seen["fits"] & (ms <= deadline)]
            if not done and len(good):
                done = True
                yield out("found", int(good.min()))
        state.update((deadline, done))
        # A timer must lie after the watermark.
        state.setTimeoutTimestamp(max(deadline + (keep_ms if done else 0), state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("key").applyInPandasWithState(step, "key string, outcome string, at timestamp", "deadline long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stale_reads(events: DataFrame, key: str, ts: str, writes: Column, reads: Column, refreshes: Column) -> DataFrame:
    """Adds ``stale``: a read after a write with no refresh between."""
    w = Window.partitionBy(key).orderBy(ts, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(writes, F.lit(True)).when(refreshes, F.lit(False)), ignorenulls=True).over(w)
    return events.withColumn("stale", reads & F.coalesce(last, F.lit(False)))


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Counts of each key's sessions, split at gaps; runs on streams with a watermark, too."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

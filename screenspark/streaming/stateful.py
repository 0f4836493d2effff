"""Waits and guarded reads as streams whose results are those of the batch form.

Rows of a key may come in any order within the watermark's delay, so nothing is decided before
the watermark has passed it: a wait when no earlier answer can come, a read when all that
happened before it has.  What a key needs until then is its state, timers run in event time,
and what has been decided is forgotten after a while.  Rows behind the watermark are dropped.
Streams start again from their checkpoint with the state that they had.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators.lineage import use_checkpoint_dir

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(us: int) -> int:
    """The first millisecond at which a time in microseconds has passed."""
    return -(-us // 1000)


class Wait(StatefulProcessor):
    """Decides each key once: at its first fitting row within ``limit`` of its first row, or at
    that deadline.  State: the first row, the first fitting one, and the timer that is set; after
    the decision the deadline alone, for ``keep`` longer."""

    def __init__(self, limit: int, keep: int, outcome: str):
        self.limit, self.keep, self.outcome = limit, keep, outcome

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "us long")
        self.best = handle.getValueState("best", "us long, x long, y long")
        self.timer = handle.getValueState("timer", "ms long")
        self.done = handle.getValueState("done", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            return
        first = self.first.get()[0] if self.first.exists() else None
        best = tuple(self.best.get()) if self.best.exists() else None
        for frame in rows:
            low = int(frame["us"].min())
            first = low if first is None else min(first, low)
            good = frame[frame["fits"]]
            if len(good):
                found = min(zip(good["us"].astype(int), good["x"].astype(int), good["y"].astype(int), strict=True))
                best = found if best is None else min(best, found)
        self.first.update((first,))
        if best is not None:
            self.best.update(tuple(map(int, best)))
        self._wake(min(first + self.limit, best[0] if best else first + self.limit))
        yield from ()

    def _wake(self, us: int) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(_ms(us))
        self.timer.update((_ms(us),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for state in (self.first, self.best, self.timer, self.done):
                state.clear()
            return
        deadline = self.first.get()[0] + self.limit
        best = tuple(self.best.get()) if self.best.exists() else None
        hit = best is not None and best[0] <= deadline
        self.done.update((deadline,))
        self.timer.clear()
        self._wake(deadline + self.keep)
        yield pd.DataFrame({"key": [key[0]], "outcome": [self.outcome if hit else "timeout"], "at_us": [best[0] if hit else deadline], "x": [best[1] if hit else None], "y": [best[2] if hit else None]})

    def close(self) -> None:
        pass


class GuardedReads(StatefulProcessor):
    """Answers reads of an element from the screen as it was last read, or as it is.  State: the
    rows that the watermark has not passed, the value as it is now, the value as last read, and
    whether the screen has moved since an answer last looked at it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, id long, kind string, value double")
        self.now = handle.getValueState("now", "value double")
        self.read = handle.getValueState("read", "value double")
        self.still = handle.getValueState("still", "yes boolean")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for frame in rows:
            new += [(int(u), int(i), k, None if pd.isna(v) else float(v)) for u, i, k, v in zip(frame["us"], frame["id"], frame["kind"], frame["value"], strict=True)]
        self.pending.appendList(new)
        self._wake(min(r[0] for r in new))
        yield from ()

    def _wake(self, us: int) -> None:
        if self.timer.exists():
            if self.timer.get()[0] <= _ms(us):
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(_ms(us))
        self.timer.update((_ms(us),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.pending.get())
        ripe = [r for r in rows if _ms(r[0]) <= passed]
        rest = rows[len(ripe) :]
        self.timer.clear()
        if rest:
            self.pending.put(rest)
            self._wake(rest[0][0])
        else:
            self.pending.clear()
        now, read = (s.get()[0] if s.exists() else None for s in (self.now, self.read))
        still = self.still.exists() and self.still.get()[0]
        out = []
        for _, i, kind, value in ripe:
            if kind in ("change", "move"):
                now, still = value, still and kind == "change"
                continue
            source = "read" if kind == "none" else "element" if kind == "element" and still else "screen"
            if source == "screen":
                read = now
            if kind != "none":
                still = True
            out.append((key[0], i, source, read if source == "read" else now))
        for state, held in ((self.now, now), (self.read, read)):
            state.update((held,))
        self.still.update((still,))
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "source", "value"])

    def close(self) -> None:
        pass


def waits(events: DataFrame, key: str, ts: str, fits: Column, limit_seconds: float, delay: str = "10 seconds", keep_seconds: float = 86_400, gone: bool = False, x: Column | None = None, y: Column | None = None) -> DataFrame:
    """Stream of (key, outcome, at_us, x, y): each key once, as ``first_match`` decides it; with
    ``gone`` as ``first_gone``.  x and y are those of the row found, the least of equal times.
    Rows with a null key or time are no polls."""
    fit = F.coalesce(~fits if gone else fits, F.lit(False))
    at = F.col(ts).cast("timestamp")
    rows = events.select(F.col(key).cast("string").alias("key"), at.alias("ts"), F.unix_micros(at).alias("us"), fit.alias("fits"), *[(F.lit(0) if c is None else c).cast("long").alias(n) for n, c in (("x", x), ("y", y))])
    known = rows.where("key is not null and ts is not null").withWatermark("ts", delay)
    step = Wait(int(limit_seconds * 1_000_000), int(keep_seconds * 1_000_000), "gone" if gone else "found")
    return known.groupBy("key").transformWithStateInPandas(step, "key string, outcome string, at_us long, x long, y long", "append", "eventtime")


def guarded_reads_stream(events: DataFrame, key: str, ts: str, name: str, kind: Column, value: Column, delay: str = "10 seconds") -> DataFrame:
    """Stream of (key, id, source, value), a row for each read, as ``guarded_reads`` gives it."""
    at = F.col(ts).cast("timestamp")
    rows = events.select(F.col(key).cast("string").alias("key"), at.alias("ts"), F.unix_micros(at).alias("us"), F.col(name).cast("long").alias("id"), kind.alias("kind"), value.cast("double").alias("value"))
    known = rows.where("key is not null and ts is not null and kind is not null").withWatermark("ts", delay)
    return known.groupBy("key").transformWithStateInPandas(GuardedReads(), "key string, id long, source string, value double", "append", "eventtime")


def guarded_reads(events: DataFrame, key: str, ts: str, name: str, kind: Column, value: Column) -> DataFrame:
    """(key, id, source, value) of all reads.  Rows are a ``change`` of the value, a change that
    may ``move`` the element, or a read: ``none`` takes the value as last read off the screen
    (source read), ``element`` looks at the element where it was (element), if nothing has moved
    since one last looked, else at the whole ``screen``, as the reads of that name always do.  A
    look at the screen is what later reads without one go by."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(name).cast("long").alias("id"), kind.alias("kind"), value.cast("double").alias("value")).where("key is not null and ts is not null and kind is not null")
    before = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    change = F.col("kind").isin("change", "move")
    # A NULL written is a value, so what is carried on is a struct.
    now = F.last(F.when(change, F.struct("value")), ignorenulls=True).over(before)
    still = F.last(F.when(F.col("kind") == "move", F.lit(False)).when(F.col("kind").isin("element", "screen"), F.lit(True)), ignorenulls=True).over(before)
    source = F.when(F.col("kind") == "none", "read").when((F.col("kind") == "element") & F.coalesce(still, F.lit(False)), "element").when(~change, "screen")
    looked = rows.withColumns({"now": now["value"], "source": source})
    read = F.last(F.when(F.col("source") == "screen", F.struct("now")), ignorenulls=True).over(before)
    told = looked.withColumn("read", read["now"]).where(~change)
    return told.select("key", "id", "source", F.when(F.col("source") == "read", F.col("read")).otherwise(F.col("now")).alias("value"))


@contextlib.contextmanager
def _rocks(spark: SparkSession):
    """State of several parts needs this store; the session's own setting comes back."""
    old = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, old)


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what its source has now; the rows that it and earlier runs with that
    folder have put out.  The folder must be one that all executors share."""
    spark = stream.sparkSession
    with _rocks(spark):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one for checkpoints."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream, be it a file or a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")

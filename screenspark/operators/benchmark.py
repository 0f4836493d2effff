"""Benchmark sets: splits, seeded draws, counters of results, and lists of ids for a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import selection
from .lineage import checkpoint


def draw(seed: int, *columns: str) -> Column:
    """A reproducible lot for a row, the same in every engine: the hash of the seed and the
    columns as text."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def split(df: DataFrame, seed: int, key: str, shares: dict[str, float]) -> DataFrame:
    """Adds ``part``: each key falls into a part by its lot, so a row stays where it is when
    others come or go; the shares hold on average."""
    lot = F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    names = list(shares)
    part, upto = F.lit(names[-1]), 1.0
    for before, name in zip(reversed(names[:-1]), reversed(names[1:]), strict=True):
        upto -= shares[name]
        part = F.when(lot < round(upto, 9), F.lit(before)).otherwise(part)
    return df.withColumn("part", part)


def permuted(df: DataFrame, seed: int, key: str, by: list[str]) -> DataFrame:
    """Adds ``place`` from 1: a seeded order within each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(draw(seed, key), key)))


def negatives(steps: DataFrame, seed: int, k: int = 2, app: str = "app", on: str = "state_id") -> DataFrame:
    """(on, caption): up to ``k`` captions of the application that a screen doesn't show, none
    of which has, or is a part of, one of its own; drawn by seed.

    Captions are tried in order of their lots, a few for each screen at a time, until a screen
    has ``k`` or the application has no more; so a screen meets few of the captions there are."""
    pool = steps.select(app, F.lower("text").alias("caption")).distinct()
    order = Window.partitionBy(app).orderBy(draw(seed, app, "caption"), "caption")
    ranked = checkpoint(pool.withColumn("rank", F.row_number().over(order)))
    own = steps.groupBy(app, on).agg(F.collect_set(F.lower("text")).alias("names"))
    need = checkpoint(own.join(ranked.groupBy(app).agg(F.max("rank").alias("size")), app).withColumn("need", F.lit(k)))
    absent = ~F.exists("names", lambda n: F.contains(n, F.col("caption")) | F.contains(F.col("caption"), n))
    found, done, step = [], 0, 4 * k
    while not need.isEmpty():
        lots = need.select(app, on, "names", "need", F.explode(F.sequence(F.lit(done + 1), F.least("size", F.lit(done + step)))).alias("rank"))
        tried = lots.join(ranked, [app, "rank"]).where(absent)
        got = tried.groupBy(app, on).agg(F.sort_array(F.collect_list(F.struct("rank", "caption"))).alias("got"), F.max("need").alias("_need"))
        got = checkpoint(got.select(app, on, F.expr("slice(got, 1, _need)").alias("got")))
        found.append(got.select(on, F.explode("got").alias("g")).select(on, "g.caption"))
        done, step = done + step, 2 * step
        left = need.join(got.select(app, on, F.size("got").alias("_got")), [app, on], "left").withColumn("need", F.col("need") - F.coalesce("_got", F.lit(0))).drop("_got")
        need = checkpoint(left.where((F.col("need") > 0) & (F.col("size") > done)))
    return reduce(DataFrame.unionByName, found) if found else steps.select(on, F.lower("text").alias("caption")).limit(0)


def counters(results: DataFrame, by: list[str]) -> DataFrame:
    """Of step results (kind, negative, hit, passed): clicks and hits, absent targets and those
    passed all the same, present targets and those passed."""
    act, neg = F.col("kind") == "action", F.col("negative")
    ver = F.col("kind") == "verify"
    n = F.count_if
    return results.groupBy(*by).agg(
        n(act).alias("clicks"), n(act & F.col("hit")).alias("hit"), n(ver & neg).alias("absent"), n(ver & neg & F.col("passed")).alias("false_pass"),
        n(ver & ~neg).alias("present"), n(ver & ~neg & F.col("passed")).alias("present_pass"),
    )


def costs(results: DataFrame, by: list[str], latency: str = "latency") -> DataFrame:
    """Number, sum and mean of the costs, and the upper median (the larger of the two middle
    ones)."""
    placed = results.where(F.col(latency).isNotNull())
    sums = placed.groupBy(*by).agg(F.sum(latency).alias("total"), F.avg(latency).alias("mean"))
    return with_same(selection.upper_median(placed, by, latency), sums, by).select(*by, "n", "total", "mean", "upper_median")


def with_same(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of both with equal keys, NULLs as well, once each key."""
    on = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in by], F.lit(True))
    return left.join(right, on).select(*[left[c] for c in left.columns], *[right[c] for c in right.columns if c not in by])


def wording_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Of step results (kind, expect, found, hit, latency) by wording: shares of clicks that hit,
    of checks that came out as expected, of all checks those that passed and shouldn't, of
    present targets those found where they are, with the numbers that they are shares of; the
    time in all and the upper median."""
    act, ver = F.col("kind") == "action", F.col("kind") == "verify"
    present = ver & (F.col("expect") == "PASSED")
    correct = F.when(F.col("found"), "PASSED").otherwise("FAILED") == F.col("expect")
    share = lambda test, base: F.round(F.try_divide(F.count_if(test & base).cast("double"), F.count_if(base)), 4)
    rates = results.groupBy(*by).agg(
        share(F.col("hit"), act).alias("action_hit_rate"), F.count_if(act).alias("actions"), share(correct, ver).alias("verify_accuracy"), F.count_if(ver).alias("verifies"),
        share(F.col("found") & (F.col("expect") == "FAILED"), ver).alias("false_pass_rate"), share(F.col("hit"), present).alias("strict_present"), F.count_if(present).alias("present"), F.round(F.sum("latency"), 1).alias("seconds_total"),
    )
    middle = selection.upper_median(results, by, "latency").select(*by, F.round("upper_median", 4).alias("median_latency"))
    return with_same(rates, middle, by)


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """Of the rows with one key that of the last version."""
    rest = [c for c in rows.columns if c not in (*key, version)]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*key, "r.*")


def match_texts(detected: DataFrame, truth: DataFrame, on: str = "state_id", least: float = 0.6) -> DataFrame:
    """(on, elem_id, gt_text, similarity): detected texts in order, each with the most similar
    true text of the screen that is free, if they are similar enough; of equally similar ones
    the first by name.  True texts count once each."""
    true = truth.where(X.present(F.trim("text")).isNotNull()).select(on, F.trim("text").alias("gt_text")).distinct()
    pairs = detected.where(X.present(F.col("text")).isNotNull()).select(on, "elem_id", "text").join(true, on)
    # Scored where they are: joined back to their distinct texts, pairs would be dealt by those.
    scored = pairs.withColumn("similarity", X.similarity(F.col("text"), F.col("gt_text"), least)).where(F.col("similarity") >= least)
    rows = F.sort_array(F.collect_list(F.struct("elem_id", (-F.col("similarity")).alias("far"), "gt_text")))
    clash = lambda k, c: (k["elem_id"] == c["elem_id"]) | (k["gt_text"] == c["gt_text"])
    keep = lambda kept, c: F.when(F.exists(kept, lambda k: clash(k, c)), kept).otherwise(F.array_append(kept, c))
    grouped = scored.groupBy(on).agg(rows.alias("_rows"))
    kept = grouped.select(on, F.explode(F.aggregate("_rows", F.filter("_rows", lambda r: F.lit(False)), keep)).alias("r"))
    return kept.select(on, "r.elem_id", "r.gt_text", (-F.col("r.far")).alias("similarity"))


def near_misses(steps: DataFrame) -> DataFrame:
    """(state_id, caption): captions of the application that a screen hasn't, but that end in
    the last word of one it has: an equi-join on that word.  A caption without a word misses
    nothing nearly."""
    caption = F.lower("text")
    own = steps.select("app", "state_id", caption.alias("caption"), F.element_at(X.tokens(F.col("text")), F.when(F.size(X.tokens(F.col("text"))) > 0, -1)).alias("last")).where("last is not null")
    pool = own.select("app", "last", "caption").distinct()
    close = own.select("app", "state_id", "last").distinct().join(pool, ["app", "last"]).select("state_id", "caption").distinct()
    return close.join(steps.select("state_id", caption.alias("caption")), ["state_id", "caption"], "left_anti")

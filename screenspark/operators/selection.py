"""Order statistics and first rows of groups of any size.

No task holds or sorts a group.  A value of a given rank is found in rounds: each counts the
values of a group by BUCKETS equal stretches of the range in question, and goes on with the
stretch that holds the rank, between its least and its greatest value, until those are one.
Counts are added up before the shuffle, so a round sends BUCKETS rows a group and task at most.
The first rows of a group are chosen by each task before the shuffle, too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import checkpoint

BUCKETS = 1024


def _same(by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by], F.lit(True))


def at_ranks(rows: DataFrame, by: list[str], value: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, a column for each of ``wanted``): the values at ranks from 0, told from a group's
    number of values.  Nulls and NaN are no values; a group without any has no row; a rank beyond
    the group is NULL.  Values are compared as doubles; null groups are groups."""
    names = list(wanted)
    own = checkpoint(rows.select(*by, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")))
    sizes = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), f(F.col("n")).cast("long").alias("rank")) for i, f in enumerate(wanted.values())]))
    state = checkpoint(sizes.withColumn("a", asked).select(*by, "n", "lo", "hi", "a.which", "a.rank", F.lit(0).cast("long").alias("below")).where("rank between 0 and n - 1"))
    done: list[DataFrame] = []
    while True:
        done.append(state.where("lo = hi"))
        left = state.where("lo < hi")
        if left.isEmpty():
            break
        met = own.alias("r").join(left.alias("s"), _same(by) & F.col("r.v").between(F.col("s.lo"), F.col("s.hi"))).select(*[f"s.{c}" for c in state.columns], "r.v")
        # Halves, since the range of doubles is wider than a double.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        counted = met.withColumn("bucket", bucket).groupBy(*by, "n", "which", "rank", "below", "bucket").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*by, "which").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        placed = counted.withColumn("below", F.col("below") + upto - F.col("c")).where("rank >= below and rank < below + c")
        state = checkpoint(placed.select(*state.columns))
    found = reduce(DataFrame.unionByName, done)
    picked = found.groupBy(*by).agg(*[F.max(F.when(F.col("which") == i, F.col("lo"))).alias(c) for i, c in enumerate(names)])
    return sizes.alias("r").join(picked.alias("s"), _same(by), "left").select(*[f"r.{c}" for c in by], "r.n", *[f"s.{c}" for c in names])


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, a column for each share): between the two nearest values in proportion."""
    wanted: dict[str, Callable[[Column], Column]] = {}
    for name, q in shares.items():
        wanted |= {f"_{name}_low": lambda n, q=q: F.floor(q * (n - 1)), f"_{name}_high": lambda n, q=q: F.ceil(q * (n - 1))}
    got = at_ranks(rows, by, value, wanted)
    part = lambda name, q: F.col(f"_{name}_low") + (q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1))) * (F.col(f"_{name}_high") - F.col(f"_{name}_low"))
    return got.select(*by, "n", *[part(name, q).alias(name) for name, q in shares.items()])


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, upper_median): the larger of the two middle values."""
    return at_ranks(rows, by, value, {"upper_median": lambda n: F.floor(n / 2)})


def first_rows(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of every group, with their ``place`` from 1: each task keeps so many of a
    group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def first_ids(rows: DataFrame, by: list[str], name: str, most: int = 8) -> DataFrame:
    """(by, n, ids): the least ids of every group as a text, and how many more there are."""
    shown = first_rows(rows.select(*by, name), by, [F.col(name)], most)
    listed = shown.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(name).cast("string").alias("id")))), lambda x: x["id"]), ", ").alias("ids"))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    both = counts.alias("r").join(listed.alias("s"), _same(by)).select(*[f"r.{c}" for c in by], "r.n", "s.ids")
    more = F.concat("ids", F.lit(" and "), (F.col("n") - most).cast("string"), F.lit(" more"))
    return both.withColumn("ids", F.when(F.col("n") > most, more).otherwise(F.col("ids")))

"""Interval and test statistics as Column expressions and small aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of the score interval, within [0, 1]; NULLs for n = 0."""
    p = F.try_divide(hits.cast("double"), n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    mid = (p + F.try_divide(F.lit(z * z / 2), n)) / d
    half = F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) * z / d
    some = lambda c: F.when(n > 0, c)
    return F.struct(some(F.greatest(F.lit(0.0), mid - half)).alias("low"), some(F.least(F.lit(1.0), mid + half)).alias("high"))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p-value of b against c discordant pairs: a running binomial term."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    zero = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("total"))
    step = lambda acc, i: F.struct((acc["term"] * (n - i) / (i + 1)).alias("term"), (acc["total"] + acc["term"]).alias("total"))
    tail = F.aggregate(F.sequence(F.lit(0), k), zero, step, lambda acc: acc["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def zero_event_bound(clusters: Column, alpha: float = 0.05) -> Column:
    return 1 - F.pow(F.lit(alpha), F.try_divide(F.lit(1.0), clusters))


def holm(df: DataFrame, p: str, by: list[str] | None = None, order: str = "p_order") -> DataFrame:
    """Adds ``holm``, the step-down adjusted value, within each family ``by``."""
    family = [F.col(c) for c in by or []]
    rank = Window.partitionBy(*family).orderBy(p, order)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    scaled = (size - F.row_number().over(rank) + 1) * F.col(p)
    upto = rank.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_scaled", scaled).withColumn("holm", F.least(F.lit(1.0), F.max("_scaled").over(upto))).drop("_scaled")


def sign_flip(clusters: DataFrame, diff: str, exact_up_to: int = 16, draws: int = 20_000, seed: int = 7) -> DataFrame:
    """(clusters, p_value, exact): two-sided permutation of the signs of cluster differences: all
    2**k of them up to ``exact_up_to`` clusters, else seeded draws by hash; ``exact`` says which
    ran.  clusters: one row each."""
    ranked = clusters.where(F.col(diff).isNotNull()).select(F.col(diff).cast("double").alias("d"), F.xxhash64(*clusters.columns).alias("h"))
    few = ranked.orderBy("h").limit(exact_up_to + 1).count() <= exact_up_to
    spark = clusters.sparkSession
    if few:
        k = ranked.count()
        numbered = ranked.withColumn("j", F.row_number().over(Window.orderBy("h", "d")) - 1)
        flips = spark.range(2**k).withColumnRenamed("id", "draw")
        sign = F.when(F.getbit("draw", F.col("j")) == 1, -1).otherwise(1)
        sums = flips.crossJoin(F.broadcast(numbered)).groupBy("draw").agg(F.sum(sign * F.col("d")).alias("s"))
    else:
        parts = ranked.select(F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), "d", "h")
        sign = F.when(F.xxhash64("h", "draw", F.lit(seed)) < 0, -1).otherwise(1)
        sums = parts.groupBy("draw").agg(F.sum(sign * F.col("d")).alias("s"))
    total = ranked.agg(F.sum("d").alias("t"), F.count("*").alias("clusters"))
    met = (F.abs("s") >= F.abs("t") - 1e-12).cast("double")
    out = F.mean(met) if few else (F.sum(met) + 1) / (F.count("*") + 1)
    return sums.crossJoin(F.broadcast(total)).groupBy("clusters").agg(out.alias("p_value"), F.lit(few).alias("exact"))


def bootstrap(clusters: DataFrame, hits: str, n: str, draws: int = 5000, seed: int = 7) -> DataFrame:
    """(low, high): 95 % interval of the pooled rate, resampling clusters.  Each draw gives
    every cluster a Poisson(1) weight by hash, so no draw needs the clusters in one place."""
    row = clusters.select(F.col(hits).cast("double").alias("hits"), F.col(n).cast("double").alias("n"), F.xxhash64(*clusters.columns).alias("h"))
    drawn = row.select("hits", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), "h")
    u = (F.xxhash64("h", "draw", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).alias("u")
    cuts = [0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582]  # Poisson(1), cumulative
    weight = sum((F.col("u") >= c).cast("int") for c in cuts)
    rates = drawn.select("draw", "hits", "n", u).withColumn("w", weight).groupBy("draw").agg(F.try_divide(F.sum(F.col("w") * F.col("hits")), F.sum(F.col("w") * F.col("n"))).alias("rate"))
    return rates.agg(F.percentile("rate", 0.025).alias("low"), F.percentile("rate", 0.975).alias("high"))

"""Order statistics by rounds of counting, and bounded first rows."""

import random

import pytest
from pyspark.sql import functions as F

from screenspark.operators import selection as S


def groups(rng):
    out = {"a": [rng.random() for _ in range(999)], "b": [rng.choice([1.0, 2.0]) for _ in range(700)], "c": [5.0], None: [rng.gauss(0, 1e-300) for _ in range(40)] + [1.7e308, -1.7e308, 0.0], "wide": [2.0**k for k in range(-1000, 1000)], "same": [3.5] * 50}
    return {k: v for k, v in out.items()}


@pytest.mark.parametrize("buckets", [1024, 2])
def test_ranks_of_all_groups(spark, monkeypatch, buckets):
    monkeypatch.setattr(S, "BUCKETS", buckets)
    want = groups(random.Random(1))
    if buckets == 2:
        want = {k: v for k, v in want.items() if k in ("a", "b", "c")}
    rows = [(k, v) for k, vs in want.items() for v in vs] + [("a", None), ("none", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in S.at_ranks(df, ["g"], "v", {"least": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "most": lambda n: n - 1, "gone": lambda n: n}).collect()}
    assert set(got) == set(want)
    for k, vs in want.items():
        s = sorted(vs)
        assert (got[k].n, got[k].least, got[k].mid, got[k].most, got[k].gone) == (len(s), s[0], s[len(s) // 2], s[-1], None)
    q = {r.g: r.p for r in S.quantiles(df.where("g in ('a', 'b', 'c')"), ["g"], "v", {"p": 0.3}).collect()}
    e = {r.g: r.p for r in df.where("g in ('a', 'b', 'c') and not isnan(v)").groupBy("g").agg(F.percentile("v", 0.3).alias("p")).collect()}
    assert q == pytest.approx(e)
    assert S.upper_median(df.where("false"), ["g"], "v").collect() == []
    assert S.upper_median(df.where("g = 'b'"), [], "v").first().n == 700


def test_first_ids_keep_few_rows_before_the_shuffle(spark):
    df = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("app"), F.col("id").alias("step"))
    got = {r.app: (r.n, r.ids) for r in S.first_ids(df, ["app"], "step").collect()}
    assert got == {"hot": (3333, "1, 2, 4, 5, 7, 8, 10, 11 and 3325 more"), None: (1667, "0, 3, 6, 9, 12, 15, 18, 21 and 1659 more")}
    plan = S.first_rows(df, ["app"], [F.col("step")], 8)._jdf.queryExecution().executedPlan().toString()
    shuffle = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[:shuffle] and "WindowGroupLimit" in plan[shuffle:]

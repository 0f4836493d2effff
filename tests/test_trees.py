"""Trees of any depth and size."""

import random

import pytest
from pyspark.sql import functions as F

from screenspark.operators import tree as T


def chain(spark, n):
    return spark.createDataFrame([(1, k, k - 1 if k else None, "t") for k in range(n)], "state_id int, elem_id int, parent_id int, visual_type string")


def test_chain_of_200_nodes(spark):
    df = chain(spark, 200)
    up = T.ancestors(df)
    assert up.count() == 200 * 199 // 2 and up.where("elem_id - ancestor_id <> distance").isEmpty()
    assert {r.elem_id: r.depth for r in T.depths(df, df).collect()} == {k: k for k in range(200)}
    paths = {r.elem_id: r.path for r in T.paths(df.drop("parent_id"), df).collect()}
    assert paths[199] == "".join(f"/t[@id='{k}']" for k in range(200)) and paths[0] == "/t[@id='0']"
    changes = spark.createDataFrame([(1, k, "delete", "", k) for k in range(3, 199)] + [(1, 2, "set_role", "x", 0)], "state_id int, elem_id int, op string, value string, ord int")
    nodes = df.select("state_id", "elem_id", "parent_id", F.col("visual_type").alias("role"))
    assert sorted((r.elem_id, r.parent_id, r.role) for r in T.apply_edits(nodes, changes).collect()) == [(0, None, "t"), (1, 0, "t"), (2, 1, "x"), (199, 2, "t")]


def test_random_trees_match_a_walk(spark):
    rng = random.Random(1)
    rows = [(s, k, rng.randrange(k) if k and rng.random() < 0.9 else None, rng.randrange(50), rng.randrange(50), "b") for s in range(4) for k in range(60)]
    df = spark.createDataFrame(rows, "state_id int, elem_id int, parent_id int, x1 int, y1 int, visual_type string")
    want = []
    for s in range(4):
        children = {}
        for _, k, p, x, y, _ in (r for r in rows if r[0] == s):
            children.setdefault(p, []).append((y, x, k))
        seen = []

        def walk(p, depth):
            for _, _, k in sorted(children.get(p, [])):  # noqa: B023
                seen.append((k, depth))  # noqa: B023
                walk(k, depth + 1)

        walk(None, 0)
        want += [(s, k, d, i) for i, (k, d) in enumerate(seen)]
    got = T.child_order(df.drop("parent_id"), df)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert {(r.state_id, r.elem_id): r.depth for r in T.depths(df, df).collect()} == {(s, k): d for s, k, d, _ in want}


def test_more_than_a_million_edges(spark):
    edges = spark.range(1_200_000).select((F.col("id") / 6).cast("int").alias("state_id"), (F.col("id") % 6).cast("int").alias("elem_id"), F.when(F.col("id") % 6 > 0, (F.col("id") % 6 - 1).cast("int")).alias("parent_id"))
    assert T.ancestors(edges).count() == 200_000 * 15
    assert T.depths(edges, edges).agg(F.sum("depth")).first()[0] == 200_000 * 15


def test_cycles_are_refused(spark):
    df = spark.createDataFrame([(1, 1, 2, "t"), (1, 2, 3, "t"), (1, 3, 1, "t")], "state_id int, elem_id int, parent_id int, visual_type string")
    for f in (lambda: T.ancestors(df), lambda: T.depths(df, df), lambda: T.paths(df.drop("parent_id"), df)):
        with pytest.raises(ValueError, match="own ancestor"):
            f()


def test_empty_trees(spark):
    df = chain(spark, 0)
    assert T.ancestors(df).collect() == [] and T.depths(df, df).collect() == [] and T.child_order(df.select("state_id", "elem_id", F.lit(0).alias("x1"), F.lit(0).alias("y1")), df).collect() == []

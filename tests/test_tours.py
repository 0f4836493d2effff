"""Tours, nested trees and accessibility labels against plain walks, at any depth."""

import json
import random

import pytest
from pyspark.sql import functions as F

from screenspark.operators import harvest as H
from screenspark.operators import tours as T
from screenspark.operators import tree
from screenspark.sources import annotations as A

BOX = "x1 int, y1 int, x2 int, y2 int"


def made(rng, screens=3, size=60):
    rows = []
    for s in range(screens):
        for k in range(size):
            rows.append((s, k, rng.randrange(k) if k and rng.random() < 0.9 else None, rng.randrange(50), rng.randrange(50)))
    return rows


def walked(rows):
    out = {}
    for s in {r[0] for r in rows}:
        children, count = {}, 0
        for _, k, p, x, y in (r for r in rows if r[0] == s):
            children.setdefault(p, []).append((y, x, k))
        todo = [(k, 0) for _, _, k in sorted(children.get(None, []), reverse=True)]
        while todo:
            k, depth = todo.pop()
            if (s, k) in out:
                continue
            out[s, k] = [depth, count]
            count += 1
            todo += [(c, depth + 1) for _, _, c in sorted(children.get(k, []), reverse=True)]
        below = {}
        for _, k, p, *_ in sorted((r for r in rows if r[0] == s), key=lambda r: -out[s, r[1]][1]):
            below[k] = below.get(k, 0)
            if p is not None:
                below[p] = below.get(p, 0) + below[k] + 1
        for k, n in below.items():
            out[s, k].append(out[s, k][1] + n)
    return {k: tuple(v) for k, v in out.items()}


def test_tours_match_a_walk(spark):
    rows = made(random.Random(2))
    df = spark.createDataFrame(rows, "state_id int, elem_id int, parent_id int, x1 int, y1 int")
    got = T.tour(df.drop("parent_id"), df).collect()
    assert {(r.state_id, r.elem_id): (r.depth, r.pre_order, r.last) for r in got} == walked(rows)
    assert {(r.state_id, r.elem_id): r.n_below for r in T.below(T.tour(df.drop("parent_id"), df)).collect()} == {k: v[2] - v[1] for k, v in walked(rows).items()}


def test_deep_chains_strange_parents_and_cycles(spark):
    chain = spark.range(20_000).select(F.lit("s").alias("state_id"), F.col("id").cast("string").alias("elem_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"), F.lit(0).alias("x1"), F.lit(0).alias("y1"))
    got = T.tour(chain.drop("parent_id"), chain)
    assert got.where("depth <> pre_order or depth <> cast(elem_id as long) or last <> 19999").isEmpty() and got.count() == 20_000
    lost = spark.createDataFrame([(1, 1, 9, 0, 0), (1, 2, 1, 0, 0)], "state_id int, elem_id int, parent_id int, x1 int, y1 int")
    assert sorted((r.elem_id, r.parent_id, r.depth) for r in T.tour(lost.drop("parent_id"), lost).collect()) == [(1, None, 0), (2, 1, 1)]
    assert T.tour(lost.drop("parent_id").where("false"), lost).collect() == []
    ring = spark.createDataFrame([(1, 1, 2, 0, 0), (1, 2, 1, 0, 0)], "state_id int, elem_id int, parent_id int, x1 int, y1 int")
    with pytest.raises(ValueError, match="own ancestor"):
        T.tour(ring.drop("parent_id"), ring)


def test_places_of_screens_match_a_walk(spark):
    """In one shuffle, without a checkpoint; parents in the rows or in a table of edges, screens
    that run over batches, ids that are text, a deep chain, parents that are missing, cycles."""
    rows = made(random.Random(3), screens=7, size=40) + [(9, k, k - 1 if k else None, 0, 0) for k in range(3000)]
    df = spark.createDataFrame(rows, "state_id int, elem_id int, parent_id int, x1 int, y1 int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (before, "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for got in (T.placed(df), T.placed(df.drop("parent_id"), df)):
                assert {(r.state_id, r.elem_id): (r.depth, r.pre_order, r.last) for r in got.collect()} == walked(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    text = df.withColumns({"elem_id": F.format_string("n%05d", "elem_id"), "parent_id": F.expr("'n' || lpad(parent_id, 5, '0')"), "state_id": F.expr("'s' || state_id")})
    assert {(int(r.state_id[1:]), int(r.elem_id[1:])): (r.depth, r.pre_order, r.last) for r in T.placed(text).collect()} == walked(rows)
    lost = spark.createDataFrame([(1, 1, 9, 0, 0), (1, 2, 1, 0, 0), (2, 9, None, 0, 0), (None, 1, None, 0, 0)], df.schema)
    assert sorted((r.state_id, r.elem_id, r.parent_id, r.depth) for r in T.placed(lost).collect()) == [(1, 1, None, 0), (1, 2, 1, 1), (2, 9, None, 0)]
    assert T.placed(df.where("false")).collect() == []
    plan = T.placed(df.drop("parent_id"), df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Scan ExistingRDD" in plan
    with pytest.raises(Exception, match="own ancestor"):  # when the rows are read
        T.placed(spark.createDataFrame([(1, 1, 2, 0, 0), (1, 2, 1, 0, 0)], df.schema)).collect()


def test_labels_take_one_shuffle(spark):
    kind = f"state_id int, elem_id int, parent_id int, name string, control_type string, {BOX}, visible boolean"
    df = spark.createDataFrame([(1, 0, None, "Window", "Window", 0, 0, 400, 300, True)], kind)
    plan = H.labels(df, (0, 0, 400, 300), (400, 300))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window [" not in plan


def test_nested_trees_come_back(spark, tmp_path):
    """Depth 700, odd letters, missing nodes and several top nodes, written and read again."""
    rows = [(1, f"n{k}", f"n{k - 1}" if k else None, k, k, k + 9, k + 9, 'say "é"\n\\' if k % 2 else None) for k in range(700)]
    rows += [(2, "a", None, 1, 2, 3, 4, "x"), (2, "b", None, 0, 9, 9, 9, "y"), (2, "c", "gone", 5, 5, 6, 6, "z")]
    df = spark.createDataFrame(rows, f"state_id int, elem_id string, parent_id string, {BOX}, text string").withColumn("visual_type", F.lit("button"))
    fields = [F.col("elem_id").alias("id"), F.array("x1", "y1", "x2", "y2").alias("bounds"), F.col("visual_type"), F.col("text"), F.col("parent_id")]
    whole = df.withColumn("role", F.lit("r"))
    trees = T.nested(whole, df.select("state_id", "elem_id", "parent_id"), fields)
    told = {r.state_id: r.hierarchy for r in trees.collect()}
    node, depth = json.loads(told[2]), 0
    assert node["id"] == "ROOT" and node["bounds"] == [0, 0, 9, 9]
    assert [c["id"] for c in node["children"]] == ["gone", "a", "b"] and node["children"][0]["children"][0]["text"] == "z" and node["children"][0]["visual_type"] == "unknown"
    T.write_nested(trees, str(tmp_path / "out"))
    back = A.read_screens(spark, str(tmp_path / "out/state_id=1/*")).orderBy("elem_id").collect()
    assert [(r.elem_key, r.x1, r.y2, r.text, r.parent_key) for r in back] == [(r[1], r[3], r[6], r[7], r[2]) for r in rows[:700]]
    node = told[1]
    while node.count('"children"') and depth < 3:
        depth += 1
        node = node[node.index('"children":[') + 12 :]
    assert depth == 3
    T.write_nested(trees, str(tmp_path / "out"))  # a second run leaves the same
    assert A.read_screens(spark, str(tmp_path / "out/state_id=2/*")).count() == 4


def plain_labels(nodes, client, picture):
    """One node after the other, each asking the ones above what became of them."""
    cx, cy, cw, ch = client
    by_id = {n["id"]: n for n in nodes}
    kept, out = {}, []
    for n in nodes:
        name = (n["name"] or "").strip()
        raw = [round((n["rect"][i] - (cx, cy)[i % 2]) * (picture[i % 2] / (cw, ch)[i % 2])) for i in range(4)]
        b = [max(0, raw[0]), max(0, raw[1]), min(picture[0], raw[2]), min(picture[1], raw[3])]
        area = lambda r: max(0, r[2] - r[0]) * max(0, r[3] - r[1])
        if n["visible"] is False or b[2] - b[0] < 4 or b[3] - b[1] < 4 or area(b) < 0.5 * area(raw):
            continue
        above, p = [], n["parent"]
        while p is not None and p in by_id:
            if p in kept:
                above.append(kept[p])
            p = by_id[p]["parent"]
        if name and any(k["name"].lower() == name.lower() and b[0] >= k["b"][0] - 2 and b[1] >= k["b"][1] - 2 and b[2] <= k["b"][2] + 2 and b[3] <= k["b"][3] + 2 for k in above):
            continue
        if not name and n["type"] not in ("Image", "Edit", "ComboBox"):
            continue
        kept[n["id"]] = {"name": name, "b": b, "key": f"E{len(out) + 1}"}
        out.append((n["id"], kept[n["id"]]["key"], above[0]["key"] if above else None, *b))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_labels_match_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    if seed == 2:  # a chain of 1,000 nodes, each a pixel or two further out than the one above
        parents = [k - 1 if k else None for k in range(1000)]
    else:
        parents = [rng.randrange(max(0, k - 6), k) if k and rng.random() < 0.95 else None for k in range(250)]
    nodes = [
        {"id": k, "parent": p, "name": rng.choice([None, "", " Save ", "save", "Open", "x"]), "type": rng.choice(["Button", "Text", "Image", "Edit", "Pane", "TreeItem"]), "visible": rng.choice([True, True, True, None, False]),
         "rect": [rng.randrange(40, 44), rng.randrange(40, 44), rng.randrange(160, 165), rng.randrange(100, 104)] if rng.random() < 0.9 else [0, 0, 30, 700]}
        for k, p in enumerate(parents)
    ]
    # The flat order of the dump is depth-first, so number the nodes that way.
    df = spark.createDataFrame([(1, n["id"], n["parent"], n["name"], n["type"], *n["rect"], n["visible"]) for n in nodes], f"state_id int, elem_id int, parent_id int, name string, control_type string, {BOX}, visible boolean")
    place = {r.elem_id: r.pre_order for r in T.tour(df, df, order=[F.col("elem_id")]).collect()}
    want = plain_labels(sorted(nodes, key=lambda n: place[n["id"]]), (30, 30, 200, 100), (301, 151))
    got = H.labels(df, (30, 30, 200, 100), (301, 151)).collect()
    assert sorted((r.elem_id, r.elem_key, r.parent_key, r.x1, r.y1, r.x2, r.y2) for r in got) == sorted(want) and len(want) > 5


def test_kinds_of_labels(spark):
    rows = [(1, 0, None, "Window", "Window", 0, 0, 400, 300, True), (1, 1, 0, "Bold", "Button", 0, 0, 20, 20, True), (1, 2, 0, "Save all", "Button", 0, 30, 90, 50, True), (1, 3, 2, "Save all", "Text", 2, 32, 80, 48, True), (1, 4, 0, "Name", "Edit", 0, 60, 90, 80, True), (1, 5, 0, "", "Pane", 0, 90, 90, 200, True), (1, 6, 5, "Hello", "Text", 0, 95, 50, 110, None), (1, 7, 5, None, "Image", 60, 95, 80, 110, True), (1, 8, 5, "Docs", "Hyperlink", 0, 120, 80, 140, True)]
    df = spark.createDataFrame(rows, f"state_id int, elem_id int, parent_id int, name string, control_type string, {BOX}, visible boolean")
    got = {r.elem_id: (r.parent_key, r.visual_type, r.text, r.role_word, r.review) for r in H.labels(df, (0, 0, 400, 300), (400, 300)).collect()}
    assert got == {
        0: (None, "block", None, None, None), 1: ("E1", "icon", "Bold", None, "icon-only?"), 2: ("E1", "button", "Save all", "button", None), 4: ("E1", "block", None, None, None),
        6: ("E1", "text", "Hello", None, None), 7: ("E1", "icon", None, None, None), 8: ("E1", "button", "Docs", "link", None),
    }
    assert [r.names for r in H.all_names(df).collect()] == [["Bold", "Docs", "Hello", "Name", "Save all", "Window"]]
    assert tree.depths(df, df).count() == 9

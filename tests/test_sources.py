"""Readers, writers, models and streams over small files."""

import json

import pytest
from pyspark.sql import functions as F

from screenspark.functions import models
from screenspark.functions import stats
from screenspark.functions import text as X
from screenspark.operators import locator
from screenspark.sources import annotations as A
from screenspark.streaming import wait

NODES = [{"id": "E1", "bounds": [0, 0, 100, 50], "visual_type": "button", "text": "Save"}, {"id": "E2", "bounds": [10, 10, 20, 20], "type": "icon", "ocr_text": "x", "text": "y"}]


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_screens_flat_and_nested(spark, tmp_path):
    put(tmp_path / "a.json", {"elements": NODES})
    put(tmp_path / "b.json", {"dom": {"hierarchy": {"id": "ROOT", "children": [{**NODES[0], "children": [NODES[1]]}]}}})
    got = {(r.state_id, r.elem_key): (r.visual_type, r.text, r.x2) for r in A.read_screens(spark, str(tmp_path)).collect()}
    want = {"E1": ("button", "Save", 100), "E2": ("icon", "x", 20)}
    assert got == {(s, k): v for s in "ab" for k, v in want.items()}


@pytest.mark.parametrize("depth", [13, 700])
def test_deeply_nested_screens_are_read_whole(spark, tmp_path, depth):
    node = None
    for k in range(depth, 0, -1):
        node = {"id": f"E{k}", "bounds": [0, 0, k, k], "children": [*([node] if node else []), {"id": f"S{k}", "bounds": [0, 0, 1, 1]}]}
    put(tmp_path / "a.json", {"dom": {"hierarchy": node}})
    got = [r.elem_key for r in A.read_screens(spark, str(tmp_path)).orderBy("elem_id").collect()]
    assert got == [f"E{k}" for k in range(1, depth + 1)] + [f"S{k}" for k in range(depth, 0, -1)]


def test_pairs_skip_screens_without_labels(spark, tmp_path):
    put(tmp_path / "p/a.json", {"elements": NODES})
    put(tmp_path / "p/b.json", {"elements": NODES})
    put(tmp_path / "g/a.json", {"elements": NODES[:1]})
    pred, gt, skipped = A.read_pairs(spark, str(tmp_path / "p"), str(tmp_path / "g"))
    assert pred.count() == 2 and gt.count() == 1 and [r.state_id for r in skipped.collect()] == ["b"]


def test_yolo_round_trip(spark, tmp_path):
    put(tmp_path / "y/s1.txt", "# note\n0 0.5 0.5 0.2 0.4\n\n1 0.1\n")
    rows = A.yolo_boxes(A.read_yolo(spark, str(tmp_path / "y")), F.lit(100), F.lit(50)).collect()
    assert [(r.state_id, r.class_id, r.x1, r.y1, r.x2, r.y2) for r in rows] == [("s1", 0, 40, 15, 60, 35)]
    boxes = spark.createDataFrame([("s1", 40, 15, 60, 35, "button"), ("s1", 0, 0, 5, 5, "other")], "state_id string, x1 int, y1 int, x2 int, y2 int, visual_type string")
    A.write_yolo(boxes, str(tmp_path / "out"), ["button"], 100, 50)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["0 0.500000 0.500000 0.200000 0.400000"]


def test_coco_and_voc(spark, tmp_path):
    put(tmp_path / "c.json", {"images": [{"id": 1, "file_name": "a.png", "width": 10, "height": 10}], "categories": [{"id": 7, "name": "button"}], "annotations": [{"image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4]}, {"image_id": 1, "category_id": 8, "bbox": [1, 2, 3, 4]}]})
    put(tmp_path / "v.xml", "<annotation><filename>a.png</filename><size><width>10</width><height>10</height></size><object><name>button</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>4</xmax><ymax>6</ymax></bndbox></object></annotation>")
    for df in (A.read_coco(spark, str(tmp_path / "c.json")), A.read_voc(spark, str(tmp_path / "v.xml"))):
        assert [tuple(r) for r in df.collect()] == [("a.png", "button", 1, 2, 4, 6, 10, 10)]


def test_label_studio_shapes(spark, tmp_path):
    box = {"type": "rectanglelabels", "origin": "manual", "value": {"x": 10, "y": 20, "width": 30, "height": 40, "rectanglelabels": ["Button"]}}
    put(tmp_path / "1.json", [{"data": {"image": "/up/a.png"}, "annotations": [{"id": 1, "result": [box, box], "updated_at": "2024-01-01"}, {"id": 2, "result": [box], "updated_at": "2024-02-01"}, {"id": 3, "result": [box], "was_cancelled": True}]}])
    put(tmp_path / "2.json", {"id": 9, "result": [box], "updated_at": "2024-01-05", "task": {"data": {"image": "b.png"}}})
    put(tmp_path / "3.json", "not json")
    got = sorted((r.image, r.annotation_id, r.x, r.class_name) for r in A.read_label_studio(spark, str(tmp_path)).collect())
    assert got == [("a.png", 2, 10.0, "Button"), ("b.png", 9, 10.0, "Button")]


def test_markup_clamps_and_drops(spark):
    text = "<Button><loc_0><loc_0><loc_250><loc_600>Save<Icon><loc_5><loc_5><loc_5><loc_9><Button><loc_0><loc_0><loc_250><loc_600>Save"
    df = spark.createDataFrame([("s", text)], "state_id string, text string").withColumnRenamed("text", "markup")
    rows = A.parse_markup(df, "markup", F.lit(1000), F.lit(500)).collect()
    assert [(r.visual_type, r.x1, r.y1, r.x2, r.y2, r.text) for r in rows] == [("button", 0, 0, 500, 500, "Save")]


def test_results_keep_the_last_file(spark, tmp_path):
    step = lambda hit: {"benchmark": "b", "results": {"e": {"steps": [{"step": "s1", "kind": "action", "hit": hit}]}}}
    put(tmp_path / "20240101_1.json", step(False))
    put(tmp_path / "20240102_1.json", step(True))
    assert [(r.executor, r.step, r.hit) for r in A.read_results(spark, str(tmp_path)).collect()] == [("e", "s1", True)]


def test_screen_writer_and_report(spark, tmp_path):
    put(tmp_path / "in/a.json", {"elements": NODES})
    df = A.read_screens(spark, str(tmp_path / "in"))
    A.write_screens(df, str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out")).first()
    assert row.element_count == 2 and row.elements[0].bounds == [0, 0, 100, 50] and row.elements[0].center == [50, 25]
    assert "| button | 1 |" in A.markdown(df.groupBy("visual_type").count(), "Types")
    with pytest.raises(ValueError):
        A.markdown(df, "Too many", 1)
    assert [r.line for r in A.robot_lines(df).orderBy("elem_id").collect()] == ["${SAVE}    text=Save || id=1", "${X}    text=x || id=2"]


def test_detector_contract(spark, tmp_path):
    (tmp_path / "s.png").write_bytes(b"abc")
    models.register("fake", lambda size=1: lambda image: [(0, 0, len(image), size, "icon", 0.5, None, "fake")])
    rows = models.detect(models.read_images(spark, str(tmp_path)), "fake", size=7).collect()
    assert [(r.state_id, r.elem_id, r.x2, r.y2) for r in rows] == [("s", 1, 3, 7)]
    with pytest.raises(KeyError):
        models.detect(models.read_images(spark, str(tmp_path)), "none")


def test_known_statistics(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    p = [one(stats.mcnemar(F.lit(a), F.lit(b))) for a, b in ((6, 1), (43, 70), (60, 71), (51, 49))]
    assert [round(x, 3) for x in p] == [0.125, 0.014, 0.382, 0.920]
    w = one(stats.wilson(F.lit(0), F.lit(92)))
    assert (round(w.low, 4), round(w.high, 4)) == (0.0, 0.0401) and one(stats.wilson(F.lit(0), F.lit(0))).low is None
    assert round(one(stats.zero_event_bound(F.lit(46))), 4) == 0.0630
    rows = stats.holm(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "k int, p double"), "p", None, "k").orderBy("k").collect()
    assert [round(r.holm, 4) for r in rows] == [0.03, 0.06, 0.06]
    five = spark.createDataFrame([(k, 1.0) for k in range(5)], "k int, d double")
    assert round(stats.sign_flip(five, "d").first().p_value, 6) == 0.0625
    many = spark.createDataFrame([(k, float(k % 2) - 0.5) for k in range(40)], "k int, d double")
    drawn = stats.sign_flip(many, "d", draws=500).first()
    assert drawn.p_value > 0.5 and not drawn.exact and stats.sign_flip(five, "d").first().exact


def test_descriptions_and_names(spark):
    said = spark.createDataFrame([("the Save As button at the top left",), ("Align Left button",), ("left",)], "d string").select(locator.describe(F.col("d")).alias("s"))
    got = [(r.s.naming, r.s.roles, r.s.places) for r in said.collect()]
    assert got == [(["save", "as"], ["button"], ["top", "left"]), (["align", "left"], ["button"], []), ([], [], ["left"])]
    names = spark.range(1).select(X.clean_name(F.lit("2 small-rings!")), X.quoted(F.lit("a b")), X.quoted(F.lit('a"b')), X.state_id_of(F.lit("My App-main_1.PNG"))).first()
    assert tuple(names) == ("E_2_SMALL_RINGS", '"a b"', None, "my__app_main_1")


def test_wait_until_as_a_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", False), ("a", "2024-01-01 00:00:05", True), ("b", "2024-01-01 00:00:00", False), ("b", "2024-01-01 00:01:00", True), ("c", "2024-01-02 00:00:00", False)]
    schema = "key string, ts string, hit boolean"
    later = [("a", "2024-01-01 01:00:00", True), ("b", "2024-01-01 01:00:00", True)]  # decided by then
    for k, part in enumerate((rows[:4], rows[4:], later + [("d", "2024-01-03 00:00:00", False)])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("ts"))
    done = wait.wait_until(source, "key", "ts", F.col("hit"), 10)
    query = done.writeStream.format("memory").queryName("waited").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r.key, r.outcome) for r in spark.sql("select * from waited").collect()]
    assert ("a", "found") in got and ("b", "timeout") in got and len(got) == len({k for k, _ in got})
    events = spark.createDataFrame(rows[:4], schema).withColumn("ts", F.to_timestamp("ts"))
    assert {r.key: r.outcome for r in wait.first_match(events, "key", "ts", F.col("hit"), 10).collect()} == {"a": "found", "b": "timeout"}

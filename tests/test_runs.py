"""Manifests, run folders, sessions, accessibility exports and the files of a run."""

import io
import json
import tarfile
import time

import pytest
from pyspark.sql import functions as F
from test_sources import NODES, put

from screenspark.functions import specs, stats
from screenspark.functions import text as X
from screenspark.operators import benchmark, merging, prompts
from screenspark.sources import annotations as A
from screenspark.sources import runs as R


def test_manifest_and_its_labels(spark, tmp_path):
    put(tmp_path / "steps.json", {"benchmark": "b", "states": [{"id": "s1", "image": "i/s1.png", "gt": "labels/a.json", "image_size": [10, 20]}], "steps": [{"id": "s1/act/1", "state": "s1", "kind": "action", "locator": "text=Save", "target_bounds": [1, 2, 3, 4]}, {"id": "s1/ver/1", "state": "s1", "kind": "verify", "negative": True}]})
    put(tmp_path / "labels/a.json", {"elements": NODES})
    put(tmp_path / "labels/b.json", {"elements": NODES})
    steps, states = R.read_manifest(spark, str(tmp_path / "steps.json"))
    assert [(r.id, r.kind, r.negative) for r in steps.orderBy("id").collect()] == [("s1/act/1", "action", None), ("s1/ver/1", "verify", True)]
    labels = R.manifest_labels(states, A.read_screens(spark, str(tmp_path / "labels")))
    assert [(r.state, r.elem_key) for r in labels.orderBy("elem_key").collect()] == [("s1", "E1"), ("s1", "E2")]


def test_newest_screens(spark):
    df = spark.createDataFrame([("a", "r1", 1), ("a", "r2", 2), ("b", "r1", 3)], "state_id string, run string, elem_id int")
    assert sorted((r.state_id, r.elem_id) for r in R.newest_screens(df).collect()) == [("a", 2), ("b", 3)]


def test_accessibility_export(spark, tmp_path):
    node = lambda **p: "<node><properties>" + "".join(f'<property displayName="{k}" value="{v}"/>' for k, v in p.items()) + "</properties></node>"
    put(tmp_path / "w.xml", "<root>" + node(Name=" Save &amp; go ", AutomationControlType="Button", ClassName="B", BoundingRectangle="1,2,30,40") + node(Name="x", AutomationControlType="Pane") + node(Name="", AutomationControlType="Edit") + node(Name="y", AutomationControlType="Text", BoundingRectangle="1,2") + "</root>")
    got = [tuple(r)[2:] for r in R.read_accessibility(spark, str(tmp_path)).orderBy("elem_id").collect()]
    assert got == [("Save & go", "button", "B", 1, 2, 30, 40), ("y", "text", None, None, None, None, None)]


def test_sessions(spark, tmp_path):
    put(tmp_path / "20240101_a/dom_result.json", {"dom": {}})
    put(tmp_path / "20240102_b/dom_result.json", {"dom": {}})
    put(tmp_path / "20240102_b/session_info.json", {"timestamp": "t", "element_count": 3, "cv_stats": {"detector": "d"}, "image_size": {"width": 5, "height": 6}})
    put(tmp_path / "20240103_c/session_info.json", {"timestamp": "never analysed"})
    got = [(r.id, r.element_count, r.detector, r.width) for r in R.read_sessions(spark, str(tmp_path)).collect()]
    assert got == [("20240102_b", 3, "d", 5), ("20240101_a", None, None, None)]


def test_tarballs(spark, tmp_path):
    def pack(name, members):
        with tarfile.open(tmp_path / name, "w:gz") as tar:
            for member, body in members.items():
                info = tarfile.TarInfo(member)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))

    pack("good.tar.gz", {"run/a[x=1:2].json": b"{}", "run/b.txt": b"hello"})
    pack("bad.tar.gz", {"../evil": b"x"})
    got = {r.name: bytes(r.content) for r in R.read_tarballs(spark, str(tmp_path / "good.tar.gz")).collect()}
    assert got == {"run/a[x=1_2].json": b"{}", "run/b.txt": b"hello"}
    with pytest.raises(Exception, match="unsafe member"):
        R.read_tarballs(spark, str(tmp_path / "bad.tar.gz")).collect()


def test_results_round_trip_and_reports(spark, tmp_path):
    rows = [("e1", "s1", "action", True, True, False, 0.5), ("e1", "s2", "verify", False, True, False, 1.5), ("e2", "s1", "action", False, False, True, 2.0)]
    df = spark.createDataFrame(rows, "executor string, step string, kind string, hit boolean, correct boolean, false_pass boolean, latency double")
    R.write_results(df, str(tmp_path / "out"), "bench")
    back = A.read_results(spark, str(tmp_path / "out" / "*"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(("bench", *r) for r in rows)
    small = df.groupBy("executor").agg(F.count("*").alias("n"), F.avg("latency").alias("mean")).orderBy("executor")
    assert json.loads(R.report_json(small)) == [{"executor": "e1", "n": 2, "mean": 1.0}, {"executor": "e2", "n": 1, "mean": 2.0}]
    page = R.report_html(small, "a < b")
    assert "<h1>a &lt; b</h1>" in page and "<td>1.000</td>" in page
    with pytest.raises(ValueError, match="at most 1 rows"):
        R.report_html(small, "t", 1)


def test_training_lines_and_review_sheets(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 0, 0, 10, 10, "button", "A<B"), ("s", 2, 0, 20, 10, 30, "text", None)], "state_id string, elem_id int, x1 int, y1 int, x2 int, y2 int, visual_type string, text string")
    edits = spark.createDataFrame([("s", 2, "delete")], "state_id string, elem_id int, op string")
    R.write_training(prompts.prompt_lines(df), edits, str(tmp_path / "t"))
    row = spark.read.json(str(tmp_path / "t")).first()
    assert row.elements.split("\n") == ["1: button 'A<B'", "2: text (below 'A<B')"] and row.edits[0].op == "delete"
    absent = spark.createDataFrame([("s", "Quit")], "state_id string, caption string")
    sheet = R.review_sheet(df, absent).first().sheet
    assert "A&lt;B" in sheet and "<li>Quit</li>" in sheet and sheet.count("<rect") == 2


def test_boxes_merge_until_none_is_close(spark):
    rows = [(1, 1, 0, 0, 10, 10), (1, 2, 30, 0, 40, 10), (1, 3, 12, 0, 28, 10), (1, 4, 100, 100, 110, 110), (2, 1, 0, 0, 5, 5)]
    df = spark.createDataFrame(rows, "state_id int, elem_id int, x1 int, y1 int, x2 int, y2 int")
    got = sorted(tuple(r) for r in merging.merge_close(df, ["state_id"]).collect())
    assert got == [(1, 0, 0, 40, 10), (1, 100, 100, 110, 110), (2, 0, 0, 5, 5)]


def test_texts_match_greedily(spark):
    import difflib

    detected = spark.createDataFrame([("s", 1, "Savf"), ("s", 2, "Save"), ("s", 3, "Open file"), ("s", 4, "zzz"), ("s", 5, "")], "state_id string, elem_id int, text string")
    truth = spark.createDataFrame([("s", " Save "), ("s", "Saves"), ("s", "Open files"), ("s", "Save")], "state_id string, text string")
    free, want = ["Open files", "Save", "Saves"], []
    for i, t in ((1, "Savf"), (2, "Save"), (3, "Open file"), (4, "zzz")):
        if not free:
            break
        best = max(free, key=lambda g: (difflib.SequenceMatcher(None, t.lower(), g.lower()).ratio(), [-ord(c) for c in g]))  # noqa: B023
        score = difflib.SequenceMatcher(None, t.lower(), best.lower()).ratio()
        if score >= 0.6:
            want.append((i, best, round(score, 6)))
            free.remove(best)
    got = sorted((r.elem_id, r.gt_text, round(r.similarity, 6)) for r in benchmark.match_texts(detected, truth).collect())
    assert got == want and len(want) == 3


def test_notations(spark):
    def say(expr, value):
        return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first().x

    times = {"10s": 10, "0.5s": 0.5, "1 min": 60, "1 min 30 s": 90, "01:30": 90, "1:00:01": 3601, "2 hours": 7200, "-5 s": -5, "7": 7, "100ms": 0.1, "soon": None, "": None}
    for text, want in times.items():
        assert say(specs.seconds, text) == want, text
    assert say(specs.scalar, "On").flag is True and say(specs.scalar, "12").whole == 12 and say(specs.scalar, "1e3").number == 1000.0 and say(specs.scalar, "x1").text == "x1"
    assert say(specs.region, "bounds(1.5,2.5,30,40)").x1 == 2 and say(specs.region, "1,2,3") is None and say(specs.region, "5,5,5,9") is None
    assert say(specs.split_specs, "a[b=1,c=2], d ,,e") == ["a[b=1,c=2]", "d", "e"]
    bad = say(specs.spec, "det[x]"), say(specs.spec, "det[a=1")
    assert bad[0].problem == "no value: x" and bad[1].problem == "no closing bracket"


def test_word_distance_matches_a_table(spark):
    import random

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    rng = random.Random(3)
    rows = [([rng.choice("abcdé") * 2 for _ in range(rng.randint(0, 12))], [rng.choice("abcdé") * 2 for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    df = spark.createDataFrame([(" ".join(a), "\t".join(b)) for a, b in rows], "a string, b string")
    assert [r.d for r in df.select(X.word_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [brute(a, b) for a, b in rows]


def test_bootstrap_matches_a_plain_loop(spark):
    import numpy as np

    rows = [("a", 3, 4), ("b", 1, 5), ("c", 2, 2), ("d", 0, 3)]
    df = spark.createDataFrame(rows, "app string, hits long, n long")
    u = (F.xxhash64("h", "draw", F.lit(7)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).alias("u")
    lots = df.select("app", F.xxhash64("app", "hits", "n").alias("h")).crossJoin(spark.range(300).select(F.col("id").cast("int").alias("draw"))).select("app", "draw", u).collect()
    cumulative = np.cumsum([np.exp(-1) / np.prod(range(1, k + 1), initial=1.0) for k in range(6)])
    hits, n = ({r[0]: r[i] for r in rows} for i in (1, 2))
    total = [[0.0, 0.0] for _ in range(300)]
    for r in lots:
        w = sum(r.u >= c for c in cumulative)
        total[r.draw][0] += w * hits[r.app]
        total[r.draw][1] += w * n[r.app]
    rates = [h / m for h, m in total if m]
    got = stats.bootstrap(df, "hits", "n", draws=300).first()
    assert np.allclose(tuple(got), np.percentile(rates, [2.5, 97.5]))


def test_many_screens_merge_soon(spark):
    """Sixty thousand screens; with a call for each the test was not over after 65 seconds."""
    rows = spark.range(180_000).select((F.col("id") / 3).cast("long").alias("state_id"), (F.col("id") % 3).alias("elem_id"))
    at = {c: (F.col("elem_id") * 9 + (10 if c[1] == "2" else 0)).cast("int") for c in ("x1", "y1", "x2", "y2")}
    began = time.monotonic()
    got = merging.merge_close(rows.withColumns(at), ["state_id"]).groupBy("x1", "y1", "x2", "y2").count().collect()
    assert [tuple(r) for r in got] == [(0, 0, 28, 28, 60_000)] and time.monotonic() - began < 20

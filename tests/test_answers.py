"""Answers of models that were cut off."""

import json
import time

import pytest
from pyspark.sql import functions as F

from screenspark.functions import answers as A

WHOLE = [
    '[{"id": 1, "t": "a]}\\"{"}, {"id": 2, "l": [1, [2, 3], {}]}, {"id": 3}]',
    '{"note": "x, [y", "edits": [1, "two, [2]", null, -4.5e3, [5], {"six": "\\\\"}], "n": 2}',
    "[]",
    '{"a": {"b": [[1, 2], [3]]}}',
    '{"no": "list"}',
]


def items(text):
    """The first list of a whole text."""
    body = json.loads(text)
    while isinstance(body, dict):
        body = next((v for v in body.values() if isinstance(v, list | dict)), None)
    return body


@pytest.fixture(scope="module")
def cuts(spark):
    rows = [(i, k, t[:k]) for i, t in enumerate(WHOLE) for k in range(len(t) + 1)]
    df = spark.createDataFrame(rows, "i int, k int, t string")
    return [(r.i, r.k, r.t, r.r) for r in df.select("*", A.repaired(F.col("t")).alias("r")).collect()]


def test_every_cut_is_whole_json(cuts):
    for i, k, t, r in cuts:
        text, want = WHOLE[i], items(WHOLE[i])
        at = text.index("[", text.index('"edits"')) if i == 1 else text.find("[")
        if k == len(text) or at < 0 or k <= at and i != 1:
            assert r == t
        elif i != 1 or k > at:
            got = items(r)
            assert got == want[: len(got)] and (k < len(text) or got == want)


def test_complete_items_stay(cuts):
    kept = {(i, k): items(r) for i, k, t, r in cuts if i == 0 and k > 0}
    ends = [k for k in range(1, len(WHOLE[0]) + 1) if len(kept[0, k]) > len(kept.get((0, k - 1), []))]
    assert [WHOLE[0][:k][-1] for k in ends] == ["}", "}", "}"] and kept[0, len(WHOLE[0])] == items(WHOLE[0])


def test_suggestions_of_cut_answers(spark):
    rows = ['```json\n[{"a": "x}"}, {"a": "y, {', '[{"a": "x}"}]', "no list", None, '[{"a": "x}"}, {"a"']
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(A.suggestions(F.col("t"), "a: string").alias("s")).collect()
    assert [[x.a for x in r.s] for r in got] == [["x}"], ["x}"], [], [], ["x}"]]


def test_long_texts(spark):
    text = "[" + ", ".join('{"t": "' + "\\\\" * 3000 + '"}' for _ in range(20))
    assert len(json.loads(spark.createDataFrame([(text[:-1],)], "t string").select(A.repaired(F.col("t"))).first()[0])) == 19


def test_repair_keeps_pace(spark):
    """A thousand answers of 200 items; the fold over all marks took more than 30 seconds."""
    item = '{"id": 1, "at": [1, 2, [3, {"x": []}]], "t": "a, [b"}'
    rows = spark.range(1000).select(F.lit("[" + ", ".join([item] * 200)).alias("t"), F.col("id"))
    began = time.monotonic()
    got = rows.select(F.length(A.repaired(F.expr("substring(t, 1, cast(length(t) - id % 7 as int))"))).alias("n")).distinct().count()
    assert got == 2 and time.monotonic() - began < 30

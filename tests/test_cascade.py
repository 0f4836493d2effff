"""Tiers that are asked about open rows only, and whose answers have to stand."""

from pyspark.sql import functions as F

from screenspark.operators import cascade as C

ELEMENTS = [
    (1, 1, 0, 0, 40, 20, "button", "Save", None, None), (1, 2, 300, 0, 340, 20, "button", "Save as", None, None), (1, 3, 0, 100, 40, 120, "input_field", None, None, "Page 2"),
    (1, 4, 300, 100, 340, 120, "text", "Delete", None, None), (1, 5, 0, 150, 40, 170, "text", "Delete", None, None),
]


def elements(spark):
    kind = "state_id int, elem_id int, x1 int, y1 int, x2 int, y2 int, visual_type string, text string, label string, hint string"
    return spark.createDataFrame(ELEMENTS, kind).withColumn("role", F.col("visual_type"))


def test_reasons_and_checks(spark):
    asked = spark.createDataFrame(
        [("a", 1, "save button"), ("b", 1, "delete"), ("c", 1, "savf button"), ("d", 1, "page 3"), ("e", 1, "savf button at the right"), ("f", 1, None), ("g", 9, "save"), ("h", 1, "the"), ("i", 1, "delete at the left")],
        "step string, state_id int, description string",
    )
    w, h = F.lit(400), F.lit(200)
    got = {r.step: r for r in C.resolve(asked, elements(spark), [C.lexical(width=w, height=h), C.spelling()], width=w, height=h).collect()}
    assert {s: (r.elem_id, r.tier, r.cost) for s, r in got.items()} == {
        "a": (1, "lexical", 0.0), "b": (None, None, 1.0), "c": (1, "spelling", 1.0), "d": (None, None, 1.0), "e": (None, None, 1.0), "f": (None, None, 1.0), "g": (None, None, 1.0), "h": (None, None, 1.0), "i": (None, None, 1.0),
    }
    assert got["b"].reason == "no confident match (lexical: tie at 2.50 between 2 candidates; spelling: 2 captions at 0 edits)"
    assert "picked 3 without a number that is named" in got["d"].reason and "picked 1 outside the described position" in got["e"].reason
    assert got["f"].reason == "no confident match (lexical: no answer; spelling: no answer)"
    assert {(r.tier, r.n) for r in C.by_tier(C.resolve(asked, elements(spark), [C.spelling()])).collect()} == {("spelling", 3), ("none", 6)}


def test_a_tier_is_asked_about_open_rows_once(spark):
    seen = []

    def first(asked, _):
        seen.append(sorted(r.step for r in asked.collect()))
        return asked.where("step < 'c'").select("step", "state_id", F.lit(4).alias("elem_id"), F.lit("sure").alias("reason"))

    def second(asked, _):
        seen.append(sorted(r.step for r in asked.collect()))
        return asked.select("step", "state_id", F.lit(3).alias("elem_id"), F.lit("guess").alias("reason"))

    asked = spark.createDataFrame([(s, 1, f"thing {s}") for s in "abcd"], "step string, state_id int, description string")
    got = C.resolve(asked, elements(spark), [C.Tier("x", first, 2.0), C.Tier("y", second, 5.0)])
    assert {(r.step, r.elem_id, r.tier, r.reason, r.cost) for r in got.collect()} == {("a", 4, "x", "x: sure", 2.0), ("b", 4, "x", "x: sure", 2.0), ("c", 3, "y", "y: guess", 7.0), ("d", 3, "y", "y: guess", 7.0)}
    assert seen == [["a", "b", "c", "d"], ["c", "d"]]
    assert C.resolve(asked.where("false"), elements(spark), [C.lexical(), C.spelling()]).collect() == []
    assert {r.tier for r in C.resolve(asked, elements(spark), []).collect()} == {None}


def test_tiers_of_one_screen_need_no_table_of_all_rows(spark, monkeypatch):
    """Rows of questions are neither cut off in a table between the tiers nor shuffled again after
    they met their screen."""
    asked = spark.createDataFrame([(s, 1, d) for s, d in [("a", "save button"), ("b", "savf button"), ("b", "savf button"), ("c", "delete at the left"), ("d", None)]], "step string, state_id int, description string")

    def never(df):
        raise AssertionError("a table of all rows was written")

    monkeypatch.setattr(C, "checkpoint", never)
    w, h = F.lit(400), F.lit(200)
    got = C.resolve(asked, elements(spark), [C.lexical(width=w, height=h), C.spelling()], width=w, height=h)
    assert sorted((r.step, r.elem_id, r.tier) for r in got.collect() if r.tier) == [("a", 1, "lexical"), ("b", 1, "spelling"), ("b", 1, "spelling")]
    assert len(got.collect()) == 5
    assert got._jdf.queryExecution().sparkPlan().toString().count("Join") == 1


def test_a_table_tier_between_tiers_of_one_screen(spark):
    asked = spark.createDataFrame([(s, 1, d) for s, d in [("a", "save button"), ("b", "savf button"), ("c", "zzz"), ("d", "page 3")]], "step string, state_id int, description string")
    guess = lambda rows, _: rows.select("step", "state_id", F.when(F.col("step") != "b", 3).alias("elem_id"), F.lit("guess").alias("reason"))
    got = {r.step: (r.elem_id, r.tier, r.cost) for r in C.resolve(asked, elements(spark), [C.lexical(), C.Tier("guess", guess, 2.0), C.spelling()]).collect()}
    assert got == {"a": (1, "lexical", 0.0), "b": (1, "spelling", 3.0), "c": (3, "guess", 2.0), "d": (None, None, 3.0)}

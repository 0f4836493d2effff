"""Readers of screens and labels as DataFrames, and the writers that go with them.

All readers take a path that Spark reads (a folder, a glob or a file); the screen's id is the
file's stem.  Boxes come out as columns x1, y1, x2, y2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import tree

_NODE = "id string, bounds array<int>, visual_type string, type string, text string, ocr_text string, content string, label string, hint string, role string, confidence double, interactable boolean, source string, parent_id string"

# Types of other formats in the types of the detectors.
YOLO_CLASSES = {"EditText": "input_field", "Button": "button", "CheckBox": "checkbox", "ImageView": "icon", "TextView": "text"}


def stem() -> Column:
    """Name of the file that a row was read from, without folder and ending."""
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def _element(e: Column) -> list[Column]:
    return [
        e["id"].alias("elem_key"), G.from_list(e["bounds"]).alias("box"),
        F.coalesce(X.present(e["visual_type"]), X.present(e["type"]), F.lit("unknown")).alias("visual_type"),
        F.coalesce(X.present(e["ocr_text"]), X.present(e["text"]), X.present(e["content"])).alias("text"),
        *[X.present(e[c]).alias(c) for c in ("label", "hint", "role", "source")], e["confidence"].alias("confidence"), e["interactable"].alias("interactable"), e["parent_id"].alias("parent_key"),
    ]


def read_screens(spark: SparkSession, path: str) -> DataFrame:
    """Elements of JSON screens, one file each: a flat ``elements`` list, or else a nested
    ``hierarchy`` in pre-order, either of them also under ``dom``."""
    raw = spark.read.text(path, wholetext=True).select(stem().alias("state_id"), F.col("value"))
    body = F.coalesce(F.get_json_object("value", "$.dom"), F.col("value"))
    flat = F.get_json_object(body, "$.elements")
    parts = raw.select("state_id", flat.alias("flat"), tree.flatten_json(F.when(flat.isNull(), F.col("value"))).alias("nodes"))
    nodes = F.transform("nodes", lambda n: F.from_json(n, _NODE))
    nested = F.filter(nodes, lambda n: F.coalesce(F.upper(n["id"]), F.lit("")) != "ROOT")
    elements = F.when(F.col("flat").isNotNull(), F.from_json("flat", f"array<struct<{_fields()}>>")).otherwise(nested)
    rows = parts.select("state_id", F.posexplode(elements).alias("elem_id", "e"))
    return rows.select("state_id", (F.col("elem_id") + 1).alias("elem_id"), *_element(F.col("e"))).select("state_id", "elem_id", "elem_key", "box.*", "visual_type", "text", "label", "hint", "role", "source", "confidence", "interactable", "parent_key")


def _fields() -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.split(" ") for f in _NODE.split(", ")))


def read_pairs(spark: SparkSession, predictions: str, labels: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predicted, truth, skipped): screens that both folders have, and those without labels."""
    pred, gt = read_screens(spark, predictions), read_screens(spark, labels)
    have = gt.select("state_id").distinct()
    return pred.join(have, "state_id", "left_semi"), gt.join(pred.select("state_id").distinct(), "state_id", "left_semi"), pred.select("state_id").distinct().join(have, "state_id", "left_anti")


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    """(state_id, class_id, cx, cy, w, h) of YOLO label lines; comments and short lines go."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(stem().alias("state_id"), F.split(F.trim("value"), r"\s+").alias("f"), F.trim("value").alias("line"))
    kept = lines.where(~F.col("line").startswith("#") & (F.size("f") >= 5))
    number = lambda i: F.expr(f"try_cast(f[{i}] AS double)")
    return kept.select("state_id", F.expr("try_cast(f[0] AS int)").alias("class_id"), *[number(i).alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)])


def yolo_boxes(labels: DataFrame, image_width: Column, image_height: Column) -> DataFrame:
    """Pixel boxes of normalised labels."""
    b = G.from_centre(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    px = lambda c, size: F.round(c * size).cast("int")
    return labels.withColumns({"x1": px(b.x1, image_width), "y1": px(b.y1, image_height), "x2": px(b.x2, image_width), "y2": px(b.y2, image_height)})


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """(image, class_name, x1, y1, x2, y2, width, height) of COCO files; annotations of
    unknown images or categories go."""
    schema = "images array<struct<id: long, file_name: string, width: int, height: int>>, categories array<struct<id: long, name: string>>, annotations array<struct<image_id: long, category_id: long, bbox: array<double>>>"
    doc = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("file", F.input_file_name())
    images = doc.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    classes = doc.select("file", F.explode("categories").alias("c")).select("file", F.col("c.id").alias("category_id"), F.col("c.name").alias("class_name"))
    boxes = doc.select("file", F.explode("annotations").alias("a")).select("file", "a.*")
    at = lambda i: F.try_element_at("bbox", F.lit(i))
    joined = boxes.join(images, ["file", "image_id"]).join(classes, ["file", "category_id"])
    return joined.select(F.col("file_name").alias("image"), "class_name", at(1).alias("x1"), at(2).alias("y1"), (at(1) + at(3)).alias("x2"), (at(2) + at(4)).alias("y2"), "width", "height")


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """The same of Pascal VOC files."""
    schema = "filename string, size struct<width: int, height: int>, object array<struct<name: string, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
    doc = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    b = F.col("o.bndbox")
    return doc.select("filename", "size", F.explode("object").alias("o")).select(F.col("filename").alias("image"), F.col("o.name").alias("class_name"), b["xmin"].alias("x1"), b["ymin"].alias("y1"), b["xmax"].alias("x2"), b["ymax"].alias("y2"), "size.width", "size.height")


def read_label_studio(spark: SparkSession, path: str) -> DataFrame:
    """(image, annotation_id, when, results, x, y, w, h, class_name, origin) of exported
    annotations, in percent: task lists and single annotations alike.  Of an image only the
    latest annotation stays (of equals the one with more results); cancelled ones and files
    that can't be read give no rows."""
    value = "struct<x: double, y: double, width: double, height: double, rectanglelabels: array<string>>"
    result = f"array<struct<type: string, origin: string, value: {value}>>"
    note = f"struct<id: long, updated_at: string, created_at: string, was_cancelled: boolean, result: {result}, task: struct<data: struct<image: string>>>"
    task = f"struct<data: struct<image: string>, annotations: array<{note}>>"
    raw = spark.read.text(path, wholetext=True)
    tasks = raw.select(F.explode_outer(F.from_json("value", f"array<{task}>")).alias("t")).select("t.data.image", F.explode("t.annotations").alias("a"))
    single = raw.select(F.from_json("value", note).alias("a")).select(F.col("a.task.data.image").alias("image"), "a")
    both = tasks.unionByName(single).where("image is not null and a.result is not null and not coalesce(a.was_cancelled, false)")
    name = F.regexp_extract("image", r"([^/\\]+)$", 1)
    dated = both.select(name.alias("image"), "a", F.coalesce("a.updated_at", "a.created_at", F.lit("")).alias("when"))
    latest = dated.groupBy("image").agg(F.max_by(F.struct("a", "when"), F.struct("when", F.size("a.result"))).alias("m"))
    rows = latest.select("image", F.col("m.a.id").alias("annotation_id"), "m.when", F.explode("m.a.result").alias("r"))
    return rows.select("image", "annotation_id", "when", *[F.col(f"r.value.{c}").alias(n) for c, n in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))], F.try_element_at("r.value.rectanglelabels", F.lit(1)).alias("class_name"), "r.origin")


def parse_markup(rows: DataFrame, text: str, width: Column, height: Column) -> DataFrame:
    """Elements of ``<tag><loc_l><loc_t><loc_r><loc_b>caption`` markup on a grid of 0 to 500,
    clamped to it; boxes without area and exact repeats go."""
    pattern = r"<(\w+)><loc_(\d+)><loc_(\d+)><loc_(\d+)><loc_(\d+)>([^<]*)"
    group = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    zipped = F.arrays_zip(*[group(k).alias(n) for k, n in enumerate(("tag", "l", "t", "r", "b", "caption"), 1)])
    found = rows.select("*", F.posexplode(zipped).alias("elem_id", "m"))
    pos = lambda c, size: F.round(F.least(F.col(f"m.{c}").cast("int"), F.lit(500)) / 500.0 * size).cast("int")
    out = found.select(*rows.columns, "elem_id", F.lower("m.tag").alias("visual_type"), pos("l", width).alias("x1"), pos("t", height).alias("y1"), pos("r", width).alias("x2"), pos("b", height).alias("y2"), F.nullif(F.trim("m.caption"), F.lit("")).alias("text"))
    keys = [c for c in rows.columns if c != text] + ["visual_type", "x1", "y1", "x2", "y2", "text"]
    return out.where("x2 > x1 and y2 > y1").drop(text).groupBy(*keys).agg(F.min("elem_id").alias("elem_id"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(benchmark, executor, step, kind, hit, correct, false_pass, latency) of result files;
    of each benchmark and executor the file with the last name counts."""
    step = "struct<step: string, kind: string, hit: boolean, correct: boolean, false_pass: boolean, latency: double>"
    schema = f"benchmark string, results map<string, struct<steps: array<{step}>>>"
    doc = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("file", F.input_file_name())
    each = doc.select("benchmark", "file", F.explode("results").alias("executor", "r"))
    last = each.groupBy("benchmark", "executor").agg(F.max_by("r", "file").alias("r"))
    return last.select("benchmark", "executor", F.explode("r.steps").alias("s")).select("benchmark", "executor", "s.*")


# --- writers ----------------------------------------------------------------------------


def screens(elements: DataFrame, version: str = "1.0") -> DataFrame:
    """One row for each screen, ready for JSON: nulls are left out by the writer."""
    cx, cy = G.floor_centre(G.box())
    rest = [c for c in elements.columns if c not in ("state_id", "elem_id", "x1", "y1", "x2", "y2")]
    item = F.struct("elem_id", F.array("x1", "y1", "x2", "y2").alias("bounds"), F.array(cx, cy).alias("center"), *rest)
    return elements.groupBy("state_id").agg(F.lit(version).alias("version"), F.count("*").alias("element_count"), F.sort_array(F.collect_list(item)).alias("elements"))


def write_screens(elements: DataFrame, path: str) -> None:
    screens(elements).write.mode("overwrite").json(path)


def write_yolo(elements: DataFrame, path: str, classes: list[str], image_width: int, image_height: int) -> None:
    """Text lines ``class cx cy w h`` in a folder for each screen; unknown types go."""
    table = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *[F.format_string("%.6f", c) for c in ("cx", "cy", "w", "h")])
    rows = elements.select("state_id", F.try_element_at(table, F.col("visual_type")).alias("class_id"), *G.to_yolo(G.box(), F.lit(float(image_width)), F.lit(float(image_height))))
    rows.where("class_id is not null").select("state_id", line.alias("value")).write.mode("overwrite").partitionBy("state_id").text(path)


def robot_lines(elements: DataFrame) -> DataFrame:
    """(state_id, elem_id, line): a variable with a locator for each named element."""
    from ..operators.elements import default_locator, unique_names

    named = unique_names(elements.where("text is not null"), "text", ["state_id"], "elem_id")
    locator = default_locator(F.col("text"), F.col("hint"), F.col("role"), F.col("elem_id"))
    return named.select("state_id", "elem_id", F.concat(F.lit("${"), "unique_name", F.lit("}    "), locator).alias("line"))


def markdown(df: DataFrame, title: str, most_rows: int = 200) -> str:
    """A report table of a small aggregate; longer ones are refused rather than cut."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report has at most {most_rows} rows")
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v)
    body = ["| " + " | ".join(map(show, r)) + " |" for r in rows]
    return "\n".join([f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *body, ""])

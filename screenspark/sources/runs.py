"""Benchmark manifests, run folders, sessions and accessibility exports, and the files of a run."""

from __future__ import annotations

import html
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import elements as E
from .annotations import stem

_BOX = "array<int>"
# Field names of a manifest.
_STEP = f"id string, state string, kind string, action string, locator string, instruction string, description string, target_id string, target_bounds {_BOX}, negative boolean, negative_kind string"
_STATE = f"id string, image string, gt string, image_size {_BOX}"

# Control types of an accessibility export whose names are read as texts.
NAMED_CONTROLS = ["Text", "Edit", "Button", "CheckBox", "ComboBox"]


def _colons(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(", "))


def folder(depth: int = 1):
    """Name of the folder that a row's file lies in, ``depth`` levels up."""
    return F.try_element_at(F.split(F.input_file_name(), "/"), F.lit(-1 - depth))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(steps, states) of manifests, each with the benchmark that its file names."""
    schema = f"benchmark string, states array<struct<{_colons(_STATE)}>>, steps array<struct<{_colons(_STEP)}>>"
    doc = spark.read.option("multiLine", True).schema(schema).json(path)
    steps = doc.select("benchmark", F.explode("steps").alias("s")).select("benchmark", "s.*")
    return steps, doc.select("benchmark", F.explode("states").alias("s")).select("benchmark", "s.*")


def manifest_labels(states: DataFrame, screens: DataFrame) -> DataFrame:
    """The labelled elements of the states of a manifest, found by the name of their file."""
    named = states.select(F.col("id").alias("state"), F.regexp_extract("gt", r"([^/\\]+?)(?:\.[A-Za-z0-9]+)?$", 1).alias("state_id"))
    return screens.join(named, "state_id")


def newest_screens(screens: DataFrame, run: str = "run") -> DataFrame:
    """Of screens that several runs have dumped, those of the newest run (the last name)."""
    last = screens.groupBy("state_id").agg(F.max(run).alias(run))
    return screens.join(last, ["state_id", run])


def read_accessibility(spark: SparkSession, path: str) -> DataFrame:
    """(state_id, elem_id, text, control, class_name, x, y, w, h): named controls of accessibility
    exports in XML, in the order of the file; a rectangle that isn't four numbers has no box."""
    raw = spark.read.text(path, wholetext=True).select(stem().alias("state_id"), F.col("value"))
    nodes = F.regexp_extract_all("value", F.lit(r"(?s)<properties>(.*?)</properties>"), F.lit(1))
    pairs = F.regexp_extract_all("node", F.lit(r"<property\b([^>]*)>"), F.lit(1))
    attribute = lambda c, name: F.regexp_extract(c, rf'\b{name}="([^"]*)"', 1)
    said = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(attribute(p, "displayName").alias("k"), _unescaped(attribute(p, "value")).alias("v")))))
    found = raw.select("state_id", F.posexplode(nodes).alias("elem_id", "node")).select("state_id", "elem_id", said.alias("p"))
    value = lambda k: F.try_element_at("p", F.lit(k))
    sides = F.transform(F.split(value("BoundingRectangle"), ","), lambda x: F.trim(x).try_cast("int"))
    fits = (F.size(sides) == 4) & ~F.exists(sides, lambda x: x.isNull())
    kept = found.where(X.present(value("Name")).isNotNull() & value("AutomationControlType").isin(NAMED_CONTROLS))
    side = lambda i: F.when(fits, F.try_element_at(sides, F.lit(i)))
    return kept.select("state_id", "elem_id", F.trim(value("Name")).alias("text"), F.lower(value("AutomationControlType")).alias("control"), value("ClassName").alias("class_name"), *[side(i).alias(n) for i, n in enumerate("xywh", 1)])


def _unescaped(c):
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def read_sessions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, timestamp, element_count, window_title, capture_source, detector, width, height) of
    session folders that hold a result, newest name first; with a limit that many.  A session
    without a readable note of its capture has nulls."""
    schema = "timestamp string, element_count long, window_title string, capture_source string, detector string, cv_stats struct<detector: string>, image_size struct<width: int, height: int>"
    results = spark.read.format("binaryFile").option("pathGlobFilter", "dom_result.json").option("recursiveFileLookup", True).load(path)
    have = results.select(F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("id")).distinct()
    notes = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "session_info.json").schema(schema).json(path).withColumn("id", folder())
    info = notes.select("id", "timestamp", "element_count", "window_title", "capture_source", F.coalesce("cv_stats.detector", "detector").alias("detector"), "image_size.width", "image_size.height")
    rows = have.join(info, "id", "left").orderBy(F.desc("id"))
    return rows if limit is None else rows.limit(limit)


def session_view(screens: DataFrame, on: str = "state_id") -> DataFrame:
    """Elements with the locator that an exporter writes for each."""
    return screens.withColumn("locator", E.default_locator(F.col("text"), F.col("hint"), F.col("role"), F.col("elem_key")))


def read_tarballs(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of the files in packed runs.  An archive with a member that would
    land outside of it is refused; characters that some file systems can't hold become _."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")

    def unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["archive"], frame["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        parts = member.name.split("/")
                        if member.name.startswith(("/", "..")) or ".." in parts:
                            raise ValueError(f"{archive}: unsafe member {member.name}")
                        if member.isfile():
                            name = "".join("_" if c in '<>:"\\|?*' else c for c in member.name)
                            yield pd.DataFrame({"archive": [archive], "name": [name], "content": [tar.extractfile(member).read()]})

    return raw.mapInPandas(unpacked, "archive string, name string, content binary")


# --- writers ----------------------------------------------------------------------------


def write_results(results: DataFrame, path: str, benchmark: str) -> None:
    """One JSON row for each benchmark and executor, with its steps, in the shape that
    ``read_results`` reads back; a folder for each executor."""
    step = F.struct(*[c for c in results.columns if c != "executor"])
    rows = results.groupBy("executor").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    doc = rows.select(F.lit(benchmark).alias("benchmark"), F.create_map("executor", F.struct("steps")).alias("results"), F.col("executor").alias("_executor"))
    doc.write.mode("overwrite").partitionBy("_executor").json(path)


def write_training(prompts: DataFrame, edits: DataFrame, path: str, on: str = "state_id") -> None:
    """JSON lines of (elements, edits), one for each screen: prompt and the list of its edits."""
    change = F.struct(*[c for c in edits.columns if c != on])
    listed = edits.groupBy(on).agg(F.sort_array(F.collect_list(change)).alias("edits"))
    rows = prompts.join(listed, on, "left").select(F.col("prompt").alias("elements"), F.coalesce("edits", F.array()).alias("edits"))
    rows.write.mode("overwrite").json(path)


def write_sessions(screens: DataFrame, info: DataFrame, path: str) -> None:
    """Sessions as a table: a folder for each, with its elements and its note."""
    screens.join(info, "session_id").write.mode("overwrite").partitionBy("session_id").json(path)


def _few(df: DataFrame, most_rows: int) -> list:
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report has at most {most_rows} rows")
    return rows


def report_json(df: DataFrame, most_rows: int = 200) -> str:
    """A small aggregate as a JSON list; longer ones are refused rather than cut."""
    return "[" + ", ".join(r["j"] for r in _few(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")), most_rows)) + "]"


def report_html(df: DataFrame, title: str, most_rows: int = 200) -> str:
    """The same as a page with one table."""
    show = lambda v: html.escape(f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v))
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{show(c)}</{tag}>" for c in cells) + "</tr>"
    body = "\n".join(row(r, "td") for r in _few(df, most_rows))
    return f"<!doctype html>\n<title>{html.escape(title)}</title>\n<h1>{html.escape(title)}</h1>\n<table>\n{row(df.columns, 'th')}\n{body}\n</table>\n"


def review_sheet(elements: DataFrame, absent: DataFrame, on: str = "state_id") -> DataFrame:
    """(on, sheet): a page for each screen with its boxes as rectangles and the captions that it
    must not have."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    box = F.format_string('<rect x="%d" y="%d" width="%d" height="%d"/><text x="%d" y="%d">%s</text>', "x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), "x1", "y2", safe(F.col("text")))
    drawn = elements.groupBy(on).agg(F.sort_array(F.collect_list(F.struct("elem_id", box.alias("b")))).alias("b"), F.max("x2").alias("w"), F.max("y2").alias("h"))
    never = absent.groupBy(on).agg(F.array_join(F.sort_array(F.collect_set(safe(F.col("caption")))), "</li><li>").alias("c"))
    page = F.concat(F.format_string('<h1>%s</h1><svg viewBox="0 0 %d %d">', F.col(on).cast("string"), "w", "h"), F.array_join(F.transform("b", lambda b: b["b"]), ""), F.lit("</svg><ul><li>"), F.coalesce("c", F.lit("")), F.lit("</li></ul>"))
    return drawn.join(never, on, "left").select(on, page.alias("sheet"))


def latest_definitions(saved: DataFrame) -> DataFrame:
    """Of the definitions of one name the one saved last."""
    place = Window.partitionBy("name").orderBy(F.desc("saved_at"))
    return saved.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")

"""Roles, names and lines of elements, as a prompt or another program reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from . import fusion

# Types and the roles that go with them.
ROLES = {
    "button": "Button", "input_field": "EditText", "checkbox": "CheckBox", "icon": "ImageView", "text": "TextView",
    "container": "ViewGroup", "block": "ViewGroup", "image": "ImageView",
}

# Words in a text that make it a button's.
BUTTON_WORDS = ["login", "sign", "submit", "cancel", "ok", "next", "back"]

# Classes of a detector and the types that they stand for.
CLASS_TYPES = {
    "button": "button", "text": "text", "icon": "icon", "input_field": "input_field", "checkbox": "checkbox", "radio_button": "checkbox",
    "toggle": "checkbox", "slider": "input_field", "dropdown": "input_field", "image": "image", "container": "container",
    "toolbar": "container", "navbar": "container", "card": "container", "list_item": "container",
}

# Kinds of the shape detector and the types that they stand for.
SHAPE_TYPES = {
    "block": "container", "button": "button", "text": "text", "icon": "icon", "input_field": "input_field", "checkbox": "checkbox", "image": "image", "divider": "divider",
}


def mapped(value: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value), F.lit(other))


def class_type(name: Column) -> Column:
    return mapped(F.lower(name), CLASS_TYPES, "unknown")


def shape_type(kind: Column) -> Column:
    return mapped(kind, SHAPE_TYPES, "unknown")


def role(visual_type: Column, text: Column) -> Column:
    """The role of a type; a text with a word of a button is one."""
    button = F.coalesce(F.lower(text).rlike("|".join(BUTTON_WORDS)), F.lit(False)) & (visual_type == "text")
    return F.when(button, "Button").otherwise(mapped(visual_type, ROLES, "View"))


def with_labels(df: DataFrame, labels: DataFrame, on: str = "state_id") -> DataFrame:
    """Adds ``label`` (an element's own trimmed text, where it has none) and ``hint`` (that of an
    input field is the text of its label), given labels (on, elem_id, label_id)."""
    texts = df.select(on, F.col("elem_id").alias("label_id"), X.present(F.col("text")).alias("_named"))
    hinted = labels.join(texts, [on, "label_id"]).groupBy(on, "elem_id").agg(F.min("_named").alias("_named"))
    both = df.join(hinted, [on, "elem_id"], "left")
    own = F.coalesce("label", X.present(F.trim("text")))
    hint = F.when((F.col("visual_type") == "input_field") & F.col("_named").isNotNull(), F.col("_named")).otherwise(F.col("hint"))
    return both.withColumns({"label": own, "hint": hint}).drop("_named")


def captions(df: DataFrame, edges: DataFrame, on: str = "state_id") -> DataFrame:
    """(on, elem_id, caption): an element's own text, or that of its first text child; '' where
    there is none."""
    own = X.present(F.trim("text"))
    child = df.where("visual_type = 'text'").select(on, "elem_id", own.alias("own")).where("own is not null").join(edges, [on, "elem_id"])
    first = child.groupBy(on, F.col("parent_id").alias("elem_id")).agg(F.min_by("own", "elem_id").alias("child"))
    return df.select(on, "elem_id", own.alias("own")).join(first, [on, "elem_id"], "left").select(on, "elem_id", F.coalesce("own", "child", F.lit("")).alias("caption"))


def properties(df: DataFrame) -> Column:
    """What a definition of an element may name: a map of texts."""
    cx, cy = G.floor_centre(G.box())
    say = lambda c: c.cast("string")
    made = {
        "text": F.col("text"), "type": F.col("visual_type"), "id": say(F.col("elem_id")), "confidence": F.format_number("confidence", 2),
        "bbox": F.format_string("%d,%d,%d,%d", "x1", "y1", "x2", "y2"), "center": F.format_string("%d,%d", cx, cy),
        "x": say(F.col("x1")), "y": say(F.col("y1")), "width": say(G.width(G.box())), "height": say(G.height(G.box())),
    }
    return F.map_filter(F.create_map(*[x for k, v in made.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def read_property(fields: Column, locators: Column, name: str, default: Column) -> Column:
    """A field by name, case aside; else a locator of that name, else the default.  A name after
    ``locators.`` is looked up there alone."""
    low = name.lower()
    find = lambda m, key: F.try_element_at(F.map_values(F.map_filter(m, lambda k, _: F.lower(k) == key)), F.lit(1))
    if low.startswith("locators."):
        return F.coalesce(find(locators, low.removeprefix("locators.")), default)
    return F.coalesce(find(fields, low), find(locators, low), default)


def to_device(x: Column, y: Column, width: Column, height: Column) -> list[Column]:
    """Pixels of a place given as shares of the screen, clamped to it."""
    share = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return [F.bround(share(x) * width).cast("int").alias("px"), F.bround(share(y) * height).cast("int").alias("py")]


def _shown(start: Column) -> Column:
    return F.concat(start, F.coalesce(F.concat(F.lit(' "'), X.present(F.col("text")), F.lit('"')), F.lit("")))


def element_line(width: float, height: float) -> Column:
    """``3: button "Save" [left-top, small]``."""
    cx, cy = G.centre_x(G.box()) / width, G.centre_y(G.box()) / height
    share = G.area(G.box()) / (width * height)
    across = F.when(cx < 0.33, "left").when(cx > 0.66, "right").otherwise("center")
    down = F.when(cy < 0.33, "top").when(cy > 0.66, "bottom").otherwise("middle")
    size = F.when(share < 0.01, "small").when(share > 0.1, "large").otherwise("medium")
    return F.concat(_shown(F.concat_ws(": ", F.col("elem_id").cast("string"), "visual_type")), F.lit(" ["), across, F.lit("-"), down, F.lit(", "), size, F.lit("]"))


def prompt_lines(df: DataFrame, on: str = "state_id") -> DataFrame:
    """(on, prompt): a line for each element of a screen, from top to bottom, with its place
    beside a neighbour and without coordinates."""
    hinted = df.join(fusion.neighbour_hint(df, on).withColumnRenamed("hint", "_hint"), [on, "elem_id"], "left")
    line = F.concat_ws(" ", F.concat_ws(": ", F.col("elem_id").cast("string"), "visual_type"), F.concat(F.lit("'"), X.present(F.col("text")), F.lit("'")), F.concat(F.lit("("), "_hint", F.lit(")")))
    rows = F.sort_array(F.collect_list(F.struct("y1", "x1", "elem_id", line.alias("line"))))
    return hinted.groupBy(on).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("prompt"))


def training_labels(df: DataFrame, on: str = "state_id") -> DataFrame:
    """(on, n_elements, n_with_text, n_interactive, types): what a made screen's label says of it."""
    counts = df.groupBy(on, "visual_type").agg(F.count("*").alias("n"), F.count_if(X.present(F.col("text")).isNotNull()).alias("named"))
    live = F.sum(F.when(F.col("visual_type").isin("button", "input_field", "checkbox", "icon"), F.col("n")).otherwise(0))
    return counts.groupBy(on).agg(F.sum("n").alias("n_elements"), F.sum("named").alias("n_with_text"), live.alias("n_interactive"), F.count("*").alias("types"))

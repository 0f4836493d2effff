"""Filters, roles and derived columns of the element table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as X

# Sources whose own detectors have applied a confidence threshold.
TRUSTED_SOURCES = ["omniparser", "modular"]

# Types that can be clicked.
CLICKABLE = ["button", "checkbox", "icon"]

# Words in a caption that mark a checkbox.
CHECK_WORDS = "check|tick|toggle|radio|switch|selected"


def size_filter(df: DataFrame, image_height: Column | None = None, confidence: float = 0.3, least_area: int = 100, least_side: int = 10, aspect: float = 20.0) -> DataFrame:
    """Drops weak, tiny and thin boxes; lengths scale with the image's height."""
    b = G.box()
    s = G.scale(image_height) if image_height is not None else F.lit(1.0)
    sure = (F.col("confidence") >= confidence) | F.col("source").isin(TRUSTED_SOURCES)
    large = (G.area(b) >= least_area * s * s) | (F.col("visual_type") == "text")
    sides = (G.width(b) >= least_side * s) & (G.height(b) >= least_side * s)
    ratio = F.greatest(G.width(b), G.height(b)) / F.greatest(F.least(G.width(b), G.height(b)), F.lit(1))
    return df.where(sure & large & sides & ((ratio <= aspect) | F.col("visual_type").isin("divider", "text")))


def infer_role(raw: Column, interactable: Column, caption: Column, w: Column, h: Column, image_height: Column) -> Column:
    """A type from the raw class, the interactive flag, the caption and the box's shape."""
    s = G.scale(image_height)
    text = F.trim(F.coalesce(caption, F.lit("")))
    named, ratio, longer = text != "", w / F.greatest(h, F.lit(1)).cast("double"), F.greatest(w, h)
    live = F.coalesce(interactable, F.lit(False))
    plain = (raw == "text") & ~live
    actionable = live | (raw == "icon")
    control = (
        F.when((ratio >= 3.0) & (h >= 22 * s), "input_field")
        .when(named & F.lower(text).rlike(CHECK_WORDS), "checkbox")
        .when(named & (w >= 82 * s) & (ratio >= 1.3), "button")
        .when((ratio <= 1.35) & (longer <= 78 * s), "icon")
        .when(named & (ratio >= 1.3) & (h >= 18 * s), "button")
        .when(longer <= 46 * s, "icon")
        .when(named, "button")
        .otherwise("icon")
    )
    return F.when(plain, "text").when(actionable, control).otherwise("icon")


def flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"clickable": F.col("visual_type").isin(CLICKABLE), "editable": F.col("visual_type") == "input_field", "scrollable": F.lit(False)})


def locators(df: DataFrame, on: str = "state_id", order: str = "elem_id") -> DataFrame:
    """Adds ``locators``: id, text (with an index where it repeats), type index, bounds and
    centre."""
    by_text, by_type = Window.partitionBy(on, "text").orderBy(order), Window.partitionBy(on, "visual_type").orderBy(order)
    count = F.count(F.lit(1)).over(Window.partitionBy(on, "text"))
    indexed = lambda c, w: F.format_string("%s[%d]", c, F.row_number().over(w) - 1)
    shown = X.present(F.col("text"))
    text = F.when(shown.isNull(), F.lit(None)).when(count == 1, shown).otherwise(indexed(shown, by_text))
    cx, cy = G.floor_centre(G.box())
    made = F.create_map(
        F.lit("id"), F.col(order).cast("string"), F.lit("text"), text, F.lit("type_index"), indexed(F.col("visual_type"), by_type),
        F.lit("bounds"), F.format_string("bounds(%d,%d,%d,%d)", "x1", "y1", "x2", "y2"), F.lit("center"), F.format_string("point(%d,%d)", cx, cy),
    )
    return df.withColumn("locators", F.map_filter(made, lambda _, v: v.isNotNull()))


def default_locator(text: Column, hint: Column, role: Column, elem_id: Column) -> Column:
    """What names an element best: text or hint, its role, and its id to fall back on."""
    name = F.coalesce(F.concat(F.lit("text="), X.quoted(X.present(text))), F.concat(F.lit("hint="), X.quoted(X.present(hint))))
    kind = F.when(F.lower(role) != "unknown", F.concat(F.lit("role="), F.lower(role)))
    main = F.concat_ws(" ", name, kind)
    return F.when(main == "", F.concat(F.lit("id="), elem_id.cast("string"))).otherwise(F.concat(main, F.lit(" || id="), elem_id.cast("string")))


def text_first(df: DataFrame, limit: int = 200, on: str = "state_id") -> DataFrame:
    """The first elements of each screen: texts with content by confidence, then the rest."""
    shown = (F.col("visual_type") == "text") & X.present(F.col("text")).isNotNull()
    w = Window.partitionBy(on).orderBy(shown.cast("int").desc(), F.desc("confidence"), "elem_id")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def absorbed_texts(df: DataFrame, on: str = "state_id", share: float = 0.7) -> DataFrame:
    """Drops a text that lies within an element that reads the same."""
    hosts = df.where(~F.col("visual_type").isin("text", "block") & X.present(F.col("text")).isNotNull())
    same = (X.normal(F.col("a.text")) == X.normal(F.col("b.text"))) & (F.col(f"a.{on}") == F.col(f"b.{on}"))
    texts = df.where("visual_type = 'text'").alias("a").join(hosts.alias("b"), same & G.is_contained(G.box("a"), G.box("b"), share), "left_anti")
    return df.where("visual_type <> 'text' or visual_type is null").unionByName(texts)


def unique_names(df: DataFrame, name: str, by: list[str], order: str) -> DataFrame:
    """Adds ``unique_name``: an identifier from a name, numbered from _1 where it repeats."""
    w = Window.partitionBy(*by, "_clean").orderBy(order)
    numbered = df.withColumn("_clean", X.clean_name(F.col(name))).withColumn("_n", F.row_number().over(w) - 1)
    return numbered.withColumn("unique_name", F.when(F.col("_n") == 0, F.col("_clean")).otherwise(F.concat_ws("_", "_clean", "_n"))).drop("_clean", "_n")


def merge_group(by: list[str], df: DataFrame) -> DataFrame:
    """One element for each group: union box, longest text, best type, any interactive."""
    from .greedy import type_rank

    return df.groupBy(*by).agg(
        *G.union_aggregates(),
        F.max_by("text", F.struct(F.length("text").alias("n"), (-F.col("elem_id")).alias("o"))).alias("text"),
        F.max_by("visual_type", F.struct(type_rank(F.col("visual_type")).alias("r"), (-F.col("elem_id")).alias("o"))).alias("visual_type"),
        F.max("confidence").alias("confidence"), F.min("elem_id").alias("elem_id"), F.bool_or("interactable").alias("interactable"),
    )


def validity(df: DataFrame, image_width: int, image_height: int) -> DataFrame:
    """Adds ``issues``: what is wrong with a normalised box."""
    cx, cy, w, h = ((G.centre_x(G.box()) / image_width), (G.centre_y(G.box()) / image_height), G.width(G.box()) / image_width, G.height(G.box()) / image_height)
    issue = lambda test, name: F.when(test, F.lit(name))
    outside = ~(cx.between(0, 1) & cy.between(0, 1) & w.between(0, 1) & h.between(0, 1))
    return df.withColumn("issues", F.array_compact(F.array(issue(outside, "outside"), issue((w < 0.01) | (h < 0.01), "tiny"), issue((w > 0.9) | (h > 0.9), "huge"))))


def twins(names: DataFrame, name: str) -> DataFrame:
    """(base, variant): names that are another's with one more pair of brackets at the end."""
    variants = names.where(F.col(name).rlike(r"\[[^\]]*\]$")).select(F.regexp_replace(name, r"\[[^\]]*\]$", "").alias("base"), F.col(name).alias("variant"))
    return variants.join(names.select(F.col(name).alias("base")).distinct(), "base").distinct()

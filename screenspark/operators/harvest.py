"""Labels from an accessibility tree: which nodes of a window are elements of its picture.

A node counts if it is visible and at least half of it, and 4 pixels each way, lies within the
captured area.  Two kinds are passed over, and what they hold belongs to the next element above:
wrappers without a name, and nodes that repeat the name of an element above within its box.
Whether a name repeats one depends on whether that one was passed over itself, so names are
decided from the top down: in the order of the tree, each node asks those of its screen that were
kept under its name for one whose subtree and box hold it.  Subtrees are intervals of places, so
this needs no levels and no pointers, and the next element above is the last kept interval that
is still open.  A screen is decided in one task, many screens at a time, after one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from . import tours

# Control types that can be acted on, with the element type and the word for it.
ACTIONABLE = {
    "Button": ("button", "button"),
    "SplitButton": ("button", "button"),
    "Hyperlink": ("button", "link"),
    "MenuItem": ("button", "menu item"),
    "TabItem": ("button", "tab"),
    "ListItem": ("button", "list item"),
    "TreeItem": ("button", "tree item"),
    "CheckBox": ("checkbox", "checkbox"),
    "RadioButton": ("checkbox", "radio button"),
}
# Least side in pixels, least share inside, slack of a box inside another.
LEAST_SIDE, LEAST_SHARE, SLACK = 4, 0.5, 2
# Control types that are elements without a name.
UNNAMED = ["Image", "Edit", "ComboBox"]

BOX = ("x1", "y1", "x2", "y2")


def stripped(name: Column) -> Column:
    return F.coalesce(F.regexp_replace(name, r"^\s+|\s+$", ""), F.lit(""))


def on_picture(nodes: DataFrame, client: tuple[float, float, float, float], picture: tuple[int, int]) -> DataFrame:
    """Nodes with their boxes on the picture, clipped, and ``fit``: whether they are on it.  The
    client area (x, y, width, height) is what the picture shows; halves go to the even pixel."""
    x, y, width, height = client
    sx, sy = picture[0] / float(width), picture[1] / float(height)
    at = {c: F.bround((F.col(c) - (x if c[0] == "x" else y)) * (sx if c[0] == "x" else sy), 0).cast("int") for c in ("x1", "y1", "x2", "y2")}
    raw = nodes.withColumns({f"_{c}": v for c, v in at.items()})
    clipped = {c: F.greatest(F.lit(0), F.col(f"_{c}")) if c in ("x1", "y1") else F.least(F.lit(picture[0] if c == "x2" else picture[1]), F.col(f"_{c}")) for c in at}
    sides = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1"))
    area = lambda p: F.greatest(F.lit(0), sides(p)[0]).cast("long") * F.greatest(F.lit(0), sides(p)[1])
    fit = F.coalesce("visible", F.lit(True)) & (sides("")[0] >= LEAST_SIDE) & (sides("")[1] >= LEAST_SIDE) & (area("") >= LEAST_SHARE * area("_"))
    return raw.withColumns(clipped).withColumn("fit", fit).drop(*[f"_{c}" for c in at])


def icon_only(name: Column, box: G.Box) -> Column:
    """A small, roughly square control whose name is a word: a tooltip that isn't printed."""
    width, height = G.width(box), G.height(box)
    return (F.length(name) > 2) & (height <= 48) & (width < 1.6 * height)


def labels(nodes: DataFrame, client: tuple[float, float, float, float], picture: tuple[int, int], on: str = "state_id", order: list[Column] | None = None) -> DataFrame:
    """(on, elem_id, elem_key, parent_key, box, visual_type, text, role_word, control_type, review)
    of the elements among nodes (on, elem_id, parent_id, name, control_type, box, visible);
    siblings are in the order of their ids unless told.  Keys are E1, E2, ... along the tree.

    A null name is none, a null ``visible`` is true, a parent that isn't there is none."""
    order = F.struct(*(order or [F.col("elem_id")]))
    seen = on_picture(nodes.where(F.col(on).isNotNull()), client, picture).withColumns({"name": stripped(F.col("name")), "parent_id": F.col("parent_id").cast(nodes.schema["elem_id"].dataType), "_order": order})
    sent = seen.select(on, "elem_id", "parent_id", "name", "control_type", *BOX, "fit", "_order").repartition(on).sortWithinPartitions(on, "_order")
    return described(kept_nodes(sent.drop("_order").withColumn("_same", F.lower("name")), on), on)


def kept_nodes(rows: DataFrame, on: str) -> DataFrame:
    """The nodes that are elements, of rows that lie together by screen, siblings in order; with
    ``number``, their place among those of the screen from 1, and ``holder``, the number of the
    nearest one above."""
    names = [on, "elem_id", "name", "control_type", *BOX]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in ("number", "holder")])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, screen in tours.by_screens(batches, on):
            up = tours.parents_of(screen, table["elem_id"].combine_chunks(), table["parent_id"].combine_chunks())
            _, place, last = tours.places(screen, up)
            order = np.lexsort((place, screen))
            chosen = decided(screen[order].tolist(), place[order].tolist(), last[order].tolist(), table.select(["fit", "_same", "control_type", *BOX]).take(pa.array(order)))
            found = table.select(names).take(pa.array(order[[i for i, _, _ in chosen]], pa.int64()))
            for name, k in (("number", 1), ("holder", 2)):
                found = found.append_column(name, pa.array([c[k] for c in chosen], pa.int64()))
            yield from found.to_batches()

    return rows.mapInArrow(kept, schema)


def decided(screens: list[int], places: list[int], lasts: list[int], table: pa.Table) -> list[tuple[int, int, int | None]]:
    """(row, number, holder) of the kept rows of ``table``, which is in the order of the trees."""
    out, now = [], None
    for i, (screen, place, last, fit, name, kind, *b) in enumerate(zip(screens, places, lasts, *(c.to_pylist() for c in table.columns), strict=True)):
        if screen != now:
            now, number, same, above = screen, 0, {}, []
        if not fit or (name == "" and kind not in UNNAMED):
            continue
        if name:
            said = same.setdefault(name, [])
            if any(end >= place and b[0] >= k[0] - SLACK and b[1] >= k[1] - SLACK and b[2] <= k[2] + SLACK and b[3] <= k[3] + SLACK for end, k in said):
                continue
            said.append((last, b))
        while above and above[-1][0] < place:
            above.pop()
        number += 1
        out.append((i, number, above[-1][1] if above else None))
        above.append((last, number))
    return out


def described(kept: DataFrame, on: str) -> DataFrame:
    """Types, texts and keys of the kept nodes (with ``number`` and ``holder``)."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("type"), F.lit(x[1]).alias("word")) for pair in ACTIONABLE.items() for x in pair])
    acts = F.when(F.col("name") != "", F.try_element_at(table, F.col("control_type")))
    icon = acts.isNotNull() & icon_only(F.col("name"), G.box())
    text = (F.col("control_type") == "Text") & (F.col("name") != "")
    kind = F.when(icon | (F.col("control_type") == "Image"), "icon").when(acts.isNotNull(), acts["type"]).when(text, "text").otherwise("block")
    key = lambda c: F.concat(F.lit("E"), F.col(c).cast("string"))
    rows = kept.withColumns({
        "elem_key": key("number"), "parent_key": key("holder"), "visual_type": kind, "text": F.when(acts.isNotNull() | text, F.col("name")),
        "role_word": F.when(~icon, acts["word"]), "review": F.when(icon, "icon-only?"),
    })
    return rows.select(on, "elem_id", "elem_key", "parent_key", *BOX, "visual_type", "text", "role_word", "control_type", "review")


def all_names(nodes: DataFrame, on: str = "state_id") -> DataFrame:
    """(on, names): the distinct names of a window's nodes, in order, whatever became of them."""
    return nodes.groupBy(on).agg(F.array_sort(F.collect_set(F.nullif(stripped(F.col("name")), F.lit("")))).alias("names"))

"""Trees walked in order without levels: tours, subtree intervals, nested JSON.

A tour enters and leaves every node once.  Each of these events knows the next one from the
node's first child, next sibling or parent alone, so they form one list for each screen, and
places in the list follow by doubling, in as many rounds as its length has bits, however deep
or wide the tree is.  No row holds a path.

The trees of screens are small and many, so ``placed`` sends each screen to one task and works
out the places of a batch of screens at once, in arrays: one shuffle and no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import geometry as G
from .lineage import checkpoint
from .tree import climb


def tour(nodes: DataFrame, edges: DataFrame, on: str = "state_id", order: list[Column] | None = None) -> DataFrame:
    """(on, elem_id, parent_id, depth, pre_order, last): the place of every node in depth-first
    order from 0, children by ``order`` (top, then left, then id), and that of the last node
    below it.  A node whose parent is not there is a root."""
    order = order or [F.col("y1"), F.col("x1"), F.col("elem_id")]
    nodes = nodes.drop("parent_id")  # the edges tell
    there = nodes.select(on, F.col("elem_id").alias("parent_id"))
    held = edges.where("parent_id is not null").select(on, "elem_id", "parent_id").join(there, [on, "parent_id"], "left_semi")
    siblings = Window.partitionBy(on, "parent_id").orderBy(*order)
    placed = nodes.join(held, [on, "elem_id"], "left").select(on, "elem_id", "parent_id", F.lead("elem_id").over(siblings).alias("after"), F.row_number().over(siblings).alias("n"))
    first = placed.where("n = 1 and parent_id is not null").select(on, F.col("parent_id").alias("elem_id"), F.col("elem_id").alias("first"))
    known = placed.join(first, [on, "elem_id"], "left")
    event = lambda name, side: F.struct(F.col(name).alias("id"), F.lit(side).alias("side"))
    enter = F.struct(event("elem_id", 0).alias("at"), F.coalesce(F.when(F.col("first").isNotNull(), event("first", 0)), event("elem_id", 1)).alias("up"), F.lit(1).alias("entered"), F.lit(1).alias("level"))
    beyond = F.coalesce(F.when(F.col("after").isNotNull(), event("after", 0)), F.when(F.col("parent_id").isNotNull(), event("parent_id", 1)))
    leave = F.struct(event("elem_id", 1).alias("at"), beyond.alias("up"), F.lit(0).alias("entered"), F.lit(-1).alias("level"))
    events = known.select(on, F.explode(F.array(enter, leave)).alias("e")).select(on, F.col("e.at").alias("elem_id"), "e.up", F.col("e.entered").cast("long").alias("entered"), F.col("e.level").cast("long").alias("level"))
    total = lambda own, above: own + F.coalesce(above, F.lit(0))
    ranked = climb(events, on, {"entered": total, "level": total})
    # What is still to be entered, at a node's two events; levels from an event on add up to 0
    # less its depth.
    side = lambda k, c: F.max(F.when(F.col("elem_id.side") == k, F.col(c)))
    met = ranked.groupBy(on, F.col("elem_id.id").alias("elem_id")).agg(side(0, "entered").alias("ahead"), side(1, "entered").alias("beyond"), (-side(0, "level")).alias("depth"))
    sizes = met.groupBy(on).agg(F.max("ahead").alias("n"))
    return (
        met.join(sizes, on)
        .join(held, [on, "elem_id"], "left")
        .select(on, "elem_id", "parent_id", "depth", (F.col("n") - F.col("ahead")).alias("pre_order"), (F.col("n") - F.col("beyond") - 1).alias("last"))
    )


def by_screens(batches: Iterator[pa.RecordBatch], on: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``on`` as tables of whole screens, with the number of each row's screen."""
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table, np.concatenate([[0], np.cumsum(changes(table[on]))])

    def changes(keys: pa.Array | pa.ChunkedArray) -> np.ndarray:
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        return pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False).astype("int64")

    for batch in batches:
        if batch.num_rows == 0:
            continue
        starts = np.flatnonzero(changes(batch[on]))
        last = int(starts[-1]) + 1 if len(starts) else 0
        if last == 0 and held and held[-1][on][-1] != batch[on][0]:
            yield whole(held)
            held = []
        elif last:
            yield whole([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield whole(held)


def parents_of(screen: np.ndarray, ids: pa.Array, parents: pa.Array) -> np.ndarray:
    """The row of each row's parent on its screen, -1 for none."""
    codes = pa.concat_arrays([ids, parents.cast(ids.type)]).dictionary_encode()
    n, code = len(ids), codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")
    own, above = screen * (len(codes.dictionary) + 1) + code[:n], screen * (len(codes.dictionary) + 1) + code[n:]
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(own[order], above), n - 1)
    row = order[at]
    return np.where((code[n:] >= 0) & (own[row] == above), row, -1)


def places(screen: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, place and place of the last node below of each row, given its parent's row;
    siblings are in the order of the rows."""
    n = len(up)

    def along(value: np.ndarray) -> np.ndarray:
        total, at = value.copy(), up.copy()
        for _ in range(n.bit_length() + 1):
            todo = np.flatnonzero(at >= 0)
            if not len(todo):
                return total
            total[todo], at[todo] = total[todo] + total[at[todo]], at[at[todo]]
        raise ValueError("a node is its own ancestor")

    depth = along((up >= 0).astype("int64"))
    size, levels = np.ones(n, "int64"), np.argsort(depth, kind="stable")
    ends = np.cumsum(np.bincount(depth))
    for start, end in zip(ends[:-1][::-1], ends[1:][::-1], strict=True):
        level = levels[start:end]
        np.add.at(size, up[level], size[level])
    group = np.where(up >= 0, up, -1 - screen)
    order = np.argsort(group, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    first = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    before -= before[np.maximum.accumulate(np.where(first, np.arange(n), 0))]
    offset = np.empty(n, "int64")
    offset[order] = before
    place = along(offset + (up >= 0))
    return depth, place, place + size - 1


def placed(nodes: DataFrame, edges: DataFrame | None = None, on: str = "state_id", order: list[Column] | None = None) -> DataFrame:
    """Nodes with the parent that ``edges`` (or their own column ``parent_id``) tell, NULL if it
    is not there, and with ``depth``, ``pre_order`` and ``last`` as ``tour`` gives them.

    For trees of screens: the nodes of one screen, not of many, have to fit in a task.  A cycle
    is an error when the rows are read."""
    order = order or [F.col("y1"), F.col("x1"), F.col("elem_id")]
    kind = nodes.schema["elem_id"].dataType
    if edges is None:
        rows = nodes.withColumns({"parent_id": F.col("parent_id").cast(kind), "_edge": F.lit(False)})
    else:
        own = nodes.drop("parent_id").withColumns({"parent_id": F.lit(None).cast(kind), "_edge": F.lit(False)})
        told = edges.where("parent_id is not null").select(on, F.col("elem_id").cast(kind).alias("elem_id"), F.col("parent_id").cast(kind).alias("parent_id"), F.lit(True).alias("_edge"))
        rows = own.unionByName(told, allowMissingColumns=True)
    names = [c for c in rows.columns if c != "_edge"]
    added = ["depth", "pre_order", "last"]
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in names] + [T.StructField(c, T.LongType()) for c in added])

    def told_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, screen in by_screens(batches, on):
            edge = table["_edge"].to_numpy()
            ids, parents = table["elem_id"].combine_chunks(), table["parent_id"].combine_chunks()
            if edge.any():
                told = np.flatnonzero(edge)
                # A node's edge, then the parent that this edge names.
                mine = parents_of(np.concatenate([screen[told], screen[~edge]]), pa.concat_arrays([ids.take(told), pa.nulls(int((~edge).sum()), ids.type)]), pa.concat_arrays([pa.nulls(len(told), ids.type), ids.filter(pa.array(~edge))]))[len(told) :]
                parents = parents.take(told).take(pa.array(mine, mask=mine < 0))
                table, screen = table.filter(pa.array(~edge)), screen[~edge]
                ids = table["elem_id"].combine_chunks()
            if not len(screen):
                continue
            up = parents_of(screen, ids, parents)
            found = table.set_column(table.column_names.index("parent_id"), "parent_id", ids.take(pa.array(up, mask=up < 0))).select(names)
            for name, values in zip(added, places(screen, up), strict=True):
                found = found.append_column(name, pa.array(values))
            yield from found.to_batches()

    return rows.where(F.col(on).isNotNull()).repartition(on).sortWithinPartitions(on, *order).mapInArrow(told_places, schema)


def below(tours: DataFrame, on: str = "state_id") -> DataFrame:
    """(on, elem_id, n_below): how many nodes each has below it."""
    return tours.select(on, "elem_id", (F.col("last") - F.col("pre_order")).alias("n_below"))


def completed(nodes: DataFrame, edges: DataFrame, on: str = "state_id") -> DataFrame:
    """Nodes with a row for each id that only the tree has: a group without a box or a text."""
    asked = edges.select(on, "elem_id").union(edges.where("parent_id is not null").select(on, "parent_id")).distinct()
    made = {"role": F.lit("group"), "visual_type": F.lit("unknown"), **{c: F.lit(0) for c in ("x1", "y1", "x2", "y2")}}
    rest = asked.join(nodes, [on, "elem_id"], "left_anti")
    missing = rest.select(on, "elem_id", *[made.get(c, F.lit(None)).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns if c not in (on, "elem_id")])
    return nodes.unionByName(missing)


def nested(nodes: DataFrame, edges: DataFrame, fields: list[Column], on: str = "state_id", order: list[Column] | None = None) -> DataFrame:
    """(on, hierarchy): each screen's tree as nested JSON, nodes with the fields that are not
    NULL and their ``children`` in order.  A screen with several top nodes gets a ROOT around
    them with the union of their boxes.

    A tree's text is the text of its nodes in depth-first order; how many brackets close after
    a node follows from its depth and that of the next one, so any depth is one pass."""
    edges = checkpoint(edges.select(on, "elem_id", "parent_id"))
    order = order or [F.col("y1"), F.col("x1"), F.col("elem_id")]
    box = ("x1", "y1", "x2", "y2")
    whole = completed(nodes, edges, on).withColumn("_text", F.to_json(F.struct(*fields)))
    carried = whole.select(on, "elem_id", *box, "_text", F.struct(*order).alias("_order"))
    walked = placed(carried, edges, on, [F.col("_order")]).select(on, "depth", "pre_order", "_text", *[F.when(F.col("depth") == 0, F.col(c)).alias(c) for c in box])
    later = F.lead("depth").over(Window.partitionBy(on).orderBy("pre_order"))
    opened = F.concat(F.expr("substring(_text, 1, length(_text) - 1)"), F.when(F.col("_next") > F.col("depth"), ',"children":[').otherwise("}"))
    closed = F.when(F.col("_next").isNull(), F.expr("repeat(']}', cast(depth as int))")).when(F.col("_next") <= F.col("depth"), F.concat(F.expr("repeat(']}', cast(depth - _next as int))"), F.lit(","))).otherwise("")
    pieces = walked.withColumn("_next", later).withColumn("piece", F.concat(opened, closed))
    inner = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre_order", "piece"))), lambda p: p["piece"]), "").alias("_inner")
    joined = pieces.groupBy(on).agg(inner, F.count_if(F.col("depth") == 0).alias("_tops"), *[c.alias(f"_{n}") for n, c in zip(box, G.union_aggregates(), strict=True)])
    around = F.to_json(F.struct(F.lit("ROOT").alias("id"), F.array("_x1", "_y1", "_x2", "_y2").alias("bounds"), F.lit("group").alias("role"), F.lit("unknown").alias("visual_type")))
    many = F.concat(F.expr("substring(_root, 1, length(_root) - 1)"), F.lit(',"children":['), "_inner", F.lit("]}"))
    return joined.withColumn("_root", around).select(on, F.when(F.col("_tops") == 1, F.col("_inner")).otherwise(many).alias("hierarchy"))


def write_nested(trees: DataFrame, path: str, on: str = "state_id") -> None:
    """One JSON file a screen, in a folder of its name, as ``read_screens`` reads them."""
    body = F.concat(F.lit('{"hierarchy":'), "hierarchy", F.lit("}")).alias("value")
    trees.select(on, body).repartition(on).write.mode("overwrite").partitionBy(on).text(path)

"""Hierarchies as edge tables (state_id, elem_id, parent_id): depth, paths, roots, diffs."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import geometry as G
from .lineage import checkpoint


def ancestors(edges: DataFrame, on: str = "state_id") -> DataFrame:
    """(on, elem_id, ancestor_id, distance): every ancestor of every node, by doubling: each
    round joins the pairs that are furthest apart so far with all pairs, which takes as many
    rounds as the depth has bits."""
    up = edges.where("parent_id is not null").select(on, "elem_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).cast("long").alias("distance"))
    parts, reach = [checkpoint(up)], 1
    while True:
        furthest = parts[-1].where(F.col("distance") == reach)
        if furthest.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        known = reduce(DataFrame.unionByName, parts).select(on, F.col("elem_id").alias("ancestor_id"), F.col("ancestor_id").alias("above"), F.col("distance").alias("more"))
        step = furthest.join(known, [on, "ancestor_id"]).select(on, "elem_id", F.col("above").alias("ancestor_id"), (F.lit(reach) + F.col("more")).alias("distance"))
        parts.append(checkpoint(step))
        if not parts[-1].where("elem_id = ancestor_id").isEmpty():
            raise ValueError("a node is its own ancestor")
        reach *= 2


def climb(at: DataFrame, on: str, carried: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Follows the pointer ``up`` of every row (on, elem_id, up, carried columns) to its end, by
    pointing each row where the row above points; ``carried`` joins a column with that of the
    row above (NULL where that row is missing).  Rows that have arrived are left alone."""
    names = list(carried)
    at = checkpoint(at.select(on, "elem_id", "up", *names))
    rounds = at.count().bit_length() + 1
    done = []
    while not (todo := at.where("up is not null")).isEmpty():
        if rounds == 0:
            raise ValueError("a node is its own ancestor")
        rounds -= 1
        done.append(at.where("up is null"))
        above = reduce(DataFrame.unionByName, [*done, todo]).select(on, F.col("elem_id").alias("up"), F.col("up").alias("next"), *[F.col(c).alias(f"{c}_above") for c in names])
        at = checkpoint(todo.join(above, [on, "up"], "left").select(on, "elem_id", F.col("next").alias("up"), *[f(F.col(c), F.col(f"{c}_above")).alias(c) for c, f in carried.items()]))
    return reduce(DataFrame.unionByName, [*done, at])


def depths(nodes: DataFrame, edges: DataFrame, on: str = "state_id") -> DataFrame:
    """(on, elem_id, depth): roots have depth 0; a node has one parent."""
    at = edges.where("parent_id is not null").select(on, "elem_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("depth"))
    far = climb(at, on, {"depth": lambda own, above: own + F.coalesce(above, F.lit(0))})
    return nodes.select(on, "elem_id").join(far.select(on, "elem_id", "depth"), [on, "elem_id"], "left").select(on, "elem_id", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def leaves(nodes: DataFrame, edges: DataFrame, on: str = "state_id") -> DataFrame:
    inner = edges.where("parent_id is not null").select(on, F.col("parent_id").alias("elem_id")).distinct()
    return nodes.join(inner, [on, "elem_id"], "left_anti")


def roots(nodes: DataFrame, edges: DataFrame, on: str = "state_id") -> DataFrame:
    """One root for each screen: its single top node, or ROOT with the union of all boxes."""
    top = nodes.join(edges.where("parent_id is not null").select(on, "elem_id"), [on, "elem_id"], "left_anti")
    found = top.groupBy(on).agg(F.count("*").alias("n_top"), F.min("elem_id").alias("only"), *G.union_aggregates())
    return found.select(on, "n_top", F.when(F.col("n_top") == 1, F.col("only").cast("string")).otherwise(F.lit("ROOT")).alias("root_id"), "x1", "y1", "x2", "y2")


def paths(nodes: DataFrame, edges: DataFrame, on: str = "state_id") -> DataFrame:
    """(on, elem_id, path): /type[@id='x'] of all ancestors and the node itself."""
    step = F.concat(F.lit("/"), F.col("visual_type"), F.lit("[@id='"), F.col("elem_id").cast("string"), F.lit("']"))
    above = edges.where("parent_id is not null").select(on, "elem_id", F.col("parent_id").alias("up"))
    at = nodes.select(on, "elem_id", step.alias("path")).join(above, [on, "elem_id"], "left")
    return climb(at, on, {"path": lambda own, above: F.concat(F.coalesce(above, F.lit("")), own)}).select(on, "elem_id", "path")


def edits(draft: DataFrame, target: DataFrame, on: str = "state_id", fields: tuple[str, ...] = ("parent_id",)) -> DataFrame:
    """(on, elem_id, op, old, new): what turns the draft tree into the target tree."""
    a, b = draft.alias("a"), target.alias("b")
    both = a.join(b, [on, "elem_id"], "full_outer")
    ops = [
        F.when(F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(None)).otherwise(
            F.struct(F.lit(f"set_{f.removesuffix('_id')}").alias("op"), F.col(f"a.{f}").cast("string").alias("old"), F.col(f"b.{f}").cast("string").alias("new"))
        )
        for f in fields
    ]
    return both.select(on, "elem_id", F.explode(F.array_compact(F.array(*ops))).alias("e")).select(on, "elem_id", "e.*")


@F.pandas_udf(T.ArrayType(T.StringType()))
def flatten_json(screen: pd.Series) -> pd.Series:
    """Pre-order array of the nodes of a screen's nested ``hierarchy`` (also under ``dom``), as
    JSON strings without their children, at any depth; empty for text that is no JSON."""

    def walk(text):
        try:
            body = json.loads(text) if text is not None else None
        except ValueError:
            return []
        if isinstance(body, dict) and body.get("dom") is not None:
            body = body["dom"]
        node = body.get("hierarchy") if isinstance(body, dict) else None
        out, todo = [], [] if node is None else [node]
        while todo:
            node = todo.pop()
            children = node.pop("children", None) if isinstance(node, dict) else None
            out.append(json.dumps(node))
            todo += reversed(children) if isinstance(children, list) else []
        return out

    return screen.map(walk)


def from_relations(relations: DataFrame, on: str = "state_id") -> DataFrame:
    """Edges of a table of relations (on, kind, from_id, to_id); of several containers the
    first counts."""
    held = relations.where("kind = 'contains'").groupBy(on, F.col("to_id").alias("elem_id"))
    return held.agg(F.min("from_id").alias("parent_id"))


def apply_edits(nodes: DataFrame, changes: DataFrame, on: str = "state_id") -> DataFrame:
    """Nodes (on, elem_id, parent_id, role) after edits (on, elem_id, op, value, ord): roles and
    parents are set, the last edit of a kind counts; deleted nodes go, and their children
    move up to the next node that stays."""
    last = changes.groupBy(on, "elem_id").agg(
        *[F.max_by("value", F.when(F.col("op") == op, F.col("ord"))).alias(f"_{op}") for op in ("set_role", "set_parent")],
        *[F.bool_or(F.col("op") == op).alias(f"has_{op}") for op in ("set_role", "set_parent", "delete")],
    )
    done = nodes.join(last, [on, "elem_id"], "left")
    pick = lambda op, old: F.when(F.coalesce(f"has_{op}", F.lit(False)), F.col(f"_{op}")).otherwise(F.col(old).cast("string"))
    moved = done.select(on, "elem_id", pick("set_parent", "parent_id").cast("int").alias("parent_id"), pick("set_role", "role").alias("role"), F.coalesce("has_delete", F.lit(False)).alias("gone"))
    stays = moved.where("not gone").select(on, F.col("elem_id").alias("parent_id"), F.lit(True).alias("stays"))
    at = moved.join(stays, [on, "parent_id"], "left")
    # A pointer stops at a node that stays; otherwise it goes where that of the deleted node goes.
    at = at.select(on, "elem_id", F.when(F.col("stays").isNull(), F.col("parent_id")).alias("up"), F.when(F.col("stays"), F.col("parent_id")).alias("nearest"))
    nearest = climb(at, on, {"nearest": lambda own, above: F.coalesce(own, above)}).select(on, "elem_id", F.col("nearest").alias("parent_id"))
    return moved.where("not gone").select(on, "elem_id", "role").join(nearest, [on, "elem_id"], "left")


def child_order(nodes: DataFrame, edges: DataFrame, on: str = "state_id", order: list[Column] | None = None) -> DataFrame:
    """(on, elem_id, depth, pre_order): depth-first places from 0, children of a node by
    ``order`` (top, then left, then id), worked out screen by screen."""
    from . import tours

    order = order or [F.col("y1"), F.col("x1"), F.col("elem_id")]
    nodes = nodes.select(on, "elem_id", F.struct(*order).alias("_order"))
    return tours.placed(nodes, edges.select(on, "elem_id", "parent_id"), on, [F.col("_order"), F.col("elem_id")]).select(on, "elem_id", "depth", "pre_order")


def edit_scores(predicted: DataFrame, expected: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Precision and recall of sets of edits, each counted once."""
    p, e = predicted.select(*by, *key).distinct(), expected.select(*by, *key).distinct()
    n = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    both = n(p, "n_pred").join(n(e, "n_true"), by, "full_outer").join(n(p.intersect(e), "tp"), by, "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return both.select(*by, "tp", "n_pred", "n_true", ratio("tp", "n_pred").alias("precision"), ratio("tp", "n_true").alias("recall"))

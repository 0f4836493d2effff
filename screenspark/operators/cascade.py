"""Descriptions resolved by tiers: what one tier leaves open goes on to the next.

A tier is a batch function over all open descriptions at once, with what a question to it
costs.  Its answers count only after checks: an element must lie where the description says,
if any element of the screen does, and carry every number that it names, since a number has no
paraphrase.  Each round is cut off in a table, so a costly tier is asked once, and asked about
open rows only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from ..functions import geometry as G
from ..functions import text as X
from . import locator
from .lineage import checkpoint


@dataclass(frozen=True)
class Tier:
    """``answer`` takes (step, on, description) and elements, and gives (step, on, elem_id,
    reason): NULL and why where it declines; a step without a row is declined, too.  A tier that
    needs no more than one screen may say the same as ``on_screen``, an expression
    struct(elem_id, reason) of a description taken apart and its screen's elements (``said`` and
    ``read`` of ``locator.asked_on_screens``); tiers that all do are asked in one pass."""

    name: str
    answer: Callable[[DataFrame, DataFrame], DataFrame]
    cost: float = 0.0
    checked: bool = True
    on_screen: Callable[[Column, Column], Column] | None = None


def _by_screen(name: str, on_screen: Callable[[Column, Column], Column], cost: float, checked: bool, on: str, width: Column | None = None, height: Column | None = None) -> Tier:
    def answer(asked: DataFrame, elements: DataFrame) -> DataFrame:
        met = locator.asked_on_screens(asked.select("step", on, "description"), elements, on, width, height)
        return met.select("step", on, on_screen(F.col("said"), F.col("read")).alias("a")).select("step", on, "a.*")

    return Tier(name, answer, cost, checked, on_screen)


def lexical(on: str = "state_id", width: Column | None = None, height: Column | None = None, floor: float = 1.5, margin: float = 0.5) -> Tier:
    """The best element by shared words, if it clears the floor and leads by the margin."""

    def told(best: Column) -> Column:
        first = F.get(best, F.lit(0))
        top, sure = -first["far"], locator.leads(best, floor, margin)
        tied = F.size(F.filter(best, lambda s: top + s["far"] < margin - 1e-9))
        reason = F.when(top.isNull(), "no element shares a token or a kind").when(sure, F.format_string("score %.2f", top)).when(top < floor, F.format_string(f"best score %.2f < {floor}", top)).otherwise(F.format_string("tie at %.2f between %d candidates", top, tied))
        return F.struct(F.when(sure, first["elem_id"]).alias("elem_id"), reason.alias("reason"))

    return _by_screen("lexical", lambda said, read: locator.once(locator.best_first(said, read), told), 0.0, False, on, width, height)


def spelling(on: str = "state_id", share: int = 4, cost: float = 1.0) -> Tier:
    """The one element with a label, text or hint nearest to what the description names, by edit
    distance, if at most one letter in ``share`` differs."""
    stops = F.array(*map(F.lit, locator.STOP_WORDS))

    def near(name: Column, read: Column) -> Column:
        # A caption that is too long or too short can't be near enough.
        close = lambda c: (c != "") & (F.abs(F.length(c) - F.length(name)) * share <= F.length(name))
        captions = lambda at: F.filter(F.array_compact(F.array(*[F.lower(at[c]) for c in locator.FIELDS])), close)
        edits = lambda r: F.array_min(F.transform(captions(r["at"]), lambda c: F.levenshtein(c, name)))
        found = F.transform(read, lambda r: F.struct(edits(r).alias("edits"), r["at"]["elem_id"].alias("elem_id")))
        return F.sort_array(F.filter(found, lambda f: F.when(name != "", f["edits"] * share <= F.length(name))))

    def told(found: Column) -> Column:
        first = F.get(found, F.lit(0))
        n = F.size(F.filter(found, lambda f: f["edits"] == first["edits"]))
        reason = F.when(first.isNull(), "no caption is near").when(n == 1, F.format_string("%d edits", first["edits"])).otherwise(F.format_string("%d captions at %d edits", n, first["edits"]))
        return F.struct(F.when(n == 1, first["elem_id"]).alias("elem_id"), reason.alias("reason"))

    def on_screen(said: Column, read: Column) -> Column:
        name = F.array_join(F.filter(said["name"], lambda t: ~F.array_contains(stops, t)), " ")
        return locator.once(name, lambda n: locator.once(near(n, read), told))

    return _by_screen("spelling", on_screen, cost, True, on)


def _verdict(got: Column, said: Column, read: Column) -> Column:
    """Why an element that a tier picked doesn't stand: it lies elsewhere, though some element of
    the screen lies where the description says, or lacks a number that is named."""
    there = lambda r: locator.in_place(said, r["at"]["cx"], r["at"]["cy"])
    numbers = X.numbers(said["name"])

    def judged(r: Column) -> Column:
        outside = (F.size(said["places"]) > 0) & F.exists(read, there) & ~there(r)
        lacks = ~answers.has_numbers(F.coalesce(r["tokens"], F.array().cast("array<string>")), numbers)
        return F.when(got.isNull(), F.lit(None)).when(outside, "outside the described position").when(lacks, "without a number that is named")

    return locator.once(F.get(F.filter(read, lambda r: r["at"]["elem_id"] == got), F.lit(0)), judged)


def _step(rows: DataFrame, tier: Tier, answer: Column) -> DataFrame:
    """Rows (elem_id, tier, reason, why, cost, said, read) after a tier was asked about those without an element."""
    rows = rows.withColumn("_open", F.col("elem_id").isNull()).withColumn("_got", F.when(F.col("_open"), answer))
    verdict = F.when(F.col("_got.elem_id").isNotNull(), _verdict(F.col("_got.elem_id"), F.col("said"), F.col("read"))) if tier.checked else F.lit(None).cast("string")
    rows = rows.withColumn("_verdict", verdict)
    picked = F.concat(F.lit("picked "), F.col("_got.elem_id").cast("string"), F.lit(" "), "_verdict")
    rows = rows.withColumn("_said", F.concat(F.lit(f"{tier.name}: "), F.coalesce(picked, "_got.reason", F.lit("no answer"))))
    found = F.when(F.col("_verdict").isNull(), F.col("_got.elem_id"))
    rows = rows.withColumn("_found", found)
    sure = F.col("_found").isNotNull()
    return rows.withColumns({
        "elem_id": F.coalesce("elem_id", "_found"), "tier": F.coalesce("tier", F.when(sure, tier.name)), "reason": F.when(sure, F.col("_said")).otherwise(F.col("reason")),
        "why": F.when(F.col("_open"), F.array_append("why", F.col("_said"))).otherwise(F.col("why")), "cost": F.col("cost") + F.when(F.col("_open"), tier.cost).otherwise(0.0),
    }).drop("_open", "_got", "_verdict", "_said", "_found")


def resolve(asked: DataFrame, elements: DataFrame, tiers: list[Tier], on: str = "state_id", width: Column | None = None, height: Column | None = None) -> DataFrame:
    """(step, on, elem_id, tier, reason, cost) of asked (step, on, description): the element of
    the first tier whose answer stands, or none and why each tier declined; the cost is that of
    all tiers asked.  Repeated steps of a screen must say the same; null descriptions are
    declined by every tier.

    Tiers that answer ``on_screen`` are asked in the pass in which rows meet their screens.  The
    rows are cut off in a table before and after each of the others, so it is asked once."""
    kind = elements.schema["elem_id"].dataType
    start = {"elem_id": F.lit(None).cast(kind), "tier": F.lit(None).cast("string"), "reason": F.lit(None).cast("string"), "why": F.array().cast("array<string>"), "cost": F.lit(0.0)}
    meet = lambda rows: locator.asked_on_screens(rows, elements, on, width, height)
    rows, met, cut = asked.select("step", on, "description"), bool(tiers) and tiers[0].on_screen is not None, False
    rows = (meet(rows) if met else rows).withColumns(start)
    for tier in tiers:
        if tier.on_screen is None:
            rows, met = rows if cut else checkpoint(rows.drop("said", "read")), False
            said = tier.answer(rows.where("elem_id is null and description is not null").select("step", on, "description"), elements)
            rows = rows.join(said.select("step", on, F.struct("elem_id", "reason").alias("_answer")), ["step", on], "left")
        if not met and (tier.on_screen is not None or tier.checked):
            rows, met = meet(rows), True
        known = F.col("description").isNotNull() & F.col(on).isNotNull()
        rows = _step(rows, tier, F.when(known, tier.on_screen(F.col("said"), F.col("read"))) if tier.on_screen is not None else F.col("_answer"))
        cut = tier.on_screen is None
        if cut:
            rows, met = checkpoint(rows.drop("said", "read", "_answer")), False
    none = F.concat(F.lit("no confident match ("), F.array_join("why", "; "), F.lit(")"))
    return rows.select("step", on, "elem_id", "tier", F.coalesce("reason", none).alias("reason"), "cost")


def by_tier(resolved: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, tier, n, cost): how many descriptions each tier resolved, and what they cost in all;
    ``none`` are those that no tier did."""
    return resolved.groupBy(*(by or []), F.coalesce("tier", F.lit("none")).alias("tier")).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))

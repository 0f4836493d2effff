"""Short notations in columns: regions, times, switches, lists of specs, edits and layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that read as yes and no.
TRUE_WORDS, FALSE_WORDS = ["true", "on", "yes"], ["false", "off", "no"]

# Units of a time and their seconds.
SECONDS = {
    "d": 86400.0, "day": 86400.0, "days": 86400.0, "h": 3600.0, "hour": 3600.0, "hours": 3600.0, "m": 60.0, "min": 60.0, "mins": 60.0, "minute": 60.0,
    "minutes": 60.0, "s": 1.0, "sec": 1.0, "secs": 1.0, "second": 1.0, "seconds": 1.0, "ms": 0.001, "millis": 0.001, "millisecond": 0.001, "milliseconds": 0.001,
}


def scalar(value: Column) -> Column:
    """struct(flag, whole, number, text): what a value reads as, the first kind that fits."""
    low = F.lower(value)
    flag = F.when(low.isin(TRUE_WORDS), F.lit(True)).when(low.isin(FALSE_WORDS), F.lit(False))
    whole = F.when(flag.isNull() & value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("long"))
    number = F.when(flag.isNull() & whole.isNull() & value.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(value).try_cast("double"))
    text = F.when(flag.isNull() & whole.isNull() & number.isNull(), value)
    return F.struct(flag.alias("flag"), whole.alias("whole"), number.alias("number"), text.alias("text"))


def region(value: Column) -> Column:
    """struct(x1, y1, x2, y2) of the four numbers in a text, rounded half to even; NULL unless
    there are four and the box has an area."""
    found = F.transform(F.regexp_extract_all(value, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: F.bround(x.cast("double")).cast("int"))
    at = lambda i: F.try_element_at(found, F.lit(i))
    box = F.struct(at(1).alias("x1"), at(2).alias("y1"), at(3).alias("x2"), at(4).alias("y2"))
    return F.when((F.size(found) == 4) & (at(3) > at(1)) & (at(4) > at(2)), box)


def seconds(value: Column) -> Column:
    """Seconds of ``1 min 30 s``, ``0.5s``, ``01:30`` (hours before, if three) or a plain number;
    a leading minus negates all; NULL for anything else."""
    low = F.lower(F.trim(value))
    minus = F.when(low.startswith("-"), -1.0).otherwise(1.0)
    body = F.regexp_replace(low, r"^[+-]\s*", "")
    plain = F.when(body.rlike(r"^\d+(\.\d+)?$"), body.try_cast("double"))
    clock = F.transform(F.split(body, ":"), lambda x: x.try_cast("double"))
    timed = F.when(body.rlike(r"^(\d+:)?\d+:\d+(\.\d+)?$"), F.aggregate(clock, F.lit(0.0), lambda acc, x: acc * 60 + x))
    part = r"(\d+(?:\.\d+)?)\s*([a-z]+)\s*"
    table = F.create_map(*[F.lit(x) for pair in SECONDS.items() for x in pair])
    amounts = F.arrays_zip(F.regexp_extract_all(body, F.lit(part), F.lit(1)).alias("n"), F.regexp_extract_all(body, F.lit(part), F.lit(2)).alias("u"))
    units = F.aggregate(amounts, F.lit(0.0), lambda acc, x: acc + x["n"].cast("double") * F.try_element_at(table, x["u"]))
    return minus * F.coalesce(plain, timed, F.when(body.rlike(r"^(\d+(\.\d+)?\s*[a-z]+\s*)+$"), units))


def split_specs(value: Column) -> Column:
    """The items of a comma list, not cut inside brackets."""
    parts = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"(?:\[[^\]]*\]?|[^,\[])+"), F.lit(0))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def spec(value: Column) -> Column:
    """struct(name, switches, suffix, problem) of ``name`` or ``name[key=value, ...]``; problem
    tells what is wrong with it, or is NULL."""
    inner = F.regexp_extract(value, r"^[^\[]*\[(.*)\]$", 1)
    items = F.filter(F.transform(F.split(inner, ","), lambda i: F.trim(i)), lambda i: i != "")
    pairs = F.transform(F.filter(items, lambda i: F.contains(i, F.lit("="))), lambda i: F.struct(F.trim(F.substring_index(i, "=", 1)).alias("key"), F.trim(F.regexp_replace(i, "^[^=]*=", "")).alias("value")))
    bracket = F.contains(value, F.lit("["))
    bad = F.element_at(F.concat(F.filter(items, lambda i: ~F.contains(i, F.lit("="))), F.array(F.lit(None).cast("string"))), 1)
    problem = F.when(bracket & ~value.endswith("]"), F.lit("no closing bracket")).when(bad.isNotNull(), F.concat(F.lit("no value: "), bad))
    return F.struct(
        F.substring_index(value, "[", 1).alias("name"), pairs.alias("switches"), F.when(bracket, F.concat(F.lit("["), inner, F.lit("]"))).otherwise("").alias("suffix"), problem.alias("problem")
    )


def tree_edits(answer: Column) -> Column:
    """array<struct(op, target, ids, value)> of a model's list of edits: merge (of two ids or
    more), split, retype, delete and role; incomplete ones go.  Of a list that was cut off the
    whole items count."""
    from .answers import suggestions

    listed = suggestions(answer, "op: string, id: string, ids: array<string>, type: string, role: string, text: string")
    op = lambda e: F.lower(F.coalesce(e["op"], F.lit("")))
    present = lambda c: F.coalesce(c, F.lit("")) != ""
    fits = lambda e: (
        ((op(e) == "merge") & (F.coalesce(F.size(e["ids"]), F.lit(0)) >= 2)) | (op(e).isin("split", "delete") & present(e["id"]))
        | ((op(e) == "retype") & present(e["id"]) & present(e["type"])) | ((op(e) == "role") & present(e["id"]) & present(e["role"]))
    )
    value = lambda e: F.when(op(e) == "merge", e["text"]).when(op(e) == "split", F.coalesce(e["type"], F.lit("button"))).when(op(e) == "retype", e["type"]).when(op(e) == "role", e["role"])
    made = lambda e: F.struct(op(e).alias("op"), F.when(op(e) == "merge", F.try_element_at(e["ids"], F.lit(1))).otherwise(e["id"]).alias("target"), F.when(op(e) == "merge", F.slice(e["ids"], 2, F.greatest(F.size(e["ids"]), F.lit(1)))).alias("ids"), value(e).alias("value"))
    return F.transform(F.filter(listed, fits), made)


def layout_object(answer: Column) -> Column:
    """The JSON object of an answer as text, fenced or not; NULL where there is none."""
    fenced = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.coalesce(F.nullif(fenced, F.lit("")), answer))
    whole = lambda c: F.when(F.get_json_object(c, "$").isNotNull() & c.startswith("{"), c)
    return F.coalesce(whole(body), whole(F.nullif(F.regexp_extract(F.coalesce(body, F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))))


def printed(name: Column, reading: Column, close: Column) -> Column:
    """Whether a box's reading shows its name: one of its readings (between bars) has the name or
    most of it, or is ``close`` to it, which the caller tells."""
    from .text import bare

    a = bare(name)
    parts = F.filter(F.transform(F.split(reading, r" \| "), bare), lambda b: b != "")
    held = F.exists(parts, lambda b: F.contains(b, a) | (F.contains(a, b) & (F.length(b) >= 0.6 * F.length(a))))
    return F.when(a == "", F.lit(False)).otherwise(held | close)

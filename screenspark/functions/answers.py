"""What a model's answer says: ids, verdicts and lists, as column expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_object(answer: Column) -> Column:
    """From the first brace to the last one."""
    return F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)


def element_answer(answer: Column) -> Column:
    """struct(id, confidence, reason) of a JSON answer; NULL where there is none.  An id may
    have the prefix of the prompt's rows; null and none are no ids."""
    parsed = F.from_json(json_object(answer), "id string, confidence string, reason string")
    bare = F.trim(F.regexp_replace(parsed["id"], r"(?i)^\s*id\s*[=:]\s*", ""))
    found = F.when(F.lower(bare).isin("null", "none", ""), F.lit(None)).otherwise(bare)
    sure = F.coalesce(F.try_to_number(parsed["confidence"], F.lit("9.999999")).cast("double"), F.lit(0.0))
    whole = F.struct(found.alias("id"), sure.alias("confidence"), F.coalesce(parsed["reason"], F.lit("")).alias("reason"))
    return F.when(F.get_json_object(json_object(answer), "$").isNotNull(), whole)


def failed_first(answer: Column) -> Column:
    has = lambda w: F.contains(answer, F.lit(w))
    return F.when(has("FAILED") | has("is not met"), "FAILED").when(has("PASSED") | has("is met"), "PASSED")


def yes_or_no(answer: Column) -> Column:
    word = F.lower(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?i)\b(yes|no)\b", 1))
    return F.when(word == "yes", "PASSED").when(word == "no", "FAILED")


#: A string, which may be cut off, or a mark outside of strings.
_MARK = re.compile(r'"(?:[^"\\]+|\\.)*+(?P<end>")?|[\[\]{},]', re.DOTALL)


def _made_whole(answer: str) -> str:
    open_, depth, over, cut, closing = [], 0, False, 0, ""
    for m in _MARK.finditer(answer):
        mark = m[0]
        if mark[0] == '"':
            if m["end"] is None:
                break  # an open string is the last mark
            continue
        at = m.end()
        if mark in "[{":
            open_.append("]" if mark == "[" else "}")
            if mark == "{" or depth:
                continue
            depth = len(open_)
        elif over or not depth:
            if mark != "," and open_:
                open_.pop()
            continue
        elif mark == ",":
            if len(open_) != depth:
                continue
            at = m.start()
        else:
            if open_:
                open_.pop()
            over = len(open_) == depth - 1
            if not over and len(open_) != depth:
                continue
        cut, closing = at, "".join(reversed(open_))
    else:
        if not open_:
            return answer
    return answer[:cut] + closing if depth else answer


@F.arrow_udf(T.StringType())
def repaired(answer: pa.Array) -> pa.Array:
    """JSON that was cut off, made whole: of the first list in it the items that are complete,
    and closing brackets for all that is open.  What comes after the list stays only if the text
    is whole; a text without a list, or one that is whole, stays as it is.

    One walk over the text's brackets, commas and strings keeps the stack of open brackets (as
    what closes them) and the last place where an item or the list ended."""
    return pa.array([None if a is None else _made_whole(a) for a in answer.to_pylist()], pa.string())


def suggestions(answer: Column, fields: str) -> Column:
    """array<struct> of a list in an answer, fenced or not; of a list that was cut off, wherever
    that was, its whole items."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"```(?:json)?", "")
    listed = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    cut = repaired(F.regexp_extract(text, r"(?s)\[.*", 0))
    kind = f"array<struct<{fields}>>"
    return F.coalesce(F.from_json(F.nullif(listed, F.lit("")), kind), F.from_json(F.nullif(cut, F.lit("")), kind), F.array().cast(kind))


def has_numbers(answer_tokens: Column, wanted: Column) -> Column:
    """An element carries all numbers that a description names."""
    return F.size(F.array_except(wanted, answer_tokens)) == 0


def relative_time(age_seconds: Column) -> Column:
    near = lambda size, unit: F.concat(F.round(age_seconds / size).cast("int").cast("string"), F.lit(unit))
    return F.when(age_seconds < 60, "just now").when(age_seconds < 3600, near(60, " min ago")).when(age_seconds < 86400, near(3600, " h ago")).otherwise(near(86400, " d ago"))


def session_time(session_id: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(session_id, r"^(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss"))

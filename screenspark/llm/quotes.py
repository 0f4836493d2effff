"""Operator 9: reply-ordered conversations from quotation links, with DataFrame functions only.

A quoted line starts with ``>`` marks; their number is its level.  Of each run of quoted
lines, the lines of one level make a passage.  Passages, and their single lines, are
normalised (case and white space) and hashed, and so are the own texts, paragraphs and
lines of every message; a passage belongs to the earliest message of the conversation that
has it as its own text.  The message that most of the level-1 text of a message comes from
(by characters; the latest of equals) is the one it replies to.

Nulls: a null text is empty; a message without conv_id or turn links with nothing.  Rows
with the same (conv_id, turn) count as one message for links and each keep their row.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import tours
from .common import checkpoint

_MARKS = r"^[ \t]*(?:>[ \t]*)+"
_RUN = r"(?m)^[ \t]*>[^\n]*(?:\n[ \t]*>[^\n]*)*"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _keys(texts: Column) -> Column:
    """(hash, size) of the distinct texts that are not blank."""
    normal = F.array_distinct(F.filter(F.transform(texts, _normal), lambda t: t != ""))
    return F.transform(normal, lambda t: F.struct(F.sha2(t, 256).alias("hash"), F.length(t).alias("size")))


def parse(messages: DataFrame) -> DataFrame:
    """Adds to each message its own text, keys of its own passages, and its quotes by level."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")
    # An own line ends any paragraph that a quote interrupts.
    shown = F.transform("lines", lambda x: F.when(_level(x) > 0, "").otherwise(x))
    clean = F.btrim(F.regexp_replace(F.array_join(F.filter("lines", lambda x: _level(x) == 0), "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\n"))
    runs = F.regexp_extract_all(F.array_join("lines", "\n"), F.lit(_RUN), F.lit(0))
    passages = F.flatten(
        F.transform(
            runs,
            lambda run: F.transform(
                F.array_distinct(F.transform(F.split(run, "\n"), _level)),
                lambda level: F.struct(
                    level.alias("level"),
                    F.transform(F.filter(F.split(run, "\n"), lambda x: _level(x) == level), lambda x: F.regexp_replace(x, _MARKS, "")).alias("parts"),
                ),
            ),
        )
    )
    return (
        messages.select("conv_id", "turn", "role", lines.alias("lines"))
        .select(
            "conv_id", "turn", "role",
            clean.alias("text"),
            passages.alias("quotes"),
            F.split(F.array_join(shown, "\n"), r"\n\s*\n").alias("paragraphs"),
            shown.alias("own_lines"),
        )
    )


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, source_turn, size): where the quotes of each message come from."""
    own = parsed.where("conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.explode(F.array_distinct(_keys(F.concat(F.array("text"), "paragraphs", "own_lines")))).alias("k")
    )
    first = own.groupBy("conv_id", F.col("k.hash").alias("hash")).agg(F.min("turn").alias("source_turn"))
    quoted = (
        parsed.where(F.size("quotes") > 0)
        .select("conv_id", "turn", F.explode("quotes").alias("q"))
        .select("conv_id", "turn", "q.level", F.posexplode(_keys(F.concat(F.array(F.array_join("q.parts", " ")), F.col("q.parts")))).alias("n", "k"))
        .groupBy("conv_id", "turn", "level", F.col("k.hash").alias("hash"))
        .agg(F.max("k.size").alias("size"))
    )
    return (
        quoted.join(first, ["conv_id", "hash"])
        .where("source_turn < turn")
        .groupBy("conv_id", "turn", "level", "source_turn")
        .agg(F.sum("size").alias("size"))
    )


def replies(found: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) of the messages whose level-1 quotes have a source."""
    return found.where("level = 1").groupBy("conv_id", "turn").agg(F.max_by("source_turn", F.struct("size", "source_turn")).alias("parent_turn"))


def roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, root_turn, depth) by doubling the pointers until all of them
    reach a message that replies to nothing."""
    at = checkpoint(parents.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")))
    while True:
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"), F.col("depth").alias("more"))
        step = at.join(up, ["conv_id", "root_turn"], "left")
        if step.where("above is not null").isEmpty():
            return at
        at = checkpoint(step.select("conv_id", "turn", "parent_turn", F.coalesce("above", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def places(threads: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_pos) of the replies: a thread is a tree, and a tour of it gives the
    places without a path for each message."""
    thread = F.struct("conv_id", "root_turn").alias("thread")
    edges = threads.select(thread, F.col("turn").alias("elem_id"), F.col("parent_turn").alias("parent_id"))
    tops = threads.select(thread, F.col("root_turn").alias("elem_id")).distinct()
    placed = tours.tour(edges.select("thread", "elem_id").union(tops), edges, "thread", [F.col("elem_id")])
    return placed.where("depth > 0").select("thread.conv_id", F.col("elem_id").alias("turn"), F.col("pre_order").alias("reply_pos"))


def reply_order(messages: DataFrame) -> DataFrame:
    """Every message without its quotes, with the message it replies to, the root of its
    thread, its depth and ``reply_pos``, its place in the thread from 0: depth first, so a reply
    follows what it answers and the replies to that, and replies to one message by turn.  A
    conversation in reply order is sorted by root_turn, then reply_pos."""
    parsed = parse(messages)
    found = links(parsed)
    threads = roots(replies(found))
    linked = found.groupBy("conv_id", "turn").agg(F.count("*").cast("long").alias("n_links"))
    rows = (
        parsed.join(threads.join(places(threads), ["conv_id", "turn"]), ["conv_id", "turn"], "left")
        .join(linked, ["conv_id", "turn"], "left")
        .withColumn("root_turn", F.coalesce("root_turn", "turn"))
    )
    return rows.select(
        "conv_id", "turn", "role", "text", "parent_turn", "root_turn",
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("reply_pos", F.lit(0)).cast("long").alias("reply_pos"),
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, root_turn, messages): each thread as one array of (role, text) in reply order."""
    said = F.struct("reply_pos", "turn", "role", "text")
    rows = reply_order(messages).groupBy("conv_id", "root_turn").agg(F.sort_array(F.collect_list(said)).alias("said"))
    return rows.select("conv_id", "root_turn", F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))

"""Column expressions over captions, names and tokens."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks, edits

#: Words as ``words`` splits them: white space here is that of the expressions.
_WORDS = re.compile(r"[^ \t\n\x0b\f\r]+")


def present(c: Column) -> Column:
    """NULL for an empty string, which counts as absent."""
    return F.nullif(c, F.lit(""))


def normal(c: Column) -> Column:
    """Trimmed, lower case, white space runs as one space."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def bare(c: Column) -> Column:
    """Lower case with anything but word characters as one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\w]+", " "))


def tokens(c: Column) -> Column:
    """ASCII words and numbers of a text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def vocabulary(*fields: Column) -> Column:
    """Aggregate: distinct tokens of the fields over a group."""
    return F.array_distinct(F.flatten(F.collect_list(F.concat(*(tokens(f) for f in fields)))))


def has_sequence(haystack: Column, needle: Column) -> Column:
    """The needle's tokens stand next to each other in the haystack."""
    padded = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return F.contains(padded(haystack), padded(needle))


def numbers(name: Column) -> Column:
    return F.filter(name, lambda t: t.rlike("^[0-9]+$"))


def app_of(state_id: Column) -> Column:
    return F.split_part(state_id, F.lit("__"), F.lit(1))


def group_of(step_id: Column) -> Column:
    return F.regexp_replace(step_id, r"_\d+$", "")


def state_id_of(image_name: Column) -> Column:
    """app__rest, from the words of an image file's name."""
    stem = F.regexp_replace(F.lower(image_name), r"\.[a-z0-9]+$", "")
    words = F.filter(F.split(stem, "[^a-z0-9]+"), lambda w: w != "")
    return F.when(F.size(words) > 1, F.concat_ws("__", words[0], F.array_join(F.slice(words, F.lit(2), F.size(words)), "_"))).otherwise(F.array_join(words, "_"))


def class_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def quoted(value: Column) -> Column:
    """A locator value: quoted where it has white space or a separator; NULL where it has a
    quote itself and can't be written."""
    return F.when(F.contains(value, F.lit('"')), F.lit(None).cast("string")).when(
        value.rlike(r"\s") | F.contains(value, F.lit("||")) | (value == ""), F.concat(F.lit('"'), value, F.lit('"'))
    ).otherwise(value)


def clean_name(c: Column) -> Column:
    """An identifier in capitals; E_ before a leading digit."""
    flat = F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.upper(F.when(flat.rlike("^[0-9]"), F.concat(F.lit("E_"), flat)).otherwise(flat))


def display_name(text: Column, label: Column, hint: Column, kind: Column) -> Column:
    shown = [F.nullif(F.trim(c), F.lit("")) for c in (text, label, hint)]
    return F.coalesce(*shown, F.concat(F.lit("("), kind, F.lit(")")))


def search_all_terms(query: Column, *fields: Column) -> Column:
    """Every term of the query stands in one of the fields."""
    hay = F.lower(F.concat_ws(" ", *fields))
    terms = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: w != "")
    return F.forall(terms, lambda w: F.contains(hay, w))


def edit_rate(hypothesis: Column, truth: Column) -> Column:
    """True character error rate: Levenshtein distance over the length of the truth."""
    return F.coalesce(F.try_divide(edit_distance(hypothesis, truth), F.length(truth)), F.lit(0.0))


def edit_distance(a: Column, b: Column, near: int = 32) -> Column:
    """Levenshtein distance.  Texts that are near each other, as most readings are, cost a band
    of that width; only for the others the whole table is filled."""
    within = F.levenshtein(a, b, near)
    return F.when(within >= 0, within).otherwise(F.levenshtein(a, b))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


@F.pandas_udf(T.LongType())
def word_distance(hypothesis: pd.Series, truth: pd.Series) -> pd.Series:
    """Levenshtein distance over words, of texts of any length; a null text has no words."""
    pairs = zip(hypothesis.fillna(""), truth.fillna(""), strict=True)
    return pd.Series([edits.distance(_WORDS.findall(a), _WORDS.findall(b)) for a, b in pairs], dtype="int64")


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratio of matching blocks of the lower-cased texts; 1 where both are empty.  Where it can't
    reach ``least`` it may come out as 0.  Pairs that a batch has several times are compared once."""

    @F.arrow_udf(T.DoubleType())
    def ratios(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (c.fill_null("").dictionary_encode() for c in (a, b))
        (of_x, of_y), (left, right) = ([c.indices.to_numpy().astype("int64") for c in (x, y)], [c.dictionary.to_pylist() for c in (x, y)])
        pairs, place = np.unique(of_x * len(right) + of_y, return_inverse=True)
        scores = [blocks.ratio(left[p // len(right)].lower(), right[p % len(right)].lower(), least) for p in pairs.tolist()]
        return pa.array(np.array(scores, dtype="float64")[place])

    return ratios(a, b)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("inserted", "deleted", "replaced")]))
def edit_counts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Counts of the matching-block edit script from b to a: a replaced stretch counts as its
    longer side."""
    rows = [blocks.edits(y, x) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)]
    return pd.DataFrame(rows, columns=["inserted", "deleted", "replaced"])


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, tests, F.lit(True))

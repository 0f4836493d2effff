r"""Operator 11: personal data, proposed by patterns, confirmed by checksums, scored by context.

A *proposal* is a stretch that one of the patterns of its kind finds; its validator says how
far the characters alone bear it out (Luhn for card numbers, mod-97 and the country's length for
account numbers, ranges for addresses and identity numbers), or drops it.  Words nearby that go
with the kind raise its score, words that go with other numbers lower it, and what reaches
THRESHOLD is reported.

The proposals of BASE kinds that pass their validators are reported whatever their context:
they are leftmost and do not overlap within their kind, and one that fails is dropped as a whole.
Beyond them the context can add spans, none of which overlaps another span:

* ``card``: groups of digits within a longer run that failed as a whole (two numbers side by
  side), if they pass Luhn and begin like the numbers of an issuer;
* ``iban``: account numbers that pass mod-97;
* ``phone`` without a country code, and ``ssn``, only where words nearby speak of them.

Nulls: a null text is empty; null ids keep their rows.  Repeated rows are searched each, an
empty table gives no rows, and other columns are ignored, or kept by ``redact``, whatever their
names.  Of proposals with one score the first counts.  Patterns run in time that grows with the
text, however long a run of letters or digits is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "ssn"]
#: Score from which an added span is reported; characters on each side that count as nearby.
THRESHOLD, NEAR = 0.6, 60

_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_COUNTRY = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![A-Za-z0-9.+-])\(?[0-9]{2,5}\)?[ /-](?:[0-9]{2,8}[ -]?){1,4}(?![A-Za-z0-9]|\.[0-9])")
_DATE = re.compile(r"[0-9]{4}[ /-][0-9]{1,2}[ /-][0-9]{1,2}$|[0-9]{1,2}[ /-][0-9]{1,2}[ /-][0-9]{4}$")
_SSN = re.compile(r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])")
_NEAR_WORD = re.compile(r"[^\W\d_]{2,}")

# Lengths of account numbers by country, as the standard lists them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "XK": 20,
}

#: Words, lower-cased, that go with a kind, and words that go with numbers of other kinds.
WORDS = {
    "email": "email mail contact write kontakt correo courriel",
    "ip": "ip address host server addr adresse dirección",
    "card": "card credit debit visa mastercard amex karte kreditkarte tarjeta carte crédito crédit payment cvv expires",
    "phone": "phone tel telephone call mobile cell fax telefon handy rufnummer teléfono llamar móvil téléphone appeler portable contact",
    "iban": "iban account bank konto cuenta compte transfer überweisung bic swift",
    "ssn": "ssn social security taxpayer",
}
#: What follows the check digits of an account number, by its length: single blanks may part it.
_ACCOUNT = {n: re.compile(f"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
OTHER = frozenset("order invoice isbn version build serial item sku article part tracking reference rechnung bestellung factura pedido facture commande".split())
_WORDS = {k: frozenset(v.split()) for k, v in WORDS.items()}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(t - 9 * (t > 9) for t in twice)) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number without blanks has its country's length and check digits."""
    moved = account[4:] + account[:4]
    return IBAN_LENGTHS.get(account[:2]) == len(account) and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def issued(digits: str) -> bool:
    """Whether a card number begins, and is as long, as those of an issuer."""
    n, two, three, four = len(digits), int(digits[:2]), int(digits[:3]), int(digits[:4])
    return (
        (digits[0] == "4" and n in (13, 16, 19))
        or (n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or two == 65 or four == 6011 or 644 <= three <= 649 or 3528 <= four <= 3589))
        or (n == 15 and two in (34, 37))
        or (n == 14 and (two in (36, 38) or 300 <= three <= 305))
    )


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


# --- base kinds -----------------------------------------------------------------------------


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part and domain: found by their @, since the run before it is
    then known to be the longest."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def number_runs(text: str) -> Iterator[tuple[int, int, bool]]:
    """Runs of digits, at most one blank or hyphen apart, and whether each is a card number."""
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = digits_of(m.group())
            if len(digits) >= 13:
                yield *m.span(), len(digits) <= 19 and luhn(digits)


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            yield m.span()


# --- kinds that need a checksum or words nearby ----------------------------------------------


def cards_within(text: str, start: int, end: int) -> Iterator[tuple[int, int, float]]:
    """Consecutive groups of a run of digits that make up a card number, the longest first at
    each place; a group is taken once."""
    groups = [(start + m.start(), start + m.end()) for m in re.finditer(r"[0-9]+", text[start:end])]
    i = 0
    while i < len(groups):
        digits, found = "", 0
        for j in range(i, len(groups)):
            digits += text[groups[j][0] : groups[j][1]]
            if len(digits) > 19:
                break
            if len(digits) >= 13 and issued(digits) and luhn(digits):
                found = j + 1
        if found:
            yield groups[i][0], groups[found - 1][1], 0.7
        i = found or i + 1


def accounts(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _COUNTRY.finditer(text):
        size = IBAN_LENGTHS.get(m.group()[:2])
        rest = _ACCOUNT[size].match(text, m.end()) if size else None
        if rest and mod97(text[m.start() : rest.end()].replace(" ", "")):
            yield m.start(), rest.end(), 0.8


def local_phones(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _LOCAL_PHONE.finditer(text):
        found = m.group().rstrip(" -")
        if 7 <= len(digits_of(found)) <= 12 and not _DATE.match(found):
            yield m.start(), m.start() + len(found), 0.4


def identity_numbers(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield *m.span(), 0.4


def context(text: str, kind: str, start: int, end: int) -> float:
    """What the words nearby add to a score: 0.3 for those of the kind, less 0.3 for others."""
    near = {w.lower() for w in _NEAR_WORD.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
    return 0.3 * bool(near & _WORDS[kind]) - 0.3 * bool(near & OTHER)


@dataclass(frozen=True)
class Rules:
    """What is searched beside the base kinds."""

    threshold: float = THRESHOLD
    added: bool = True


def spans(text: str, rules: Rules) -> list[Span]:
    """All spans of a text, by kind as listed in BASE and ADDED, then by start."""
    runs = list(number_runs(text))
    base = [("email", s, e, 0.9) for s, e in emails(text)] + [("ip", s, e, 0.7) for s, e in addresses(text)]
    base += [("card", s, e, 0.8) for s, e, good in runs if good] + [("phone", s, e, 0.7) for s, e in phones(text)]
    out = [Span(k, s, e, min(1.0, max(0.0, p + context(text, k, s, e))), True) for k, s, e, p in base]
    if rules.added:
        more = [("card", *x) for s, e, good in runs if not good for x in cards_within(text, s, e)]
        more += [(k, *x) for k, find in (("iban", accounts), ("phone", local_phones), ("ssn", identity_numbers)) for x in find(text)]
        scored = [Span(k, s, e, min(1.0, p + context(text, k, s, e)), False) for k, s, e, p in more]
        out += apart(sorted(x for x in scored if x.score >= rules.threshold), out)
    order = {k: i for i, k in enumerate([*BASE, *ADDED])}
    return sorted(out, key=lambda x: (order[x.kind], x.start))


def apart(candidates: list[Span], taken: list[Span]) -> list[Span]:
    """Candidates that overlap no taken span and no better candidate: a sweep by start keeps the
    better of two that overlap."""
    held = sorted(taken, key=lambda x: x.start)
    starts, reach = [x.start for x in held], list(accumulate((x.end for x in held), max))
    kept: list[Span] = []
    for x in sorted(candidates, key=lambda x: (x.start, -x.score)):
        before = bisect_left(starts, x.end)
        if before and reach[before - 1] > x.start:
            continue
        if kept and x.start < kept[-1].end:
            if x.score > kept[-1].score:
                kept[-1] = x
            continue
        kept.append(x)
    return kept


# --- Spark ----------------------------------------------------------------------------------

SPANS = "array<struct<kind: string, start: long, end: long, score: double, base: boolean>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def _with(batch: pa.RecordBatch, f: Callable[[str], object], kind: pa.DataType, name: str) -> pa.RecordBatch:
    values = pa.array([f(t.as_py() or "") for t in batch.column("text")], kind)
    at = batch.schema.get_field_index(name)
    return batch.set_column(at, name, values) if at >= 0 else batch.append_column(name, values)


def find(docs: DataFrame, threshold: float = THRESHOLD, added: bool = True) -> DataFrame:
    """(doc_id, spans) of every document; places are code points, the end exclusive."""
    rules = Rules(threshold, added)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _with(batch, lambda t: [x._asdict() for x in spans(t, rules)], _ARROW_SPANS, "spans").drop_columns(["text"])

    return map_batches(docs.select("doc_id", "text"), one, f"doc_id {kind}, spans {SPANS}")


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents with ``[KIND]`` in place of every span, overlapping ones as one; null texts
    stay null, and other columns as they are."""
    rules = Rules(threshold)

    def hidden(text: str) -> str:
        out, done = [], 0
        for x in sorted(spans(text, rules), key=lambda x: (x.start, -x.end)):
            if x.start >= done:
                out += [text[done : x.start], f"[{x.kind.upper()}]"]
            done = max(done, x.end)
        return "".join(out) + text[done:]

    def run(batches):
        for batch in batches:
            values = pa.array([None if not t.is_valid else hidden(t.as_py()) for t in batch.column("text")], batch.schema.field("text").type)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", values)

    return docs.mapInArrow(run, T.StructType(list(docs.schema)))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans of each kind, the hash of the base spans, and all spans."""
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    of = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))

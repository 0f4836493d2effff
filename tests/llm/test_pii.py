"""Personal data: base kinds against plain patterns, checksums, words nearby, redaction."""

import hashlib
import random
import re
import time

import pytest

from screenspark.llm import pii as P

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good_luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def plain(text):
    """The base kinds by the contract's patterns, as they stand."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and good_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [(x.kind, x.start, x.end) for x in P.spans(text, P.Rules()) if x.base]


def test_base_kinds_on_random_texts():
    rng = random.Random(3)
    pieces = ["a", "B", "@", ".", "-", "_", "+", "1", "22", "255", "256", "0", " ", "(", ")", "é", "日", "4", "4111111111111111", "x@y.z", "\n", "%", "10.0.0.1", "+1 (523) 555-1055"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert base(text) == plain(text), text


def test_query_against_plain_patterns(spark):
    from screenspark.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_pii"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want, row = plain(text), got[i]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x[0] for x in want) for k in P.BASE]
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert row.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(row.spans.split(","))
        assert row.spans == ",".join(f"{x.kind}:{x.start}:{x.end}" for x in P.spans(text, P.Rules()))


@pytest.mark.parametrize(
    "text, want",
    [
        ("pay to DE89 3704 0044 0532 0130 00 NOW", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("GB82WEST12345698765432.", [("iban", "GB82WEST12345698765432")]),
        ("DE89 3704 0044 0532 0130 01", []),  # mod-97 fails
        ("4465758382889437 4111111111111111", [("card", "4465758382889437"), ("card", "4111111111111111")]),
        ("9999999999999995 9999999999999995", []),  # no issuer's
        ("my SSN is 123-45-6789", [("ssn", "123-45-6789")]),
        ("item 123-45-6789", []),
        ("SSN 000-45-6789, order SSN 123-45-6789", []),  # no such area; an order number, by the words nearby
        ("Tel. 0171 2345678, heute", [("phone", "0171 2345678")]),
        ("0171 2345678", []),
        ("contact us since 2024-01-15", []),
        ("call +1 (523) 555-1055", [("phone", "+1 (523) 555-1055")]),
    ],
)
def test_checksums_and_words_nearby(text, want):
    assert [(x.kind, text[x.start : x.end]) for x in P.spans(text, P.Rules())] == want


def test_mod97_and_luhn():
    for account in ("NL91ABNA0417164300", "FR1420041010050500013M02606", "CH9300762011623852957"):
        assert P.mod97(account) and not P.mod97(account[:-1] + str((int(account[-1]) + 1) % 10))
    rng = random.Random(1)
    for _ in range(500):
        d = "".join(rng.choice("0123456789") for _ in range(rng.randint(13, 19)))
        assert P.luhn(d) == good_luhn(d)


def test_context_moves_scores():
    near = P.spans("card 4111111111111111", P.Rules())[0].score
    assert near > P.spans("4111111111111111", P.Rules())[0].score > P.spans("invoice 4111111111111111", P.Rules())[0].score
    assert P.spans("Tel. 0171 2345678", P.Rules(threshold=0.9)) == [] == P.spans("Tel. 0171 2345678", P.Rules(added=False))


def test_spans_that_overlap_stay_apart():
    s = lambda a, b, score=0.7: P.Span("card", a, b, score, False)
    assert P.apart([s(0, 100), s(10, 20), s(30, 40, 0.6), s(35, 50, 0.8)], [s(90, 95)]) == [s(10, 20), s(35, 50, 0.8)]


@pytest.mark.parametrize("text", ["x" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "1 " * 150_000, "4 " * 40_000, "+1" + "." * 300_000, "AB12 " * 60_000, "é" * 200_000 + " a@b.cd", "12-" * 100_000, "tel (12345 " * 20_000])
def test_long_texts_take_linear_time(text):
    began = time.perf_counter()
    P.spans(text, P.Rules())
    assert time.perf_counter() - began < 5


def test_odd_rows_and_redaction(spark):
    rows = [(1, "mail a@b.cd and é a@b.cd", 1), (None, None, 2), (3, "", 3), (3, "card 4111111111111111", 4), (3, "card 4111111111111111", 4)]
    docs = spark.createDataFrame([(i, t, n, "y") for i, t, n in rows], "doc_id long, text string, spans int, kind string").repartition(2)
    found = sorted(((r.doc_id, [(x.start, x.end) for x in r.spans]) for r in P.find(docs).collect()), key=str)
    assert found == sorted([(1, [(5, 11), (18, 24)]), (None, []), (3, []), (3, [(5, 21)]), (3, [(5, 21)])], key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.base_sha256 for r in P.digest(P.find(docs.where("text is null"))).collect()] == [empty]
    out = P.redact(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.spans) for r in out.collect()), key=str) == sorted([(1, "mail [EMAIL] and é [EMAIL]", 1), (None, None, 2), (3, "", 3), (3, "card [CARD]", 4), (3, "card [CARD]", 4)], key=str)
    assert P.find(docs.where("false")).count() == 0 == P.redact(docs.where("false")).count()

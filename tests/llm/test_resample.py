"""Importance resampling and its radix sort against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.llm import resample as R
from screenspark.llm import textkernel as K

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = ["", " ", None, "one", "\x00a\x7fb{c", "É é Ünü 日本 x", "w " * 60, "x" * 5000 + " y", "A-B_C 1.5", "ten words " * 12, "ten words " * 12]


def buckets(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def brute(rows, target):
    """The contract, row by row: {(doc_id, text): (n_features, weight, score, rank)} in a list."""
    own = [(i, *buckets(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in buckets(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, n, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: 25 * len(fit) // 100])}
    return [(r[0], r[2], r[3], r[4], rank.get(id(r))) for r in out]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_crc_of_spans():
    rng = random.Random(1)
    text = "".join(rng.choice("ab é日 ") for _ in range(2000)).encode()
    data = np.frombuffer(text, np.uint8)
    start = np.array([0, 5, 5, 7, 100, 300])
    end = np.array([0, 6, 5, 60, 1900, 348])
    got = K.crc_spans(data, start, end, np.full(6, K.CRC_START, np.uint32)) ^ np.uint32(K.CRC_START)
    assert got.tolist() == [zlib.crc32(text[a:b]) for a, b in zip(start, end, strict=True)]


def test_query_against_brute_force(spark):
    from screenspark.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op12_resample"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(got.collect(), brute(docs, target))


def test_odd_rows(spark):
    rows = list(enumerate(ODD)) + [(None, "ten words " * 30), (None, None), (3, "again " * 25), (3, "again " * 25), (-7, "minus seven " * 11), (2**62, "a b c d " * 9), (-(2**62), "b c d e " * 9)]
    rng = random.Random(2)
    rows += [(100 + i, " ".join(rng.choice(["one", "Two", "drei", "é", "4"]) for _ in range(rng.randint(15, 30)))) for i in range(200)]
    docs = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], "doc_id long, text string, score int, place string, digit int").repartition(3)
    target = spark.createDataFrame([("two drei",), (None,)], "text string")
    got = R.resample(docs, target).drop("n_words").select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = brute(rows, ["two drei", None])
    same(got, want)
    assert R.resample(docs.where("false"), target).count() == 0
    assert R.resample(docs, target.where("false")).count() == len(rows)
    with pytest.raises(TypeError):
        R.resample(docs.withColumn("doc_id", F.col("doc_id").cast("string")), target)


@pytest.mark.parametrize("seed", range(3))
def test_ranks_of_skewed_keys(spark, seed, monkeypatch):
    """Small digits and parts, a third of the rows with one score, ids of all sizes and nulls."""
    monkeypatch.setattr(R, "DIGIT_BITS", 4 + 4 * seed)
    monkeypatch.setattr(R, "PART_ROWS", 50)
    rng = random.Random(seed)
    ids = [rng.choice([None, rng.randint(-9, 9), rng.randint(-(2**63), 2**63 - 1) if seed == 2 else rng.randint(0, 10**6)]) for _ in range(1500)]
    rows = [(i, 5 if rng.random() < 0.33 else rng.randint(-3000, 9000), k) for k, i in enumerate(ids)]
    table = spark.createDataFrame(rows, "doc_id long, score long, tag int").repartition(7)
    got = sorted(R.ranked(table).collect(), key=lambda r: r.place)
    assert [(r.doc_id, r.score) for r in got] == [(i, s) for i, s, _ in sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))]
    assert [r.place for r in got] == sorted(r.tag for r in got) == list(range(1500))


def test_digits_cover_the_key():
    for bits in (1, 12, 13, 24, 25, 63, 65):
        parts = R.digits(bits)
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) == bits
        assert max(n for _, n in parts) <= 12

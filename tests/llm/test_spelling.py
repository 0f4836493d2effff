"""Spelling variants against a plain comparison of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from screenspark.llm import spelling as S

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(rows, every=31, least=7):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= least:
                out[w] += 1
    return out


def brute(rows, every=31):
    """By all words with one letter left out: two words are near if one is the other less a
    letter, or both leave the same after a letter at the same place."""
    n = {w: k for w, k in words_of(rows, every).items() if k >= 2}
    less = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            less[k, w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for (_, short), group in less.items():
        for w in group:
            near[w] |= group - {w}
            if short in n:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out)


def told(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def test_query_against_brute_force(spark):
    from screenspark.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    assert told(QUERIES["op13_spelling"](spark, SF)) == want
    assert sum(w[1] is not None for w in want) > 3


@pytest.fixture(scope="module")
def made():
    """Words of two letters, so that nearly all share signatures and halves, and edits at every
    place, with counts that make chains of forms."""
    rng = random.Random(5)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(7, 11))) for _ in range(150)] + ["transaction", "straße" + "é" * 5, "Éclair" + "x" * 40]
    rows = []
    for w in base:
        for times in (300, 25, 2, 2, 3):
            rows.append((len(rows), f"{w} " * times))
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k:], w[:k] + rng.choice("abc") + w[k + 1 :]])
    return rows


@pytest.mark.parametrize("parts, subparts, crowd", [(3, 1, 48), (3, 1, 2), (2, 3, 4), (1, 5, 300)])
def test_signatures_lose_no_pair(spark, made, monkeypatch, parts, subparts, crowd):
    monkeypatch.setattr(S, "PARTS", parts)
    monkeypatch.setattr(S, "SUBPARTS", subparts)
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(S, "GATHER_BYTES", 4000)
    counts = {w: k for w, k in words_of(made).items() if k >= 2}
    words = pa.table({"word": pa.array([w.encode("latin-1") for w in counts], pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})
    v = S.Vocabulary(words.column("word").combine_chunks())
    word, tag, key = v.keys()
    order = np.argsort(key.view(np.int64), kind="stable")
    rows = words.take(pa.array(word[order])).append_column("tag", pa.array(tag[order], pa.int32())).append_column("key", pa.array(key.view(np.int64)[order]))
    found = S.verified(rows).to_pandas().groupby("word").near.sum()
    assert {w.decode("latin-1"): k for w, k in found.items()} == {w[0]: w[4] for w in brute(made) if w[4]}
    if parts == 3:
        docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
        assert told(S.variants(docs)) == brute(made)


def test_chains_of_forms(spark, made):
    want = brute(made)
    assert any(w[1] is not None and w[1] != w[2] for w in want)
    rows = [(f"w{i}".encode(), f"w{i + 1}".encode()) for i in range(9)]
    got = {bytes(r.word): bytes(r.root) for r in S.roots(spark.createDataFrame(rows, "word binary, form binary"), 10**9, 10).collect()}
    assert set(got.values()) == {b"w9"} and len(got) == 9


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Abcdefg abcdefg"), (3, "ÀÀÀÀÀÀÀ ààààààà × ÷÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷"), (3, "ÀÀÀÀÀÀÀ ààààààà"), (3, "ÀÀÀÀÀÀÀ ààààààà"), (4, "x" * 5000 + " " + "x" * 4999 + " ĀabcdefgĀabcdefg日abcdefg"), (4, "x" * 5000 + "1" + "x" * 4999)]
    rows += [(k, " ".join(["Wörterbuch"] * 40 + ["Wörterbch"] * 2)) for k in range(60)]
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    assert told(S.variants(docs)) == brute(rows)
    assert told(S.variants(docs, every=1)) == brute(rows, every=1)
    assert S.variants(docs.where("false")).collect() == []


def test_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(S.K.Prefix, "span", lambda self, s, e: np.zeros(len(s), np.uint64))
    data = np.frombuffer(b"abcabcabdabc", np.uint8)
    got = S.distinct(data, np.array([3, 3, 3, 3])).to_pydict()
    total = Counter()
    for w, k in zip(got["word"], got["n"], strict=True):
        total[w] += k
    assert total == {b"abc": 3, b"abd": 1}


def test_choices_need_subparts(monkeypatch):
    monkeypatch.setattr(S, "PARTS", 1)
    monkeypatch.setattr(S, "SUBPARTS", 2)
    with pytest.raises(ValueError):
        S.choices()

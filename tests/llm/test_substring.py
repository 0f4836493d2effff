"""Substring removal against brute force, over planted repeats and odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from screenspark.llm import anchors as A
from screenspark.llm import repeats as R
from screenspark.llm import substring as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passages = [text(k) for k in (20, 40, 60, 90)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            t = rng.choice(rows)[1] or ""
        elif kind < 0.5 and rows:
            words = (rng.choice(rows)[1] or "x").split()
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words)) if words else 0 : 1] = ["new"]
            t = " ".join(words)
        else:
            t = text(rng.randint(0, 150))
        if rng.random() < 0.4:
            t += "\n" + rng.choice(passages) + "\t " + text(rng.randint(0, 5))
        rows.append((i * 3, t))
    rows += [(1000, None), (1001, ""), (1002, "a " * 500), (1003, "a" * 700), (1004, passages[3] + " " + passages[3]), (1005, text(4000) + passages[2])]
    rows += [rows[0], rows[10]]
    rng.shuffle(rows)
    return rows


def brute_words(rows, width):
    seen = Counter()
    docs = [WORD.findall(t or "") for _, t in rows]
    for w in docs:
        for s in range(len(w) - width + 1):
            seen[tuple(w[s : s + width])] += 1
    out = []
    for (i, _), w in zip(rows, docs):
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s : s + width])] > 1:
                gone[s : s + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def brute_bytes(rows, width):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - width + 1):
            k = b[s : s + width]
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < (i, s):
                gone[s : s + width] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module", params=["plain", "common"])
def crowding(request):
    """The second time every anchor with two kinds of stretches counts as common, and the
    documents are dealt into many buckets."""
    old = R.COMMON, R.CROWDED, R.CHUNK_ROWS, A.BUCKET_BYTES
    if request.param == "common":
        R.COMMON, R.CROWDED, R.CHUNK_ROWS, A.BUCKET_BYTES = 1, 1, 50, 5000
    yield
    R.COMMON, R.CROWDED, R.CHUNK_ROWS, A.BUCKET_BYTES = old


@pytest.mark.parametrize("seed", [5, 6])
def test_words_match_brute_force(spark, crowding, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, doc_key string, spans string").repartition(3)
    got = sorted(tuple(r) for r in S.repeated_words(df).collect())
    assert got == brute_words(rows, 35)


@pytest.mark.parametrize("seed", [5, 6])
def test_bytes_match_brute_force(spark, crowding, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, doc_key string, spans string").repartition(3)
    got = sorted(tuple(r) for r in S.repeated_bytes(df).collect())
    assert got == brute_bytes(rows, 100)


def test_hits_are_grid_blocks_found_elsewhere(spark):
    rows = [(i, t) for i, t in corpus(7, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs, _, bits = A.dealt(df)
    found = A.hits(A.probes(docs, S.WORDS, 5, bits)).collect()
    got = {int(h) for r in found for h in A._unpacked(r.hits)}
    grid, every = set(), Counter()
    for _, t in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - 17 if len(w) >= 35 else 0):
            every[tuple(w[s : s + 18])] += 1
            grid |= {tuple(w[s : s + 18])} if s % 18 == 0 else set()
    assert len(got) == sum(every[g] > 1 for g in grid) > 20


def test_packed_numbers_come_back():
    for n in (0, 1, 1000):
        values = np.sort(np.random.default_rng(n).integers(0, 2**44, n, dtype=np.uint64))
        assert (A._unpacked(A._packed(values)) == values).all()
        marks = values % np.uint64(3) == 0
        assert (A._unflagged(A._flags(marks), n) == marks).all()


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.repeated_words(empty).collect() == [] and S.repeated_bytes(empty).collect() == []
    long = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, long), (1, long)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in S.repeated_bytes(df).collect()} == {1: 0, None: len(long)}
    assert {r.doc_id: r.n_removed for r in S.repeated_words(df).collect()} == {1: 60, None: 60}


def test_texts_without_repeats_stay(spark):
    long = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, "a  b\n" + long, 9), (2, "c " + long + " d", 9), (3, "just  this", 10), (4, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in S.without_repeated_words(df).collect()}
    assert got == {1: ("a  b", 4), 2: ("c\nd", 3), 3: ("just  this", 10), 4: (None, None)}


def shared(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(6))
def test_previous_factors_match_brute_force(seed):
    rng = random.Random(seed)
    width = rng.choice([8, 12, 33, 100])
    raw = bytes(rng.choice(b"ab" if seed % 2 else b"abcdefgh") for _ in range(150)) * 2 + b"x" * 120
    text, start = np.frombuffer(raw, np.uint8), np.arange(len(raw) - width + 1)
    place = np.array([rng.randrange(60) for _ in start]) if seed > 2 else start
    got = S.longest_previous_factors(text, start, place, width)
    part = [raw[s : s + width] for s in start]
    assert got.tolist() == [max((shared(part[i], part[j]) for j in range(len(part)) if place[j] < place[i]), default=0) for i in range(len(part))]


def test_smaller_before_matches_brute_force():
    for n in (0, 1, 2, 7, 64, 100):
        place = np.random.default_rng(n).integers(0, 1 + n // 3, n)
        want = [max((j for j in range(i) if place[j] < place[i]), default=-1) for i in range(n)]
        assert S.smaller_before(place).tolist() == want


def test_null_ids_are_told_apart(spark, crowding):
    """Texts with equal 32-bit hashes and no id, and the largest id beside none."""
    made = spark.range(400_000).selectExpr("concat_ws(' ', transform(sequence(1, 40 + int(id % 30)), k -> hex(xxhash64(id, k)))) as text").selectExpr("text", "hash(text) as h")
    pair = made.groupBy("h").agg({"text": "min", "h": "count"}).where("`count(h)` > 1").limit(1).select("h")
    texts = sorted(r.text for r in made.join(pair, "h").collect())
    assert len(texts) == 2
    repeat = " ".join(f"w{k}" for k in range(50))
    rows = [(None, texts[0]), (None, texts[1]), (None, repeat + " x " + repeat), (2**63 - 1, texts[0] + " y"), (7, repeat)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r)[1:] for r in S.repeated_words(df).collect())) == sorted(r[1:] for r in brute_words([(0, t) for _, t in rows], 35))
    # A null id comes last, and ties with the largest one.
    last = [(2**63 - 1 if i is None else i, t) for i, t in rows]
    got = S.repeated_bytes(df).collect()
    assert sorted((2**63 - 1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == brute_bytes(last, 100)
    kept = {r.text for r in S.without_repeated_words(df).collect()}
    assert texts[1] in kept and "x" in kept


def test_columns_of_any_name_are_kept(spark):
    long = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, "a " + long, 5, 6, 7, 8), (2, long, 1, 2, 3, 4)], "doc_id long, text string, __id int, __bucket int, __tag int, c0 int")
    got = S.without_repeated_words(df)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [(1, "a", 5, 6, 7, 8), (2, "", 1, 2, 3, 4)]


def test_ids_of_other_types_are_refused(spark):
    df = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    for f in (S.repeated_words, S.repeated_bytes, S.without_repeated_words):
        with pytest.raises(TypeError, match="integer"):
            f(df)


def test_pieces_of_a_range_change_nothing(monkeypatch):
    """However small the pieces are that a range is compared in, the hits are the same."""
    rng = np.random.default_rng(3)
    grams = [np.unique(rng.integers(0, 3000, 900)).astype(np.uint64) for _ in range(4)]
    flags = [[rng.random(len(g)) < share for g in grams] for share in (0.3, 0.05)]
    table = pa.table({
        "__range": pa.array([5] * 4, pa.int64()), "__bucket": pa.array(range(4), pa.int64()), "grams": pa.array([A._packed(g) for g in grams], pa.binary()),
        "grid": pa.array([A._flags(f) for f in flags[0]], pa.binary()), "many": pa.array([A._flags(f) for f in flags[1]], pa.binary()),
    })
    seen = {}
    for g, grid, many in zip(grams, *flags, strict=True):
        for x, a, b in zip(g.tolist(), grid.tolist(), many.tolist(), strict=True):
            n, block = seen.get(x, (0, False))
            seen[x] = n + 1 + b, block or a
    expected = [[x for x in g.tolist() if seen[x][0] > 1 and seen[x][1]] for g in grams]
    for most in (100, 1_000_000):
        monkeypatch.setattr(A, "PIECE_HASHES", most)
        out = A.of_range(table)
        assert [A._unpacked(raw).tolist() for raw in out.column("hits").to_pylist()] == expected

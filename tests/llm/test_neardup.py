"""Near-duplicate components against brute force."""

import random
import re

import numpy as np
import pytest

from screenspark.llm import neardup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"W{k}" if k % 3 else f"w{k}é" for k in range(400)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, rows = text(30), []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = WORD.findall(rng.choice(rows)[1] or "w1")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.2:
                w = w[: max(1, int(len(w) * rng.uniform(0.75, 1)))]
        else:
            w = text(rng.choice([0, 1, 3, 5, 8, 40, 90, 200]))
        if rng.random() < 0.3:
            w = w + passage
        t = " ".join(w)
        rows.append((i * 7, t.upper() if rng.random() < 0.1 and "é" not in t else t))
    rows += [(5000, None), (5001, ""), (5002, "a " * 300), (5003, "a " * 200), (5004, " ".join(text(3000)))]
    rows += [rows[0], rows[5]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, node string").repartition(3)
    got = sorted(tuple(r) for r in N.near_duplicates(df).collect())
    assert got == brute(rows)


def test_chain_of_links_and_one_of_each(spark):
    base = [f"t{k}" for k in range(200)]
    rows, w = [], base
    for i in range(8):  # each text links with the one before, the ends do not link
        w = w[:]
        for k in range(3):
            w[(i * 23 + k * 9) % 200] = f"new{i}_{k}"
        rows.append((i + 1, " ".join(w)))
    rows.append((99, " ".join(f"z{k}" for k in range(100))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in N.near_duplicates(df).collect()) == brute(rows)
    assert sorted(r.doc_id for r in N.one_of_each(df).collect()) == sorted({c for _, _, c in brute(rows)})


def test_empty_and_null(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, None), (None, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (4, 0, 4), (None, 0, None)], key=str)


def test_a_large_group_is_joined_in_tiles(spark, monkeypatch):
    def whole_group(*_):
        raise AssertionError("a whole group in one task")

    monkeypatch.setattr(N.R, "by_group", whole_group)
    rng = random.Random(3)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(120):  # near copies that all differ
        w = base[:]
        w[rng.randrange(30, 120)] = f"own{i}"
        rows.append((i, " ".join(w)))
    for i in range(40):  # strays that share a passage with them, some with each other
        rows.append((200 + i, " ".join(base[:30] + [f"s{i // 2}_{k}" for k in range(90)] + [f"e{i}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for tile, pairs in ((1000, 4_000_000), (7, 50)):
        monkeypatch.setattr(N, "TILE_ROWS", tile, raising=False)
        monkeypatch.setattr(N, "HUB_PAIRS", pairs, raising=False)
        monkeypatch.setattr(N, "FREQUENT", (4, 500) if tile == 1000 else (0, 20))
        assert sorted(tuple(r) for r in N.near_duplicates(df).collect()) == brute(rows)


@pytest.mark.parametrize("tile", [1, 5, 1000])
def test_pairs_across_components_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE_ROWS", tile, raising=False)
    rng = random.Random(tile)
    node = {k: (rng.choice([90, 100, 130]), rng.randint(40, 100), rng.randint(0, 3), 60) for k in range(60)}
    label = {k: rng.choice([0, 0, 0, k]) for k in node}
    rows = [(t, t % 2 * (1 + k % 5), k, rng.randint(1, 40), *node[k]) for t in range(3) for k in node if rng.random() < 0.7]
    live = spark.createDataFrame(rows, "token long, salt int, node long, left int, n int, most int, last long, spare int")
    labels = spark.createDataFrame(list(label.items()), "node long, label long")
    want = set()
    for t, _, a, left_a, na, most_a, last_a, spare_a in rows:
        for u, _, b, left_b, nb, most_b, last_b, spare_b in rows:
            pick = lambda x, y: x if last_a < last_b else y if last_a > last_b else min(x, y)  # noqa: B023, E731
            if t == u and a < b and label[a] != label[b] and 5 * min(na, nb) >= 4 * max(na, nb) and 9 * pick(most_a, most_b) >= 4 * (na + nb) and 9 * (min(left_a, left_b) + pick(spare_a, spare_b)) >= 4 * (na + nb):
                want.add((a, b, na, nb))
    got = {tuple(r)[:4] for r in N.across(N.mixed(live, labels)).collect()}
    assert want and got == want


@pytest.mark.parametrize("often", [(4, 500), (0, 1)])
def test_frequent_shingles_are_spread(spark, monkeypatch, often):
    monkeypatch.setattr(N, "FREQUENT", often)
    monkeypatch.setattr(N, "FRAGMENT_GRAMS", 250 if often[0] else 2)
    monkeypatch.setattr(N, "SENT_BYTES", 2 << 20 if often[0] else 100)
    rows = corpus(5, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in N.near_duplicates(df).collect()) == brute(rows)


def test_fragments_cut_the_global_order_evenly():
    rng = np.random.default_rng(2)
    gram = rng.integers(0, 2**64, 400_000, dtype=np.uint64)
    gram = np.concatenate([gram, np.repeat(gram[:200], 1500)])
    rank = np.floor(2 * np.log2(np.bincount(N._cell(gram), minlength=1 << N.SKETCH_BITS) + 1.0)).astype(np.uint8)
    cuts = N.pivots(rank, N.FRAGMENTS)
    sizes = np.bincount(np.searchsorted(cuts, N.in_order(gram, rank), "right"), minlength=N.FRAGMENTS)
    assert len(cuts) == N.FRAGMENTS - 1 and sizes.max() < 2 * len(gram) / N.FRAGMENTS
    assert (np.sort(cuts) == cuts).all() and len(N.pivots(np.zeros(8, np.uint8), 8)) == 7


def test_one_of_each_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(None, text, 1, 2), (None, text, 1, 2), (None, text + " x", 1, 2), (5, text + " y", 3, 4), (5, text + " z", 5, 6), (5, text + " z", 5, 6), (6, "", 7, 8), (6, "", 7, 8), (None, None, 9, 9)]
    rows += [(None, "only here " + " ".join(f"n{k}" for k in range(50)), 0, 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, doc_key int, again int").repartition(3)
    got = N.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.doc_key, r.again) for r in got.collect()), key=str)
    assert [r for r in kept if r[1] in (3, 5)] in ([(5, 3, 4)], [(5, 5, 6)])
    assert sorted((r for r in kept if r[1] not in (3, 5)), key=str) == sorted([(6, 7, 8), (6, 7, 8), (None, 9, 9), (None, 0, 0)], key=str)


def test_components_take_few_stages(spark):
    """A path of 200 nodes in mixed order, a star and a pair."""
    ids = [(i * 7919) % 200 for i in range(200)]
    edges = [*zip(ids, ids[1:], strict=False), *((1000, n) for n in range(1001, 1100)), (5000, -7), (-7, 5000)]
    tracker = spark.sparkContext._jsc.sc().statusStore()
    before = tracker.jobsList(None).size()
    got = {r["node"]: r["label"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(200)} | {n: 1000 for n in range(1000, 1100)} | {5000: -7, -7: -7}
    assert tracker.jobsList(None).size() - before < 60

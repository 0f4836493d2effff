"""Edit distances of sequences against the plain table."""

import random
import time

import pytest

from screenspark.functions import edits as E


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("near, block", [(24, 4096), (0, 3), (2, 1), (5, 7)])
def test_random_pairs(monkeypatch, near, block):
    monkeypatch.setattr(E, "NEAR", near)
    monkeypatch.setattr(E, "BLOCK", block)
    rng = random.Random(near)
    for _ in range(800):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 25))] if rng.random() < 0.6 else [x for x in a if rng.random() < 0.8]
        assert E.distance(a, b) == plain(a, b) == E.distance(b, a)
        if a and b:
            assert E.by_blocks(a, b) == plain(a, b)
            assert E.along_diagonals(*sorted((a, b), key=len), 30) in (plain(a, b), None)


def test_long_texts_are_quick():
    rng = random.Random(4)
    a = [f"w{i}" for i in range(20_000)]
    near = [x for x in a if rng.random() > 0.0004]
    began = time.perf_counter()
    assert E.distance(a, near) == len(a) - len(near)
    assert time.perf_counter() - began < 1
    b = [f"w{rng.randrange(20_000)}" for _ in range(20_000)]
    began = time.perf_counter()
    far = E.distance(a, b)
    assert time.perf_counter() - began < 4 and 15_000 < far <= 20_000
    assert E.distance([f"x{i}" for i in range(1_200_000)], ["y"]) == 1_200_000  # no limit on different words

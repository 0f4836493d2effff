"""Matching blocks of two texts, the same as ``difflib.SequenceMatcher`` finds, for use inside batches.

A longest match is sought among the stretches of characters that are not frequent in the second
text (all, where it is short) and then grown at both ends.  Its length is found by halving over
the sets of stretches of one length, so no character is held against all its equals.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable

import numpy as np

#: Length from which difflib leaves frequent characters out; the longest stretches kept as strings.
LONG, SHORT_RUN = 200, 64

Run = tuple[int, int]


def blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) in order, neighbours not joined."""
    if len(b) < LONG:
        return difflib.SequenceMatcher(None, a, b).get_matching_blocks()[:-1]
    rare = {c for c, n in Counter(b).items() if n <= len(b) // 100 + 1}
    found = re.compile("[" + re.escape("".join(sorted(rare))) + "]+") if rare else None
    runs = [[m.span() for m in found.finditer(t)] if found else [] for t in (a, b)]
    ends = [[e for _, e in r] for r in runs]
    queue, out = [(0, len(a), 0, len(b))], []
    while queue:
        alo, ahi, blo, bhi = queue.pop()
        i, j, n = _longest(a, _within(runs[0], ends[0], alo, ahi), b, _within(runs[1], ends[1], blo, bhi)) or (alo, blo, 0)
        back = _same_before(a, i, b, j, min(i - alo, j - blo)) if n else 0
        i, j, n = i - back, j - back, n + back
        n += _same_after(a, i + n, b, j + n, min(ahi - i, bhi - j) - n)
        if n:
            out.append((i, j, n))
            if alo < i and blo < j:
                queue.append((alo, i, blo, j))
            if i + n < ahi and j + n < bhi:
                queue.append((i + n, ahi, j + n, bhi))
    return sorted(out)


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Twice the share of matching characters, 1 for two empty texts.  0 where the characters
    that both have, wherever they stand, don't make up ``least``."""
    size = len(a) + len(b)
    if not size:
        return 1.0
    if least and (2.0 * min(len(a), len(b)) / size < least or 2.0 * (Counter(a) & Counter(b)).total() / size < least):
        return 0.0
    return 2.0 * sum(n for _, _, n in blocks(a, b)) / size


def edits(a: str, b: str) -> tuple[int, int, int]:
    """Items inserted, deleted and replaced from a to b; a replaced stretch counts as its longer side."""
    i = j = inserted = deleted = replaced = 0
    for x, y, n in [*blocks(a, b), (len(a), len(b), 0)]:
        if i < x and j < y:
            replaced += max(x - i, y - j)
        else:
            deleted, inserted = deleted + x - i, inserted + y - j
        i, j = x + n, y + n
    return inserted, deleted, replaced


def _within(runs: list[Run], ends: list[int], low: int, high: int) -> list[Run]:
    """The parts of the runs that lie there."""
    out = []
    for k in range(bisect_right(ends, low), len(runs)):
        s, e = runs[k]
        if s >= high:
            break
        out.append((max(s, low), min(e, high)))
    return out


def _longest(a: str, a_runs: list[Run], b: str, b_runs: list[Run]) -> tuple[int, int, int] | None:
    """The longest stretch that lies within a run of both: of equal ones the first in a, then in b."""
    if not a_runs or not b_runs:
        return None
    most = min(max(e - s for s, e in a_runs), max(e - s for s, e in b_runs))
    cut = lambda t, runs, n: {t[i : i + n] for s, e in runs for i in range(s, e - n + 1)}
    shared = _halved(lambda n: cut(a, a_runs, n) & cut(b, b_runs, n), min(most, SHORT_RUN))
    if shared is None:
        return None
    n, both = shared
    if n == SHORT_RUN < most:
        return _longest_by_ranks(a, a_runs, b, b_runs, most)
    i = next(i for s, e in a_runs for i in range(s, e - n + 1) if a[i : i + n] in both)
    return i, next(j for s, e in b_runs for j in _places(b, a[i : i + n], s, e)), n


def _places(text: str, part: str, low: int, high: int) -> list[int]:
    at = text.find(part, low, high)
    return [at] if at >= 0 else []


def _halved(shared: Callable[[int], object], most: int) -> tuple[int, object] | None:
    """The greatest length up to ``most`` for which something is shared, and what; a shorter
    stretch of a shared one is shared.  Short lengths, which are likely, are tried first."""
    best, n = None, 1
    while n <= most and (got := shared(n)):
        best, n = (n, got), min(2 * n, most) if n < most else most + 1
    if best is None:
        return None
    low, high = best[0], min(n, most + 1)
    while high - low > 1:
        middle = (low + high) // 2
        if got := shared(middle):
            low, best = middle, (middle, got)
        else:
            high = middle
    return best


def _longest_by_ranks(a: str, a_runs: list[Run], b: str, b_runs: list[Run], most: int) -> tuple[int, int, int]:
    """The same for long stretches: those of 1, 2, 4, ... characters get numbers, equal ones the
    same, and one of any length is told by the numbers of its first and last such part."""
    runs = [(0, s, e) for s, e in a_runs] + [(1, s, e) for s, e in b_runs]
    size = np.array([e - s for _, s, e in runs])
    place = np.concatenate([np.arange(s, e) for _, s, e in runs])
    left = np.repeat(size.cumsum(), size) - np.arange(size.sum())  # characters up to the end of the run
    of_a = np.arange(size.sum()) < sum(e - s for s, e in a_runs)
    ranks = {1: np.unique(np.frombuffer("".join((a, b)[k][s:e] for k, s, e in runs).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)}

    def names(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of stretches of n characters, and what tells them."""
        base = 1 << (n.bit_length() - 1)
        if base not in ranks:
            at, name = names_from(base // 2, base)
            ranks[base] = np.zeros(len(left), np.int64)
            ranks[base][at] = np.unique(name, return_inverse=True)[1]
        return names_from(base, n)

    def names_from(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(left >= n)
        return at, ranks[base][at] * (len(left) + 1) + ranks[base][at + n - base]

    def shared(n: int) -> tuple[int, int] | None:
        at, name = names(n)
        mine = of_a[at]
        hit = np.isin(name[mine], name[~mine])
        if not hit.any():
            return None
        i = int(hit.argmax())
        return int(place[at[mine][i]]), int(place[at[~mine][(name[~mine] == name[mine][i]).argmax()]])

    n, (i, j) = _halved(shared, most)
    return i, j, n


def _same_after(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters from there on are equal, up to ``most``."""
    n, step = 0, 32
    while n < most and step:
        take = min(step, most - n)
        if a[i + n : i + n + take] == b[j + n : j + n + take]:
            n, step = n + take, step * 2
        else:
            most, step = n + take, take // 2
    return n


def _same_before(a: str, i: int, b: str, j: int, most: int) -> int:
    n, step = 0, 32
    while n < most and step:
        take = min(step, most - n)
        if a[i - n - take : i - n] == b[j - n - take : j - n]:
            n, step = n + take, step * 2
        else:
            most, step = n + take, take // 2
    return n

"""Edit distance of two sequences of hashable items, for use inside batches.

What both share at either end is left out.  Near sequences are compared along diagonals, in
time that grows with their length and the square of their distance; the others by bit vectors,
a block of BLOCK items at a time, so memory grows with the length alone.
"""

from __future__ import annotations

from collections.abc import Sequence

#: Distance up to which diagonals are followed; items of a bit vector.
NEAR, BLOCK = 24, 4096


def distance(a: Sequence, b: Sequence) -> int:
    low, high = 0, 0
    short = min(len(a), len(b))
    while low < short and a[low] == b[low]:
        low += 1
    while high < short - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    near = along_diagonals(a, b, NEAR)
    return by_blocks(a, b) if near is None else near


def along_diagonals(a: Sequence, b: Sequence, most: int) -> int | None:
    """The distance if it is at most ``most``.  ``reach[d]`` is how far into a one gets on
    diagonal d (place in b less place in a) with so many edits."""
    m, n = len(a), len(b)
    if n - m > most:
        return None
    reach = {}
    for edits in range(most + 1):
        now = {}
        for d in range(-edits, edits + 1):
            if not -m <= d <= n:
                continue
            # A replaced item moves along the diagonal; one left out of a comes from the
            # diagonal above, one put into a from the diagonal below.
            i = 0 if edits == 0 else max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -1))
            i = min(i, m, n - d)
            while i < m and i + d < n and a[i] == b[i + d]:
                i += 1
            now[d] = i
        if now.get(n - m) == m:
            return edits
        reach = now
    return None


def by_blocks(a: Sequence, b: Sequence) -> int:
    """The distance by bit vectors over a.  A block hands the steps along its lower edge on to
    the next one."""
    edge = [1] * len(b)  # of the row above the first item: each place costs one more
    for start in range(0, len(a), BLOCK):
        part = a[start : start + BLOCK]
        places: dict = {}
        for i, x in enumerate(part):
            places[x] = places.get(x, 0) | 1 << i
        full, last = (1 << len(part)) - 1, 1 << (len(part) - 1)
        up, down = full, 0  # places where the column grows or falls
        for j, x in enumerate(b):
            same, step = places.get(x, 0), edge[j]
            fixed = same | down
            if step < 0:
                same |= 1
            across = (((same & up) + up) ^ up) | same
            grows, falls = down | (full & ~(across | up)), up & across
            edge[j] = 1 if grows & last else -1 if falls & last else 0
            grows, falls = grows << 1 & full, falls << 1 & full
            if step > 0:
                grows |= 1
            elif step < 0:
                falls |= 1
            up, down = falls | (full & ~(fixed | grows)), grows & fixed
    return len(a) + sum(edge)

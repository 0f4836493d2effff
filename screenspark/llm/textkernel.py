"""Vectorised helpers over the UTF-8 bytes of an Arrow string column.

Every operator that needs words, shingles or byte windows inside a task works on
blocks of whole documents: one ``uint8`` array plus document offsets.  Hashes are two
polynomials modulo the prime 2**31 - 1, of different bases and over different seeded values,
read off running sums, so a window of any length costs a subtraction in each; ``mix``
finalises the 62 bits.  (Modulo a power of two, long words made of two letters by the rule of
Thue and Morse would collide whatever the base.)
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds at most, unless a single document is longer.
BLOCK_BYTES = 1 << 19

#: Hands free pages of the C heap back, where the C library can.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Modulus of both lanes of a hash.
PRIME = (1 << 31) - 1
#: Bases of the two lanes, for bytes and for items that have hashes of their own.
_BYTE_BASES, _ITEM_BASES = (1_213_954_823, 684_501_377), (1_825_406_219, 397_204_093)
_P, _BITS = _U(PRIME), _U(31)


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME or a little over it, in place: under 2**32 for x under 2**62."""
    high = x >> _BITS
    x &= _P
    x += high
    return x


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in place, for x under 2**63."""
    x = _folded(_folded(x))
    x -= _P * (x >= _P)
    return x


@lru_cache(maxsize=8)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, PRIME, (2, 256), dtype=np.uint64)


_POWERS: dict[tuple[int, ...], list[np.ndarray]] = {}


def _power_table(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint32)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = _residue(out[:more] * _U(step))
        have, step = 2 * have, step * step % PRIME
    return out


def _powers(n: int, bases: tuple[int, int]) -> list[np.ndarray]:
    """Powers of both bases, then of their inverses, at least n of each.  A worker keeps as many
    as the blocks so far have asked for, up to those of a block's bytes."""
    have = _POWERS.get(bases)
    if have is None or len(have[0]) < n:
        m = min(1 << (n - 1).bit_length(), BLOCK_BYTES + 1) if n <= BLOCK_BYTES + 1 else n
        have = [_power_table(m, b) for b in (*bases, *(pow(b, -1, PRIME) for b in bases))]
        if n <= BLOCK_BYTES + 1:
            _POWERS[bases] = have
    return have


class Prefix:
    """Running hashes of a sequence; ``span(s, e)`` hashes items s..e-1.  ``lanes`` are the
    values of the items, under PRIME, in both lanes."""

    def __init__(self, lanes: tuple[np.ndarray, np.ndarray], bases: tuple[int, int]):
        self.n = len(lanes[0])
        powers = _powers(self.n + 1, bases)
        self.inverse = powers[2:]
        self.sum = []
        for values, power in zip(lanes, powers, strict=False):
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_folded(values * power[: self.n]), out=total[1:])
            self.sum.append(total)

    def _mixed(self, sums: list[np.ndarray], inverse: list[np.ndarray]) -> np.ndarray:
        low, high = (_residue(_folded(d) * i) for d, i in zip(sums, inverse, strict=True))
        return mix(high << _BITS | low)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._mixed([s[end] - s[start] for s in self.sum], [i[start] for i in self.inverse])

    def rolling(self, width: int) -> np.ndarray:
        """Hashes of all windows of that width, by start."""
        n = self.n + 1 - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return self._mixed([s[width:] - s[:n] for s in self.sum], [i[:n] for i in self.inverse])


def byte_prefix(data: np.ndarray, seed: int = 7) -> Prefix:
    first, second = _byte_values(seed)
    return Prefix((first[data], second[data]), _BYTE_BASES)


def item_prefix(hashes: np.ndarray) -> Prefix:
    return Prefix((hashes & _P, hashes >> _BITS & _P), _ITEM_BASES)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive whole documents; at the end, memory
    that is free again goes back to the system, since workers outlive their tasks."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs(ink: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of marked bytes; none crosses a document's start."""
    edge = np.zeros(len(ink) + 1, bool)  # a byte whose run can't go on from the one before
    edge[at] = True
    before = np.concatenate([[False], ink[:-1]]) if len(ink) else ink
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.concatenate([ink[1:], [False]]) if len(ink) else ink
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return start, end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block: byte spans, document of each, and the
    first word of every document (``first[d]`` to ``first[d + 1]``)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        ink = ~_SPACE[data]
        before = np.empty(len(ink), bool)
        before[:1] = False
        before[1:] = ink[:-1]
        heads = at[:-1][at[:-1] < len(ink)]
        before[heads] = False
        self.start = np.flatnonzero(ink & ~before)
        after = np.empty(len(ink), bool)
        after[-1:] = False
        after[:-1] = ink[1:]
        after[heads[heads > 0] - 1] = False
        self.end = np.flatnonzero(ink & ~after) + 1
        self.first = np.searchsorted(self.start, at, "left")
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(at) - 1), self.counts)

    def hashes(self, data: np.ndarray, seed: int = 7) -> np.ndarray:
        return byte_prefix(data, seed).span(self.start, self.end)


def minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum over windows of that width."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Totals of flags between consecutive offsets; an empty stretch has 0."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals that are sorted by start."""
    if len(starts) == 0:
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def coverage(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of n items covered by any of the half-open intervals."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), out >> np.uint32(1) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_CRC = _crc_table()
#: Register of a CRC-32 before its first byte; the CRC is the register with all bits flipped.
CRC_START = 0xFFFFFFFF
#: Bytes up to which all spans advance together; longer ones go on one by one.
_CRC_STEPS = 48


def crc_step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """CRC-32 registers after one more byte each."""
    return _CRC[(state ^ np.asarray(byte, np.uint32)) & np.uint32(0xFF)] ^ state >> np.uint32(8)


def crc_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of each span, from the registers given."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, out = start[order], state.astype(np.uint32)[order]
    longer = len(size) - np.bincount(np.minimum(size, _CRC_STEPS), minlength=_CRC_STEPS + 1).cumsum()  # spans of more than so many bytes
    for step in range(_CRC_STEPS):
        k = int(longer[step])
        if not k:
            break
        out[:k] = crc_step(out[:k], data[at[:k] + step])
    for i in np.flatnonzero(size[order] > _CRC_STEPS).tolist():
        rest = data[at[i] + _CRC_STEPS : end[order[i]]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i]) ^ CRC_START) ^ CRC_START
    back = np.empty_like(out)
    back[order] = out
    return back


class HashIndex:
    """Open-addressing map from 64-bit hashes to the order in which they were added."""

    def __init__(self, bits: int = 20):
        self.size, self.shift, self.n = 1 << bits, _U(64 - bits), 0
        self.key = np.zeros(self.size, np.uint64)
        self.value = np.full(self.size, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 where absent."""
        slot = self._slots(keys)
        out = self.value[slot]
        todo = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (self.size - 1)
            out[todo] = self.value[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.key[slot[todo]] != keys[todo])]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Add distinct keys that are absent; their numbers."""
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        if 2 * self.n > self.size:
            raise ValueError("the index is over half full")
        slot, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.value[slot[todo]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.key[slot[placed]], self.value[slot[placed]] = keys[placed], numbers[placed]
            todo = todo[self.key[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (self.size - 1)
        return numbers


def equal_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans of a and b, of the same sizes, hold the same bytes."""
    total = size.cumsum()
    step = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - size, size)
    differ = a[np.repeat(a_start, size) + step] != b[np.repeat(b_start, size) + step]
    out = np.ones(len(size), bool)
    out[np.searchsorted(total, np.flatnonzero(differ), "right")] = False
    return out


class SpanIndex:
    """Numbers of distinct spans, in the order in which they were added.  Spans are found by
    hash and told by their bytes."""

    def __init__(self, bits: int, most: int):
        self.index = HashIndex(bits)
        self.raw, self.used = np.zeros(1 << 16, np.uint8), 0
        self.start, self.size = np.zeros(most, np.int64), np.zeros(most, np.int64)

    @property
    def n(self) -> int:
        return self.index.n

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of spans; -1 where the hash is absent, -2 where it is that of other bytes."""
        got = self.index.find(keys)
        size = end - start
        other = (got >= 0) & (self.size[got] != size)
        rest = np.flatnonzero((got >= 0) & ~other)
        same = equal_spans(data, start[rest], self.raw, self.start[got[rest]], size[rest])
        got[other] = -2
        got[rest[~same]] = -2
        return got

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Add spans of distinct hashes that are absent; their numbers."""
        numbers, size = self.index.add(keys), end - start
        need = self.used + int(size.sum())
        if need > len(self.raw):
            self.raw = np.concatenate([self.raw[: self.used], np.zeros(max(need, 2 * self.used) - self.used, np.uint8)])
        at = size.cumsum() - size
        self.raw[self.used : need] = data[np.repeat(start - at, size) + np.arange(int(size.sum()))]
        self.start[numbers], self.size[numbers] = self.used + at, size
        self.used = need
        return numbers


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The spans of a block as text; callers pass spans that are whole characters."""
    raw = data.tobytes()
    return [raw[s:e].decode("utf-8", "replace") for s, e in zip(start.tolist(), end.tolist(), strict=True)]

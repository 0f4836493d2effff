"""Operator 13: spelling variants grouped around the frequent word one edit away.

Words are maximal runs of letters up to U+00FF, so each is a row of bytes, one a code point.
Where the contract's hash says so, a run loses one letter first.  Distinct words are counted
within blocks, then by a shuffle; all that follows runs over the vocabulary.

Near words (one letter inserted, deleted or replaced) are found by PartEnum signatures.  A
word's letters with their numbers of occurrence are a binary vector; an edit changes at most
two of its places.  The places are partitioned by hash into ``PARTS`` parts of ``SUBPARTS``
each; of some part at most 2 // PARTS subparts differ, so words that are near agree in one of
the enumerated choices of the others.  Made-up and natural words alike have many anagrams, so
a signature also carries half of the word: an edit leaves one half alone, the first or the
last.  Words with equal signatures meet by an equi-join and are verified letter by letter.
Where more than CROWD of them meet, what is not known to be equal is halved again and again,
so only words that agree in all but a shrinking stretch are compared.  A pair counts at the
first signature that its words share, so no pass over pairs is needed to make them distinct.

Nulls: a null text has no words; a null doc_id is hashed as an empty one.  Repeated rows count
each.  Of near words with one count the least in code-point order is the form.  Words of any
length take part.  An empty table has no words; other columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from . import textkernel as K
from .common import checkpoint

#: First-level parts of a vector, and subparts of each.
PARTS, SUBPARTS = 3, 1
#: Words with one signature that are compared pair by pair.
CROWD = 48
#: Bytes of words that a task gathers before it counts the distinct ones.
GATHER_BYTES = 1 << 22
_U = np.uint64

_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


def spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    first = size.cumsum() - size
    return data[np.repeat(start - first, size) + np.arange(int(size.sum()))]


def occurrences(ids: list[str], column: pa.Array, every: int, least: int):
    """(bytes, sizes) of the words of each block of texts: lower-cased runs of at least
    ``least`` letters; where ``every`` divides the CRC-32 of ``<id>:<run>``, without the letter
    at that CRC modulo the run's length."""
    for i, j, data, at in K.blocks(column):
        low = K.lower_ascii(data)
        lead = data == 0xC3  # first byte of U+00C0 to U+00FF
        tail = np.concatenate([[False], lead[:-1]]) if len(lead) else lead
        start, end = K.runs(_ASCII[data] | lead | tail, at)
        place = np.concatenate([[0], (~lead).cumsum()])
        size = place[end] - place[start]
        fit = size >= least
        start, end, size = start[fit], end[fit], size[fit]
        doc = np.searchsorted(at, start, "right") - 1
        begin = np.array([zlib.crc32(f"{x}:".encode()) ^ K.CRC_START for x in ids[i:j]], np.uint32)
        crc = (K.crc_spans(low, start, end, begin[doc]) ^ np.uint32(K.CRC_START)).astype(np.int64)
        letters = np.where(tail, low + np.uint8(0x40), low)[~lead]
        cut = crc % every == 0
        gone = np.where(cut, crc % np.maximum(size, 1), size)
        # A word is what stands before the letter that goes, and what stands after it.
        first, kept = place[start], size - cut
        own = kept >= least
        first, kept, gone = first[own], kept[own], gone[own]
        step = np.arange(int(kept.sum())) - np.repeat(kept.cumsum() - kept, kept)
        yield letters[np.repeat(first, kept) + step + (step >= np.repeat(gone, kept))], kept


def binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], size.cumsum()]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def distinct(data: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """(word, n) of words one after the other.  Words of one hash that differ stay apart."""
    end = size.cumsum()
    start = end - size
    _, first, back, n = np.unique(K.byte_prefix(data).span(start, end), return_index=True, return_inverse=True, return_counts=True)
    other = size != size[first][back]
    alike = np.flatnonzero(~other)
    other[alike] = ~K.equal_spans(data, start[alike], data, start[first][back[alike]], size[alike])
    if other.any():
        n -= np.bincount(back[other], minlength=len(n))
        first, n = np.concatenate([first, np.flatnonzero(other)]), np.concatenate([n, np.ones(int(other.sum()), np.int64)])
    return pa.RecordBatch.from_arrays([binary(spans(data, start[first], size[first]), size[first]), pa.array(n, pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, every: int = 31, least: int = 7, count: int = 2) -> DataFrame:
    """(word binary, n) of the distinct words with at least ``count`` occurrences; a word has a
    byte for each code point."""

    def run(batches):
        held, sizes, room = [], [], 0
        for batch in batches:
            ids = batch.column("name").to_pylist()
            for data, size in occurrences(ids, batch.column("text"), every, least):
                held.append(data)
                sizes.append(size)
                room += len(data)
                if room >= GATHER_BYTES:
                    yield distinct(np.concatenate(held), np.concatenate(sizes))
                    held, sizes, room = [], [], 0
        if room:
            yield distinct(np.concatenate(held), np.concatenate(sizes))

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    return named.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


# --- signatures -----------------------------------------------------------------------------


def choices() -> list[tuple[int, ...]]:
    """Subparts, of all parts in one row, that a signature covers."""
    differ = min(2 // PARTS, SUBPARTS - 1)
    if 2 // PARTS > differ:
        raise ValueError("a part needs more subparts than may differ")
    return [tuple(p * SUBPARTS + s for s in kept) for p in range(PARTS) for kept in combinations(range(SUBPARTS), SUBPARTS - differ)]


def signatures(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row for each word: hashes of its vector within each of the choices."""
    n, parts = len(size), PARTS * SUBPARTS
    word = np.repeat(np.arange(n), size)
    code = word << 8 | data
    code.sort()
    new = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
    at = np.arange(len(code))
    times = at - np.maximum.accumulate(np.where(new, at, 0))
    place = K.mix(((code & 0xFF) << 32 | times).astype(np.uint64) + _U(0x51ED27))
    total = np.zeros(n * parts, np.uint64)
    np.add.at(total, (code >> 8) * parts + (place >> _U(33)).astype(np.int64) % parts, K.mix(place ^ _U(0xA5A5)))
    total = K.mix(total.reshape(n, parts) + np.arange(1, parts + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    return np.stack([K.mix(sum(total[:, s] for s in kept) + _U(i)) for i, kept in enumerate(choices())], axis=1)


class Vocabulary:
    """Words of a batch, one after the other, with what comparing them takes."""

    def __init__(self, column: pa.Array):
        self.data, at = K.utf8(column)
        self.start, self.end = at[:-1], at[1:]
        self.size = np.diff(at)
        self.prefix = K.byte_prefix(self.data)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, tag, key) of all signatures.  Words of c and of c - 1 letters meet in class c.
        A tag tells whether the class is that of a longer word, the half, and the choice."""
        sig = signatures(self.data, self.size)
        n, many = sig.shape
        words, tags, keys = [], [], []
        for longer in (0, 1):
            c = self.size + longer
            head = self.prefix.span(self.start, self.start + c // 2)
            tail = self.prefix.span(self.end - (c - c // 2), self.end)
            for half, text in enumerate((head, tail)):
                base = K.mix(text + (c.astype(np.uint64) << _U(1) | _U(half)))
                for i in range(many):
                    words.append(np.arange(n))
                    tags.append(np.full(n, (longer << 1 | half) * many + i))
                    keys.append(K.mix(base ^ sig[:, i]))
        return np.concatenate(words), np.concatenate(tags), np.concatenate(keys)

    def parity(self) -> np.ndarray:
        """Bits that tell which letters a word has an odd number of times; an edit turns two at
        most."""
        bit = _U(1) << (self.data & 63).astype(np.uint64)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.bitwise_xor.accumulate(bit, out=total[1:])
        return total[self.end] ^ total[self.start]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of different words are one edit apart, letter by letter."""
        swap = self.size[a] < self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        longer = self.size[a] - self.size[b]
        out = longer <= 1
        a, b, longer = a[out], b[out], longer[out]
        if not len(a):
            return out
        size = self.size[b]
        first = size.cumsum() - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        at, one = np.repeat(self.start[a], size) + step, np.repeat(longer, size)
        other = self.data[np.repeat(self.start[b], size) + step]
        differ = self.data[at] != other
        shifted = self.data[at + one] != other
        replaced = np.add.reduceat(differ.astype(np.int64), first) == 1
        most = int(size.max())
        until = np.minimum.reduceat(np.where(differ, step, most), first)
        beyond = np.maximum.reduceat(np.where(shifted, step, -1), first)
        out[out] = np.where(longer == 0, replaced, beyond < until)
        return out


def meetings(v: Vocabulary, tag: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with equal keys that may be near, by parity; rows are in the order of keys."""
    many = len(choices())
    longer, half = tag // many >> 1, tag // many & 1
    c = v.size + longer
    row = np.arange(len(key))
    low = np.where(half == 0, v.start + c // 2, v.start)
    high = np.where(half == 0, v.end, v.end - (c - c // 2))
    left = np.where(half == 0, c - c // 2, c // 2)  # letters that may differ, of the longer word
    group, parity = key, v.parity()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(row):
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        count = np.diff(np.append(head, len(group)))
        crowded = (np.repeat(count, count) > CROWD) & (left > 1)
        last = np.repeat(head + count, count)  # end of a row's group
        i, k = np.flatnonzero(~crowded & (last - np.arange(len(row)) > 1)), 1
        while len(i):
            a, b = row[i], row[i + k]
            close = np.bitwise_count(parity[a] ^ parity[b]) <= 2
            found.append((a[close], b[close]))
            k += 1
            i = i[i + k < last[i]]
        row, low, high, left, group = (x[crowded] for x in (row, low, high, left, group))
        if not len(row):
            break
        h = left // 2
        ahead = K.mix(group ^ K.mix(v.prefix.span(low, low + h)))
        behind = K.mix(group + K.mix(v.prefix.span(high - (left - h), high)))
        row, group = np.concatenate([row, row]), np.concatenate([ahead, behind])
        low, high, left = np.concatenate([low + h, low]), np.concatenate([high, high - (left - h)]), np.concatenate([left - h, h])
        order = np.argsort(group, kind="stable")
        row, low, high, left, group = (x[order] for x in (row, low, high, left, group))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b = np.minimum(a, b), np.maximum(a, b)
    code = np.unique(a * len(key) + b)  # halves of halves meet more than once
    return code // len(key), code % len(key)


def verified(part: pa.Table) -> pa.RecordBatch | None:
    """Of each word of a signature: its near words that count here, and the best of them."""
    v = Vocabulary(part.column("word").combine_chunks())
    tag, n, key = part.column("tag").to_numpy(), part.column("n").to_numpy(), part.column("key").to_numpy().view(np.uint64)
    a, b = meetings(v, tag, key)
    fine = v.near(a, b)
    a, b = a[fine], b[fine]
    # A pair counts in the class of its longer word, by the first half and choice that agree.
    many = len(choices())
    c = np.maximum(v.size[a], v.size[b])
    fine = (v.size[a] + (tag[a] // many >> 1) == c) & (v.size[b] + (tag[b] // many >> 1) == c)
    a, b, c = a[fine], b[fine], c[fine]
    half, choice = tag[a] // many & 1, tag[a] % many
    heads = v.prefix.span(v.start[a], v.start[a] + c // 2) == v.prefix.span(v.start[b], v.start[b] + c // 2)
    rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    if not len(rows):
        return None
    sig = signatures(spans(v.data, v.start[rows], v.size[rows]), v.size[rows])
    first = (sig[place[: len(a)]] == sig[place[len(a) :]]).argmax(axis=1)
    fine = (first == choice) & ((half == 0) | ~heads)
    a, b = a[fine], b[fine]
    if not len(a):
        return None
    own, other = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(v.size), np.int64)  # code-point order of the words of this part
    words = part.column("word").combine_chunks()
    rank[pa.compute.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort([rank[other], -n[other], own])
    own, other = own[order], other[order]
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    near = np.diff(np.append(head, len(own)))
    take = lambda i: words.take(pa.array(i))
    return pa.RecordBatch.from_arrays([take(own[head]), pa.array(near, pa.int64()), pa.array(-n[other[head]], pa.int64()), take(other[head])], ["word", "near", "less", "other"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best struct<less, other>) of the words that have near words; ``less`` is
    the count of the best one, negated."""

    def sign(batches):
        for batch in batches:
            if batch.num_rows:
                word, tag, key = Vocabulary(batch.column("word")).keys()
                rows = batch.take(pa.array(word))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tag, pa.int32()), rows.column("word"), rows.column("n")], ["key", "tag", "word", "n"])

    signed = words.mapInArrow(sign, "key long, tag int, word binary, n long")
    found = R.by_group(signed, "key", verified, "word binary, near long, less long, other binary")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "other")).alias("best"))


def roots(links: DataFrame, most: int, factor: int) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling.  Counts grow by
    ``factor`` with each step, so a word of at most ``most`` occurrences ends a chain soon."""
    up = checkpoint(links.select("word", F.col("form").alias("root")))
    steps, reach = 1, factor * factor
    while reach <= most:
        steps, reach = steps + 1, reach * factor
    done = 1
    while done < steps:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        up = checkpoint(up.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root")))
        done *= 2
    return up


def variants(docs: DataFrame, every: int = 31, least: int = 7, count: int = 2, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words: the form is the near word with most
    occurrences, if it has ``factor`` times the word's; the root the last of the forms."""
    words = checkpoint(vocabulary(docs, every, least, count))
    best = words.join(near_words(words), "word", "left")
    formed = F.col("best.less") <= -factor * F.col("n")
    told = checkpoint(best.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")))
    most = told.agg(F.max("n")).first()[0] or 0
    up = roots(told.where(F.col("form").isNotNull()), most, factor)
    text = lambda c: F.decode(c, "ISO-8859-1")
    rooted = told.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return rooted.select(text(F.col("word")).alias("word"), text(F.col("form")).alias("form"), text(F.col("root")).alias("root"), "n", "n_near", "form_n")

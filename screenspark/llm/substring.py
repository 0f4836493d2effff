"""Operators 3 and 5: exact substring removal, over bytes and over words.

Operator 3 removes every byte covered by a 100-byte string that also starts earlier, by
document id and then by place.  Operator 5 removes every word covered by a window of 35
words that also starts anywhere else.  Both keep all documents and judge the input only.

Nulls: a null text is empty; a null doc_id comes after all others, the largest one apart, with
which it ties.  Rows with equal doc_id (or none) and different texts are documents of their
own, told apart by 64 bits of their texts; operator 3 orders their places by start alone.  So
are rows with equal doc_id and text (operator 5 removes what they share; for operator 3 none
of them is earlier).  Texts shorter than a window lose nothing; other columns of the table are
ignored, or kept whatever their names; an empty table gives no rows.  doc_id is an integer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from . import repeats as R
from . import textkernel as K
from .common import integer_ids

BYTES = R.Windows(width=100, block=24, words=False)
WORDS = R.Windows(width=35, block=18, words=True)


def _ranks(text: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """{n: rank of the n bytes from each place}, for n = 8, 16, 32, ... up to ``width``, by
    prefix doubling; equal bytes have equal ranks, and bytes behind the end count as zeros."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = padded[:-1] << np.uint64(8) | padded[1:]
    word = word[:-2] << np.uint64(16) | word[2:]
    word = word[:-4] << np.uint64(32) | word[4:]
    ranks = {8: np.unique(word[: len(text)], return_inverse=True)[1]}
    have = 8
    while 2 * have <= width:
        rank, second = ranks[have], np.zeros(len(text), np.int64)
        second[: max(0, len(rank) - have)] = rank[have:] + 1
        have *= 2
        ranks[have] = np.unique(rank * (len(text) + 2) + second, return_inverse=True)[1]
    return ranks


def smaller_before(place: np.ndarray) -> np.ndarray:
    """Of each element the last one before it that is smaller; -1 where there is none.  Goes up
    and down a tree of minima, all elements at once."""
    n = len(place)
    tree = [place]
    while len(tree[-1]) > 1:
        row = tree[-1] if len(tree[-1]) % 2 == 0 else np.append(tree[-1], np.iinfo(np.int64).max)
        tree.append(np.minimum(row[::2], row[1::2]))
    end, out = np.arange(n), np.full(n, -1, np.int64)
    todo = np.arange(n)
    found: list[np.ndarray] = []  # by level: elements whose answer lies in block out[element]
    for k, row in enumerate(tree):
        block = (end[todo] >> k) - 1
        own = (end[todo] >> k & 1) == 1
        hit = own.copy()
        hit[own] = row[block[own]] < place[todo[own]]
        out[todo[hit]] = block[hit]
        found.append(todo[hit])
        end[todo[own & ~hit]] -= 1 << k
        todo = todo[~hit]
        todo = todo[end[todo] > 0]
    down = np.zeros(0, np.int64)
    for k in range(len(tree) - 1, 0, -1):
        down = np.concatenate([down, found[k]])
        right = 2 * out[down] + 1
        row = tree[k - 1]
        ok = (right < len(row)) & (row[np.minimum(right, len(row) - 1)] < place[down])
        out[down] = np.where(ok, right, right - 1)
    return out


def longest_previous_factors(text: np.ndarray, start: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """How many bytes, ``width`` at most, the suffix at each start has in common with one of a
    smaller place.  Each start has ``width`` (8 or more) bytes behind it.

    In suffix order the longest common prefix shrinks with the distance, so the best earlier
    match of a suffix is the nearest one of a smaller place before it or after it."""
    n = len(start)
    ranks = _ranks(text, width)
    most = max(ranks)
    # Beginnings of ``width`` bytes: the first ``most`` of them, then the last ``most``.
    order = np.lexsort((place, ranks[most][start + width - most], ranks[most][start]))
    at, own = start[order], place[order]
    best = np.zeros(n, np.int64)
    before, after = smaller_before(own), n - 1 - smaller_before(own[::-1])[::-1]
    for other in (before, after):
        live = np.flatnonzero((other >= 0) & (other < n))
        a, b, size = at[live], at[other[live]], np.zeros(len(live), np.int64)
        for k in sorted(ranks, reverse=True):
            fits = np.flatnonzero(size + k <= width)
            equal = fits[ranks[k][a[fits] + size[fits]] == ranks[k][b[fits] + size[fits]]]
            size[equal] += k
        for _ in range(7):
            more = np.flatnonzero(size < width)
            equal = more[text[a[more] + size[more]] == text[b[more] + size[more]]]
            size[equal] += 1
            if not len(equal):
                break
        best[live] = np.maximum(best[live], size)
    out = np.zeros(n, np.int64)
    out[order] = best
    return out


def _lone_windows(part: pa.Table, keep_first: bool) -> list[tuple[np.ndarray, ...]]:
    """(id, tag, window, 1) of windows to remove, from rows of single windows."""
    route, name, tag, low, size = R._columns(part, "route", *R.KEY, "low", "size")
    order = R._order(route, name, low)
    route, name, tag, low, size = (c[order] for c in (route, name, tag, low, size))
    head = R._starts(route)
    at, of = np.flatnonzero(head), head.cumsum() - 1
    if keep_first:
        goes = (name > name[at][of]) | ((name == name[at][of]) & (low > low[at][of]))
    else:
        goes = np.add.reduceat(size.astype(np.int64), at)[of] > 1 if len(at) else np.zeros(0, bool)
    goes |= size == 0
    return [(name[goes], tag[goes], low[goes], np.ones(int(goes.sum()), np.int32))]


def _in_suffix_order(part: pa.Table, width: int) -> list[tuple[np.ndarray, ...]]:
    """The same from rows with content: those whose longest previous factor fills the window.
    Windows of different anchors differ, so the anchors of a chunk share one suffix order."""
    content = part.column("content").combine_chunks()
    name, tag, low, size = R._columns(part, *R.KEY, "low", "size")
    text, offsets = K.utf8(content)
    n = size.astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(int(n.sum())) - np.repeat(n.cumsum() - n, n)
    names, lows = name[row], low[row] + step
    order = np.lexsort((lows, names))
    place = np.empty(len(row), np.int64)
    place[order] = R._starts(names[order], lows[order]).cumsum()
    goes = longest_previous_factors(text, offsets[:-1][row] + step, place, width) >= width
    return [(names[goes], tag[row][goes], lows[goes].astype(np.int32), np.ones(int(goes.sum()), np.int32))]


def _runs(name: np.ndarray, tag: np.ndarray, low: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Consecutive windows of a document as one row."""
    order = np.lexsort((low, tag, name))
    name, tag, low, size = name[order], tag[order], low[order], size[order]
    new = R._starts(name, tag)
    new[1:] |= low[1:] > low[:-1] + size[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(name)) - 1
    return [name[at], tag[at], low[at], low[last] + size[last] - low[at] if len(at) else size]


def repeated_windows(docs: DataFrame, rows: DataFrame, windows: R.Windows, keep_first: bool) -> DataFrame:
    """(low, size) of the runs of windows that go, by document; rows: their stretches."""
    marks = R.settle(rows, keep_first)
    rows = R.opened(docs, marks, windows, keep_first, keep_first)

    def one(part: pa.Table) -> pa.RecordBatch:
        text = part.column("content").is_valid()
        found = _lone_windows(part.filter(pa.compute.invert(text)), keep_first)
        if keep_first and pa.compute.any(text).as_py():
            found += _in_suffix_order(part.filter(text), windows.width)
        name, tag, low, size = _runs(*(np.concatenate(c) for c in zip(*found, strict=True)))
        return R._batch({"__id": name, "__tag": tag, "low": low.astype(np.int32), "size": size.astype(np.int32)})

    compared = R.by_group(rows, "route", one, "__id long, __tag long, low int, size int")
    return marks.where(F.col("mark") == R.SETTLED).select(*R.KEY, "low", "size").unionByName(compared)


def _word_masks(column: pa.Array, spans: list, width: int):
    """For each document of a column: its bytes, the byte spans of its words, and the mask of
    words that go."""
    for i, j, data, at in K.blocks(column):
        w = K.Words(data, at)
        for d in range(j - i):
            a, b = int(w.first[d]), int(w.first[d + 1])
            low, end = spans[i + d]
            yield data, w.start[a:b], w.end[a:b], K.coverage(b - a, low, end + width - 1)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> bytes:
    """Kept words joined by one space."""
    keep = ~gone
    raw = data[start[0] : end[-1]].tobytes() if len(start) else b""
    base = int(start[0]) if len(start) else 0
    return b" ".join([raw[s - base : e - base] for s, e in zip(start[keep].tolist(), end[keep].tolist(), strict=True)])


def _changed(docs: DataFrame, windows: R.Windows, f, schema) -> DataFrame:
    """Runs f over all documents with the windows of each that also start elsewhere."""
    integer_ids(docs)
    buckets, n, bits = anchors.dealt(docs)
    spans = repeated_windows(docs.select("doc_id", "text"), anchors.stretches(buckets, n, bits, windows), windows, keep_first=False)
    return anchors.removed(buckets, n, spans, f, schema)


def repeated_words(docs: DataFrame, windows: R.Windows = WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""

    def one(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        n, gone, sha = [], [], []
        for data, start, end, mask in _word_masks(batch.column("text"), spans, windows.width):
            n.append(len(mask))
            gone.append(int(mask.sum()))
            sha.append(hashlib.sha256(_joined(data, start, end, mask)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _changed(docs.select("doc_id", "text"), windows, one, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeated_words(docs: DataFrame, windows: R.Windows = WORDS) -> DataFrame:
    """The documents with the kept stretches of their texts: white space between kept words
    stays, and ``n_chars``, where there is one, follows.  A document that loses nothing
    keeps its text as it is."""
    given = docs.columns
    names = [n if n in ("doc_id", "text", "n_chars") else f"c{i}" for i, n in enumerate(given)]
    docs = docs.toDF(*names)

    def one(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        texts, old = [], batch.column("text")
        for k, (data, start, end, mask) in enumerate(_word_masks(old, spans, windows.width)):
            if not mask.any():
                texts.append(old[k].as_py())
                continue
            keep = np.flatnonzero(~mask)
            new = np.concatenate([[True], np.diff(keep) > 1]) if len(keep) else np.zeros(0, bool)
            heads, last = keep[new], keep[np.append(np.flatnonzero(new)[1:], len(keep)) - 1] if len(keep) else keep
            texts.append("\n".join(data[start[a] : end[b]].tobytes().decode("utf-8", "replace") for a, b in zip(heads, last, strict=True)))
        columns = {n: batch.column(n) for n in names}
        columns["text"] = pa.array(texts, pa.string())
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return _changed(docs, windows, one, docs.schema).toDF(*given)


def repeated_bytes(docs: DataFrame, windows: R.Windows = BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def one(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        rows = []
        for i, j, data, at in K.blocks(batch.column("text")):
            for d in range(j - i):
                own = data[at[d] : at[d + 1]]
                mask = K.coverage(len(own), spans[i + d][0], spans[i + d][1] + windows.width - 1)
                edges = int((mask[1:] & ~mask[:-1]).sum() + mask[:1].sum())
                rows.append((len(own), int(mask.sum()), edges, hashlib.sha256(own[~mask].tobytes()).hexdigest()))
        n, gone, runs, sha = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    integer_ids(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", "text")
    spans = repeated_windows(own, R.stretches(own, windows, True), windows, keep_first=True)
    return R.removed(docs.select("doc_id", "text"), spans, one, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

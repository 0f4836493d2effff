"""Operator 2: cost-balanced packing of tokenised documents into fixed-length sequences.

One scan tokenises every document, cuts off full pieces and deals what is left, with its
ids, to buckets of a few thousand documents.  Each bucket is packed on its own: pieces in
descending order go to the sequence of least estimated cost that has room for them, and a
piece that fits nowhere is cut.  The capacities of a bucket add up to its tokens exactly
(the last ones are powers of two, which need no padding), so nothing is padded.

A null text counts as empty: its only token is the end-of-document id.  Repeated rows are
packed as often as they occur, null ids keep their rows, other columns are ignored, and an
empty table gives no pieces.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textkernel as K

#: Documents that a bucket holds on average.
BUCKET_DOCS = 4000
#: Distinct units that a worker remembers before it starts afresh; fewer than half of 2 ** INDEX_BITS.
MEMORY_UNITS, INDEX_BITS = 350_000, 20
#: Bytes of those units.
MEMORY_BYTES = 1 << 24

# White space beyond ASCII, as UTF-8, which the splitting pattern also knows.
_WIDE_SPACES = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_KEYS = np.sort(np.array([int.from_bytes(c.encode().rjust(3, b"\0"), "big") for c in _WIDE_SPACES], np.int64))


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[Callable[[str], list[int]], Callable[[str], list[int]]]:
    """(ids of a stretch without special tokens, ids of a whole text) of a byte-level BPE in
    tokenizers' JSON format.  Ranks are read off the vocabulary, where the id of a merged
    token is its rank; whole texts go to the tokenizer itself."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(shown[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    held: list[Tokenizer] = []  # few texts need it

    def whole(text: str) -> list[int]:
        if not held:
            held.append(Tokenizer.from_file(path))
        return held[0].encode(text, add_special_tokens=False).ids

    return fast.encode_ordinary, whole


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of stretches that tokenise independently of each other: a word
    with the space before it, or a run of other white space."""
    w = K.Words(data, at)
    n, docs = len(w.start), len(at) - 1
    left = np.empty(n, np.int64)  # end of the previous word, or the document's start
    left[1:] = w.end[:-1]
    heads = w.first[:-1][w.counts > 0]
    left[heads] = at[:-1][w.counts > 0]
    spaced = (w.start > left) & (data[np.maximum(w.start - 1, 0)] == 0x20) if n else np.zeros(0, bool)
    begin = w.start - spaced
    gap = begin - left
    pieces = (gap > 0).astype(np.int64) + ((gap > 1) & ~spaced)
    tail_from = at[:-1].copy()
    filled = w.counts > 0
    tail_from[filled] = w.end[w.first[1:][filled] - 1]
    tail = at[1:] > tail_from
    slots = pieces + 1
    total = np.concatenate([[0], slots.cumsum()])
    before = np.concatenate([[0], tail.cumsum()])  # tails of earlier documents
    place = total[:-1] + before[w.doc] if n else total[:-1]
    size = int(total[-1] + before[-1])
    start, end, doc = np.empty(size, np.int64), np.empty(size, np.int64), np.empty(size, np.int64)
    two, one = pieces == 2, pieces == 1
    start[place[one]], end[place[one]] = left[one], begin[one]
    start[place[two]], end[place[two]] = left[two], begin[two] - 1
    start[place[two] + 1], end[place[two] + 1] = begin[two] - 1, begin[two]
    for k in (0, 1, 2):
        doc[place[pieces >= k] + k] = w.doc[pieces >= k]
    start[place + pieces], end[place + pieces] = begin, w.end
    tails = np.flatnonzero(tail)
    spot = total[w.first[tails + 1]] + before[tails]
    start[spot], end[spot], doc[spot] = tail_from[tails], at[1:][tails], tails
    return start, end, doc


def _unusual(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Documents with white space beyond ASCII or a possible special token."""
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    two = padded[lead] << 8 | padded[lead + 1]
    key = np.where(padded[lead] == 0xC2, two, two << 8 | padded[lead + 2])
    spots = lead[np.isin(key, _WIDE_KEYS)]
    marks = np.flatnonzero(data == ord("<"))
    marks = marks[padded[marks + 1] == ord("|")]
    out = np.zeros(len(at) - 1, bool)
    out[np.searchsorted(at, np.concatenate([spots, marks]), "right") - 1] = True
    return out


class Tokens:
    """Ids of blocks of documents; remembers the ids of every distinct unit it has met."""

    def __init__(self, path: str, end_id: int):
        self.part, self.whole = encoder(path)
        self.end_id = end_id
        self._clear()

    def _clear(self):
        self.index = K.SpanIndex(INDEX_BITS, 2 * MEMORY_UNITS + 2)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size = np.zeros(2 * MEMORY_UNITS + 2, np.int64), np.zeros(2 * MEMORY_UNITS + 2, np.int64)
        none = np.zeros(1, np.int64)
        self._store(self.index.add(np.zeros(0, np.uint8), none, none, np.array([1], np.uint64)), [[self.end_id]])  # unit 0

    def _store(self, numbers: np.ndarray, ids: list[list[int]]):
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        need = self.used + int(sizes.sum())
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(need, np.uint32)])
        self.flat[self.used : need] = [i for one in ids for i in one]
        self.start[numbers], self.size[numbers] = self.used + np.concatenate([[0], sizes[:-1].cumsum()]), sizes
        self.used = need

    def _numbers(self, data, start, end, keys) -> np.ndarray:
        """Numbers of units; negative where a unit's hash is that of another unit."""
        got = self.index.find(data, start, end, keys)
        if (got == -1).any():
            spots = np.flatnonzero(got == -1)
            fresh, where = np.unique(keys[spots], return_index=True)
            spots = spots[where]
            if self.index.n + len(fresh) > MEMORY_UNITS or self.index.used > MEMORY_BYTES:
                self._clear()
                fresh, spots = np.unique(keys, return_index=True)
            self._store(self.index.add(data, start[spots], end[spots], fresh), [self.part(s) for s in K.strings(data, start[spots], end[spots])])
            got = self.index.find(data, start, end, keys)
        return got

    def block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, offsets by document); each document ends
        with the end-of-document id."""
        docs = len(at) - 1
        start, end, doc = units(data, at)
        if len(start) > MEMORY_UNITS // 2:  # a single very long document
            return self._plain(data, at)
        odd = _unusual(data, at)
        number = self._numbers(data, start, end, K.byte_prefix(data).span(start, end))
        odd[doc[number < 0]] = True  # the tokenizer itself sees to those documents
        keep = ~odd[doc]
        number, doc = number[keep], doc[keep]
        first = np.searchsorted(doc, np.arange(docs + 1))
        number = np.insert(number, first[1:], 0)
        sizes = self.size[number]
        ends = sizes.cumsum()
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[number] - (ends - sizes), sizes) + np.arange(total)]
        offsets = np.concatenate([[0], ends[first[1:] + np.arange(docs)]]) if docs else np.zeros(1, np.int64)
        if odd.any():
            parts = [ids[offsets[d] : offsets[d + 1]] for d in range(docs)]
            for d in np.flatnonzero(odd):
                text = data[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace")
                parts[d] = np.array([*self.whole(text), self.end_id], np.uint32)
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets

    def _plain(self, data, at):
        parts = [np.array([*self.whole(data[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace")), self.end_id], np.uint32) for d in range(len(at) - 1)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_WORKER: dict[tuple[str, int], Tokens] = {}


def tokens_of(path: str, end_id: int) -> Tokens:
    """The tokeniser of this Python worker, which outlives a task."""
    if (path, end_id) not in _WORKER:
        _WORKER.clear()
        _WORKER[path, end_id] = Tokens(path, end_id)
    return _WORKER[path, end_id]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def balance(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Cuts and places pieces: (piece, start in it, length, sequence, offset).

    ``lengths`` are in descending order.  The sequences hold ``capacity`` tokens each, the
    last ones the powers of two that make up the rest, so that all are filled."""
    total = int(lengths.sum())
    rest = total % capacity
    sizes = [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length(), -1, -1) if rest >> k & 1]
    room, cost, fill = np.array(sizes, np.int64), np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
    out = []
    for piece, length in enumerate(lengths.tolist()):
        done = 0
        while done < length:
            left = length - done
            fits = room >= left
            if fits.any():
                at, size = int(np.where(fits, cost, np.inf).argmin()), left
            else:
                at = int(room.argmax())
                size = int(room[at])
            out.append((piece, done, size, at, int(fill[at])))
            room[at] -= size
            fill[at] += size
            cost[at] += linear * size + quadratic * size * size
            done += size
    return out


PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, bucket_docs: int = BUCKET_DOCS, linear: float = 1.0, quadratic: float = 1 / 1024, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents with their places in sequences of ``capacity`` tokens; with
    ``with_ids`` also the ids of each piece, as little-endian unsigned 32-bit integers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = max(1, -(-docs.count() // bucket_docs))

    def cut(batches):
        tokens, seen = tokens_of(tokenizer, end_id), {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for i, _, data, at in K.blocks(batch.column("text"), K.BLOCK_BYTES):
                ids, offsets = tokens.block(data, at)
                rows: list[list] = [[] for _ in range(7)]
                for d in range(len(at) - 1):
                    own = ids[offsets[d] : offsets[d + 1]]
                    # Rows that are alike are dealt by task and by how many the task has had.
                    # The mark has 128 bits of id and content, so a task that runs again deals the
                    # same rows to the same buckets in whatever order they come.
                    mark = hashlib.blake2b(own.tobytes() + str(names[i + d]).encode(), digest_size=16).digest()
                    seen[mark] = seen.get(mark, -1) + 1
                    bucket = zlib.crc32(mark + struct.pack("<QQ", task, seen[mark])) % buckets
                    for s in range(0, len(own), capacity):
                        piece = own[s : s + capacity]
                        full = len(piece) == capacity
                        value = (bucket, names[i + d], s, len(piece), crc(piece) if full else None, len(own), None if full and not with_ids else piece.astype("<u4" if ids.max() > 65535 else "<u2").tobytes())
                        for column, x in zip(rows, value, strict=True):
                            column.append(x)
                kinds = [pa.int32(), batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["bucket", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    def place(pieces: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pieces["bucket"].iloc[0])
        full = pieces["length"].to_numpy() == capacity
        whole = pieces[full].sort_values(["doc_id", "start", "ids_crc32"])
        rest = pieces[~full].sort_values(["length", "doc_id", "start", "doc_tokens", "ids"], ascending=[False, True, True, True, True])
        read = lambda raw, length: np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4")
        rows = [(r.doc_id, r.start, capacity, r.ids_crc32, r.doc_tokens, s, 0, r.ids if with_ids else None) for s, r in enumerate(whole.itertuples(index=False))]
        held = list(rest.itertuples(index=False))
        ids = [read(r.ids, r.length) for r in held]
        for p, start, size, at, offset in balance(rest["length"].to_numpy(np.int64), capacity, linear, quadratic):
            r, own = held[p], ids[p][start : start + size]
            rows.append((r.doc_id, r.start + start, size, crc(own), r.doc_tokens, len(whole) + at, offset, own.astype("<u4").tobytes() if with_ids else None))
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        if with_ids:
            out["ids"] = [x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, n in zip(out["ids"], out["length"], strict=True)]
        out["sequence_id"] += bucket << 32
        return out if with_ids else out.drop(columns="ids")

    cut_schema = f"bucket int, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    schema = PIECES.format(kind=kind) + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, cut_schema).groupBy("bucket").applyInPandas(place, schema)

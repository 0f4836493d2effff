"""Exact repeats of fixed-width windows over all documents, without comparing pairs.

Both substring operators look for windows (of bytes, or of words) that occur more than
once.  Every window picks an anchor, the block of ``block`` items with the least hash in it
(over words, of those that ``anchors`` found elsewhere), so equal windows pick equal anchors
at equal places; the windows of one anchor occurrence are consecutive and make a *stretch*.
The work then narrows in three steps.

1. ``stretches``: one scan emits a row for each stretch with the hash of its anchor and of
   its whole content.  An anchor that occurs once has no repeated window.  Stretches with
   equal content repeat as a whole, and are settled by that.
2. Only stretches whose anchor occurs with different contents are left; ``settle`` names
   them, and their windows are compared one by one (or in suffix order), grouped by content.
3. What was found is joined back to the documents once.

Rows of one anchor are thinned before any shuffle: within a batch, equal stretches are
settled at once, and an anchor with many different stretches is marked as common; its
stretches skip the anchor's group and go straight to step 2, where they are spread by
window.  So a passage that a third of all documents share sends a few rows a batch to any
one group.  Groups stream through tasks in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K

#: Different stretches of one anchor in a batch beyond which the anchor is common.
COMMON = 64
#: Different stretches of one anchor beyond which its windows are spread over tasks.
CROWDED = 2000
#: Rows and bytes that a task gathers before it works on whole groups of them.
CHUNK_ROWS, CHUNK_BYTES = 200_000, 2 << 20

SETTLED, ALONE, CROWD = 0, 1, 2
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Windows:
    """Windows of ``width`` bytes or words whose anchors are blocks of ``block`` of them."""

    width: int
    block: int
    words: bool

    def items(self, data: np.ndarray, at: np.ndarray) -> tuple[K.Prefix, np.ndarray]:
        """Running hash over the items of a block of documents, and their offsets."""
        if not self.words:
            return K.byte_prefix(data), at
        w = K.Words(data, at)
        return K.item_prefix(w.hashes(data)), w.first

    def rolling(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the rolling windows of ``block`` items in the documents that hold a window
        of ``width``, from the start of the block of documents and from that of their own."""
        size = np.where(np.diff(first) >= self.width, np.diff(first) - self.block + 1, 0)
        own = np.arange(int(size.sum())) - np.repeat(size.cumsum() - size, size)
        return own + np.repeat(first[:-1], size), own

    def stretches(self, prefix: K.Prefix, first: np.ndarray, hit: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """(document, first window, end of windows, anchor hash, content hash) of all
        stretches; places count from the start of the block.  Where ``hit`` tells which blocks
        may be anchors, windows without any have no stretch."""
        n = prefix.n
        if n < self.width:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        grams = prefix.rolling(self.block)
        mask = np.uint64((1 << max(1, n.bit_length())) - 1)
        packed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        none = np.uint64(2**64 - 1)
        if hit is not None:
            packed[~hit(grams)] = none
        least = K.minimum(packed, self.width - self.block + 1)
        pick = (least & mask).astype(np.int64)
        size = np.diff(first) - self.width + 1
        doc = np.repeat(np.arange(len(size)), np.maximum(size, 0))
        base = np.maximum(size, 0)
        start = np.arange(len(doc)) - np.repeat(base.cumsum() - base, base) + first[doc]
        if hit is not None:
            held = least[start] != none
            doc, start = doc[held], start[held]
        pick = pick[start]
        head = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
        low, end = start[head], start[np.append(head[1:], len(doc)) - 1] + 1 if len(doc) else head
        anchor = pick[head]
        content = K.mix(prefix.span(low, end + self.width - 1) + (anchor - low).astype(np.uint64))
        return doc[head], low, end, grams[anchor], content


#: A document is told by its id and 64 bits of its text; ``__id`` gives the order of documents.
KEY = ["__id", "__tag"]


def keys() -> dict[str, Column]:
    """The columns of KEY.  A null id comes last, and is told from the largest id by the hash."""
    null = F.col("doc_id").isNull()
    return {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "__tag": F.xxhash64(null, "text")}


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that are small enough to hold a few copies of."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with the columns of KEY and their texts compressed, as they are shuffled."""
    return compressed(docs.withColumns(keys()))


def compressed(docs: DataFrame) -> DataFrame:
    """The same rows with ``text`` compressed; ``plain`` brings it back."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, 1000):
            texts = batch.column("text").cast(pa.binary())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array([None if t is None else packer.compress(t) for t in texts.to_pylist()], pa.binary()))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in docs.schema]))


def plain(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of keyed documents with their texts as they were."""
    unpacker = zstandard.ZstdDecompressor()
    texts = [None if t is None else unpacker.decompress(t) for t in batch.column("text").to_pylist()]
    return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string()))


def _order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Marks the first row of each group of equal keys, in sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], list(columns))


def _keys(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in KEY]


def _spread(name: np.ndarray, tag: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A route of its own for a row that needs no group."""
    return K.mix(name.view(np.uint64) + K.mix(tag.view(np.uint64)) + low.astype(np.uint64))


#: ``at`` holds the first window, the number of windows and the state of a stretch.
STRETCH = "route long, content long, __id long, __tag long, at long"
STRETCH_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.int32()) for n, t in (c.split() for c in STRETCH.split(", "))])


def stretch_rows(batch: pa.RecordBatch, windows: Windows, keep_first: bool, most: int, hit: Callable[[np.ndarray], np.ndarray] | None = None) -> pa.RecordBatch | None:
    """Rows of STRETCH of a batch of keyed documents, routed by anchor.  state: 0 unless the
    batch has settled the stretch (1), knows it as one of a common anchor (2), or has more like
    it (3, the row that stands for them in the anchor's group; 4 where the anchor is common,
    too)."""
    parts: list[tuple[np.ndarray, ...]] = []
    name, tag = _keys(batch)
    for i, _, data, at in K.blocks(batch.column("text")):
        prefix, first = windows.items(data, at)
        doc, low, end, anchor, content = windows.stretches(prefix, first, hit)
        parts.append((anchor, content, name[i + doc], tag[i + doc], low - first[doc], end - low))
    if not parts or not sum(len(p[0]) for p in parts):
        return None
    anchor, content, name, tag, low, size = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = _order(anchor, content, name, low, tag)
    anchor, content, name, tag, low, size = (c[order] for c in (anchor, content, name, tag, low, size))
    group, kind = _starts(anchor), _starts(anchor, content)
    # Of equal stretches one stands for all; the others are settled here.
    head = np.flatnonzero(kind)
    of = kind.cumsum() - 1
    many = np.bincount(of) > 1
    state = np.zeros(len(anchor), np.int32)
    if keep_first:
        later = (name > name[head][of]) | ((name == name[head][of]) & (low > low[head][of]))
        state[later] = 1
    else:
        state[~kind & many[of]] = 1
        state[head[many]] = 3
    # An anchor with more kinds of stretches than ``most`` is common: only its first one stays.
    kinds = np.add.reduceat(kind.astype(np.int64), np.flatnonzero(group))
    common = (kinds > most)[group.cumsum() - 1]
    state[common & (state != 1)] = 2
    state[group & common] = 4
    # A common one that stands for more goes whatever its windows say.
    twin = np.flatnonzero(common & kind & many[of]) if not keep_first else np.zeros(0, np.int64)
    if len(twin):
        anchor, content, name, tag, low, size, state, order = (np.concatenate([c, c[twin]]) for c in (anchor, content, name, tag, low, size, state, order))
        state[-len(twin) :] = 1
    spread = np.isin(state, (1, 2))
    route = np.where(spread, _spread(name, tag, low), anchor)
    back = np.argsort(order, kind="stable")  # rows of a document together compress better
    columns = {"route": route, "content": content, "__id": name, "__tag": tag, "at": low.astype(np.int64) << 16 | size.astype(np.int64) << 3 | state}
    return _batch({k: c[back] for k, c in columns.items()})


def stretches(docs: DataFrame, windows: Windows, keep_first: bool) -> DataFrame:
    """``stretch_rows`` of all documents."""
    most = COMMON

    def run(batches):
        for batch in batches:
            rows = stretch_rows(batch, windows, keep_first, most)
            if rows is not None:
                yield rows

    return docs.select(*[c.alias(k) for k, c in keys().items()], "text").mapInArrow(run, STRETCH)


def chunked(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Tables of whole groups of consecutive rows with equal key."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < most and size < CHUNK_BYTES:
            continue
        last = batch.column(key)[-1]
        mark = pa.Table.from_batches(held)
        keys = mark.column(key).combine_chunks().to_numpy()
        cut = int(np.searchsorted(keys, last.as_py(), "left"))
        if cut:
            yield mark.slice(0, cut)
            held = mark.slice(cut).combine_chunks().to_batches()
            rows, size = mark.num_rows - cut, sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, key: str, f: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Runs f over tables of whole groups, with the groups dealt over tasks by key."""
    most = CHUNK_ROWS

    def run(batches):
        for part in chunked(batches, key, most):
            out = f(part)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _columns(part: pa.Table, *names: str) -> list[np.ndarray]:
    return [part.column(n).to_numpy() for n in names]


def settle(rows: DataFrame, keep_first: bool) -> DataFrame:
    """Of each document the stretches to remove (SETTLED), and those whose windows must be
    compared, by anchor (ALONE) or one by one (CROWD)."""

    def one(part: pa.Table) -> pa.RecordBatch:
        anchor, content, name, tag, at = _columns(part, "route", "content", *KEY, "at")
        order = _order(anchor, content, name, at, tag)
        anchor, content, name, tag, at = (c[order] for c in (anchor, content, name, tag, at))
        low, size, state = (at >> 16).astype(np.int32), (at >> 3 & 0x1FFF).astype(np.int32), at & 7
        at, group, kind = np.flatnonzero(_starts(anchor, content)), _starts(anchor), _starts(anchor, content)
        of, owner = kind.cumsum() - 1, group.cumsum() - 1
        kinds = np.add.reduceat(kind.astype(np.int64), np.flatnonzero(group))
        known = np.maximum.reduceat((state == 4).astype(np.int64), np.flatnonzero(group)) > 0
        crowd = (known | (kinds > CROWDED))[owner]
        mixed = (kinds > 1)[owner] | crowd
        if keep_first:
            done = (name > name[at][of]) | ((name == name[at][of]) & (low > low[at][of]))
            open_ = mixed & ~done
        else:
            many = np.add.reduceat(1 + (state == 3).astype(np.int64), at)[of] > 1
            done = many
            open_ = mixed & (kind | ~many)  # one of each kind is compared with the others
        preset = np.isin(state, (1, 2))
        done = np.where(preset, state == 1, done)
        open_ = np.where(preset, state == 2, open_)
        out = []
        for chosen, mark in ((done, np.zeros(len(done), np.int32)), (open_, np.where(crowd | preset, CROWD, ALONE).astype(np.int32))):
            rows = np.flatnonzero(chosen)
            out.append((name[rows], tag[rows], anchor[rows], low[rows], size[rows], mark[rows]))
        name, tag, anchor, low, size, mark = (np.concatenate(c) for c in zip(*out, strict=True))
        return _batch({"__id": name, "__tag": tag, "anchor": anchor, "low": low, "size": size, "mark": mark})

    return by_group(rows, "route", one, "__id long, __tag long, anchor long, low int, size int, mark int")


def removed(docs: DataFrame, spans: DataFrame, f: Callable[[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]], pa.RecordBatch], schema: str) -> DataFrame:
    """Runs f over batches of documents with the (first window, end of windows) of each that
    go; every document is kept."""
    gathered = spans.groupBy(*KEY).agg(F.collect_set(F.struct("low", "size")).alias("__spans"))
    joined = keyed(docs).join(gathered, KEY, "left")

    def run(batches):
        for batch in sliced(batches, 1000):
            yield f(plain(batch.drop_columns([*KEY, "__spans"])), list(_lists(batch.column("__spans"))))

    return joined.mapInArrow(run, schema)


def _lists(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    values = column.values
    low, size = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("low", "size"))
    at, null = column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        own = slice(0, 0) if null[i] else slice(at[i], at[i + 1])
        order = np.argsort(low[own], kind="stable")
        yield low[own][order], (low[own] + size[own])[order]


OPEN = "route long, __id long, __tag long, low int, size int, content binary"


def opened(docs: DataFrame, marks: DataFrame, windows: Windows, alone_as_text: bool, keep_first: bool) -> DataFrame:
    """Rows of OPEN for the stretches whose windows must be compared: with their content,
    routed by anchor; or, for crowded anchors (all, unless alone_as_text), a row for each
    window, routed by its hash.  A batch sends equal windows once, with size 2 if it has more
    of them and the first is not kept."""
    asked = marks.where(F.col("mark") != SETTLED).groupBy(*KEY).agg(F.collect_set(F.struct("anchor", "low", "size", "mark")).alias("open"))
    joined = keyed(docs.select("doc_id", "text")).join(asked, KEY)

    def run(batches):
        for batch in sliced(batches, 1000):
            name, tag = _keys(batch)
            text_of = plain(batch).column("text")
            values, offsets = batch.column("open").values, batch.column("open").offsets.to_numpy()
            anchor, low, size, mark = (values.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "low", "size", "mark"))
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            anchor, low, size, mark = (c[offsets[0] : offsets[-1]] for c in (anchor, low, size, mark))
            whole: list[dict] = []
            seen: list[tuple[np.ndarray, ...]] = []
            for i, j, data, at in K.blocks(text_of):
                prefix, first = windows.items(data, at)
                own = np.flatnonzero((of >= i) & (of < j))
                doc, begin = of[own], first[of[own] - i] + low[own]
                text = (mark[own] == ALONE) & alone_as_text
                raw = data.tobytes()
                if text.any():
                    pick = own[text]
                    cut = [raw[b : b + n] for b, n in zip(begin[text].tolist(), (size[pick] + windows.width - 1).tolist(), strict=True)]
                    whole.append({"route": anchor[pick], "__id": name[doc[text]], "__tag": tag[doc[text]], "low": low[pick].astype(np.int32), "size": size[pick].astype(np.int32), "content": pa.array(cut, pa.binary())})
                rest = own[~text]
                n = size[rest].astype(np.int64)
                step = np.arange(int(n.sum())) - np.repeat(n.cumsum() - n, n)
                start = np.repeat(begin[~text], n) + step
                seen.append((prefix.span(start, start + windows.width), name[np.repeat(doc[~text], n)], tag[np.repeat(doc[~text], n)], np.repeat(low[rest], n) + step))
            for part in whole:
                yield _batch(part)
            if not seen or not sum(len(s[0]) for s in seen):
                continue
            route, names, tags, lows = (np.concatenate(c) for c in zip(*seen, strict=True))
            order = _order(route, names, lows, tags)
            route, names, tags, lows = (c[order] for c in (route, names, tags, lows))
            head = _starts(route)
            at_, of_ = np.flatnonzero(head), head.cumsum() - 1
            if keep_first:
                later = (names > names[at_][of_]) | ((names == names[at_][of_]) & (lows > lows[at_][of_]))
                settled, weight = later, np.ones(len(route), np.int32)
            else:
                many = np.bincount(of_)[of_] > 1
                settled, weight = many & ~head, np.where(many, 2, 1).astype(np.int32)
            # A settled window needs no group; a size of 0 says that it goes.
            route = np.where(settled, _spread(names, tags, lows), route)
            weight = np.where(settled, 0, weight).astype(np.int32)
            yield _batch({"route": route, "__id": names, "__tag": tags, "low": lows.astype(np.int32), "size": weight, "content": pa.nulls(len(route), pa.binary())})

    return joined.mapInArrow(run, OPEN)

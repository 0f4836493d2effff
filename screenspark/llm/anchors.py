"""Fixed-block anchors: reference blocks on a grid, probed by every rolling window.

The index holds the non-overlapping blocks of ``block`` items that each document of at least
``width`` items is cut into; every rolling window of ``block`` items probes it.  As ``width``
is at least twice ``block`` less one, each window of ``width`` items holds a whole block of
its own document's grid, so a window that occurs twice always holds a *hit*: a block of the
index that is found at some other place, too.  ``hits`` finds them, and ``stretches`` goes on
with the windows that hold one; ``repeats`` extends those to maximal exact repeats.

Probes are many, so they travel packed.  Documents are dealt into buckets of about
BUCKET_BYTES of text.  Of each bucket the distinct hashes, in order, are cut into ranges, and
a row holds the differences of one range.  A range is probed in one piece, of about
RANGE_BUCKETS buckets' worth of hashes, and answers each bucket with its hits, which meet the
bucket's documents again; so do the windows that go in the end, and the documents are shuffled
once for all of it.  However often a block occurs, a bucket sends it once.  Hashes have SPARE
bits more here than the text has bytes, so the share of false hits is the same at every size;
one costs a comparison and changes no result, since windows are compared by 64 bits later.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from . import textkernel as K

#: Bits of a hash that probes carry, beyond those that number the bytes of the input.
SPARE = 15
#: Bytes of text in a bucket, about; buckets and ranges grow in number with the input.
BUCKET_BYTES = 4 << 20
#: Hashes of how many buckets a task probes at a time.
RANGE_BUCKETS = 4
#: Hashes of a range that are compared at a time, about.
PIECE_HASHES = 250_000


def _packed(values: np.ndarray) -> bytes:
    """Ordered numbers as compressed planes of the bytes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).cumsum(dtype=np.uint64)


def _flags(marks: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(marks).tobytes())


def _unflagged(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), count=n).astype(bool)


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64(*R.KEY), F.lit(n))


def dealt(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Keyed documents with the number of their bucket; the number of buckets; bits of a hash."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // BUCKET_BYTES
    return R.keyed(docs).withColumn("__bucket", _bucket(n)), n, min(63, SPARE + max(20, total.bit_length()))


def _texts(part: pa.Table) -> pa.RecordBatch:
    return R.plain(part.combine_chunks().to_batches()[0])


def probes(docs: DataFrame, windows: R.Windows, ranges: int, bits: int) -> DataFrame:
    """(__range, __bucket, grams, grid, many): distinct rolling windows of a bucket in one range
    of hashes, whether each is a block of the grid, and whether it occurs more than once."""

    def one(part: pa.Table) -> pa.Table:
        seen = [np.zeros(0, np.uint64)]
        for _, _, data, at in K.blocks(_texts(part).column("text")):
            prefix, first = windows.items(data, at)
            start, own = windows.rolling(first)
            if len(start):
                grid = own % windows.block == 0
                seen.append((prefix.rolling(windows.block)[start] >> np.uint64(64 - bits)) << np.uint64(1) | grid.astype(np.uint64))
        found = np.concatenate(seen)
        seen.clear()
        found.sort()
        head = np.flatnonzero(R._starts(found >> np.uint64(1)))
        grid = np.maximum.reduceat(found & np.uint64(1), head) > 0 if len(head) else np.zeros(0, bool)
        many = np.diff(np.append(head, len(found))) > 1
        grams = found[head] >> np.uint64(1)
        # The ranges cut the space of hashes evenly.
        to = (grams >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)
        cut = np.append(np.flatnonzero(R._starts(to)), len(grams))
        spans = [slice(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.table({
            "__range": pa.array(to[cut[:-1]].astype(np.int64)),
            "__bucket": pa.array([part.column("__bucket")[0].as_py()] * len(spans), pa.int64()),
            "grams": pa.array([_packed(grams[s]) for s in spans], pa.binary()),
            "grid": pa.array([_flags(grid[s]) for s in spans], pa.binary()),
            "many": pa.array([_flags(many[s]) for s in spans], pa.binary()),
        })

    return docs.groupBy("__bucket").applyInArrow(one, "__range long, __bucket long, grams binary, grid binary, many binary")


def of_range(part: pa.Table) -> pa.RecordBatch:
    """``hits`` of the rows of one range.  Hashes are compared by pieces of the range, which are
    cut at the same values in every bucket."""
    grams = [_unpacked(raw) for raw in part.column("grams").to_pylist()]
    unflag = lambda name: [_unflagged(raw, len(g)) for raw, g in zip(part.column(name).to_pylist(), grams, strict=True)]
    grid, many = unflag("grid"), unflag("many")
    found = [np.zeros(len(g), bool) for g in grams]
    low, high = min(int(g[0]) for g in grams), max(int(g[-1]) for g in grams)
    pieces = 1 + sum(map(len, grams)) // PIECE_HASHES
    edges = np.array([low + (high - low) * k // pieces for k in range(1, pieces)], np.uint64)
    cuts = [[0, *np.searchsorted(g, edges).tolist(), len(g)] for g in grams]
    for k in range(pieces):
        spans = [slice(c[k], c[k + 1]) for c in cuts]
        every = np.concatenate([g[s] for g, s in zip(grams, spans, strict=True)])
        if not len(every):
            continue
        order = np.argsort(every, kind="stable")
        head = R._starts(every[order])
        at = np.flatnonzero(head)
        twice, block = (np.concatenate([x[s] for x, s in zip(marks, spans, strict=True)])[order] for marks in (many, grid))
        live = (np.add.reduceat(1 + twice.astype(np.int32), at) > 1) & np.logical_or.reduceat(block, at)
        hit = np.zeros(len(every), bool)
        hit[order] = live[head.cumsum() - 1]
        for of, s, own in zip(found, spans, np.split(hit, np.cumsum([s.stop - s.start for s in spans])[:-1]), strict=True):
            of[s] = own
    own = [_packed(g[h]) if h.any() else None for g, h in zip(grams, found, strict=True)]
    out = pa.record_batch({"__bucket": part.column("__bucket").combine_chunks(), "hits": pa.array(own, pa.binary())})
    return out.filter(out.column("hits").is_valid())


def hits(probes: DataFrame) -> DataFrame:
    """(__bucket, hits): of each bucket the windows that are a block of the grid in some
    document, and occur at another place besides.  Ranges are unpacked one at a time, however
    many of them a task gets together."""

    def one(part: pa.Table) -> pa.RecordBatch | None:
        at = np.append(np.flatnonzero(R._starts(part.column("__range").to_numpy())), part.num_rows).tolist()
        found = pa.Table.from_batches([of_range(part.slice(a, b - a)) for a, b in zip(at, at[1:], strict=False)]).combine_chunks().to_batches()
        return found[0] if found else None

    return R.by_group(probes, "__range", one, "__bucket long, hits binary")


def stretches(docs: DataFrame, n: int, bits: int, windows: R.Windows) -> DataFrame:
    """Rows of ``repeats.STRETCH`` of the windows of dealt documents that hold a hit; the anchor
    of a window is its hit of least hash, and equal windows hold equal hits."""
    found = hits(probes(docs, windows, -(-n // RANGE_BUCKETS), bits))
    most = R.COMMON

    def one(part: pa.Table, answers: pa.Table) -> pa.Table:
        rows = None
        if part.num_rows and answers.num_rows:
            live = np.sort(np.concatenate([_unpacked(raw) for raw in answers.column("hits").to_pylist()]))
            rows = R.stretch_rows(_texts(part), windows, False, most, lambda grams: _among(grams >> np.uint64(64 - bits), live))
        return pa.Table.from_batches([rows] if rows is not None else [], R.STRETCH_ARROW)

    return docs.groupBy("__bucket").cogroup(found.groupBy("__bucket")).applyInArrow(one, R.STRETCH)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def removed(docs: DataFrame, n: int, spans: DataFrame, f: Callable[[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]], pa.RecordBatch], schema) -> DataFrame:
    """``repeats.removed`` for dealt documents, bucket by bucket."""

    def one(part: pa.Table, found: pa.Table) -> pa.Table:
        name, tag, low, size = R._columns(found, *R.KEY, "low", "size")
        order = R._order(name, tag, low)
        name, tag, low, size = (c[order].astype(np.int64) for c in (name, tag, low, size))
        at = np.append(np.flatnonzero(R._starts(name, tag)), len(name)).tolist()
        own = {(name[a], tag[a]): (low[a:b], low[a:b] + size[a:b]) for a, b in zip(at, at[1:], strict=False)}
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        batch = _texts(part)
        spans_of = [own.get(key, none) for key in zip(*(k.tolist() for k in R._keys(batch)), strict=True)]
        return pa.Table.from_batches([f(batch.drop_columns([*R.KEY, "__bucket"]), spans_of)])

    goes = spans.select(*R.KEY, "low", "size", _bucket(n).alias("__bucket"))
    return docs.groupBy("__bucket").cogroup(goes.groupBy("__bucket")).applyInArrow(one, schema)

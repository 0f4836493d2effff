"""Operator 10: benchmark passages in documents, by q-gram counting and banded alignment.

Texts are compared as UTF-8 bytes with A-Z lowered and white space runs as one space.  A
passage of m bytes leaks into a document that has a stretch within k edits of it, where
k = m * edits / 100, or less if a short passage would otherwise share no q-gram with its
copies.  Such a stretch shares at least m + 1 - q - k * q q-grams with the passage, all on
diagonals at most k apart; so only overlapping diagonal bands with that many shared q-grams
are aligned.  A passage under q bytes allows no edit and is its own only gram.

1. ``passages`` and ``signatures`` make a table of the benchmark's grams.  Of each passage
   the rarest are enough: of k * q + t distinct grams a copy keeps at least t.
2. ``sieve`` is a bitmap of all grams.  It has 2 ** SIEVE_BITS bits at most, whatever the
   benchmark; a fuller one lets more text through and loses nothing.
3. ``regions``: one scan of the documents finds the stretches where as many places pass the
   sieve as a passage of some size asks for, and emits the text around them.
4. Distinct regions are joined with the signatures by gram, and counted by pair; both sides
   are salted, so a passage that a third of all documents have, or a gram that all passages
   have, is spread over tasks.  Pairs that share enough are counted by band and aligned.

Nulls: a null text is empty and clean, a null or blank passage is never found; null ids are
ids.  Rows with equal doc_id and text are reported once, and stay or go together.  Other
columns are ignored, or kept whatever their names.  An empty benchmark finds nothing.
Regions, passages and texts are told apart by 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as K
from .common import checkpoint, map_batches

Q = 12
EDITS_PERCENT = 6
#: Bits of the sieve for each byte of the benchmark, and at most (their logarithm).
BITS_A_BYTE, SIEVE_BITS = 32, 28
#: Parts that a frequent gram is spread over (a passage has many), and a frequent passage or
#: region.
GRAM_SALTS, SALTS = 8, 64
#: Bands aligned together, and a cost that no alignment has.
BANDS, _FAR = 256, 1 << 29
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and offsets of a block."""
    low = K.lower_ascii(data)
    blank = K._SPACE[data]
    low[blank] = 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[at[:-1][at[:-1] < len(data)]] = True
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return low[keep], place[at]


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 12 bytes from each place."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = data.astype(np.uint64)
    w = w[:-1] << np.uint64(8) | w[1:]
    w = w[:-2] << np.uint64(16) | w[2:]
    w = w[:-4] << np.uint64(32) | w[4:]
    return (w[:n] * _C1) ^ (w[4 : n + 4] * _C2)


def short_grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place, for passages under q bytes."""
    return K.byte_prefix(data, 11).rolling(size) ^ np.uint64(size)


def budget(size: int, percent: int = EDITS_PERCENT) -> int:
    """Edits allowed in a passage: at least one shared q-gram must follow from the bound."""
    return max(0, min(size * percent // 100, (size - Q) // Q))


def edits_in_bands(passage: np.ndarray, text: np.ndarray, k: int, low: np.ndarray, width: int) -> int | None:
    """The least edits, at most k, of an alignment of the whole passage with a stretch of text
    that keeps to one of the bands of diagonals ``low`` to ``low + width - 1`` (place in the
    text less place in the passage).  Rows run over the passage; a band ends when it holds no
    cell with at most k edits, so the work is that of the bands, not of the text."""
    n, best = len(text), None
    for part in range(0, len(low), BANDS):
        diagonal = low[part : part + BANDS, None] + np.arange(width)
        cost = np.where((diagonal >= 0) & (diagonal <= n), 0, _FAR).astype(np.int32)
        step = np.arange(width, dtype=np.int32)
        for i, c in enumerate(passage):
            at = diagonal + i  # place in the text of the byte that meets this one
            there = (at >= 0) & (at < n)
            now = np.where(there, cost + (text[np.clip(at, 0, n - 1)] != c), _FAR)
            np.minimum(now[:, :-1], np.where(at[:, :-1] + 1 >= 0, cost[:, 1:] + 1, _FAR), out=now[:, :-1])
            now[at + 1 > n] = _FAR
            cost = np.minimum.accumulate(now - step, axis=1) + step
            cost[at + 1 > n] = _FAR
            live = cost.min(axis=1) <= k
            if not live.all():
                diagonal, cost = diagonal[live], cost[live]
                if not len(cost):
                    break
        if len(cost):
            found = int(cost.min())
            best, k = found, found - 1
            if k < 0:
                break
    return best


@dataclass(frozen=True)
class Sieve:
    """Bitmap of gram hashes; a gram has ``probes`` bits, more for the grams of short passages,
    which have no neighbours to confirm them.  ``dense``: (shared grams, reach) that the
    passages of each size ask for at least; ``short``: sizes of the short passages."""

    bits: np.ndarray
    log: int
    dense: list[tuple[int, int]]
    short: list[int]

    def passes(self, grams: np.ndarray, probes: int) -> np.ndarray:
        """Places of the grams that the sieve lets through."""
        at = None
        for k in range(probes):
            live = _cell(grams if at is None else grams[at], self.log, k)
            held = np.flatnonzero(self.bits[live >> 3] >> (live & 7).astype(np.uint8) & 1)
            at = held if at is None else at[held]
        return at

    def stretches(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, end) of the regions of a normalised block."""
        docs, low, high = [], [], []
        g = grams(data)
        p = self.passes(g, 2) if self.dense else np.zeros(0, np.int64)
        doc = np.searchsorted(at, p, "right") - 1
        real = p + Q <= at[doc + 1]
        p, doc = p[real], doc[real]
        for need, reach in self.dense:
            # Places of other documents are out of reach of each other.
            far = p + doc * (reach + 1)
            near = np.searchsorted(far, far + reach, "right") - np.searchsorted(far, far - reach, "left")
            d, x = doc[near >= need], p[near >= need]
            docs.append(d)
            low.append(np.maximum(at[d], x - reach))
            high.append(np.minimum(at[d + 1], x + reach + Q))
        if self.dense:
            # Numbers of documents keep the stretches of neighbours apart.
            d, x, y = (np.concatenate(c) for c in (docs, low, high))
            order = np.argsort(x, kind="stable")
            x, y = K.merged((x + d)[order], (y + d)[order])
            d = np.searchsorted(at + np.arange(len(at)), x, "right") - 1
            docs, low, high = [d], [x - d], [y - d]
        for size in self.short:
            g = short_grams(data, size)
            p = self.passes(g, 3)
            doc = np.searchsorted(at, p, "right") - 1
            real = p + size <= at[doc + 1]
            p, doc = p[real], doc[real]
            order = np.lexsort((g[p], doc))
            p, doc = p[order], doc[order]
            first = np.ones(len(p), bool)
            first[1:] = (g[p][1:] != g[p][:-1]) | (doc[1:] != doc[:-1])
            docs.append(doc[first])
            low.append(p[first])
            high.append(p[first] + size)
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *c]) for c in (docs, low, high))


def _cell(grams: np.ndarray, log: int, probe: int) -> np.ndarray:
    """A bit of each gram in a sieve of 2 ** log bits."""
    h = K.mix(grams + np.uint64(probe)) if probe else grams * _C1
    return (h >> np.uint64(64 - log)).astype(np.int64)


def passages(benchmark: DataFrame, percent: int) -> DataFrame:
    """(item_id, pid, body, size, k): normalised passages that are not blank."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = []
        for _, _, data, at in K.blocks(batch.column("text")):
            data, at = normal(data, at)
            bodies += [data[a:b].tobytes().strip(b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        size = [len(b) for b in bodies]
        out = pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(bodies, pa.binary()), pa.array(size, pa.int32()), pa.array([budget(n, percent) for n in size], pa.int32())], ["item_id", "body", "size", "k"])
        return out.filter(pa.array(np.array(size) > 0))

    found = map_batches(benchmark.select("item_id", "text"), one, f"item_id {kind}, body binary, size int, k int")
    return found.select("item_id", F.xxhash64("body").alias("pid"), "body", "size", "k")


def bodies(items: DataFrame) -> DataFrame:
    """(pid, body, size, k): each passage once."""
    return items.groupBy("pid").agg(*[F.first(c).alias(c) for c in ("body", "size", "k")])


def passage_grams(items: DataFrame, log: int) -> DataFrame:
    """(pid, gram, asked, cells): distinct grams of each passage, the edits' share of them
    (k * q), and their bits in the sieve."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        pids, found, places = [], [], []
        for i, body in enumerate(batch.column("body").to_pylist()):
            data = np.frombuffer(body, np.uint8)
            own = np.unique(grams(data) if len(data) >= Q else short_grams(data, len(data)))
            pids.append(np.full(len(own), i))
            found.append(own)
            places += np.stack([_cell(own, log, k) for k in range(2 if len(data) >= Q else 3)], axis=1).tolist()
        row = pa.array(np.concatenate(pids))
        return pa.RecordBatch.from_arrays([batch.column("pid").take(row), pa.array(np.concatenate(found).view(np.int64)), batch.column("asked").take(row), pa.array(places, pa.list_(pa.int64()))], ["pid", "gram", "asked", "cells"])

    own = bodies(items).select("pid", "body", (F.col("k") * Q).alias("asked"))
    return map_batches(own, one, "pid long, gram long, asked int, cells array<long>")


def signatures(found: DataFrame) -> DataFrame:
    """(gram, pid, need): the rarest grams of each passage, and how many of them a copy keeps."""
    often = found.groupBy("gram").agg(F.count("*").alias("often"))
    own = Window.partitionBy("pid")
    ranked = found.join(often, "gram").select("gram", "pid", "asked", F.row_number().over(own.orderBy("often", "gram")).alias("n"), F.count("*").over(own).alias("all"))
    spare = F.col("all") - F.col("asked")
    need = F.when(spare > 0, F.floor((spare + 1) / 2)).otherwise(1)
    return ranked.withColumn("need", need).where((spare <= 0) | (F.col("n") <= F.col("asked") + F.col("need"))).select("gram", "pid", "need")


def sieve(items: DataFrame) -> tuple[Sieve, DataFrame] | None:
    """The sieve and the grams of the passages; None where there are none."""
    size, k = F.col("size"), F.col("k")
    total = items.agg(F.sum("size")).first()[0]
    if not total:
        return None
    log = min(SIEVE_BITS, max(16, (BITS_A_BYTE * total).bit_length()))
    # Passages of one power of two ask alike; there are 31 of those at most.
    asks = items.where(size >= Q).groupBy(F.length(F.bin(size))).agg(F.min(size + 1 - Q - k * Q).alias("need"), F.max(size + k).alias("reach")).collect()
    short = items.where(size < Q).select("size").distinct().collect()
    found = checkpoint(passage_grams(items, log))
    cell = found.select(F.explode("cells").alias("cell")).select((F.col("cell") + 1).alias("cell"))
    parts = cell.groupBy(F.bitmap_bucket_number("cell").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    bits = np.zeros(1 << (log - 3), np.uint8)
    for row in parts.collect():  # 2 ** SIEVE_BITS bits at most
        at = (row["part"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)[: len(bits) - at]
    return Sieve(bits, log, [(r["need"], r["reach"]) for r in asks], sorted(r["size"] for r in short)), found.select("pid", "gram", "asked")


def regions(docs: DataFrame, mesh: Sieve) -> DataFrame:
    """(doc_id, tag, region): stretches of normalised text that may hold a passage."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, texts = [], []
        for i, _, data, at in K.blocks(batch.column("text")):
            data, at = normal(data, at)
            doc, low, high = mesh.stretches(data, at)
            rows.append(i + doc)
            texts += [data[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        row = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("tag").take(row), pa.array(texts, pa.binary())], ["doc_id", "tag", "region"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("tag"), "text"), one, f"doc_id {kind}, tag long, region binary")


def region_grams(found: DataFrame, mesh: Sieve) -> DataFrame:
    """(rid, gram): distinct grams of each region that pass the sieve."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, out = [], []
        for i, text in enumerate(batch.column("region").to_pylist()):
            data = np.frombuffer(text, np.uint8)
            g = grams(data)
            own = [g[mesh.passes(g, 2)]]
            if len(data) in mesh.short:
                own.append(short_grams(data, len(data)))
            own = np.unique(np.concatenate(own))
            rows.append(np.full(len(own), i))
            out.append(own)
        return pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(out).view(np.int64))], ["rid", "gram"])

    return map_batches(found, one, "rid long, gram long")


def edits_of(passage: np.ndarray, text: np.ndarray, k: int) -> int | None:
    """The least edits that make the passage a stretch of text, if at most k.

    Grams that repeat in the passage stand for runs of diagonals, which are counted by their
    ends; so the work does not grow with the product of the repeats on both sides."""
    if passage.tobytes() in text.tobytes():
        return 0
    if k == 0:
        return None
    m, half = len(passage), k + 1
    need = m + 1 - Q - k * Q
    own, g = grams(passage), grams(text)
    order = np.argsort(own, kind="stable")
    key, spot = own[order], order
    new = np.ones(len(key), bool)  # runs of spots of one gram, a band's width apart at most
    new[1:] = (key[1:] != key[:-1]) | (spot[1:] - spot[:-1] > 2 * half)
    head = np.flatnonzero(new)
    key, low, high = key[head], spot[head], spot[np.append(head[1:], len(spot)) - 1]
    first, end = np.searchsorted(key, g, "left"), np.searchsorted(key, g, "right")
    many = end - first
    p = np.repeat(np.arange(len(g)), many)
    run = np.repeat(first - (many.cumsum() - many), many) + np.arange(int(many.sum()))
    # An alignment with k edits keeps to k + 1 diagonals next to each other, which some band
    # holds, and so do all the grams that it shares.
    full = []
    for shift in (0, 1):
        band = lambda diagonal: (diagonal + m + shift * half) // (2 * half)  # noqa: B023, E731
        size = (len(text) + m) // (2 * half) + 3
        count = (np.bincount(band(p - high[run]), minlength=size) - np.bincount(band(p - low[run]) + 1, minlength=size)[:size]).cumsum()
        full.append(np.flatnonzero(count >= need) * 2 * half - shift * half - m)  # least diagonal of the band
    return edits_in_bands(passage, text, k, np.concatenate(full), 2 * half)


def _salted(df: DataFrame, salts: int) -> DataFrame:
    """Every row once for each salt; the other side of a join has one salt a row."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _salt(salts: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int").alias("salt")


def verified(texts: DataFrame, items: DataFrame, mesh: Sieve, found: DataFrame) -> DataFrame:
    """(rid, pid, edits) of the regions (rid, region) that hold a passage."""
    met = region_grams(texts, mesh).select("rid", "gram", _salt(GRAM_SALTS, "rid")).join(_salted(signatures(found), GRAM_SALTS), ["gram", "salt"])
    pairs = met.groupBy("rid", "pid", "need").agg(F.count("*").alias("shared")).where("shared >= need").select("rid", "pid", _salt(SALTS, "rid"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = lambda c: [np.frombuffer(x, np.uint8) for x in batch.column(c).to_pylist()]
        edits = [edits_of(b, t, k) for b, t, k in zip(raw("body"), raw("region"), batch.column("k").to_pylist(), strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("pid"), pa.array(edits, pa.int32())], ["rid", "pid", "edits"])
        return out.filter(out.column("edits").is_valid())

    both = pairs.join(_salted(bodies(items).select("pid", "body", "k"), SALTS), ["pid", "salt"]).join(texts, "rid")
    return map_batches(both.select("rid", "pid", "body", "region", "k"), one, "rid long, pid long, edits int")


def _leaks(docs: DataFrame, benchmark: DataFrame, percent: int) -> tuple[Sieve, DataFrame] | None:
    """The sieve, and (doc_id, tag, item_id, edits)."""
    items = checkpoint(passages(benchmark, percent))
    made = sieve(items)
    if made is None:
        return None
    mesh, found = made
    held = checkpoint(regions(docs, mesh).withColumn("rid", F.xxhash64("region")))
    texts = held.groupBy("rid").agg(F.first("region").alias("region"))
    named = verified(texts, items, mesh, found).select("rid", "pid", "edits", _salt(SALTS, "rid")).join(_salted(items.select("pid", "item_id"), SALTS), ["pid", "salt"])
    rows = held.select("doc_id", "tag", "rid", _salt(SALTS, "doc_id", "tag")).join(_salted(named.select("rid", "item_id", "edits"), SALTS), ["rid", "salt"])
    return mesh, rows.groupBy("doc_id", "tag", "item_id").agg(F.min("edits").alias("edits"))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = EDITS_PERCENT) -> DataFrame:
    """(doc_id, item_id, edits): one row for each passage that a document has a copy of."""
    found = _leaks(docs.select("doc_id", "text"), benchmark, percent)
    if found is None:
        kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int")
    return found[1].select("doc_id", "item_id", "edits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = EDITS_PERCENT) -> DataFrame:
    """The documents without a leak, with all their columns.  Those without any region pass
    straight through a second scan; only the others are joined with what was found."""
    found = _leaks(docs.select("doc_id", "text"), benchmark, percent)
    if found is None:
        return docs
    mesh, rows = found

    def held(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        for i, _, data, at in K.blocks(text):
            doc, _, _ = mesh.stretches(*normal(data, at))
            out[i + doc] = True
        return pa.array(out)

    suspect = F.arrow_udf(held, "boolean")(docs["text"])
    bad = rows.select(F.col("tag").alias("__bad")).distinct()
    suspects = docs.where(suspect)
    return docs.where(~suspect).union(suspects.join(bad, F.xxhash64(suspects["text"]) == bad["__bad"], "left_anti"))

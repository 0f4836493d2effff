"""Operator 12: documents resampled towards a target, by importance weights.

Features are the runs of one or two words of a text, hashed into BUCKETS buckets by CRC-32.
One scan counts the buckets of all documents, another those of the target; each bucket's gain,
the logarithm of its smoothed frequency in the target over that in the documents, is one entry
of an array of fixed size, and a document's weight is the mean of the entries of its features.
Noise of a Gumbel distribution, made from a hash of doc_id, turns the draw without replacement
into a sort by score.

The sort is a distributed radix sort from the least digit up, over the composite key (score
descending, doc_id ascending).  Rows have places; a part is a range of places.  A pass counts,
part by part and in the order of places, how many rows of each digit went before a row; the
counts of parts and digits, summed before each part and digit, are where rows of that part and
digit begin, and a row's new place is that plus its own count.  Equal digits keep their order,
so after the last digit the place of a row is its rank.  A task holds one array of counters,
whatever the size or the skew of its parts, and places deal rows out evenly.

Nulls: a null text has no words, hence weight 0 and no draw.  A null doc_id is hashed as an
empty one and comes last among equal scores.  Repeated rows are drawn and ranked each, in any
order among rows of equal score and id.  An empty table gives no rows; an empty target has
only the counts that smoothing gives.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as K
from .common import checkpoint, integer_ids, map_batches

BUCKETS = 10_000
#: Bits of a digit at most, rows of a part at least, and parts at most: the table of counts has
#: 2 ** 24 rows at most, however many rows are sorted.
DIGIT_BITS, PART_ROWS, PARTS = 12, 1024, 4096

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(column: pa.Array):
    """Of each block of texts: (words of each document, features of each, buckets of all)."""
    for _, _, data, at in K.blocks(column):
        low = K.lower_ascii(data)
        start, end = K.runs(_WORD[low], at)
        first = np.searchsorted(start, at)
        words = np.diff(first)
        doc = np.repeat(np.arange(len(words)), words)
        one = K.crc_spans(low, start, end, np.full(len(start), K.CRC_START, np.uint32))
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        two = K.crc_spans(low, start[pair + 1], end[pair + 1], K.crc_step(one[pair], 0x20))
        crc = np.concatenate([one, two]) ^ np.uint32(K.CRC_START)
        of = np.concatenate([doc, doc[pair]])
        yield words, of, (crc % np.uint32(BUCKETS)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts by bucket; tasks add up their own first."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, bucket in features(batch.column("text")):
                total += np.bincount(bucket, minlength=BUCKETS)
        held = np.flatnonzero(total)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """The floored logarithm of target over source frequencies, in thousandths, by bucket."""
    s, t = float(source.sum()) + len(source), float(target.sum()) + len(target)
    return np.array([math.floor(scale * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of all documents."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, sizes, weights = [], [], []
        for n, of, bucket in features(batch.column("text")):
            size = np.bincount(of, minlength=len(n))
            order = np.argsort(of, kind="stable")
            total = K.sums(gain[bucket[order]], np.concatenate([[0], size.cumsum()]))
            words.append(n)
            sizes.append(size)
            weights.append(np.where(size > 0, total // np.maximum(size, 1), 0))
        columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in (words, sizes, weights)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, scale: int = 1000) -> Column:
    """Gumbel noise in thousandths, from a hash of the seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0)))


# --- the sort -----------------------------------------------------------------------------


def digits(bits: int) -> list[tuple[int, int]]:
    """(shift, bits) of the digits of a key, the least first, as even as they can be."""
    n = -(-bits // DIGIT_BITS)
    return [(bits * i // n, bits * (i + 1) // n - bits * i // n) for i in range(n)]


#: A digit of a batch's rows, as integers from 0.
Digit = Callable[[pa.RecordBatch], np.ndarray]


def digit_of(column: str, origin: int, descending: bool, shift: int, bits: int) -> Digit:
    """A digit of a column's distance from its first value, which may take all 64 bits.  Nulls
    have the digits of the first value; ``nulls_last`` parts them."""

    def digit(batch: pa.RecordBatch) -> np.ndarray:
        values = batch.column(column).fill_null(origin).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        start = np.uint64(origin % 2**64)
        away = start - values if descending else values - start
        return (away >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)

    return digit


def nulls_last(column: str) -> Digit:
    return lambda batch: batch.column(column).is_null().to_numpy(zero_copy_only=False).astype(np.int64)


def counted(rows: DataFrame, digit_in: Digit, bits: int, every: int | None) -> DataFrame:
    """Rows with their digit, and how many of that part and digit went before.  Places give the
    parts of ``every`` rows; before the first pass there are none, and the partitions that the
    rows were read in are the parts."""
    keep = [c for c in rows.columns if c != "place"]
    if every is None:
        ordered = rows.withColumn("part", F.lit(None).cast("long"))
    else:
        ordered = rows.withColumn("part", F.floor(F.col("place") / every)).repartition("part").sortWithinPartitions("place")

    def run(batches):
        seen, now = np.zeros(1 << bits, np.int64), None
        task = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.full(batch.num_rows, task, np.int64) if every is None else batch.column("part").to_numpy()
            digit = digit_in(batch)
            before = np.empty(batch.num_rows, np.int64)
            edge = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if part[a] != now:
                    now = part[a]
                    seen[:] = 0
                own = digit[a:b]
                order = np.argsort(own, kind="stable")
                head = np.searchsorted(own[order], own[order], "left")
                before[a:b][order] = seen[own[order]] + np.arange(b - a) - head
                seen += np.bincount(own, minlength=len(seen))
            columns = [pa.array(part), pa.array(digit, pa.int32()), pa.array(before), *(batch.column(c) for c in keep)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "digit", "before", *keep])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return ordered.select("part", *keep).mapInArrow(run, f"part long, digit int, before long, {kinds}")


def radix_pass(rows: DataFrame, digit: Digit, bits: int, every: int | None) -> DataFrame:
    """Rows with the places that a stable sort by the digit gives them, from 0."""
    own = checkpoint(counted(rows, digit, bits, every))
    counts = own.groupBy("part", "digit").agg(F.count(F.lit(1)).alias("n"))
    totals = dict(counts.groupBy("digit").agg(F.sum("n").alias("n")).collect())
    start, begins = 0, []
    for d in sorted(totals):
        begins.append((d, start))
        start += totals[d]
    begin = rows.sparkSession.createDataFrame(begins, "digit int, begin long")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("digit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.withColumn("earlier", earlier).join(F.broadcast(begin), "digit").select("part", "digit", (F.col("begin") + F.col("earlier")).alias("base"))
    return own.join(base, ["part", "digit"]).withColumn("place", F.col("base") + F.col("before")).drop("part", "digit", "base", "before")


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with their place by score, highest first, and doc_id, least first; from 0."""
    rows = checkpoint(rows)
    n, nulls, low, high, first, last = rows.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.min("score"), F.max("score"), F.min("doc_id"), F.max("doc_id")).first()
    if not n:
        return rows.withColumn("place", F.lit(None).cast("long"))
    first, last = first or 0, last or 0
    every = max(PART_ROWS, -(-n // PARTS))
    span = lambda column, origin, most, descending: [(digit_of(column, origin, descending, shift, bits), bits) for shift, bits in digits(max(1, most.bit_length()))]
    step = None
    for digit, bits in [*span("doc_id", first, last - first, False), *([(nulls_last("doc_id"), 1)] if nulls else []), *span("score", high, high - low, True)]:
        rows = radix_pass(rows, digit, bits, step)
        step = every
    return rows


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of all documents: of those with
    ``least_words`` words the ``percent`` with the highest scores have ranks from 1."""
    integer_ids(docs)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = checkpoint(weighted(docs, gain).withColumn("score", F.col("weight") + noise(seed)))
    fit = scored.where(F.col("n_words") >= least_words)
    placed = ranked(fit)
    drawn = fit.count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).drop("place").unionByName(rest)

"""Operator 7: Jaccard join on word shingles by vertical partitioning, and its components.

A document's set holds its distinct 5-word shingles (A-Z lowered); two documents link when
100 * intersection >= 80 * union.  Documents with equal sets are one *node*.

The global shingle order runs from rare to frequent; a sketch of fixed size, summed over
all documents, says how frequent.  By the prefix bound, sets that link share shingles among
the first fifth of each, so only those (and a few more, which sharpens the bounds) are
shuffled to find candidates.  A prefix shingle that no other prefix has can't be shared with a
set whose prefix reaches as far, which bounds the overlap of a pair by what is known of its two
sets alone.  Of the nodes that meet at a shingle each is first paired with one only, the one
with the fewest such shingles, which tends to be the original of its copies.

Pairs are counted by vertical partitions: pivots, which the sketch gives, cut the global order
into FRAGMENTS of equal weight, more for the pairs of larger sets; every set is cut there, each fragment counts the partial
overlap of a pair on its own, and the counts are summed per pair.  Links make components; then
the pairs that still meet across components, and may share enough by the place at which they
meet, are counted the same way; where a group has many of those, further nodes of it are paired
with all others first.  Groups are joined in tiles of a bounded size.  So copies of one text
never become all their pairs, and no link between different components is lost.

Rows of a shingle that the sketch knows as much more frequent than the mean are spread over
SALTS tasks by node, and so are the pairs of a node that meet at one.

Nulls: a null text has no words, hence an empty set, which links with nothing; a null
doc_id never names a component that has another id.  Repeated rows have equal sets and link.
Texts of 1 to 4 words have one shingle, the whole sequence.  Other columns are ignored, or kept
whatever their names; an empty table gives no rows.  doc_id is an integer.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import repeats as R
from . import textkernel as K
from .common import checkpoint, integer_ids, union

SHINGLE = 5
#: Counters of the frequency sketch (2 ** SKETCH_BITS), and parts that it is summed in.
SKETCH_BITS, SKETCH_PARTS = 22, 256
#: Pieces that the global order is cut into for sets of up to so many shingles a piece; tasks that
#: a frequent shingle is spread over.
FRAGMENTS, FRAGMENT_GRAMS, SALTS = 8, 250, 256
#: Bytes of fragments that a task sends at a time.
SENT_BYTES = 2 << 20
#: Tasks that the rows of one key are spread over where something is looked up for them.
LOOKUP_SALTS = 16
#: A shingle is frequent if its counter is this many times the mean, and this much, at least.
FREQUENT = 4, 500
#: Rows of a group on each side of a tile; pairs of a group from which further hubs are tried.
TILE_ROWS, HUB_PAIRS = 1000, 4_000_000


def key_of() -> Column:
    """A document is told by its id and its text together."""
    return F.xxhash64("doc_id", "text")


def _sets(data: np.ndarray, at: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of a block, with repeats."""
    data = K.lower_ascii(data)
    w = K.Words(data, at)
    prefix = K.item_prefix(w.hashes(data))
    size = np.where(w.counts >= width, w.counts - width + 1, np.minimum(w.counts, 1))
    doc = np.repeat(np.arange(len(size)), size)
    start = w.first[doc] + np.arange(len(doc)) - np.repeat(size.cumsum() - size, size)
    return doc, prefix.span(start, np.minimum(start + width, w.first[doc + 1]))


def ordered_sets(data: np.ndarray, at: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, offsets by document): distinct shingles in the global order."""
    doc, gram = _sets(data, at)
    keys = (gram, doc) if rank is None else (gram, rank[_cell(gram)], doc)
    order = np.lexsort(keys)
    doc, gram = doc[order], gram[order]
    new = R._starts(doc, gram)
    doc, gram = doc[new], gram[new]
    return doc, gram, np.searchsorted(doc, np.arange(len(at)))


def _cell(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def nodes_of(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for the set of each document; 0 for an empty set."""
    total = np.zeros(len(gram) + 1, np.uint64)
    np.cumsum(K.mix(gram + np.uint64(0x51ED270B)), out=total[1:])
    node = K.mix(total[first[1:]] - total[first[:-1]])
    return np.where(np.diff(first) > 0, np.where(node == 0, np.uint64(1), node), np.uint64(0))


def survey(docs: DataFrame) -> DataFrame:
    """One scan: (doc_id, doc_key, node, n) of every document, and rows with ``part`` that
    hold a task's counters of the frequency sketch, compressed."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen, node, size = True, [], []
            for _, _, data, at in K.blocks(batch.column("text")):
                _, gram, first = ordered_sets(data, at, None)
                np.add.at(counts, _cell(gram), np.uint32(1))
                node.append(nodes_of(gram, first))
                size.append(np.diff(first))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("doc_key"), pa.array(np.concatenate(node).view(np.int64)), pa.array(np.concatenate(size).astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                ["doc_id", "doc_key", "node", "n", "part", "counts"],
            )
        if seen:
            packed = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in counts.reshape(SKETCH_PARTS, -1)]
            none = pa.nulls(SKETCH_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "doc_key", "node", "n", "part", "counts"])

    return docs.select("doc_id", key_of().alias("doc_key"), "text").mapInArrow(run, "doc_id long, doc_key long, node long, n long, part int, counts binary")


def ranks(surveyed: DataFrame) -> np.ndarray:
    """Frequency class (half powers of two) of each cell of the sketch: 2 ** SKETCH_BITS bytes,
    whatever the size of the input."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64)
        for raw in rows["counts"]:
            total += np.frombuffer(zlib.decompress(raw), "<u4").astype(np.uint64)
        cls = np.floor(2 * np.log2(total + 1.0)).astype(np.uint8)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "classes": [zlib.compress(cls.tobytes(), 1)]})

    got = surveyed.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(add, "part int, classes binary")
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    for row in got.collect():
        out[row["part"]] = np.frombuffer(zlib.decompress(bytes(row["classes"])), np.uint8)
    return out.reshape(-1)


def frequent(rank: np.ndarray) -> int:
    """The least frequency class of frequent shingles."""
    cells = np.bincount(rank, minlength=256)
    mean = float((cells * (2.0 ** (np.arange(256) / 2) - 1)).sum()) / len(rank)
    return int(2 * np.log2(FREQUENT[0] * mean + FREQUENT[1]))


def in_order(gram: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of shingles in the global order: frequency class, then hash."""
    return rank[_cell(gram)].astype(np.uint64) << np.uint64(56) | gram >> np.uint64(8)


def pivots(rank: np.ndarray, parts: int) -> np.ndarray:
    """Places that cut the global order into parts of about equal weight."""
    cells = np.bincount(rank, minlength=256)
    weight = cells * (2.0 ** (np.arange(256) / 2) - 1 + 1e-9)
    upto = np.concatenate([[0.0], weight.cumsum()])
    at = upto[-1] * np.arange(1, parts) / parts
    cls = np.minimum(np.searchsorted(upto, at, "right") - 1, 255)
    share = np.divide(at - upto[cls], weight[cls], out=np.zeros(parts - 1), where=weight[cls] > 0)
    return cls.astype(np.uint64) << np.uint64(56) | (np.minimum(share, 0.999999) * 2.0**56).astype(np.uint64)


def least_shared(n: np.ndarray) -> np.ndarray:
    """Shingles of a prefix beyond the shortest that the bound allows, and one."""
    return 1 + n // 25


#: Bits of ``place`` in a row of a prefix; above them lies the frequency class, then a mark.
PLACE_BITS, LAST = 40, 1 << 48


def _heads(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """The prefix of each node in the global order: a row (token, salt, node, place) for each
    shingle.  salt is 0, or for a frequent shingle one of SALTS by node; of the last shingle the
    place has its frequency class, too, and the mark LAST."""
    often = frequent(rank)

    def run(batches):
        for batch in batches:
            met: set[int] = set()
            for _, _, data, at in K.blocks(batch.column("text")) if batch.num_rows else ():
                doc, gram, first = ordered_sets(data, at, rank)
                node, n = nodes_of(gram, first), np.diff(first)
                fresh = np.zeros(len(n), bool)
                for d, x in enumerate(node.tolist()):
                    fresh[d] = x != 0 and x not in met
                    met.add(x)
                length = np.minimum(n, n - -(-4 * n // 5) + least_shared(n))
                if not fresh.any():
                    continue
                place = np.arange(len(gram)) - first[doc]
                keep = fresh[doc] & (place < length[doc])
                own, gram, place, last = node[doc[keep]], gram[keep], place[keep], (place == length[doc] - 1)[keep]
                cls = rank[_cell(gram)]
                salt = np.where(cls >= often, own % np.uint64(SALTS) + np.uint64(1), np.uint64(0))
                place[last] |= cls[last].astype(np.int64) << PLACE_BITS | LAST
                yield R._batch({"token": gram, "salt": salt.astype(np.int32), "node": own, "place": place})

    return docs.select("text").mapInArrow(run, "token long, salt int, node long, place long")


def spread(groups: DataFrame) -> DataFrame:
    """A row of each group (with its ``salts``) for every salt that its rows have."""
    return groups.withColumn("salt", F.explode("salts")).drop("salts")


def shared_tokens(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (token, salt, node, place) whose token several nodes have; and (node, last) of
    every node, the place in the global order where its prefix ends."""
    own = Window.partitionBy("token", "salt")
    rows = tokens.withColumns({"low": F.min("node").over(own), "high": F.max("node").over(own)})
    rows = checkpoint(rows.where(f"low <> high or salt > 0 or place >= {LAST}").distinct())
    end = F.shiftleft(F.shiftright("place", PLACE_BITS).bitwiseAND(F.lit(255)), 56).bitwiseOR(F.shiftrightunsigned("token", 8))
    ends = rows.where(F.col("place") >= LAST).select("node", end.alias("last"))
    rows = rows.withColumn("place", F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
    often = rows.where("salt > 0")
    groups = often.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.collect_set("salt").alias("salts")).where("least <> most")
    often = often.join(spread(groups.select("token", "salts")), ["token", "salt"])
    return rows.where("salt = 0 and low <> high").unionByName(often).select("token", "salt", "node", "place"), ends


def possible(a: str, b: str) -> Column:
    """Whether structs a and b (n, most, last) of two nodes leave room for a link: ``most`` is
    how many of its shingles a set can share with one whose prefix ends no earlier."""
    n, most, last = ((F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in ("n", "most", "last"))
    shared = F.when(last[0] < last[1], most[0]).when(last[0] > last[1], most[1]).otherwise(F.least(*most))
    return (5 * F.least(*n) >= 4 * F.greatest(*n)) & (9 * shared >= 4 * (n[0] + n[1]))


def fragments(docs: DataFrame, wanted: DataFrame, rank: np.ndarray) -> DataFrame:
    """Rows (a, slot, b, sizes, grams) of the wanted (node, doc_key, chunk, own, to): each set cut at
    the pivots of the global order, without its empty fragments.  A slot is a salt, a number of
    fragments and one of them.  A set goes to its ``own`` (salt, parts) with b NULL, and to every
    a that it is paired with (``to``: a, salt, parts, sizes) with its node as b."""
    found = R.compressed(docs.select(key_of().alias("doc_key"), "text")).join(wanted, "doc_key").dropDuplicates(["doc_key", "chunk"])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["a", "slot", "b", "sizes", "grams"])

    def lists(column: pa.ListArray, *names: str) -> tuple[list[int], list[list[int]]]:
        """Offsets of the lists of a column, and the fields of all their structs."""
        size = pa.compute.list_value_length(column).fill_null(0).to_numpy()
        return [0, *size.cumsum().tolist()], [pa.compute.struct_field(column.flatten(), n).to_pylist() for n in names]

    def run(batches):
        cuts: dict[int, np.ndarray] = {}
        for batch in R.sliced(batches, 500):
            rows, size = [], 0
            node = batch.column("node").to_pylist()
            own_at, own = lists(batch.column("own"), "salt", "parts")
            to_at, to = lists(batch.column("to"), "a", "salt", "parts", "sizes")
            for i, _, data, at in K.blocks(R.plain(batch).column("text")):
                _, gram, first = ordered_sets(data, at, rank)
                place = in_order(gram, rank)
                for k, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), i):
                    goes = [(node[k], own[0][j], own[1][j], None, 0) for j in range(own_at[k], own_at[k + 1])]
                    goes += [(to[0][j], to[1][j], to[2][j], node[k], to[3][j]) for j in range(to_at[k], to_at[k + 1])]
                    pieces: dict[int, list[tuple[int, bytes]]] = {}
                    for a, salt, parts, b, sizes in goes:
                        if parts not in pieces:
                            if parts not in cuts:
                                cuts[parts] = pivots(rank, parts)
                            edge = [low, *(low + np.searchsorted(place[low:high], cuts[parts])).tolist(), high]
                            pieces[parts] = [(f, gram[x:y].tobytes()) for f, (x, y) in enumerate(zip(edge, edge[1:], strict=False)) if x < y]
                        for f, raw in pieces[parts]:
                            rows.append((a, (salt << 32) + parts + f, b, sizes, raw))
                            size += len(raw)
                        if size > SENT_BYTES:  # a set may go to many others
                            yield packed(rows)
                            rows, size = [], 0
            if rows:
                yield packed(rows)

    return found.select("node", "own", "to", "text").mapInArrow(run, "a long, slot long, b long, sizes long, grams binary")


def partial_overlaps(parts: DataFrame) -> DataFrame:
    """(a, b, sizes, shared): what the sets of each pair share in one fragment.  In a slot of a
    the rows of a's own set come first, so a task holds one of them at a time."""

    def run(batches):
        slot, held = None, None
        for batch in batches:
            a, at, b, sizes, raw = (batch.column(c).to_pylist() for c in ("a", "slot", "b", "sizes", "grams"))
            out: list[tuple] = []
            for k in range(batch.num_rows):
                grams = np.frombuffer(raw[k], np.uint64)
                if b[k] is None:
                    slot, held = (a[k], at[k]), grams
                elif slot == (a[k], at[k]):
                    shared = len(np.intersect1d(held, grams, assume_unique=True))
                    if shared:
                        out.append((a[k], b[k], sizes[k], shared))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "sizes", "shared"])

    ordered = parts.repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(run, "a long, b long, sizes long, shared long")


def verified(docs: DataFrame, pairs: DataFrame, where: DataFrame, rank: np.ndarray) -> DataFrame:
    """The (a, b) of pairs (a, b, na, nb, often) that link; where: (node, doc_key).  The pairs of
    a node that meet at a frequent shingle are spread by the other node."""
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.max("often").alias("often"))
    spread_by = lambda c: F.when(F.col("often"), 1 + F.pmod(c, F.lit(SALTS))).otherwise(0).cast("int")
    sizes = (F.shiftleft(F.col("na").cast("long"), 32) + F.col("nb")).alias("sizes")
    # Twice as many fragments for sets twice as large, so that no row is long.
    parts = F.expr(f"{FRAGMENTS} << greatest(0, int(ceil(log2(least(na, nb) / {FRAGMENTS * FRAGMENT_GRAMS}))))").alias("parts")
    pairs = checkpoint(pairs.select("a", "b", spread_by("b").alias("salt"), spread_by("a").alias("chunk"), parts, sizes))
    own = pairs.groupBy(F.col("a").alias("node")).agg(F.lit(-1).alias("chunk"), F.collect_set(F.struct("salt", "parts")).alias("own"))
    to = pairs.groupBy(F.col("b").alias("node"), "chunk").agg(F.collect_list(F.struct("a", "salt", "parts", "sizes")).alias("to"))
    wanted = own.unionByName(to, allowMissingColumns=True).join(where, "node")
    total = partial_overlaps(fragments(docs, wanted, rank)).groupBy("a", "b", "sizes").agg(F.sum("shared").alias("shared"))
    both = F.shiftright("sizes", 32) + F.col("sizes").bitwiseAND(F.lit(0xFFFFFFFF))
    return total.where(9 * F.col("shared") >= 4 * both).select("a", "b")


def looked_up(rows: DataFrame, key: str, other: str, values: DataFrame) -> DataFrame:
    """Left join of rows with values (key, ...; one row each).  Rows of one key are spread by
    another column, and a value goes only where rows of its key are."""
    salted = rows.withColumn("salt", F.pmod(other, F.lit(LOOKUP_SALTS)).cast("int"))
    salts = salted.groupBy(key).agg(F.collect_set("salt").alias("salts"))
    return salted.join(spread(values.join(salts, key)), [key, "salt"], "left").drop("salt")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v, changed), v any other node (large) or a lesser one.  The least
    of a node and its neighbours takes over the neighbours above the node (large), or all of
    them and the node itself (small).  The rows of a node come in order, least neighbour first,
    so a task holds one batch of them; ``changed`` tells of rows that were not so before."""

    def run(batches):
        node, least, seen = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (batch.column(c).to_numpy() for c in ("u", "v"))
            changed = batch.column("changed").to_numpy(zero_copy_only=False)
            new = R._starts(u, v)
            new[0] = (u[0], v[0]) != (node, seen)
            head = R._starts(u)
            first = v[np.flatnonzero(head)]
            if u[0] == node:
                first[0] = least
            m = first[head.cumsum() - 1]
            node, least, seen = u[-1], m[-1], v[-1]
            if large:
                m = np.minimum(u, m)
                keep, child, changed = new & (v > u), v, changed | (m != u)
            else:
                keep, child, changed = new, np.where(v == m, u, v), changed | (v != m)
            yield pa.RecordBatch.from_arrays([pa.array(child[keep]), pa.array(m[keep]), pa.array(changed[keep])], ["u", "v", "changed"])

    ordered = edges.repartition("u").sortWithinPartitions("u", "v", F.desc("changed"))
    return ordered.mapInArrow(run, "u long, v long, changed boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of the component of every node of edges (a, b).  Each
    round hangs nodes on the least of their neighbours, from above and then from below (large
    and small stars), until all edges lead to the least node of their component."""
    lesser, other = F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")
    at = edges.where("a <> b").select(other, lesser, F.lit(False).alias("changed"))
    while True:
        both = at.withColumn("changed", F.lit(False)).unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(False).alias("changed")))
        at = checkpoint(_star(_star(both, True), False))
        if at.where("changed").isEmpty():
            lone = at.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
            return lone.unionByName(lone.select(F.col("label").alias("node"), "label").distinct())


def mixed(live: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of live in groups with several labels, with ``label``, ``main`` (the label with most
    rows in the group), how many ``rows`` the group has, and ``others`` beside the main label."""
    named = live.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = named.groupBy("token", "label").agg(F.count("*").alias("m"), F.collect_set("salt").alias("salts"))
    groups = sizes.groupBy("token").agg(
        F.sum("m").alias("rows"), F.max("m").alias("m"), F.max_by("label", "m").alias("main"), F.array_distinct(F.flatten(F.collect_set("salts"))).alias("salts")
    ).where("rows > m")
    return named.join(spread(groups.select("token", "salts", "rows", "main", (F.col("rows") - F.col("m")).alias("others"))), ["token", "salt"])


def joined_by_hubs(docs: DataFrame, live: DataFrame, links: DataFrame, where: DataFrame, rank: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(links of nodes to their labels, mixed rows): in groups with many pairs of different labels, one node beside the
    main label is verified with all others, and labels are made anew, as long as that halves
    the pairs that are left in such groups."""
    before = None
    while True:
        labels = components(links)
        links = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        rows = checkpoint(mixed(live, labels))
        crowded = rows.where(F.col("rows") * F.col("others") > HUB_PAIRS)
        pairs = crowded.agg(F.sum("others")).first()[0] or 0
        if not pairs or (before is not None and 2 * pairs > before):
            return links, rows
        before = pairs
        own = F.struct(F.xxhash64("node", F.lit(pairs)).alias("draw"), "node", "n", "most", "last", "label")
        picked = F.max(F.when(F.col("label") != F.col("main"), own))
        hubs = spread(crowded.groupBy("token").agg(picked.alias("hub"), F.collect_set("salt").alias("salts")))
        stars = crowded.join(hubs, ["token", "salt"]).where("label <> hub.label").withColumn("x", F.struct("n", "most", "last")).where(possible("x", "hub"))
        links = checkpoint(union([links, verified(docs, _ordered(stars, "node", "n", "hub.node", "hub.n"), where, rank)]))


def _ordered(rows: DataFrame, x: str, nx: str, y: str, ny: str) -> DataFrame:
    """(a, b, na, nb, often) with the lesser node first."""
    swap = F.col(x) > F.col(y)
    pick = lambda c, d: F.when(swap, F.col(d)).otherwise(F.col(c))
    return rows.select(pick(x, y).alias("a"), pick(y, x).alias("b"), pick(nx, ny).cast("int").alias("na"), pick(ny, nx).cast("int").alias("nb"), (F.col("salt") > 0).alias("often"))


def across(rows: DataFrame) -> DataFrame:
    """(a, b, na, nb, often): nodes of different components that may share enough shingles, of
    mixed rows; a pair for each shingle that they meet at.

    Of each such pair one has another label than the group's main one: those rows are joined
    with all rows of the group, in tiles of a bounded size, so that neither a group nor the
    pairs within a label meet in a task.

    What two sets share up to the end of the shorter prefix they share among the shingles
    that other prefixes have, too (``left``: how many of those a node has from a shingle on);
    beyond it lie only ``spare`` shingles of that set."""
    tiles = lambda c: F.ceil(F.col(c) / TILE_ROWS).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), tiles(c) - 1))
    one = lambda c: F.pmod(F.xxhash64("node"), tiles(c)).cast("int")
    own = F.struct("node", "label", "n", "most", "last", "spare", "left")
    x = rows.select("token", "salt", "main", one("rows").alias("i"), every("others").alias("j"), own.alias("x"))
    y = rows.where("label <> main").select("token", every("rows").alias("i"), one("others").alias("j"), own.alias("y"))
    once = (F.col("x.label") == F.col("main")) | (F.col("x.node") < F.col("y.node"))
    # At the first shingle that a pair shares, enough must be left for the others.
    spare = F.when(F.col("x.last") < F.col("y.last"), F.col("x.spare")).when(F.col("x.last") > F.col("y.last"), F.col("y.spare")).otherwise(F.least("x.spare", "y.spare"))
    room = 9 * (F.least("x.left", "y.left") + spare) >= 4 * (F.col("x.n") + F.col("y.n"))
    met = x.join(y, ["token", "i", "j"]).where((F.col("x.label") != F.col("y.label")) & once & possible("x", "y") & room)
    return _ordered(met, "x.node", "x.n", "y.node", "y.n")


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, node, n, label) of every document; label tells its component."""
    integer_ids(docs)
    docs = docs.select("doc_id", "text")
    surveyed = checkpoint(survey(docs))
    rank = ranks(surveyed)
    sized = surveyed.where("part is null").select("doc_id", "doc_key", "node", "n")
    where = checkpoint(sized.where("node <> 0").groupBy("node").agg(F.min("doc_key").alias("doc_key"), F.max("n").cast("int").alias("n")))

    live, ends = shared_tokens(_heads(docs, rank))
    alive = live.groupBy("node").agg(F.count("*").alias("alive"))
    # As many as ``_heads`` takes.
    spare = (F.col("n") - F.least("n", F.expr("n - (4 * n + 4) div 5 + 1 + n div 25"))).cast("int")
    nodes = alive.join(ends, "node").join(where, "node").select("node", "n", (spare + F.col("alive")).cast("int").alias("most"), "last", spare.alias("spare"))
    left = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("place"))).alias("left")
    live = checkpoint(live.select("token", "salt", "node", left).join(nodes, "node"))
    where = where.select("node", "doc_key")

    own = F.struct(F.try_divide("most", "n").alias("share"), "node", "n", "most", "last")
    hubs = spread(live.groupBy("token").agg(F.max(own).alias("hub"), F.collect_set("salt").alias("salts")))
    stars = live.join(hubs, ["token", "salt"]).select(own.alias("x"), "hub", (F.col("salt") > 0).alias("often")).where("x.node <> hub.node").where(possible("x", "hub"))
    stars = stars.select(F.col("hub.node").alias("a"), F.col("x.node").alias("b"), F.col("hub.n").alias("na"), F.col("x.n").alias("nb"), "often")
    first = checkpoint(verified(docs, stars, where, rank))
    first, rows = joined_by_hubs(docs, live, first, where, rank)
    links = union([first, verified(docs, across(rows), where, rank)])
    return looked_up(sized, "node", "doc_key", components(links)).withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    named = _named(docs)
    names = named.where("node <> 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return looked_up(named, "label", "doc_key", names).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: that of the least doc_id (a null
    one is the last), of several texts with that id the one of the least hash, of repeated rows
    any.  Documents without a word all stay."""
    word = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "doc_key"))
    kept = _named(docs).where("node <> 0").groupBy("label").agg(first.alias("first")).select(F.col("first.doc_key").alias("doc_key"))
    rows = docs.where(word).select(key_of().alias("doc_key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    single = rows.join(kept, "doc_key", "left_semi").groupBy("doc_key").agg(F.first("row").alias("row")).select("row.*")
    return single.union(docs.where(~word))

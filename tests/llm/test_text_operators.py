"""Classifiers, rules, packing, token counts, quotes and decontamination."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from screenspark.llm import classifiers as C
from screenspark.llm import decontaminate as D
from screenspark.llm import features as X
from screenspark.llm import models as M
from screenspark.llm import packing as G
from screenspark.llm import quotes as Q
from screenspark.llm import textkernel as K
from screenspark.llm import tokencounts as T
from screenspark.llm.common import fold

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "a", "\n", "a b c", "é ñ x", "x" * 3000, "A!! B!! A!! B!! A!! B!!", "# $ %\nx\nx\n x\nx", "you stupid fool", "st0p y0u 1di0t", "日本 語"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, score int, word string").repartition(2)


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


# --- words and features -----------------------------------------------------------------


def test_words_split_at_ascii_space_only():
    texts = [*ODD, "a\x0bb\x1fc d"]
    for _, _, data, at in K.blocks(pa.array(texts)):
        w = K.Words(data, at)
        got = [[data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
        assert got == [WORD.findall(t) for t in texts]


def brute_rules(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    mask = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            mask[i : i + 3] = [True] * 3
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, sum(mask)]


def test_rule_counts_match_brute_force(spark):
    texts = ODD + [r.text for r in tables(spark)[0].limit(200).collect()]
    assert X.rule_counts(pa.array(texts)).tolist() == [brute_rules(t) for t in texts]


def test_toxic_features_see_through_marks():
    row = lambda t: dict(zip(X.TOXIC, X.toxic_features(pa.array([t]))[0]))
    assert row("you are an idiot, friend")["near_second"] > 0 and row("the *Idiot*!")["hits"] > 0
    assert row("an 1d10t here")["hits_leet"] > 0 and row("a fine day")["hits"] == 0


# --- classifiers ------------------------------------------------------------------------


@pytest.mark.parametrize("label, parts, out, fit, least", [("toxic", 5, 0, C.toxicity, 0.93), ("quality", 4, 2, C.quality, 0.95)])
def test_held_out_accuracy(spark, label, parts, out, fit, least):
    docs, labels = tables(spark)
    scored = fit(docs, labels, fold("doc_id", parts) != out).join(labels, "doc_id").where(fold("doc_id", parts) == out).toPandas()
    cut = 0.5 if label == "toxic" else 0.7
    assert len(scored) > 30 and ((scored.score >= cut) == (scored[label] == 1)).mean() >= least


@pytest.mark.parametrize("name, label, parts, out, cut, least", [("op1_toxicity", "toxic", 5, 0, 0.5, 0.93), ("op4_quality", "quality", 4, 2, 0.7, 0.95)])
def test_queries_of_classifiers(spark, name, label, parts, out, cut, least):
    """The columns follow from the scores, every document has its row, the fold is that of the
    contract, and held-out rows come out right."""
    from screenspark.llm.queries import QUERIES

    docs, labels = tables(spark)
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % parts == out for i in got.doc_id]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= cut)).all()
    out_rows = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (out_rows.predicted == out_rows[label]).mean() >= least


def test_query_of_quality_rules(spark):
    """Base columns by counting; the verdict on held-out rows, by forests that have not seen
    them, is nearly as good as on the others."""
    from screenspark.llm.queries import QUERIES

    docs, labels = tables(spark)
    got = QUERIES["op8_quality_rules"](spark, SF).toPandas().set_index("doc_id")
    for r in docs.collect():
        n, chars, symbols, dup, repeat = brute_rules(r.text or "")
        row = got.loc[r.doc_id]
        assert [row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words] == [n, chars, symbols, dup, repeat]
        assert row.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (row.base_failed and row.kept)
        assert row.kept == (not row.base_failed and row.anomaly <= 1)
    out = fold("doc_id", 4) == 2
    held = C.quality_rules(docs, labels, ~out).join(labels, "doc_id").where(out & ~F.col("base_failed")).toPandas()
    assert held[held.quality == 1].kept.mean() > 0.9 and held[held.quality == 0].kept.mean() < 0.35


def test_scores_of_odd_rows(spark):
    docs, labels = tables(spark)
    odd = docs_of(spark, [*enumerate(ODD), (None, None), (3, "again")])
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    for fit in (C.toxicity, C.quality):
        got = fit(both, labels, F.lit(True)).toPandas()
        assert len(got) == 1000 + len(ODD) + 2 and got.score.between(0, 1).all()
        assert fit(odd.where("false"), labels, F.lit(True)).collect() == []
        assert len(fit(odd, labels.where("false"), F.lit(True)).collect()) == len(ODD) + 2
    rules = C.quality_rules(both, labels).toPandas()
    assert (rules[rules.base_failed].kept == False).all()  # noqa: E712
    assert len(C.quality_rules(odd, labels.where("false")).collect()) == len(ODD) + 2


def test_rules_keep_good_and_drop_bad(spark):
    docs, labels = tables(spark)
    got = C.quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.2


def test_isotonic_is_monotone_and_tables_add_up():
    rng = np.random.default_rng(0)
    z = rng.normal(size=500)
    y = (rng.random(500) < M.sigmoid(2 * z)).astype(float)
    p = M.Isotonic().fit(z, y)(np.sort(z))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    model = M.AdditiveModel(pairs=1).fit(x, y)
    assert list(model.pair_tables) == [(0, 1)] and ((model.score(x) > 0.5) == y).mean() > 0.9


# --- packing ----------------------------------------------------------------------------


def test_packing_is_a_partition_of_the_ids(spark):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    encode = G.encoder(path)[1]
    rng = random.Random(2)
    odd = ["".join(rng.choice(["ab", "c", " ", "  ", "\n", "'s", "é", "12", "!", " ", "<|endoftext|>", "<|", "日"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(i, r.text) for i, r in enumerate(tables(spark)[0].limit(60).collect())] + [(100 + i, t) for i, t in enumerate([*ODD, *odd])] + [(5000, None)]
    got = G.pack(docs_of(spark, rows), path, bucket_docs=100, with_ids=True).toPandas().sort_values(["doc_id", "start"])
    pieces = defaultdict(list)
    for r in got.itertuples():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.start == sum(map(len, pieces[r.doc_id]))
        pieces[r.doc_id].append(ids)
    for i, t in rows:
        assert np.concatenate(pieces[i]).tolist() == [*encode(t or ""), 0]
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        total = own.length.sum()
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and total <= 1024 and total & (total - 1) == 0
    assert G.pack(docs_of(spark, []), path).collect() == []


def test_alike_rows_are_dealt_over_buckets(spark):
    import public_tokenizers as P

    rows = [(None, "the same text of some words")] * 3000 + [(7, None)] * 1000
    got = G.pack(docs_of(spark, rows), P.path("byte_bpe_50k.json"), bucket_docs=100).toPandas()
    sizes = got.assign(bucket=got.sequence_id.to_numpy() // 2**32).groupby("bucket").size()
    assert len(got[got.start == 0]) == 4000 and len(sizes) == 40 and sizes.max() < 250


def test_labels_and_texts_of_one_id(spark):
    """The larger of two labels counts, and one text of an id: the sample stays bounded."""
    from screenspark.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, t) for t in ("b", "a", None)] * 50 + [(2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, None), (2, 0), (None, 1), (3, 1)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", F.lit(True), 10)
    assert sorted((r.doc_id, r.text, r.y) for r in got.collect()) == [(1, "a", 1), (2, "c", 0)]


def test_balance_fills_every_sequence():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 300):
        lengths = np.sort(rng.integers(1, 1024, n))[::-1]
        room = Counter()
        for _, _, size, at, offset in G.balance(lengths, 1024):
            assert offset == room[at]
            room[at] += size
        assert sum(room.values()) == lengths.sum() and all(v & (v - 1) == 0 for v in room.values())


def brute_balance(lengths, capacity):
    """One piece after the other to the cheapest sequence that has room, else what fits where
    there is most room."""
    total = sum(lengths)
    sizes = [capacity] * (total // capacity) + [1 << k for k in reversed(range(capacity.bit_length())) if total % capacity >> k & 1]
    held, out = [[] for _ in sizes], []
    cost = lambda own: sum(n + n * n / 1024 for n in own)
    for piece, length in enumerate(lengths):
        done = 0
        while done < length:
            left = length - done
            room = [s - sum(own) for s, own in zip(sizes, held)]
            fits = [i for i, r in enumerate(room) if r >= left]
            at = min(fits, key=lambda i: (cost(held[i]), i)) if fits else max(range(len(sizes)), key=lambda i: (room[i], -i))  # noqa: B023
            size = min(left, room[at])
            out.append((piece, done, size, at, sum(held[at])))
            held[at].append(size)
            done += size
    return out


@pytest.mark.parametrize("seed", range(5))
def test_lowest_cost_sequence_comes_first(seed):
    rng = random.Random(seed)
    lengths = [600, 500, 400, 300, 248] if seed == 0 else sorted((rng.randint(1, 1023) for _ in range(60)), reverse=True)
    got = G.balance(np.array(lengths), 1024)
    assert got == brute_balance(lengths, 1024)
    if seed == 0:
        assert got[:4] == [(0, 0, 600, 0, 0), (1, 0, 500, 1, 0), (2, 0, 400, 1, 500), (3, 0, 300, 0, 600)]


# --- token counts -----------------------------------------------------------------------


def test_token_counts_match_plain_segmentation(spark):
    import public_tokenizers as P

    path = P.path("piece_bpe_32k.model")
    vocab = T.vocabulary(path)
    longest = max(map(len, vocab))
    rows = [(i, r.text) for i, r in enumerate(tables(spark)[0].limit(40).collect())] + [(100 + i, t) for i, t in enumerate(ODD)] + [(200, None), (201, "y" * 200 + " 🙂🙂 ab")]
    want = {i: sum(T.segment(T.MARK + w, vocab, longest) for w in WORD.findall(t or "")) for i, t in rows}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in T.token_counts(docs_of(spark, rows), path).collect()}
    assert got == {i: (len(WORD.findall(t or "")), want[i]) for i, t in rows}
    assert T.token_counts(docs_of(spark, []), path).collect() == []


def test_a_word_of_a_million_tokens(spark):
    import public_tokenizers as P

    path = P.path("piece_bpe_32k.model")
    emoji = "\U0001fae8"
    assert emoji not in T.vocabulary(path)
    df = docs_of(spark, [(1, emoji * 1000), (2, emoji * 270_000)])
    got = {r.doc_id: r.n_tokens for r in T.token_counts(df, path).collect()}
    assert got[2] - got[1] == 4 * 269_000


def test_segment_prefers_few_tokens_of_equal_cost():
    vocab = {"a": T.cost(0), "b": T.cost(1), "ab": T.cost(0)}
    assert T.segment("ab", vocab, 2) == 1 and T.segment("ba", vocab, 2) == 2 and T.segment("é", vocab, 2) == 2


# --- quotes -----------------------------------------------------------------------------


def test_reply_order_by_quotes(spark):
    rows = [
        ("c", 0, "user", "First  line\nsecond line", "x"),
        ("c", 1, "user", "An unrelated start", "x"),
        ("c", 2, "bot", "> first line\n> Second line\nI agree", "x"),
        ("c", 3, "user", "> I agree\n> > first line\n\nMe too\n", "x"),
        ("c", 4, "user", "> an unrelated start\nand > not a quote", "x"),
        ("c", 5, "user", "> never said\nhello", "x"),
        ("d", 1, "user", "> First line\nother conversation", "x"),
        ("d", 2, None, None, "x"),
        (None, 1, "user", "> I agree", "x"),
        ("c", None, "user", "text", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, level string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.text) for r in Q.reply_order(df).collect()}
    assert len(got) == len(rows)
    assert got["c", 2] == (0, 0, 1, "I agree") and got["c", 3] == (2, 0, 2, "Me too")
    assert got["c", 4] == (1, 1, 1, "and > not a quote") and got["c", 5] == (None, 5, 0, "hello")
    assert got["d", 1] == (None, 1, 0, "other conversation") and got["d", 2] == (None, 2, 0, "")
    assert got[None, 1] == (None, 1, 0, "") and got["c", None] == (None, None, 0, "text")
    assert Q.reply_order(df.where("false")).collect() == []


def test_long_reply_chain_and_repeated_rows(spark):
    rows = [("c", k, f"> line {k - 1}\nline {k}") for k in range(20)] * 2
    df = spark.createDataFrame(rows, "conv_id string, turn long, text string").withColumn("role", F.lit("u"))
    got = Q.reply_order(df).toPandas()
    assert len(got) == 40 and (got.depth == got.turn).all() and (got.root_turn == 0).all() and (got.reply_pos == got.turn).all()


def test_replies_follow_what_they_answer(spark):
    """Branches of a thread: each message comes after its parent and before the parent's later
    replies; conversations are built in that order."""
    said = ["alpha", "> alpha\nbeta", "> alpha\ngamma", "> beta\ndelta", "> gamma\nepsilon", "> delta\nzeta", "other", "> alpha\neta"]
    df = spark.createDataFrame([(c, t, f"r{t}", x) for c in ("c", "d") for t, x in enumerate(said)], "conv_id string, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.root_turn, r.reply_pos) for r in Q.reply_order(df).collect()}
    order = [0, 1, 3, 5, 2, 4, 7]
    assert got == {(c, t): (0, i) for c in ("c", "d") for i, t in enumerate(order)} | {(c, 6): (6, 0) for c in ("c", "d")}
    built = {(r.conv_id, r.root_turn): [(m.role, m.text) for m in r.messages] for r in Q.conversations(df).collect()}
    assert built["d", 0] == [(f"r{t}", said[t].split("\n")[-1]) for t in order] and built["c", 6] == [("r6", "other")]


def test_quotes_of_a_large_thread_and_a_long_text(spark):
    long = "word " * 200_000
    rows = [("c", 0, "the start\n" + long)] + [("c", k, "> the start\nreply %d" % k) for k in range(1, 500)] + [("d", k, f"> m{k - 1}\nm{k}") for k in range(100)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, text string").withColumn("role", F.lit("u"))
    got = Q.reply_order(df).toPandas()
    c, d = got[got.conv_id == "c"], got[got.conv_id == "d"]
    assert len(got) == len(rows) and (c.reply_pos == c.turn).all() and (c.depth == (c.turn > 0)).all() and (d.reply_pos == d.turn).all() and (d.depth == d.turn).all()


def test_a_chain_of_replies_and_lost_messages(spark):
    """No row grows with the depth of a thread; messages of no conversation meet nobody."""
    rows = spark.range(300).select(F.lit("c").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.concat(F.lit("> line "), (F.col("id") - 1).cast("string"), F.lit("\nline "), F.col("id").cast("string")).alias("text"))
    lost = spark.range(20_000).select(F.lit(None).cast("string").alias("conv_id"), (F.col("id") % 3).alias("turn"), F.lit("u").alias("role"), F.lit("> line 1\nlost").alias("text"))
    got = Q.reply_order(rows.union(lost))
    assert got.where("conv_id = 'c' and reply_pos = turn and depth = turn and root_turn = 0").count() == 300
    assert got.where("conv_id is null and reply_pos = 0 and depth = 0 and root_turn = turn and n_links = 0").count() == 20_000


def test_reply_order_matches_its_sql(spark):
    import duckdb

    from screenspark.llm.oracles import OP9

    rng = random.Random(6)
    line = lambda: rng.choice(["Alpha  beta", "gamma delta", "Epsilon", "zeta eta", "", "theta > iota"])
    rows = []
    for c in range(30):
        said: list[str] = []
        for t in range(rng.randint(1, 8)):
            lines = [line() for _ in range(rng.randint(1, 4))]
            for _ in range(rng.randint(0, 2) if said else 0):
                old = rng.choice(said).split("\n")
                cut = old[rng.randrange(len(old)) :][: rng.randint(1, 3)]
                lines[rng.randrange(len(lines) + 1) : 0] = [rng.choice(["> ", ">", " >  "]) + x.upper() for x in cut]
            said.append("\n".join(lines))
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice([said[-1], said[-1].replace("\n", "\r\n")])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Q.reply_order(df).toPandas()
    con = duckdb.connect()
    conversations = df.toPandas()
    con.register("conversations", conversations)
    want = con.sql(OP9).df()
    plain = lambda v: v if isinstance(v, str) else None if pd.isna(v) else int(v)
    show = lambda d: sorted(repr([plain(v) for v in r]) for r in d[list(got.columns)].itertuples(index=False))
    assert show(got) == show(want) and got.parent_turn.notna().sum() > 20


# --- decontamination --------------------------------------------------------------------


def brute_edits(passage, text):
    row = list(range(1))
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(passage, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(prev[j - 1] + (a != b), prev[j] + 1, row[j - 1] + 1))
        prev = row
    return min(prev)


@pytest.mark.parametrize("bands", [256, 1])
def test_bands_find_the_least_edits(monkeypatch, bands):
    """Passages with edits at all places, at the ends of a text and twice in it, of few letters,
    so that many bands are full."""
    monkeypatch.setattr(D, "BANDS", bands)
    rng = random.Random(bands)
    found = 0
    for _ in range(250):
        letters = rng.choice(["ab", "abcdefgh "])
        passage = "".join(rng.choice(letters) for _ in range(rng.randint(30, 90)))
        copy = list(passage)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([[], [rng.choice(letters)], [copy[k], rng.choice(letters)]])
        around = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 40, 300]))) for _ in range(3)]
        text = around[0] + "".join(copy) + around[1] + rng.choice(["", "".join(copy)]) + around[2]
        raw = [np.frombuffer(x.encode(), np.uint8) for x in (passage, text)]
        k = D.budget(len(passage))
        want = brute_edits(passage, text)
        assert D.edits_of(*raw, k) == (want if want <= k else None)
        found += want <= k and want > 0
    assert found > 20


def test_a_passage_in_a_long_region_is_quick():
    import time

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    passage = " ".join(rng.choice(words) for _ in range(280))
    copy = passage[:500] + "x" + passage[520:]
    text = " ".join(rng.choice(words) for _ in range(30_000)) + " " + copy + " " + " ".join(rng.choice(words) for _ in range(30_000))
    raw = [np.frombuffer(x.encode(), np.uint8) for x in (passage, text)]
    began = time.perf_counter()
    assert D.edits_of(*raw, D.budget(len(passage))) == 20
    assert time.perf_counter() - began < 3


def clean_bytes(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return D.normal(raw, np.array([0, len(raw)]))[0].tobytes()


def test_leaks_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    items = [(k, text(rng.choice([4, 8, 15, 25]))) for k in range(12)] + [(50, None), (51, "tiny"), (52, "a b " * 30)]
    rows = []
    for i in range(60):
        t = text(rng.randint(0, 25))
        if rng.random() < 0.7:
            s = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 5)):
                q = rng.randrange(len(s))
                s[q : q + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            t = t + " \n" + "".join(s).upper() + " " + text(rng.randint(0, 9))
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "A  b " * 40), (3, rows[3][1])]
    want = set()
    for i, t in rows:
        for j, p in items:
            q = clean_bytes(p).strip()
            e = brute_edits(q, clean_bytes(t))
            if q and e <= D.budget(len(q)):
                want.add((i, j, e))
    df = docs_of(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in D.leaks(df, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 15
    for bits, least in ((32, 16), (1, 8)):  # the second sieve is nearly full
        monkeypatch.setattr(D, "BITS_A_BYTE", bits)
        monkeypatch.setattr(D, "SIEVE_BITS", 28 if bits > 1 else 16)
        assert {tuple(r) for r in D.leaks(df, bench).collect()} == want
    kept = sorted(r.doc_id for r in D.decontaminate(df, bench).collect())
    assert kept == sorted(i for i, _ in rows if i not in {w[0] for w in want})
    assert D.leaks(df, bench.where("false")).collect() == [] and D.leaks(df.where("false"), bench).collect() == []
    assert D.decontaminate(df, bench.where("false")).count() == len(rows) and D.decontaminate(df.where("false"), bench).collect() == []


def test_short_repetitive_and_shared_passages(spark):
    dashes, line = "-" * 600, "Choose the right answer of these: "
    items = [(1, "Paris"), (2, dashes), (3, "-" * 300 + "x" + "-" * 299), (4, "é!"), (None, "no id but text here"), (5, "   "), (5, "Paris")]
    items += [(100 + k, line + " ".join(f"q{k}w{j}" for j in range(20))) for k in range(40)]
    rows = [(1, "I saw paris"), (2, "-" * 1_000_000), (3, "-" * 599), (4, "x" + "-" * 650), (None, "É! no ID  but text\nhere"), (6, line * 20), (7, "p a r i s"), (8, None), (9, "é!\n"), (10, line + " ".join(f"q7w{j}" for j in range(20)))]
    rows += [(11, "ab" * 150_000), (1, "I saw paris")]
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], "doc_id long, text string, tag string, __bad string, rid int").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1, 0), (1, 5, 0), (2, 2, 0), (2, 3, 1), (3, 2, 1), (3, 3, 1), (4, 2, 0), (4, 3, 1), (None, None, 0), (9, 4, 0), (10, 107, 0)}
    assert {tuple(r) for r in D.leaks(df, bench).collect()} == want
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [6, 7, 8, 11]

"""Long words made of two letters, which hashes modulo a power of two can't tell apart."""

import numpy as np
import pyarrow as pa
import pytest

from screenspark.llm import features as X
from screenspark.llm import neardup, packing, substring, tokencounts
from screenspark.llm import textkernel as K

SF = "/root/testdata/sf0.01"


def pair(n):
    """The sequence of Thue and Morse, of n letters, and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="module", params=[1024, 4096])
def words(request):
    return pair(request.param)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def test_hashes_of_spans_and_windows():
    rng = np.random.default_rng(3)
    for n in (512, 1024, 2048, 8192):
        data = np.frombuffer("".join(pair(n)).encode(), np.uint8)
        a, b = K.byte_prefix(data).span(np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
        items = np.where(data == 97, *rng.integers(0, 2**63, 2, dtype=np.uint64))
        a, b = K.item_prefix(items).span(np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    rolled = K.byte_prefix(data).rolling(9)
    same = {}
    for i, h in enumerate(rolled.tolist()):
        assert same.setdefault(data[i : i + 9].tobytes(), h) == h
    assert len(set(same.values())) == len(same)
    # The plain sums, in Python's integers.
    (first, second), p = K._byte_values(7), K.PRIME
    value = [sum(int(lane[c]) * pow(base, k, p) for k, c in enumerate(data[5:2000].tolist())) % p for lane, base in zip((first, second), K._BYTE_BASES, strict=True)]
    assert K.byte_prefix(data).span(np.array([5]), np.array([2000]))[0] == K.mix(np.array([value[1] << 31 | value[0]], np.uint64))[0]


def test_spans_with_one_hash_are_told_by_their_bytes():
    data = np.frombuffer(b"abcdabxx", np.uint8)
    index = K.SpanIndex(8, 100)
    at = lambda *x: np.array(x)
    assert index.add(data, at(0), at(2), np.array([5], np.uint64)).tolist() == [0]
    keys = np.array([5, 5, 5, 5, 6], np.uint64)
    assert index.find(data, at(0, 2, 4, 0, 0), at(2, 4, 6, 3, 2), keys).tolist() == [0, -2, 0, -2, -1]


def test_memos_of_units_and_words_survive_equal_hashes(monkeypatch):
    """Hashes of three bits: nearly all units collide, and ids and counts are still right."""
    import public_tokenizers as P

    span = K.Prefix.span
    monkeypatch.setattr(K.Prefix, "span", lambda self, s, e: span(self, s, e) & np.uint64(7))
    texts = ["one two three four one two", "five  six\nseven one", "", "two"]
    data, at = K.utf8(pa.array(texts))
    tokens = packing.Tokens(P.path("byte_bpe_50k.json"), 0)
    ids, offsets = tokens.block(data, at)
    for d, text in enumerate(texts):
        assert ids[offsets[d] : offsets[d + 1]].tolist() == [*tokens.whole(text), 0]
    trie = tokencounts.Trie(P.path("piece_bpe_32k.model"))
    w = K.Words(data, at)
    assert trie.count(data, w).tolist() == [tokencounts.segment("▁" + x, trie.vocab, trie.longest) for t in texts for x in t.split()]


def test_packing(spark, words):
    import public_tokenizers as P

    path, texts = P.path("byte_bpe_50k.json"), [f"x {words[0]}", f"x {words[1]}"]
    got = packing.pack(table(spark, texts), path, with_ids=True).toPandas().sort_values(["doc_id", "start"])
    for d, text in enumerate(texts):
        ids = np.frombuffer(b"".join(got[got.doc_id == d].ids), "<u4").tolist()
        assert ids == [*packing.encoder(path)[1](text), 0]


def test_repeated_words(spark, words):
    fill = " ".join(f"w{i}" for i in range(34))
    got = substring.repeated_words(table(spark, [f"{w} {fill}" for w in words] + [f"{fill} {words[0]}"])).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]
    again = substring.repeated_words(table(spark, [f"{words[0]} {fill}", f"{words[0]} {fill}"])).collect()
    assert [r.n_removed for r in again] == [35, 35]


def test_token_counts(spark, words):
    import public_tokenizers as P

    path = P.path("piece_bpe_32k.model")
    vocab = tokencounts.vocabulary(path)
    got = {r.doc_id: r.n_tokens for r in tokencounts.token_counts(table(spark, words), path).collect()}
    assert got == {d: tokencounts.segment("▁" + w, vocab, max(map(len, vocab))) for d, w in enumerate(words)}


def test_near_duplicates(spark, words):
    texts = [words[0], words[1], f"{words[0]} b c d e", f"{words[1]} b c d e", words[0]]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}


def test_rules(spark, words):
    lines = "\n".join(words)
    assert X.rule_counts(pa.array([lines, f"{words[0]}\n{words[0]}", f"{words[0]} b c {words[1]} b c"]))[:, 3:].tolist() == [[0, 0], [1, 0], [0, 0]]

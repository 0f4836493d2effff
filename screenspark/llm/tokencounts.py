"""Operator 6: token counts under a unigram model, shared over a trie of pre-tokens.

A pre-token is a word with the word mark before it.  The distinct new words of a block are
sorted, which makes them the leaves of a trie in depth-first order; the forward score of a
trie node (the best segmentation of its prefix) is computed once, for all nodes of a depth
together, and the count at a word's last node is remembered by the task, by the word's bytes.  There is no
shuffle: every document's count is the sum over its words.

Scores: a piece at place i of the vocabulary costs ln(i + 2), which is Zipf's law for its
probability, in fixed point so that sums are exact; of equally good segmentations the one
with fewer tokens counts.  A character that no piece covers is one token for each of its
UTF-8 bytes.  Null and empty texts have no tokens; other columns are ignored; repeated rows
are counted each.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as K
from .common import map_batches

MARK = "▁"
#: A cost and the number of tokens share one integer: cost * ONE + tokens.  A text has fewer
#: than ONE bytes, hence tokens; the cost of LONG characters leaves 64 bits unfilled.
ONE = 1 << 32
SCALE = 100_000
#: Words longer than this share no prefix that pays; their forward pass runs on its own, in
#: integers without a bound.
LONG = 48
#: Distinct words that a worker remembers before it starts afresh.
MEMORY_WORDS = 900_000
#: Bytes of those words.
MEMORY_BYTES = 1 << 24
#: Base of the hashes of pieces and prefixes, which are short: modulo 2**64.
_BASE = 0xC2B2AE3D27D4EB4F


def cost(place: int) -> int:
    return round(SCALE * math.log(place + 2)) * ONE + 1


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Cost of each ordinary piece of a sentencepiece model, by its place."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): cost(i) for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


def byte_cost(vocab: dict[str, int], char: str) -> int:
    return (round(SCALE * math.log(len(vocab) + 2)) * ONE + 1) * len(char.encode("utf-8", "replace"))


def segment(word: str, vocab: dict[str, int], longest: int) -> int:
    """Tokens of one pre-token, by the plain forward pass."""
    best = [0]
    for j in range(1, len(word) + 1):
        options = [best[j - 1] + byte_cost(vocab, word[j - 1])]
        for i in range(max(0, j - longest), j):
            piece = vocab.get(word[i:j])
            if piece is not None:
                options.append(best[i] + piece)
        best.append(min(options))
    return best[-1] % ONE


class Trie:
    """Counts of distinct words by forward scores over the nodes of their trie."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.longest = max(map(len, self.vocab), default=1)
        pieces = [p for p in self.vocab]
        self.index = K.HashIndex(max(12, (4 * len(pieces)).bit_length()))
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        self.index.add(keys)
        self.costs = np.array([self.vocab[p] for p in pieces] + [0], np.int64)
        self.power = self._powers(self.longest + 1)
        self.fallback = round(SCALE * math.log(len(self.vocab) + 2)) * ONE + 1
        self._clear()

    def _clear(self):
        self.known, self.counts = K.SpanIndex(21, MEMORY_WORDS + 1), np.zeros(MEMORY_WORDS + 1, np.int64)

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)

    def _hash(self, piece: str) -> int:
        values = K.mix(np.array([ord(c) for c in reversed(piece)], np.uint64) + np.uint64(77))
        power = self._powers(len(piece) + 1)[: len(piece)]
        return int(K.mix(np.array([(values * power).sum(dtype=np.uint64)]))[0])

    def forward(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token; words are distinct, sorted and at most LONG characters."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        wide = int(size.max(initial=0))
        if not wide:
            return np.zeros(n, np.int64)
        chars = np.array(words, f"U{wide}").view(np.uint32).reshape(n, wide)
        same = np.concatenate([np.zeros((1, wide), bool), chars[1:] == chars[:-1]])
        shared = np.minimum.accumulate(same, axis=1).sum(1)  # depth that a word shares with the word before
        shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
        value = K.mix(chars.astype(np.uint64) + np.uint64(77))
        step = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4))) * self.fallback
        score = np.zeros((wide + 1, n), np.int64)  # of a word's prefix of that depth
        for depth in range(1, wide + 1):
            node = np.flatnonzero((size >= depth) & (shared < depth))
            if len(node):
                best = score[depth - 1, node] + step[node, depth - 1]
                key = np.zeros(len(node), np.uint64)
                for k in range(1, min(depth, self.longest) + 1):
                    key += value[node, depth - k] * self.power[k - 1]
                    piece = self.index.find(K.mix(key))
                    found = piece >= 0
                    best = np.where(found, np.minimum(best, score[depth - k, node] + self.costs[piece]), best)
                score[depth, node] = best
                # words that share the node with an earlier one read its score
                owner = np.maximum.accumulate(np.where((size >= depth) & (shared < depth), np.arange(n), 0))
                score[depth] = score[depth, owner]
        return score[size, np.arange(n)] % ONE

    def count(self, data: np.ndarray, w: K.Words) -> np.ndarray:
        """Tokens of every word of a block."""
        keys = w.hashes(data)
        if len(keys) > MEMORY_WORDS:  # a single very long document
            _, where, back = np.unique(keys, return_index=True, return_inverse=True)
            out = self._new(data, w.start[where], w.end[where])[back]
            first, size = w.start[where][back], w.end - w.start
            other = size != (w.end[where] - w.start[where])[back]
            other[~other] = ~K.equal_spans(data, w.start[~other], data, first[~other], size[~other])
            out[other] = self._new(data, w.start[other], w.end[other])
            return out
        got = self.known.find(data, w.start, w.end, keys)
        if (got == -1).any():
            fresh, where = np.unique(keys[got == -1], return_index=True)
            spots = np.flatnonzero(got == -1)[where]
            if self.known.n + len(fresh) > MEMORY_WORDS or self.known.used > MEMORY_BYTES:
                self._clear()
                fresh, spots = np.unique(keys, return_index=True)
            self.counts[self.known.add(data, w.start[spots], w.end[spots], fresh)] = self._new(data, w.start[spots], w.end[spots])
            got = self.known.find(data, w.start, w.end, keys)
        out, other = self.counts[got], got < 0
        out[other] = self._new(data, w.start[other], w.end[other])
        return out

    def _new(self, data, start, end) -> np.ndarray:
        words = [MARK + s for s in K.strings(data, start, end)]
        order = sorted(range(len(words)), key=words.__getitem__)
        short = [i for i in order if len(words[i]) <= LONG]
        out = np.zeros(len(words), np.int64)
        for part in range(0, len(short), 50_000):
            own = short[part : part + 50_000]
            out[own] = self.forward([words[i] for i in own])
        for i in (i for i in order if len(words[i]) > LONG):
            out[i] = segment(words[i], self.vocab, self.longest)
        return out


_WORKER: dict[str, Trie] = {}


def trie_of(path: str) -> Trie:
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = Trie(path)
    return _WORKER[path]


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of docs."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        trie, words, tokens = trie_of(model), [], []
        for _, _, data, at in K.blocks(batch.column("text")):
            w = K.Words(data, at)
            words.append(w.counts)
            tokens.append(K.sums(trie.count(data, w), w.first))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(words), pa.int64()), pa.array(np.concatenate(tokens), pa.int64())], ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), one, f"doc_id {kind}, n_words long, n_tokens long")

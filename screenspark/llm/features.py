"""Dense features of a text, for the quality and toxicity classifiers and the quality rules.

Everything is counted over whole texts, a block of documents at a time, without a loop
over documents or words.  A null text counts as empty; an empty text has zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textkernel as K

# Plain insults in the four languages of the corpus.
INSULTS = (
    "idiot idiots moron morons stupid scum trash loser losers clown clowns pathetic worthless disgusting dumb imbecile "
    "freak filth garbage vermin bastard bitch asshole dickhead shithead fuck fucking shit crap bullshit cunt whore slut "
    "wanker twat retard retarded degenerate subhuman parasite "
    "dummkopf blödmann arschloch scheiße scheisse abschaum hurensohn wichser trottel "
    "connard connasse salaud salope merde ordure crétin débile abruti enculé "
    "idiota imbécil estúpido estúpida mierda cabrón gilipollas puta pendejo basura escoria"
).split()

# Second-person words in the same languages.
SECOND_PERSON = (
    "you your yours yourself youre ya du dich dir dein deine deinen deiner ihr euch euer "
    "tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros vuestro"
).split()

# Characters that stand in for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True  # any byte of a character beyond ASCII
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not (chr(c).isalnum())]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_LEET = _PLAIN.copy()
for _a, _b in STAND_INS.items():
    _LEET[ord(_a)] = ord(_b)

RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

SHAPE = (
    "log_words", "word_len", "upper", "digit", "punct", "symbol", "bang", "beyond_ascii", "line_words", "dup_lines", "repeat_words",
    "same_next", "distinct", "caps_words", "long_words", "short_words", "stops", "symbol_words", "bang_words", "longest",
)

TOXIC = ("hits", "hit_rate", "hits_leet", "near_second", "second", "caps_words", "upper", "bang", "punct", "masked", "digit_in", "log_words")


def _key(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(K.byte_prefix(data).span(np.array([0]), np.array([len(data)]))[0])


_INSULT_KEYS = np.sort(np.array([_key(w) for w in INSULTS], np.uint64))
_SECOND_KEYS = np.sort(np.array([_key(w) for w in SECOND_PERSON], np.uint64))


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values


class Block:
    """What the feature sets share: words, their hashes, and lines of a block."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at, len(at) - 1
        self.words = w = K.Words(data, at)
        self.prefix = K.byte_prefix(data)
        self.hash = self.prefix.span(w.start, w.end)
        self.n_words = w.counts
        self.chars = (data & 0xC0) != 0x80
        self._repeat = None

    def count(self, flags: np.ndarray) -> np.ndarray:
        return K.sums(flags, self.at)

    def word_count(self, flags: np.ndarray) -> np.ndarray:
        return K.sums(flags, self.words.first)

    def in_words(self, flags: np.ndarray) -> np.ndarray:
        """Bytes of each word that are set in flags."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.words.end] - total[self.words.start]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each document: lines with a word, and those equal to an earlier line of it."""
        breaks = np.flatnonzero(self.data == 10)
        heads = np.unique(np.concatenate([self.at[:-1], breaks + 1]))
        heads = heads[heads < len(self.data)]
        ends = np.append(heads[1:], len(self.data))
        ends = np.where(self.data[np.maximum(ends - 1, 0)] == 10, ends - 1, ends) if len(heads) else ends
        filled = np.searchsorted(self.words.start, heads) < np.searchsorted(self.words.start, ends)
        heads, ends = heads[filled], ends[filled]
        doc = np.searchsorted(self.at, heads, "right") - 1
        again = ~_first_of(K.mix(self.prefix.span(heads, ends) + doc.astype(np.uint64)))
        return np.bincount(doc, minlength=self.n), np.bincount(doc[again], minlength=self.n)

    def repeat_words(self) -> np.ndarray:
        """Of each document: words within 3-word windows that occur twice or more in it."""
        if self._repeat is None:
            w, n = self.words, len(self.hash)
            out = np.zeros(self.n, np.int64)
            if n >= 3:
                start = np.flatnonzero(w.doc[: n - 2] == w.doc[2:])
                key = K.mix(K.item_prefix(self.hash).rolling(3)[start] + w.doc[start].astype(np.uint64))
                twice = start[_repeated(key)]
                mask = np.zeros(n, bool)
                for k in range(3):
                    mask[twice + k] = True
                out = self.word_count(mask)
            self._repeat = out
        return self._repeat


def _first_of(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    first = np.ones(len(keys), bool)
    first[order[1:]] = keys[order[1:]] != keys[order[:-1]]
    return first


def _repeated(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _per(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _collect(column: pa.Array, width: int, dtype, one) -> np.ndarray:
    out = np.zeros((len(column), width), dtype)
    for i, j, data, at in K.blocks(column):
        out[i:j] = np.stack(one(Block(data, at)), axis=1)
    return out


def rule_counts(column: pa.Array) -> np.ndarray:
    """The exact integer statistics of RULES, one row for each text."""

    def one(b: Block):
        return b.n_words, b.word_count(b.in_words(b.chars)), b.count(_SYMBOLS[b.data]), b.lines()[1], b.repeat_words()

    return _collect(column, len(RULES), np.int64, one)


def shape_features(column: pa.Array) -> np.ndarray:
    """The features of SHAPE, one row for each text."""

    def one(b: Block):
        n, size, data, w = b.n_words, b.at[1:] - b.at[:-1], b.data, b.words
        chars = b.in_words(b.chars)
        upper, symbols = _UPPER[data], _SYMBOLS[data]
        lines, dup = b.lines()
        same = np.zeros(len(b.hash), bool)
        same[1:] = (b.hash[1:] == b.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        distinct = b.word_count(_first_of(K.mix(b.hash + w.doc.astype(np.uint64))))
        big = b.in_words(upper)
        longest = np.zeros(b.n)
        np.maximum.at(longest, w.doc, chars)
        last = data[w.end - 1] if len(w.end) else data[:0]
        return (
            np.log1p(n), _per(b.word_count(chars), n), _per(b.count(upper), size), _per(b.count(_DIGIT[data]), size),
            _per(b.count(_PUNCT[data]), size), _per(b.count(symbols), size), _per(b.count(data == 33), size), _per(b.count(data >= 128), size),
            _per(n, lines), _per(dup, lines), _per(b.repeat_words(), n), _per(b.word_count(same), n), _per(distinct, n),
            _per(b.word_count((big >= 2) & (2 * big >= w.end - w.start)), n), _per(b.word_count(chars > 14), n), _per(b.word_count(chars < 3), n),
            _per(b.word_count(_STOP[last]), n), _per(b.word_count(b.in_words(symbols) > 0), n), _per(b.word_count(b.in_words(data == 33) > 0), n),
            np.log1p(longest),
        )

    return _collect(column, len(SHAPE), np.float64, one)


def _stripped(b: Block, table: np.ndarray) -> np.ndarray:
    """Hashes of the words of a block, stripped to letters after mapping bytes by table."""
    low = table[b.data]
    keep = _LETTER[low]
    place = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return K.byte_prefix(low[keep]).span(place[b.words.start], place[b.words.end])


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash of a word stripped to letters, a hash that copies of the row share) for the
    distinct words of every text."""
    rows, words, copies = [], [], []
    for i, _, data, at in K.blocks(column):
        b = Block(data, at)
        plain = _stripped(b, _PLAIN)
        own = _first_of(K.mix(plain + b.words.doc.astype(np.uint64)))
        least = np.full(b.n, 2**64 - 1, np.uint64)
        if len(plain) >= 3:
            np.minimum.at(least, b.words.doc[: len(plain) - 2], K.item_prefix(plain).rolling(3))
        rows.append(b.words.doc[own] + i)
        words.append(plain[own])
        copies.append(least[b.words.doc[own]])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty.astype(np.int64), *rows]), np.concatenate([empty, *words]), np.concatenate([empty, *copies])


def toxic_features(column: pa.Array, learned: np.ndarray = np.zeros(0, np.uint64), window: int = 5) -> np.ndarray:
    """The features of TOXIC: densities of the insults and of learned words, over words
    stripped to letters (and over words with stand-ins undone), such words within ``window``
    words of a second-person word, capitals, punctuation and signs of masking.

    learned: sorted hashes of further words, as ``distinct_words`` gives them."""
    keys = np.union1d(_INSULT_KEYS, learned)

    def one(b: Block):
        n, size, data, w = b.n_words, b.at[1:] - b.at[:-1], b.data, b.words
        plain, leet = _stripped(b, _PLAIN), _stripped(b, _LEET)
        hit = _among(plain, keys)
        hit_leet = _among(leet, keys) & ~hit
        second = _among(plain, _SECOND_KEYS)
        near = np.zeros(len(hit) + 1, np.int64)
        spots = np.flatnonzero(second)
        lo = np.maximum(spots - window, w.first[w.doc[spots]])
        hi = np.minimum(spots + window + 1, w.first[w.doc[spots] + 1])
        close = K.coverage(len(hit), lo, hi) if len(spots) else near[:-1] > 0
        bad = hit | hit_leet
        letters, width = b.in_words(_LETTER[data]), w.end - w.start
        big = b.in_words(_UPPER[data])
        edge = np.zeros(len(width), np.int64)  # marks that only open or close a word
        if len(width):
            edge = (~_LETTER[data[w.start]]).astype(np.int64) + ~_LETTER[data[w.end - 1]]
        masked = (letters >= 2) & (width - letters > edge)
        digits = (letters >= 2) & (b.in_words(_DIGIT[data]) > 0)
        hits = b.word_count(hit)
        return (
            np.log1p(hits), _per(hits, n), np.log1p(b.word_count(hit_leet)), _per(b.word_count(bad & close), n), _per(b.word_count(second), n),
            _per(b.word_count((big >= 2) & (2 * big >= width)), n), _per(b.count(_UPPER[data]), size), _per(b.count(data == 33), size),
            _per(b.count(_PUNCT[data]), size), _per(b.word_count(masked), n), _per(b.word_count(digits), n), np.log1p(n),
        )

    return _collect(column, len(TOXIC), np.float64, one)

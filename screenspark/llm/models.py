"""Small models fitted on a bounded sample of labelled rows and scored inside tasks.

Each model is a few arrays: fitting runs on the sample, scoring is table lookups and
additions over a batch of feature rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner bin edges of every column; a bin holds values in (edge[i-1], edge[i]]."""
    q = np.linspace(0, 1, bins + 1)[1:-1]
    out = []
    for col in x.T:
        values = np.unique(col)
        if len(values) <= bins:
            out.append((values[1:] + values[:-1]) / 2)
        else:
            out.append(np.unique(np.quantile(col, q)))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)], axis=1).astype(np.int32)


# --- gradient-boosted trees -----------------------------------------------------------


@dataclass
class BoostedTrees:
    """Binary logistic boosting of complete trees over binned features."""

    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    ridge: float = 2.0
    edges: list = field(default_factory=list)
    base: float = 0.0
    nodes: list = field(default_factory=list)  # (feature[2**depth - 1], cut[...], leaf[2**depth])

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges, self.nodes = quantile_edges(x, self.bins), []
        b = binned(x, self.edges)
        p0 = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p0 / (1 - p0)))
        z = np.full(len(y), self.base)
        for _ in range(self.trees if len(y) else 0):
            p = sigmoid(z)
            tree = self._grow(b, p - y, p * (1 - p))
            self.nodes.append(tree)
            z += self._leaf(b, tree)
        return self

    def _grow(self, b, g, h):
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int32), np.full(inner, np.iinfo(np.int32).max, np.int32)
        at, wide = np.zeros(len(g), np.int64), self.bins + 1
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            slot, best = at - first, np.full(count, 1e-6)
            for f in range(b.shape[1]):
                key = slot * wide + b[:, f]
                gs = np.bincount(key, g, count * wide).reshape(count, wide).cumsum(1)
                hs = np.bincount(key, h, count * wide).reshape(count, wide).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = 0
                pick = gain.argmax(1)
                better = gain[np.arange(count), pick] > best
                best[better] = gain[np.arange(count), pick][better]
                feature[first : first + count][better], cut[first : first + count][better] = f, pick[better]
            at = 2 * at + 1 + (b[np.arange(len(g)), feature[at]] > cut[at])
        leaf = at - inner
        total, weight = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return feature, cut, -self.rate * total / (weight + self.ridge)

    def _leaf(self, b, tree):
        feature, cut, leaf = tree
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return leaf[at - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        z = np.full(len(x), self.base)
        for tree in self.nodes:
            z += self._leaf(b, tree)
        return z


@dataclass
class Isotonic:
    """Non-decreasing map from margins to probabilities, by pooling adjacent violators."""

    at: np.ndarray = field(default_factory=lambda: np.zeros(1))
    value: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def fit(self, z: np.ndarray, y: np.ndarray) -> Isotonic:
        if len(z) == 0:
            return self
        marks, where = np.unique(z, return_inverse=True)
        total, weight = np.bincount(where, y), np.bincount(where).astype(float)
        pools: list[list[float]] = []
        for m, t, w in zip(marks, total, weight, strict=True):
            pools.append([t, w, m, m])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                t2, w2, _, hi = pools.pop()
                pools[-1][0] += t2
                pools[-1][1] += w2
                pools[-1][3] = hi
        self.at = np.array([x for p in pools for x in (p[2], p[3])])
        self.value = np.repeat([(p[0] + 0.5) / (p[1] + 1.0) for p in pools], 2)
        self.value = np.maximum.accumulate(self.value)
        return self

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return np.interp(z, self.at, self.value)


# --- generalised additive model with pairwise interactions -------------------------------


@dataclass
class AdditiveModel:
    """Cyclic boosting: each round visits every feature in turn with a shallow tree over its
    bins, then every chosen pair with a two-cut tree over both; the trees of a term add up
    to one lookup table, so a score is a sum of bin lookups."""

    rounds: int = 60
    pairs: int = 6
    rate: float = 0.2
    bins: int = 24
    pair_bins: int = 8
    cuts: int = 3
    ridge: float = 5.0
    edges: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    base: float = 0.0
    tables: list = field(default_factory=list)
    pair_tables: dict = field(default_factory=dict)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        k = x.shape[1]
        self.edges, self.coarse = quantile_edges(x, self.bins), quantile_edges(x, self.pair_bins)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pair_tables = {}
        p0 = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p0 / (1 - p0)))
        if not len(y):
            return self
        b, c = binned(x, self.edges), binned(x, self.coarse)
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for f in range(k):
                p = sigmoid(z)
                step = self._tree(b[:, f], p - y, p * (1 - p), len(self.tables[f]))
                self.tables[f] += step
                z += step[b[:, f]]
        p = sigmoid(z)
        gains = []
        for i in range(k):
            for j in range(i + 1, k):
                gains.append((self._quadrants(c[:, i], c[:, j], p - y, p * (1 - p), len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)[0], i, j))
        for _, i, j in sorted(gains, key=lambda t: (-t[0], t[1:]))[: self.pairs]:
            self.pair_tables[i, j] = np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))
        for _ in range(self.rounds // 2):
            for (i, j), table in self.pair_tables.items():
                p = sigmoid(z)
                _, step = self._quadrants(c[:, i], c[:, j], p - y, p * (1 - p), *table.shape)
                table += step
                z += step[c[:, i], c[:, j]]
        return self

    def _tree(self, b, g, h, n):
        """A tree with at most ``cuts`` cuts over the bins of one feature, best cut first."""
        gs = np.concatenate([[0], np.bincount(b, g, n).cumsum()])
        hs = np.concatenate([[0], np.bincount(b, h, n).cumsum()])
        parts = [(0, n)]
        worth = lambda lo, hi: (gs[hi] - gs[lo]) ** 2 / (hs[hi] - hs[lo] + self.ridge)
        for _ in range(self.cuts):
            best = (1e-9, None, None)
            for lo, hi in parts:
                mid = np.arange(lo + 1, hi)
                if len(mid):
                    gain = worth(lo, mid) + worth(mid, hi) - worth(lo, hi)
                    m = int(gain.argmax())
                    if gain[m] > best[0]:
                        best = (gain[m], (lo, hi), int(mid[m]))
            if best[1] is None:
                break
            parts.remove(best[1])
            parts += [(best[1][0], best[2]), (best[2], best[1][1])]
        step = np.zeros(n)
        for lo, hi in parts:
            step[lo:hi] = -self.rate * (gs[hi] - gs[lo]) / (hs[hi] - hs[lo] + self.ridge)
        return step

    def _quadrants(self, a, b, g, h, na, nb):
        """The best cut of both features at once: its gain and its step."""
        key = a.astype(np.int64) * nb + b
        gs = np.bincount(key, g, na * nb).reshape(na, nb).cumsum(0).cumsum(1)
        hs = np.bincount(key, h, na * nb).reshape(na, nb).cumsum(0).cumsum(1)
        corners = lambda s: (s, s[:, -1:] - s, s[-1:] - s, s[-1, -1] - s[:, -1:] - s[-1:] + s)
        gq, hq = corners(gs), corners(hs)
        gain = sum(x**2 / (w + self.ridge) for x, w in zip(gq, hq, strict=True)) - gs[-1, -1] ** 2 / (hs[-1, -1] + self.ridge)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        value = [-self.rate * x[i, j] / (w[i, j] + self.ridge) for x, w in zip(gq, hq, strict=True)]
        step = np.empty((na, nb))
        step[: i + 1, : j + 1], step[: i + 1, j + 1 :] = value[0], value[1]
        step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = value[2], value[3]
        return float(gain[i, j]), step

    def score(self, x: np.ndarray) -> np.ndarray:
        b, c = binned(x, self.edges), binned(x, self.coarse)
        z = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            z += table[b[:, f]]
        for (i, j), table in self.pair_tables.items():
            z += table[c[:, i], c[:, j]]
        return sigmoid(z)


# --- isolation forest -------------------------------------------------------------------


def _average_depth(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Path lengths over random splits; a score near 1 is an anomaly."""

    trees: int = 100
    sample: int = 256
    seed: int = 11
    forest: list = field(default_factory=list)
    unit: float = 1.0

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        take = min(self.sample, len(x))
        self.forest, self.unit = [], float(max(_average_depth(take), 1e-9))
        limit = max(1, int(np.ceil(np.log2(max(take, 2)))))
        for _ in range(self.trees if take else 0):
            rows = x[rng.choice(len(x), take, replace=False)]
            size = 2 ** (limit + 1) - 1
            feature, cut, depth = np.full(size, -1, np.int32), np.zeros(size), np.zeros(size)
            stack = [(0, np.arange(take), 0)]
            while stack:
                node, own, d = stack.pop()
                span = rows[own].max(0) - rows[own].min(0) if len(own) else np.zeros(x.shape[1])
                able = np.flatnonzero(span > 0)
                if d == limit or len(own) <= 1 or not len(able):
                    depth[node] = d + float(_average_depth(len(own)))
                    continue
                f = int(rng.choice(able))
                c = float(rng.uniform(rows[own, f].min(), rows[own, f].max()))
                feature[node], cut[node] = f, c
                right = rows[own, f] > c
                stack += [(2 * node + 1, own[~right], d + 1), (2 * node + 2, own[right], d + 1)]
            self.forest.append((feature, cut, depth))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.forest:
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, depth in self.forest:
            node = np.zeros(len(x), np.int64)
            while (live := feature[node] >= 0).any():
                f = np.maximum(feature[node], 0)
                node = np.where(live, 2 * node + 1 + (x[rows, f] > cut[node]), node)
            total += depth[node]
        return 2.0 ** (-total / len(self.forest) / self.unit)

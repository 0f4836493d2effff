"""Operators 1, 4 and 8: toxicity, quality and the quality rules.

All three score whole texts in one scan without a shuffle.  A model is fitted on a bounded
sample of labelled rows (``sample_rows``); its arrays are small and travel with the task.  The
thresholds of operator 8 come from all labelled rows, in a scan of their own; there every row
of a doc_id counts.
Nulls: a null text scores as an empty one; a null doc_id keeps its row and is never a
training row.  Of several labels of one doc_id the largest counts, of several texts the least;
repeated rows each have their row.  Other columns are ignored, or kept whatever their names; an
empty ``documents`` gives an empty result, and empty ``labels`` give a constant score.  doc_id is
an integer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features as X
from .common import checkpoint, labelled_sample, map_batches, sampled_features
from .models import AdditiveModel, BoostedTrees, IsolationForest, Isotonic

SAMPLE_ROWS = 12_000


def _with_score(docs: DataFrame, score: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row of docs."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text")), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), one, f"doc_id {kind}, score double")


def learned_lexicon(sample: DataFrame, least: int = 5, odds: float = 20.0) -> np.ndarray:
    """Hashes of the words that mark toxic rows of the sample: they occur in at least ``least``
    toxic texts that are no copies of each other (told by the least hash of their 3-word
    shingles) and ``odds`` times likelier there than in other texts."""

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, word, copies = X.distinct_words(batch.column("text"))
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(copies.view(np.int64)), batch.column("y").take(pa.array(doc))], ["word", "copies", "y"])

    rows = map_batches(sample.select("text", "y"), emit, "word long, copies long, y int").distinct()
    counts = rows.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean"))
    size = sample.agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean")).first()
    if not size["clean"]:
        return np.zeros(0, np.uint64)
    likelier = F.col("toxic") / max(size["toxic"], 1) >= odds * (F.col("clean") + 0.5) / size["clean"]
    found = counts.where((F.col("toxic") >= least) & likelier).select("word").toPandas()
    return np.sort(found["word"].to_numpy(np.int64).view(np.uint64))


def fit_toxicity(docs: DataFrame, labels: DataFrame, use: Column, sample_rows: int = SAMPLE_ROWS) -> Callable[[pa.Array], np.ndarray]:
    """Boosted trees on the features of TOXIC; the isotonic map is fitted on margins of rows
    that the trees behind them have not seen (two halves, each scored by the other's trees)."""
    sample = checkpoint(labelled_sample(docs, labels, "toxic", use, sample_rows))
    learned = learned_lexicon(sample)
    features = lambda column: X.toxic_features(column, learned)
    x, y = sampled_features(sample, features, len(X.TOXIC))
    half = np.arange(len(y)) % 2 == 0
    z = np.zeros(len(y))
    for part in (half, ~half):
        z[part] = BoostedTrees().fit(x[~part], y[~part]).margin(x[part])
    trees, curve = BoostedTrees().fit(x, y), Isotonic().fit(z, y)

    def score(column: pa.Array) -> np.ndarray:
        return np.clip(curve(trees.margin(features(column))), 0.0, 1.0)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, use: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score): the calibrated probability that a text is toxic."""
    return _with_score(docs, fit_toxicity(docs, labels, use, sample_rows))


def fit_quality(docs: DataFrame, labels: DataFrame, use: Column, sample_rows: int = SAMPLE_ROWS) -> Callable[[pa.Array], np.ndarray]:
    x, y = sampled_features(labelled_sample(docs, labels, "quality", use, sample_rows), X.shape_features, len(X.SHAPE))
    model = AdditiveModel().fit(x, y)
    return lambda column: model.score(X.shape_features(column))


def quality(docs: DataFrame, labels: DataFrame, use: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score): the additive model's probability that a text is of good quality."""
    return _with_score(docs, fit_quality(docs, labels, use, sample_rows))


def good_only(docs: DataFrame, labels: DataFrame, use: Column, least: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that score at least ``least``, with all their columns."""
    score = fit_quality(docs, labels, use, sample_rows)
    # Only the texts go to Python, and one bit of each comes back.
    good = F.arrow_udf(lambda text: pa.array(score(text) >= least), "boolean")
    return docs.where(good(docs["text"]))


#: Ratios of the rule statistics that the isolation forest splits on.
def rule_ratios(counts: np.ndarray) -> np.ndarray:
    n, chars, symbols, dup, repeat = (counts[:, k].astype(float) for k in range(5))
    words = np.maximum(n, 1)
    return np.stack([chars / words, symbols / words, np.log1p(dup), dup / words, repeat / words], axis=1)


def base_failed(counts: np.ndarray, least_words: int = 50, repeat_percent: int = 50) -> np.ndarray:
    return (counts[:, 0] < least_words) | (100 * counts[:, 4] > repeat_percent * counts[:, 0])


#: Places of the grid that scores, which lie between 0 and 1, are counted on.
CUTS = 4096
#: Columns of ``rule_ratios`` that each forest of the rules splits on.
VIEWS = {"symbols": [1], "words": [0], "lines": [2, 3], "repeats": [4], "all": [0, 1, 2, 3, 4]}


class RuleForests:
    """One isolation forest for each view of the rule ratios, each with its own threshold."""

    def __init__(self, trees: int = 50):
        self.forests = {name: IsolationForest(trees=trees) for name in VIEWS}
        self.limits = dict.fromkeys(VIEWS, np.inf)

    def grow(self, x: np.ndarray) -> RuleForests:
        """Trees of each view; a tree draws its few rows from those given, as the method does."""
        for name, columns in VIEWS.items():
            self.forests[name].fit(x[:, columns])
        return self

    def places(self, x: np.ndarray) -> np.ndarray:
        """The place of each row's score on the grid of CUTS, a column a view."""
        scores = [self.forests[name].score(x[:, columns]) for name, columns in VIEWS.items()]
        return np.minimum(np.stack(scores, axis=1) * CUTS, CUTS - 1).astype(np.int32)

    def limit(self, good: np.ndarray, bad: np.ndarray, keep_share: float, least_gain: float) -> RuleForests:
        """Thresholds from how many good and bad rows score at each place (a row a view)."""
        for name, g, b in zip(VIEWS, good.cumsum(axis=1), bad.cumsum(axis=1), strict=True):
            if not g[-1] or not b[-1]:
                continue
            # Only cuts that keep this share of the good rows; of those the best balance.
            kept = g / g[-1]
            gain = np.where(kept >= keep_share, kept - b / b[-1], -1.0)
            if gain.max() >= least_gain:
                # In the middle of the places that cut alike.
                best = np.flatnonzero(gain == gain.max())
                alike = best[: 1 + int(np.argmax(np.append(np.diff(best), 2) > 1))]
                self.limits[name] = float(alike[0] + 1 + alike[-1] + 1) / 2 / CUTS
        return self

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """The largest ratio of a score to its threshold; beyond 1 a row is an anomaly."""
        out = np.zeros(len(x))
        for name, columns in VIEWS.items():
            if np.isfinite(self.limits[name]):
                np.maximum(out, self.forests[name].score(x[:, columns]) / self.limits[name], out=out)
        return out


def fit_rules(
    docs: DataFrame, labels: DataFrame, use: Column | None = None, sample_rows: int = SAMPLE_ROWS, keep_share: float = 0.998, least_gain: float = 0.05
) -> RuleForests:
    """Forests over the labelled rows that pass the base rules: trees from at most
    ``sample_rows`` of them, thresholds from all.  A view's threshold is the cut with the best
    balanced accuracy among those that keep ``keep_share`` of the good rows; a view that gains
    less than ``least_gain`` is not used, nor is any without labels."""
    use = use if use is not None else F.lit(True)
    counts, _ = sampled_features(labelled_sample(docs, labels, "quality", use, sample_rows), X.rule_counts, len(X.RULES))
    forests = RuleForests().grow(rule_ratios(counts[~base_failed(counts)]))
    return forests.limit(*placed_labels(docs, labels, use, forests), keep_share, least_gain)


def placed_labels(docs: DataFrame, labels: DataFrame, use: Column, forests: RuleForests) -> tuple[np.ndarray, np.ndarray]:
    """How many good and bad rows score at each place of the grid, a row a view: of every
    labelled text that passes the base rules.  The texts are scored where they are; ids and
    places meet the labels, and CUTS counts a view at most come back."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = X.rule_counts(batch.column("text"))
        passed = ~base_failed(counts)
        at = forests.places(rule_ratios(counts[passed]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(passed)).cast(pa.int64()), *map(pa.array, at.T)], ["doc_id", *VIEWS])

    known = labels.select("doc_id", F.col("quality").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & use)
    known = known.groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    schema = "doc_id long, " + ", ".join(f"`{v}` int" for v in VIEWS)
    met = map_batches(docs.select("doc_id", "text").where("doc_id is not null"), one, schema).join(known, "doc_id")
    each = met.select("y", F.posexplode(F.array(*[F.col(v) for v in VIEWS])).alias("view", "place")).groupBy("y", "view", "place").agg(F.count("*").alias("n"))
    good, bad = np.zeros((len(VIEWS), CUTS), np.int64), np.zeros((len(VIEWS), CUTS), np.int64)
    for row in each.collect():
        if row["y"] in (0, 1):
            (good if row["y"] == 1 else bad)[row["view"], row["place"]] = row["n"]
    return good, bad


def quality_rules(docs: DataFrame, labels: DataFrame, use: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rule statistics of every text, the base verdict, the forest's score and ``kept``."""
    forests = fit_rules(docs, labels, use, sample_rows)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = X.rule_counts(batch.column("text"))
        failed, anomaly = base_failed(counts), forests.anomaly(rule_ratios(counts))
        columns = [pa.array(counts[:, k], pa.int64()) for k in range(len(X.RULES))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns, pa.array(failed), pa.array(anomaly), pa.array(~failed & (anomaly <= 1))],
            ["doc_id", *X.RULES, "base_failed", "anomaly", "kept"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{k} long" for k in X.RULES) + ", base_failed boolean, anomaly double, kept boolean"
    return map_batches(docs.select("doc_id", "text"), one, schema)

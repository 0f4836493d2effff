"""Scores of the models against walks of their trees and tables, one row at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.llm import classifiers as C
from screenspark.llm import features as X
from screenspark.llm import models as M
from screenspark.llm.common import fold

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(500, 4)), 1)
    return x, ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)


def bin_of(value, edges):
    return sum(value > e for e in edges)


def isotonic(model, z):
    """The step or the line between two steps at a margin."""
    at, value = model.at, model.value
    if z <= at[0]:
        return value[0]
    for k in range(1, len(at)):
        if z <= at[k]:
            return value[k] if at[k] == at[k - 1] else value[k - 1] + (value[k] - value[k - 1]) * (z - at[k - 1]) / (at[k] - at[k - 1])
    return value[-1]


def test_boosted_trees_match_a_walk(rows):
    x, y = rows
    model = M.BoostedTrees(trees=25).fit(x, y)
    for row, z in zip(x[:200], model.margin(x[:200]), strict=True):
        total = model.base
        for feature, cut, leaf in model.nodes:
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if bin_of(row[feature[node]], model.edges[feature[node]]) > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert z == pytest.approx(total)
    assert ((M.sigmoid(model.margin(x)) > 0.5) == y).mean() > 0.95


def test_isotonic_pools_match_averages():
    z, y = np.array([0.0, 1, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1])
    model = M.Isotonic().fit(z, y)
    # 1 0 and 1 0 are pooled; with half a row of each label beside every pool.
    assert model(z).tolist() == pytest.approx([0.25, 0.5, 0.5, 0.5, 0.5, 0.75])
    assert [isotonic(model, v) for v in (-1, 0.5, 2.2, 4.5, 9)] == pytest.approx(model(np.array([-1, 0.5, 2.2, 4.5, 9])).tolist())


def test_additive_tables_match_a_walk(rows):
    x, y = rows
    model = M.AdditiveModel(rounds=15, pairs=2).fit(x, y)
    assert model.pair_tables
    for row, p in zip(x[:200], model.score(x[:200]), strict=True):
        z = model.base + sum(t[bin_of(v, e)] for t, v, e in zip(model.tables, row, model.edges, strict=True))
        z += sum(t[bin_of(row[i], model.coarse[i])][bin_of(row[j], model.coarse[j])] for (i, j), t in model.pair_tables.items())
        assert p == pytest.approx(1 / (1 + math.exp(-z)))


def path_score(forest, row):
    """The mean depth at which a row ends, over all trees, as a score."""
    total = 0.0
    for feature, cut, depth in forest.forest:
        node = 0
        while feature[node] >= 0:
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        total += depth[node]
    return 2.0 ** (-total / len(forest.forest) / forest.unit)


def test_path_lengths_match_a_walk(rows):
    x = np.concatenate([rows[0], [[9.0, 9, 9, 9]]])
    forest = M.IsolationForest(trees=30).fit(x)
    score = forest.score(x)
    assert score.tolist() == pytest.approx([path_score(forest, r) for r in x]) and score.argmax() == len(x) - 1
    assert float(M._average_depth(2)) == 1 and float(M._average_depth(256)) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def plain_kept(forests, counts):
    n, chars, symbols, dup, repeat = map(float, counts)
    words = max(n, 1)
    x = [chars / words, symbols / words, math.log1p(dup), dup / words, repeat / words]
    ratio = max([path_score(forests.forests[v], [x[k] for k in columns]) / forests.limits[v] for v, columns in C.VIEWS.items() if np.isfinite(forests.limits[v])], default=0.0)
    return ratio, not (n < 50 or 100 * repeat > 50 * n) and ratio <= 1


def test_verdicts_of_the_rules_match_a_walk(spark):
    """Every document of the table: the largest ratio of a path score to its threshold decides."""
    from screenspark.llm.queries import QUERIES

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forests = C.fit_rules(docs, labels)
    assert any(np.isfinite(v) for v in forests.limits.values())
    for r in QUERIES["op8_quality_rules"](spark, SF).collect():
        ratio, kept = plain_kept(forests, [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words])
        assert r.anomaly == pytest.approx(ratio) and r.kept == kept


def test_thresholds_keep_the_good_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forests = C.fit_rules(docs, labels, fold("doc_id", 4) != 2)
    good = docs.join(labels.where("quality = 1"), "doc_id").where(fold("doc_id", 4) != 2)
    counts = X.rule_counts(good.select("text").toArrow()["text"])
    passed = counts[~C.base_failed(counts)]
    for name, columns in C.VIEWS.items():
        s = forests.forests[name].score(C.rule_ratios(passed)[:, columns])
        assert not np.isfinite(forests.limits[name]) or (s <= forests.limits[name]).mean() >= 0.99


def test_very_long_texts_have_scores(spark):
    """A text beyond the size of a block, of one word or of many, among short ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    many = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.expr("repeat('a clean and honest sentence about nothing, with 12 words in it. ', 12000)").alias("text"))
    one = spark.range(1).select(F.lit(-2).cast("long").alias("doc_id"), F.expr("repeat('x', 700000)").alias("text"))
    both = docs.union(many).union(one)
    for fit in (C.toxicity, C.quality):
        short = {r.doc_id: r.score for r in fit(docs, labels, F.lit(True)).collect()}
        got = {r.doc_id: r.score for r in fit(both, labels, F.lit(True)).collect()}
        assert len(got) == docs.count() + 2 and all(0 <= v <= 1 for v in got.values())
        assert {i: got[i] for i in short} == pytest.approx(short)
    rules = {r.doc_id: r for r in C.quality_rules(both, labels).where("doc_id < 0").collect()}
    assert rules[-1].n_words == 144_000 and rules[-1].base_failed and rules[-2].word_chars == 700_000


def test_thresholds_come_from_all_labelled_rows(spark):
    """Trees may be drawn from a few rows; the thresholds count every one, so the good rows that
    are kept are that share of all of them."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    forests = C.fit_rules(docs, labels, sample_rows=60)
    good, bad = C.placed_labels(docs, labels, F.lit(True), forests)
    known = C.quality_rules(docs, labels, sample_rows=60).join(labels, "doc_id").where("not base_failed and quality is not null")
    n = {r["quality"]: (r["n"], r["kept"]) for r in known.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert [sorted(set(c.sum(axis=1).tolist())) for c in (good, bad)] == [[n[1][0]], [n[0][0]]] and n[1][0] > 60
    assert n[1][1] >= 0.98 * n[1][0]

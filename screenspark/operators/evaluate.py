"""Detection, text and hierarchy metrics, and comparisons of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from . import greedy, selection, spatial


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def match_elements(predicted: DataFrame, truth: DataFrame, on: str = "state_id", least: float = 0.5) -> DataFrame:
    """(on, pred_id, gt_id, iou): greedy matching by IoU."""
    near = spatial.pairs(predicted, truth, on, lambda a, b: G.iou(a, b) >= least)
    scored = near.select(F.col(f"a.{on}").alias(on), F.col("a.elem_id").alias("pred_id"), F.col("b.elem_id").alias("gt_id"), G.iou(G.box("a"), G.box("b")).alias("iou"))
    return greedy.match(scored, [on], "pred_id", "gt_id", "iou")


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), _ratio(tp, tp + fp + fn).alias("accuracy")]


def screen_metrics(predicted: DataFrame, truth: DataFrame, matched: DataFrame, on: str = "state_id") -> DataFrame:
    """Counts and rates of each screen that has elements on either side."""
    n = lambda df, name: df.groupBy(on).agg(F.count("*").alias(name))
    m = matched.groupBy(on).agg(F.count("*").alias("tp"), F.sum("iou").alias("iou_sum"))
    joined = n(predicted, "n_pred").join(n(truth, "n_gt"), on, "full_outer").join(m, on, "left").na.fill(0)
    tp, fp, fn = F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_gt") - F.col("tp")
    return joined.select(on, "tp", fp.alias("fp"), fn.alias("fn"), *rates(tp, fp, fn), _ratio(F.col("iou_sum"), tp).alias("mean_iou"), "iou_sum")


def pooled(metrics: DataFrame) -> DataFrame:
    """One row over all screens: pooled counts, and unweighted means of the screens."""
    sums = metrics.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "iou_sum")], *[F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "f1")], F.count("*").alias("screens"))
    return sums.select("screens", "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")), _ratio(F.col("iou_sum"), F.col("tp")).alias("mean_iou"), "mean_precision", "mean_recall", "mean_f1")


def class_metrics(predicted: DataFrame, truth: DataFrame, matched: DataFrame, on: str = "state_id") -> DataFrame:
    """By type: a matched prediction counts for its own type, whatever type it matched."""
    pred = predicted.join(matched.select(on, F.col("pred_id").alias("elem_id"), F.lit(1).alias("m")), [on, "elem_id"], "left")
    gt = truth.join(matched.select(on, F.col("gt_id").alias("elem_id"), F.lit(1).alias("m")), [on, "elem_id"], "left")
    p = pred.groupBy("visual_type").agg(F.count("m").alias("tp"), F.count_if(F.col("m").isNull()).alias("fp"))
    g = gt.groupBy("visual_type").agg(F.count_if(F.col("m").isNull()).alias("fn"), F.count("*").alias("support"))
    both = p.join(g, "visual_type", "full_outer").na.fill(0)
    return both.select("visual_type", "tp", "fp", "fn", "support", *rates(F.col("tp"), F.col("fp"), F.col("fn"))[:3])


def type_accuracy(predicted: DataFrame, truth: DataFrame, matched: DataFrame, on: str = "state_id") -> DataFrame:
    """By type of the truth: share found, and share found with the right type."""
    pred = predicted.select(on, F.col("elem_id").alias("pred_id"), F.col("visual_type").alias("pred_type"))
    got = truth.join(matched.withColumnRenamed("gt_id", "elem_id"), [on, "elem_id"], "left").join(pred, [on, "pred_id"], "left")
    right = F.coalesce(F.col("pred_type") == F.col("visual_type"), F.lit(False))
    return got.groupBy("visual_type").agg(F.count("*").alias("support"), F.count("pred_id").alias("found"), F.count_if(right).alias("typed")).select(
        "*", _ratio(F.col("found"), F.col("support")).alias("recall"), _ratio(F.col("typed"), F.col("support")).alias("type_accuracy")
    )


def text_metrics(pairs: DataFrame) -> DataFrame:
    """pairs (pred_text, gt_text): comparisons with a true text; edit distances over all
    characters and all words, exact matches after trimming, case aside."""
    p, g = F.coalesce("pred_text", F.lit("")), F.coalesce("gt_text", F.lit(""))
    own = pairs.select(p.alias("p"), g.alias("g")).where("g <> ''")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = own.agg(
        F.count("*").alias("comparisons"), total(F.length("g")).alias("chars"), total(X.edit_distance(F.col("p"), F.col("g"))).alias("edits"),
        total(F.size(X.words(F.col("g")))).alias("words"), total(X.word_distance(F.col("p"), F.col("g"))).alias("word_edits"),
        F.count_if(F.lower(F.trim("p")) == F.lower(F.trim("g"))).alias("exact"),
    )
    cer, wer = _ratio(F.col("edits"), F.col("chars")), _ratio(F.col("word_edits"), F.col("words"))
    least = lambda c: F.greatest(F.lit(0.0), 1 - c)
    return sums.select("*", cer.alias("cer"), wer.alias("wer"), least(cer).alias("char_accuracy"), least(wer).alias("word_accuracy"), _ratio(F.col("exact"), F.col("comparisons")).alias("exact_rate"))


def hierarchy_metrics(draft: DataFrame, target: DataFrame, on: str = "state_id") -> DataFrame:
    """Share of common elements with the same parent, by screen; and the size difference."""
    both = draft.alias("a").join(target.alias("b"), [on, "elem_id"])
    same = F.col("a.parent_id").eqNullSafe(F.col("b.parent_id"))
    return both.groupBy(on).agg(F.count("*").alias("common"), F.count_if(same).alias("same_parent")).select("*", _ratio(F.col("same_parent"), F.col("common")).alias("parent_accuracy"))


def locator_metrics(elements: DataFrame) -> DataFrame:
    """elements with a locators map: coverage, share with text, uniqueness, repeated texts."""
    n = F.count("*")
    text = F.try_element_at("locators", F.lit("text"))
    counts = elements.groupBy("state_id").agg(n.alias("n"), F.count_if(F.size("locators") > 0).alias("covered"), F.count(text).alias("with_text"), F.count_distinct("text").alias("texts"), F.count("text").alias("captions"))
    return counts.select("*", _ratio(F.col("covered"), F.col("n")).alias("coverage"), _ratio(F.col("with_text"), F.col("n")).alias("text_rate"), _ratio(F.col("captions") - F.col("texts"), F.col("n")).alias("repeat_rate"))


def run_diff(new: DataFrame, old: DataFrame, step: str = "step", ok: str = "ok") -> DataFrame:
    """Steps that both runs have, as identical, gain or loss."""
    both = new.select(step, F.col(ok).alias("new_ok")).join(old.select(step, F.col(ok).alias("old_ok")), step)
    kind = F.when(F.col("new_ok") == F.col("old_ok"), "identical").when(F.col("new_ok"), "gain").otherwise("loss")
    return both.select(step, kind.alias("change"))


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Of step results (kind, negative, hit, passed, latency): click rate, pass rates of
    present and absent targets, their mean, and the exact median latency."""
    act, neg = F.col("kind") == "action", F.col("negative")
    ver = (F.col("kind") == "verify")
    rate = lambda test, base: F.try_divide(F.count_if(test & base).cast("double"), F.count_if(base))
    present, absent = rate(F.col("passed"), ver & ~neg), rate(~F.col("passed"), ver & neg)
    rates = results.groupBy(*by).agg(
        F.count("*").alias("steps"), rate(F.col("hit"), act).alias("click_rate"), present.alias("present_pass"), absent.alias("absent_fail"),
        ((present + absent) / 2).alias("balanced"), F.count_if(ver & neg & F.col("passed")).alias("false_passes"),
    )
    middle = selection.quantiles(results, by, "latency", {"median_latency": 0.5}).drop("n")
    on = reduce(lambda a, b: a & b, [rates[c].eqNullSafe(middle[c]) for c in by], F.lit(True))
    return rates.join(middle, on, "left").select(*[rates[c] for c in rates.columns], "median_latency")


def similar_texts(pairs: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs whose matching-block similarity is at least that, with the score."""
    return pairs.withColumn("similarity", X.similarity(F.col("pred_text"), F.col("gt_text"), least)).where(F.col("similarity") >= least)

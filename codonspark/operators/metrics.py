"""Evaluation: confusion, precision and recall, multilabel and binary metrics, ranking curves, threshold scans.

Everything is an aggregation to a few rows; ranking curves first group equal scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonspark.plans.frames import stored


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    d = [x.cast("double") for x in (tp + fp, tp + fn, tn + fp, tn + fn)]
    area = d[0] * d[1] * d[2] * d[3]
    return F.when(area > 0, (tp.cast("double") * tn - fp.cast("double") * fn) / F.sqrt(area)).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, classes: Sequence[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(label, support, tp, fp, fn, precision, recall, f1) of each class, absent ones included."""
    counts = confusion(rows, truth, predicted)  # at most classes * classes rows
    names = rows.sparkSession.createDataFrame([(k, c) for k, c in enumerate(classes)], "label_order int, label string")
    joined = names.join(counts, (F.col("label") == F.col("truth")) | (F.col("label") == F.col("predicted")), "left")
    n = F.coalesce("n", F.lit(0))
    total = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("long")
    hit, own, said = F.col("truth") == F.col("predicted"), F.col("truth") == F.col("label"), F.col("predicted") == F.col("label")
    sums = joined.groupBy("label_order", "label").agg(total(own).alias("support"), total(own & hit).alias("tp"), total(said & ~hit).alias("fp"), total(own & ~hit).alias("fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("label", "support", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1")).orderBy("label_order")


def overall(rows: DataFrame, classes: Sequence[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: n, accuracy and macro F1 over all ``classes``."""
    m = class_metrics(rows, classes, truth, predicted).agg(F.sum("tp").alias("hits"), F.avg("f1").alias("macro_f1"))
    return rows.agg(F.count("*").alias("n")).join(F.broadcast(m)).select("n", _ratio(F.col("hits"), F.col("n")).alias("accuracy"), "macro_f1")


def multilabel(rows: DataFrame, labels: Sequence[str], truth: str = "truth", predicted: str = "predicted") -> tuple[DataFrame, DataFrame]:
    """(by label, overall) of two array columns of labels."""
    has = lambda c, label: F.array_contains(F.coalesce(c, F.array().cast("array<string>")), label)
    known = F.array(*[F.lit(x) for x in labels])
    t, p = F.array_intersect(F.coalesce(truth, F.array().cast("array<string>")), known), F.array_intersect(F.coalesce(predicted, F.array().cast("array<string>")), known)
    flat = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("label"), has(truth, x).alias("t"), has(predicted, x).alias("p")) for k, x in enumerate(labels)])).alias("x")).select("x.*")
    by = flat.groupBy("k", "label").agg(F.count_if("t").alias("support"), F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"), F.count_if(~F.col("t") & ~F.col("p")).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    by = by.select("k", "label", "support", "tp", "fp", "fn", "tn", prec.alias("precision"), rec.alias("recall"), _ratio(tn, tn + fp).alias("specificity"), _f1(prec, rec).alias("f1"), _mcc(tp, fp, fn, tn).alias("mcc"))
    both, either = F.size(F.array_intersect(t, p)), F.size(F.array_union(t, p))
    one = rows.agg(F.count("*").alias("n_rows"), F.avg((either == both).cast("double")).alias("subset_accuracy"), F.avg(F.when(either > 0, both / either).otherwise(F.lit(1.0))).alias("jaccard"),
                   F.avg(F.when(F.size(t) + F.size(p) > 0, 2.0 * both / (F.size(t) + F.size(p))).otherwise(F.lit(1.0))).alias("sample_f1"), F.avg((either - both) / len(labels)).alias("hamming_loss"))
    sums = by.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_observed"))
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    sums = sums.select(p1.alias("micro_precision"), r1.alias("micro_recall"), _f1(p1, r1).alias("micro_f1"), "macro_f1", F.coalesce("macro_f1_observed", "macro_f1").alias("macro_f1_observed"))
    return by.orderBy("k").drop("k"), one.join(F.broadcast(sums))


def binary(rows: DataFrame, truth: str = "truth", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """One row: counts and rates at a threshold, average precision and the area under the ROC curve (null if there is one class)."""
    t, s = F.col(truth) == 1, F.col(score) >= threshold
    counts = rows.agg(F.count("*").alias("n_rows"), F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    rates = counts.select("*", p.alias("precision"), r.alias("recall"), _ratio(tn, tn + fp).alias("specificity"), _ratio(tp + tn, F.col("n_rows")).alias("accuracy"), _f1(p, r).alias("f1"), _mcc(tp, fp, fn, tn).alias("mcc"))
    return rates.join(F.broadcast(ranking(rows, truth, score)))


def ranking(rows: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """One row (auprc, auroc). Rows with equal scores are one step of the curves."""
    steps = score_steps(rows, truth, score)
    ap, roc = F.sum(F.col("pos") / F.col("P") * (F.col("cp") / (F.col("cp") + F.col("cn")))), F.sum(F.col("neg") * (F.col("cp") - F.col("pos") / 2.0) / (F.col("P") * F.col("N")))
    usable = steps.where("P > 0 AND N > 0")
    return usable.agg(ap.alias("auprc"), roc.alias("auroc"))


def score_steps(rows: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """(s, pos, neg, cp, cn, P, N) of each distinct score: rows with it, rows with it or a higher one, and all rows, by truth (1 or not).

    Scores are dealt to ranges, which are summed up on their own; only the ranges' sums are put in order in one place. Rows without
    a score or truth don't count.
    """
    steps = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    ranges = stored(steps.repartitionByRange(F.desc("s")).withColumn("part", F.spark_partition_id()), "scores")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    sums = sums.select("part", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in "pn"], F.sum("p").over(Window.partitionBy()).alias("P"), F.sum("n").over(Window.partitionBy()).alias("N"))
    upto = Window.partitionBy("part").orderBy(F.desc("s"))
    own = ranges.withColumn("cp", F.sum("pos").over(upto)).withColumn("cn", F.sum("neg").over(upto)).join(F.broadcast(sums), "part")
    return own.select("s", "pos", "neg", (F.col("cp") + F.col("p_before")).alias("cp"), (F.col("cn") + F.col("n_before")).alias("cn"), "P", "N")


def f1_thresholds(rows: DataFrame, truth: str = "truth", score: str = "score", most: int = 80) -> DataFrame:
    """(threshold, f1, tp, fp, fn): of all distinct scores the ``most`` with the highest F1 of predicting 1 from there up; of equals those
    with fewer false positives, more true ones, then the lower score. Without rows one row (0.5, 0, 0, 0, 0)."""
    steps = score_steps(rows, truth, score)
    fn = F.col("P") - F.col("cp")
    own = steps.select(F.col("s").alias("threshold"), F.coalesce(2 * F.col("cp") / F.nullif(2 * F.col("cp") + F.col("cn") + fn, F.lit(0)), F.lit(0.0)).alias("f1"), F.col("cp").alias("tp"), F.col("cn").alias("fp"), fn.alias("fn"))
    best = stored(own.orderBy(F.desc("f1"), "fp", F.desc("tp"), "threshold").limit(most), "thresholds")
    none = rows.sparkSession.createDataFrame([(0.5, 0.0, 0, 0, 0)], best.schema)
    return none if best.isEmpty() else best.orderBy(F.desc("f1"), "fp", F.desc("tp"), "threshold")


def best_f1_threshold(rows: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """One row (threshold, f1, tp, fp, fn): of all distinct scores the one with the highest F1, of equals the highest; where F1 is 0
    everywhere, the highest score, with all positives missed. Without rows (0.5, 0, 0, 0, 0)."""
    steps = score_steps(rows, truth, score)
    fn = F.col("P") - F.col("cp")
    f1 = F.coalesce(2 * F.col("cp") / F.nullif(2 * F.col("cp") + F.col("cn") + fn, F.lit(0)), F.lit(0.0))
    best = steps.agg(F.max(F.struct(f1.alias("f1"), F.col("s").alias("threshold"), F.col("cp").alias("tp"), F.col("cn").alias("fp"), fn.alias("fn"))).alias("b"), F.max("s").alias("top"), F.coalesce(F.max("P"), F.lit(0)).alias("P"))
    found = F.coalesce(F.col("b.f1"), F.lit(0.0)) > 0
    zero = F.lit(0).cast("long")
    return best.select(F.coalesce(F.when(found, F.col("b.threshold")), "top", F.lit(0.5)).alias("threshold"), F.when(found, F.col("b.f1")).otherwise(0.0).alias("f1"), F.when(found, F.col("b.tp")).otherwise(zero).alias("tp"),
                       F.when(found, F.col("b.fp")).otherwise(zero).alias("fp"), F.when(found, F.col("b.fn")).otherwise(F.col("P")).alias("fn"))


def best_threshold(rows: DataFrame, truth: str = "truth", score: str = "score", grid: Sequence[float] = tuple(k / 100 for k in range(1, 100))) -> DataFrame:
    """One row (threshold, f1): the threshold of the grid with the highest F1, of equals the nearest to 0.5, then the lowest.

    Rows are counted once by the grid cell of their score; the scan runs over the grid.
    """
    cells = F.size(F.filter(F.array(*[F.lit(float(g)) for g in sorted(grid)]), lambda g: g <= F.col(score))).alias("cell")
    counts = rows.groupBy(cells).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    table = rows.sparkSession.createDataFrame([(k + 1, float(g)) for k, g in enumerate(sorted(grid))], "k int, threshold double")
    # grid rows against at most as many cells
    scored = table.join(F.broadcast(counts), F.lit(True), "left").groupBy("threshold", "k").agg(F.sum(F.when(F.col("cell") >= F.col("k"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("cell") >= F.col("k"), F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("P"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("P"))
    scored = scored.select("threshold", F.round(_f1(p, r), 12).alias("f1"))
    return scored.orderBy(F.desc("f1"), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)

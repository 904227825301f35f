"""Nearest-centroid classifiers: fitting by aggregation, predicting by array expressions, calibration of probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonspark.operators.labels import CLASSES


def fit(rows: DataFrame, features: Sequence[str], label: str = "label", classes: Sequence[str] | None = None, fold: str | None = None, weight: str | None = None) -> DataFrame:
    """(class, class_order, mean, std, centroid, log_prior), arrays in the order of ``features``; with ``fold`` also for each left-out fold.

    Means and population deviations (0 counts as 1) are over all rows; a centroid is the mean of its class in these units;
    priors are Laplace-smoothed. All comes from sums by class, and by fold: a model without a fold is the total less that
    fold's sums, in one pass. Rows without a fold are left out of no model. With ``weight`` a row counts so often in all of these.
    """
    keys = [F.col(label).alias("class")] + ([F.col(fold).alias("_fold")] if fold else [])
    own = rows.where(F.col(label).isin(*classes)) if classes else rows
    times = (lambda c: c) if weight is None else (lambda c: c * F.col(weight))
    total = F.count("*") if weight is None else F.sum(weight)
    sums = own.groupBy(*keys).agg(total.alias("n"), *[F.sum(times(F.col(f))).alias(f"s{k}") for k, f in enumerate(features)], *[F.sum(times(F.col(f) * F.col(f))).alias(f"q{k}") for k, f in enumerate(features)])
    names = _sums(features)
    if fold:
        folds = sums.select(F.col("_fold").alias("fold")).where("fold IS NOT NULL").distinct()
        sums = sums.join(F.broadcast(folds), ~F.col("_fold").eqNullSafe(F.col("fold"))).groupBy("fold", "class").agg(*[F.sum(x).alias(x) for x in names])
    return _centroids(sums, features, classes, ["fold"] if fold else [])


def _sums(features: Sequence[str]) -> list[str]:
    return ["n"] + [f"{x}{k}" for x in "sq" for k in range(len(features))]


def fit_without(rows: DataFrame, features: Sequence[str], label: str, classes: Sequence[str], fold: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """As ``fit``, with ``fold`` the name of a set of folds, joined by /: a model of the rows outside each of ``sets``.

    Rows are summed up by fold and class once; all models are sums of these.
    """
    own = rows.where(F.col(label).isin(*classes)).groupBy(F.col(fold).cast("string").alias("_fold"), F.col(label).alias("class"))
    sums = own.agg(F.count("*").alias("n"), *[F.sum(F.col(f)).alias(f"s{k}") for k, f in enumerate(features)], *[F.sum(F.col(f) * F.col(f)).alias(f"q{k}") for k, f in enumerate(features)])
    table = rows.sparkSession.createDataFrame([("/".join(s), list(s)) for s in sets], "fold string, without array<string>")
    sums = sums.join(F.broadcast(table), ~F.array_contains("without", F.col("_fold"))).groupBy("fold", "class").agg(*[F.sum(x).alias(x) for x in _sums(features)])
    return _centroids(sums, features, classes, ["fold"])


def _centroids(sums: DataFrame, features: Sequence[str], classes: Sequence[str] | None, by: list[str]) -> DataFrame:
    names = _sums(features)
    total = sums.groupBy(*by).agg(F.count("*").alias("_k"), *[F.sum(x).alias(f"_{x}") for x in names])
    both = sums.join(F.broadcast(total), by) if by else sums.join(F.broadcast(total))
    mean = [F.col(f"_s{k}") / F.col("_n") for k in range(len(features))]
    deviation = [F.sqrt(F.greatest(F.lit(0.0), F.col(f"_q{k}") / F.col("_n") - m * m)) for k, m in enumerate(mean)]
    std = [F.when(d < 1e-9, F.lit(1.0)).otherwise(d) for d in deviation]
    centre = [(F.col(f"s{k}") / F.col("n") - m) / d for k, (m, d) in enumerate(zip(mean, std, strict=True))]
    prior = F.ln((F.col("n") + 1.0) / (F.col("_n") + F.col("_k")))
    order = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class")) - 1 if classes else F.lit(0).cast("long")
    return both.select(*by, "class", order.alias("class_order"), F.array(*mean).alias("mean"), F.array(*std).alias("std"), F.array(*centre).alias("centroid"), prior.alias("log_prior"))


def predict(rows: DataFrame, model: DataFrame, features: Sequence[str], fold: str | None = None) -> DataFrame:
    """``rows`` with ``predicted`` and ``probabilities`` (map): softmax of -d^2 / 2 + log prior over the classes' centroids.

    The model has a row for each class (and fold) and is broadcast as one row of arrays.
    """
    packed = model.groupBy(*(["fold"] if fold else [])).agg(F.array_sort(F.collect_list(F.struct("class_order", "class", "mean", "std", "centroid", "log_prior"))).alias("_m"))
    x = F.array(*[F.col(f).cast("double") for f in features])
    joined = rows.withColumn("_x", x)
    joined = joined.join(F.broadcast(packed.withColumnRenamed("fold", "_f")), F.col(fold) == F.col("_f")).drop("_f") if fold else joined.join(F.broadcast(packed))
    square = lambda m: F.aggregate(F.zip_with(F.zip_with(F.zip_with("_x", m["mean"], lambda a, b: a - b), m["std"], lambda a, b: a / b), m["centroid"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    joined = joined.withColumn("_logit", F.transform("_m", lambda m: -0.5 * square(m) + m["log_prior"]))
    joined = joined.withColumn("_e", F.transform("_logit", lambda v: F.exp(v - F.array_max("_logit"))))
    share = F.transform("_e", lambda v: v / F.aggregate("_e", F.lit(0.0), lambda s, y: s + y))
    names = F.transform("_m", lambda m: m["class"])
    out = joined.withColumn("probabilities", F.map_from_arrays(names, share))
    best = F.array_position("_logit", F.array_max("_logit")) - 1
    return out.withColumn("predicted", F.get(names, best.cast("int"))).drop("_x", "_m", "_logit", "_e")


def normalize(p: dict[str, Column]) -> dict[str, Column]:
    """Class probabilities that sum to 1; noTP is certain if all are 0."""
    clean = {c: F.greatest(F.lit(0.0), F.coalesce(F.nanvl(p[c], F.lit(0.0)), F.lit(0.0))) for c in CLASSES}
    total = sum(clean.values(), F.lit(0.0))
    return {c: F.when(total > 0, v / total).otherwise(F.lit(1.0 if c == "noTP" else 0.0)) for c, v in clean.items()}


def constrain(p: dict[str, Column], group: Column) -> dict[str, Column]:
    """Normalised probabilities; without cTP and lTP where the organism group is non_plant."""
    own = normalize(p)
    return normalize({c: F.when(group.eqNullSafe("non_plant"), F.lit(0.0)).otherwise(v) if c in ("cTP", "lTP") else v for c, v in own.items()})


def scale(p: dict[str, Column], temperature: float) -> dict[str, Column]:
    """Normalised probabilities at a temperature; one that isn't positive, or 1, changes nothing."""
    own = normalize(p)
    if not temperature > 0 or abs(temperature - 1) < 1e-12 or temperature == float("inf"):
        return own
    powered = {c: F.pow(F.least(F.lit(1.0), F.greatest(F.lit(1e-12), v)), F.lit(1 / temperature)) for c, v in own.items()}
    total = sum(powered.values(), F.lit(0.0))
    return {c: v / total for c, v in powered.items()}


def choose(p: dict[str, Column], thresholds: dict[str, float] | None = None) -> Column:
    """The class with the highest probability over its threshold, the first of equals."""
    usable = lambda t: t if 0 < t < float("inf") else 1.0
    scores = F.array(*[p[c] / F.lit(usable((thresholds or {}).get(c, 1.0))) for c in CLASSES])
    return F.get(F.array(*[F.lit(c) for c in CLASSES]), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def two_stage(is_tp: Column, by_kind: dict[str, Column], ctp_ltp: dict[str, Column] | None = None) -> dict[str, Column]:
    """Class probabilities from the probability of any targeting peptide, of its kinds, and of cTP against lTP."""
    kinds = dict(by_kind)
    if ctp_ltp:
        plastid = kinds["cTP"] + kinds["lTP"]
        kinds |= {c: plastid * ctp_ltp[c] for c in ("cTP", "lTP")}
    return normalize({"noTP": 1 - is_tp, **{c: is_tp * kinds[c] for c in CLASSES[1:]}})


def fit_multilabel(rows: DataFrame, features: Sequence[str], labels: Sequence[str], column: str = "labels") -> DataFrame:
    """(label, label_order, mean, std, yes, no, log_odds): a pair of centroids for each label of an array column."""
    flagged = rows.select(*features, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("label"), F.array_contains(column, x).alias("has")) for k, x in enumerate(labels)])).alias("l")).select(*features, "l.*")
    names = range(len(features))
    sums = flagged.groupBy("k", "label").agg(F.count("*").alias("n"), F.count_if("has").alias("m"), *[F.avg(f).alias(f"a{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"d{i}") for i, f in enumerate(features)],
                                             *[F.avg(F.when(F.col("has"), F.col(f))).alias(f"y{i}") for i, f in enumerate(features)], *[F.avg(F.when(~F.col("has"), F.col(f))).alias(f"x{i}") for i, f in enumerate(features)])
    std = [F.when(F.col(f"d{i}") < 1e-9, F.lit(1.0)).otherwise(F.col(f"d{i}")) for i in names]
    z = lambda c: F.array(*[F.coalesce((F.col(f"{c}{i}") - F.col(f"a{i}")) / std[i], F.lit(0.0)) for i in names])
    odds = F.ln((F.col("m") + 1.0) / (F.col("n") - F.col("m") + 1.0))
    return sums.select("label", F.col("k").alias("label_order"), F.array(*[F.col(f"a{i}") for i in names]).alias("mean"), F.array(*std).alias("std"), z("y").alias("yes"), z("x").alias("no"), odds.alias("log_odds"))


def predict_multilabel(rows: DataFrame, model: DataFrame, features: Sequence[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    """``rows`` with ``probabilities`` (map) and ``predicted`` (array): labels whose probability reaches their threshold (0.5), and
    if none does the one with the highest probability over its threshold."""
    packed = model.agg(F.array_sort(F.collect_list(F.struct("label_order", "label", "mean", "std", "yes", "no", "log_odds"))).alias("_m"))
    joined = rows.withColumn("_x", F.array(*[F.col(f).cast("double") for f in features])).join(F.broadcast(packed))
    z = lambda m: F.zip_with(F.zip_with("_x", m["mean"], lambda a, b: a - b), m["std"], lambda a, b: a / b)
    far = lambda m, side: F.aggregate(F.zip_with(z(m), m[side], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    joined = joined.withColumn("_p", F.transform("_m", lambda m: F.struct(m["label"].alias("label"), (1 / (1 + F.exp(-(0.5 * (far(m, "no") - far(m, "yes")) + m["log_odds"])))).alias("p"))))
    limit = F.create_map(*[F.lit(x) for pair in (thresholds or {"": 0.5}).items() for x in pair])
    joined = joined.withColumn("_r", F.transform("_p", lambda x: F.struct(x["label"].alias("label"), (x["p"] / F.coalesce(F.element_at(limit, x["label"]), F.lit(0.5))).alias("r"))))
    chosen = F.transform(F.filter("_r", lambda x: x["r"] >= 1), lambda x: x["label"])
    top = F.get(F.transform(F.filter("_r", lambda x: x["r"] == F.array_max(F.transform("_r", lambda y: y["r"]))), lambda x: x["label"]), 0)
    out = joined.withColumn("probabilities", F.map_from_arrays(F.transform("_p", lambda x: x["label"]), F.transform("_p", lambda x: x["p"])))
    return out.withColumn("predicted", F.when(F.size(chosen) > 0, chosen).otherwise(F.array(top))).drop("_x", "_m", "_p", "_r")


def save(model: DataFrame, path: str) -> None:
    """A model as JSON lines, a line for each class."""
    model.coalesce(1).write.mode("overwrite").json(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.schema("fold int, class string, class_order long, mean array<double>, std array<double>, centroid array<double>, log_prior double").json(path)

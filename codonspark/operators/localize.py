"""Localisation of proteins: features, training with left-out folds, prediction and its report, each as one operator.

A model is two tables of centroids (see ``centroid.fit``): of the localisation classes, and of peroxisomal proteins (yes, no).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonspark.functions import proteins as P
from codonspark.operators import centroid, labels, metrics
from codonspark.operators.labels import CLASSES
from codonspark.plans.frames import stored

PEROX = ("no", "yes")


def feature_names() -> tuple[str, ...]:
    """Names of the base features, in their order; needs a Spark session."""
    return tuple(P.base_features(F.col("seq")))


@dataclass(frozen=True)
class Model:
    """Centroids of the classes and of peroxisomal proteins, and what is applied to the classes' probabilities."""

    classes: DataFrame
    perox: DataFrame
    temperature: float = 1.0
    thresholds: dict[str, float] | None = None


def with_features(seqs: DataFrame, mode: str = "auto", table: int | str = 1) -> DataFrame:
    """``seqs`` with protein and the 33 base features; see ``proteins.protein_of`` for ``mode``."""
    rows = seqs.withColumn("protein", P.protein_of(F.col("seq"), mode, table))
    return rows.select("*", *[v.alias(n) for n, v in P.base_features(F.col("protein")).items()])


def localize(seqs: DataFrame, model: Model, mode: str = "auto", table: int | str = 1, group: Column | None = None, features: bool = False) -> DataFrame:
    """(input_order, seq_id, predicted_class, p_noTP ... p_lTP, p_peroxisome, perox_signal_type) of each sequence, and with
    ``features`` the 33 base features.

    ``group``: the organism's group; where it is non_plant, there are no cTP and lTP. The model is broadcast as one row, rows
    aren't shuffled. Raises for sequences that ``mode`` doesn't allow. An empty table gives no rows.
    """
    rows = with_features(seqs.withColumn("_group", F.lit("") if group is None else group), mode, table).withColumn("perox_signal_type", P.signal_type(F.col("protein")))
    return place(rows, model, F.col("_group"), features)


def place(rows: DataFrame, model: Model, group: Column | None = None, features: bool = False) -> DataFrame:
    """``localize`` of rows that have their base features and perox_signal_type, as a stored table has that is also learned from."""
    names = feature_names()
    rows = rows.withColumn("_group", F.lit("") if group is None else group)
    rows = centroid.predict(rows, model.classes, names).withColumnRenamed("probabilities", "_p").drop("predicted")
    rows = centroid.predict(rows, model.perox, names).withColumn("_yes", F.coalesce(F.element_at("probabilities", "yes"), F.lit(0.0)))
    rows = rows.withColumns({f"p_{c}": F.coalesce(F.element_at("_p", c), F.lit(0.0)) for c in CLASSES})
    p = {c: F.col(f"p_{c}") for c in CLASSES}
    # each step on the columns of the one before, as their expressions would multiply
    rows = rows.withColumns({f"p_{c}": v for c, v in centroid.normalize(p).items()})
    plastid = F.col("_group").eqNullSafe("non_plant")
    rows = rows.withColumns({f"p_{c}": v for c, v in centroid.normalize({c: F.when(plastid, 0.0).otherwise(v) if c in ("cTP", "lTP") else v for c, v in p.items()}).items()})
    if model.temperature != 1:
        rows = rows.withColumns({f"p_{c}": v for c, v in centroid.scale(p, model.temperature).items()})
    best = centroid.choose(p, model.thresholds)
    return rows.select("input_order", F.col("id").alias("seq_id"), best.alias("predicted_class"), *[f"p_{c}" for c in CLASSES], F.col("_yes").alias("p_peroxisome"),
                       "perox_signal_type", *(names if features else ()))


def training_rows(table: DataFrame, seq: str = "sequence", mode: str = "auto", code: int | str = 1) -> DataFrame:
    """Rows of a training table with label, perox and the base features.

    A column ``localization`` gives the class (see ``labels.localization_class``), else it is inferred from ``cc_subcellular_location``;
    ``peroxisome`` likewise. Rows whose text names several places are left out, no others: unknown names and empty sequences raise
    in the job. ValueError if neither column is there.
    """
    held = F.trim(F.coalesce(F.col(seq), F.lit("")))
    rows = table.withColumn("_seq", F.when(held != "", held).otherwise(F.raise_error(F.lit("an empty sequence in the training table")).cast("string")))
    if "localization" in table.columns:
        rows = rows.withColumn("label", labels.localization_class(F.col("localization"))).withColumn("perox", labels.yes_no(F.col("peroxisome")) if "peroxisome" in table.columns else F.lit("no"))
    elif "cc_subcellular_location" in table.columns:
        own = labels.from_location_text(F.col("cc_subcellular_location"))
        rows = rows.withColumn("_l", own).where("NOT _l.ambiguous").select(*table.columns, "_seq", F.col("_l.label").alias("label"), F.col("_l.perox").alias("perox"))
    else:
        raise ValueError("a training table has localization or cc_subcellular_location")
    return with_features(rows.withColumn("seq", F.col("_seq")).drop("_seq"), mode, code)


def predefined_folds(rows: DataFrame, column: str = "fold") -> DataFrame:
    """``rows`` with an int ``fold``; ValueError where it isn't a whole number, or there are fewer than two folds."""
    own = rows.withColumn("fold", F.col(column).try_cast("int"))
    facts = own.agg(F.count_if(F.col("fold").isNull()).alias("bad"), F.count_distinct("fold").alias("n")).first()
    if facts.bad or facts.n < 2:
        raise ValueError("folds are whole numbers, two or more")
    return own


def learn(table: DataFrame, n_folds: int = 5, seq: str = "sequence", mode: str = "auto", key: str = "accession", fold: str | None = None, seed: int = 1) -> tuple[Model, DataFrame, DataFrame]:
    """(model, predictions, report): centroids of all rows, and what models without a row's fold say of it.

    predictions: (key, fold, label, predicted, probabilities). report: by class, see ``metrics.class_metrics``. Folds are those of the column
    ``fold``, else stratified ones. Features are written once; fitting and prediction of all folds are one pass each.
    """
    rows = training_rows(table, seq, mode)
    rows = predefined_folds(rows, fold) if fold else labels.stratified_folds(rows, n_folds, "label", key, seed)
    names = feature_names()
    rows = stored(rows.select(key, "label", "perox", "fold", *names), "training")
    model = Model(stored(centroid.fit(rows, names, "label", CLASSES), "classes"), stored(centroid.fit(rows, names, "perox", PEROX), "perox"))
    out = centroid.predict(rows, centroid.fit(rows, names, "label", CLASSES, "fold"), names, "fold").select(key, "fold", "label", "predicted", "probabilities")
    out = stored(out, "left_out")
    return model, out, metrics.class_metrics(out, CLASSES, "label", "predicted")


def save(model: Model, path: str) -> None:
    """A folder with the classes, the peroxisomal centroids, and what is applied to the classes' probabilities, as JSON lines."""
    centroid.save(model.classes, f"{path}/classes")
    centroid.save(model.perox, f"{path}/perox")
    limits = [(c, float(t)) for c, t in (model.thresholds or {}).items()]
    settings = model.classes.sparkSession.createDataFrame([(float(model.temperature), model.thresholds is not None, limits)], "temperature double, has_thresholds boolean, thresholds array<struct<class:string,threshold:double>>")
    settings.coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def load(spark, path: str) -> Model:
    own = spark.read.schema("temperature double, has_thresholds boolean, thresholds array<struct<class:string,threshold:double>>").json(f"{path}/settings").first()
    limits = {r["class"]: r.threshold for r in own.thresholds or []} if own.has_thresholds else None
    return Model(centroid.load(spark, f"{path}/classes"), centroid.load(spark, f"{path}/perox"), own.temperature, limits)

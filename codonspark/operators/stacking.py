"""Stacking over left-out predictions, with cross-fitting: whatever is fitted for a fold has seen none of its rows.

A specialist's threshold for a fold must come from scores of the other folds' rows, and each of these from a model that has seen neither
the row's fold nor that one. All models are sums by fold and class less those of one or two folds, so a single aggregation over the rows
gives them all; a row of fold j is scored by the models without {i, j} for each other fold i (the inner scores of i) and the
one without {j} (its own).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonspark.operators import centroid, joins, labels, specialists, trees
from codonspark.operators.labels import CLASSES
from codonspark.plans.frames import stored

YES_NO = ("no", "yes")


def stack_features(sources: Sequence[Column]) -> dict[str, Column]:
    """What a stack sees of its sources (arrays of class probabilities): all of them, then of each its highest, lTP's share of the plastid classes and
    these classes' mass."""
    out = {f"s{i}_{c}": F.get(p, k) for i, p in enumerate(sources) for k, c in enumerate(CLASSES)}
    for i, p in enumerate(sources):
        mass = F.get(p, specialists.CTP) + F.get(p, specialists.LTP)
        out |= {f"s{i}_top": F.array_max(p), f"s{i}_ltp_share": F.get(p, specialists.LTP) / F.greatest(mass, F.lit(1e-9)), f"s{i}_plastid": mass}
    return out


def stack_oof(wide: DataFrame, n_sources: int, more: Sequence[str] = (), key: str = "row_idx", **options) -> DataFrame:
    """(key, fold, truth, probs) by randomised trees on ``stack_features`` of p0, p1, ... (see ``calibration.joined_sources``) and the columns ``more``."""
    seen = stack_features([F.col(f"p{k}") for k in range(n_sources)])
    rows = wide.select(key, "fold", "truth", *more, *[v.alias(n) for n, v in seen.items()])
    return trees.ensemble_oof(rows, [*seen, *more], CLASSES, "truth", key=key, **options)


def fold_sets(folds: Sequence[str]) -> list[tuple[str, ...]]:
    """The sets of folds that models leave out: each fold, and each pair."""
    return [(f,) for f in folds] + list(combinations(folds, 2))


def cross_fit(rows: DataFrame, features: Sequence[str], positive: Column, keep: Sequence[str], fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(own, inner) scores of a binary centroid specialist.

    own: (keep, fold, score), by the model without the row's fold. inner: (keep, fold, outer, score) once for each other fold ``outer``, by the model
    without both. ``positive``: whether a row is of the specialist's class. At least three folds, else ValueError.
    """
    wanted = [c for c in dict.fromkeys([*keep, *features]) if c != fold]
    own = stored(rows.select(*wanted, F.col(fold).cast("string").alias(fold), F.when(positive, "yes").otherwise("no").alias("_y")), "specialist_rows")
    folds = sorted(r[fold] for r in own.select(fold).distinct().collect() if r[fold] is not None)
    if len(folds) < 3 or not own.where(F.col(fold).isNull()).isEmpty():
        raise ValueError("cross-fitting takes three folds at least, and a fold for each row")
    model = stored(centroid.fit_without(own, features, "_y", YES_NO, fold, fold_sets(folds)), "specialists")
    # names of sets follow the folds' order
    pair = F.transform(F.filter(F.array(*map(F.lit, folds)), lambda f: f != F.col(fold)), lambda f: F.struct(f.alias("outer"), F.concat_ws("/", F.array_sort(F.array(f, F.col(fold)))).alias("without")))
    columns = list(dict.fromkeys([*keep, fold]))
    yes = F.coalesce(F.element_at("probabilities", "yes"), F.lit(0.0)).alias("score")
    single = centroid.predict(own.withColumn("_set", F.col(fold)), model, features, "_set").select(*columns, yes)
    both = own.select("*", F.explode(pair).alias("_p")).select("*", F.col("_p.outer").alias("outer"), F.col("_p.without").alias("_set")).drop("_p")
    return single, centroid.predict(both, model, features, "_set").select(*columns, "outer", yes)


def foldwise_override(rows: DataFrame, features: Sequence[str], positive: str, probs: str = "probs", truth: str = "truth", key: str = "row_idx", fold: str = "fold", thresholds: Sequence[float] | None = None, sources: Sequence[str] | None = None,
                      grid: Sequence[float] = ()) -> DataFrame:
    """(key, fold, truth, predicted, score, threshold): class predictions after a cross-fitted specialist of the class ``positive``.

    Each fold's threshold has the highest macro F1 over the inner scores of its other folds (of ``grid``, or all distinct scores where that is empty; of equals the
    lowest). Without ``sources`` the specialist also demotes its class (see ``specialists.specialist``); with these it only rescues rows that
    are predicted as one of them.
    """
    place, p = CLASSES.index(positive), F.col(probs)
    base = specialists.best_class(p, thresholds)

    def after(score: Column, t: float | Column) -> Column:
        if sources is None:
            return specialists.specialist(base, p, score, t, place, thresholds)
        return specialists.rescue(base, score, t, place, [CLASSES.index(c) for c in sources])

    own, inner = cross_fit(rows, features, F.col(truth) == positive, [key, truth, probs], fold)
    score = F.col("score")
    best = specialists.fit_override(stored(inner, "inner_scores"), after(score, F.lit(float("-inf"))), "score", truth, after(score, F.lit(float("inf"))), grid, bool(grid), "outer")
    joined = own.join(F.broadcast(best.select(F.col("outer").alias("_o"), "threshold")), F.col(fold) == F.col("_o"))  # a row for each fold
    return joined.select(key, fold, truth, F.get(F.array(*map(F.lit, CLASSES)), after(score, F.col("threshold"))).alias("predicted"), "score", "threshold")


def augmented_oof(rows: DataFrame, external: DataFrame, features: Sequence[str], truth: str = "truth", key: str = "row_idx", fold: str = "fold", weight: float = 0.25, most_per_class: int | None = None, seed: int = 1, overlaps: bool = False) -> DataFrame:
    """(key, fold, truth, probs) of ``rows`` by centroids of the other folds and of all external rows, each of which counts ``weight``.

    External rows of unknown classes go; ``overlaps``: so do those that share accession or sequence with ``rows``; ``most_per_class`` of each class stay, by
    a seeded hash of the key. They are never predicted, and never left out.
    """
    if not weight > 0:
        raise ValueError("the weight of external rows is positive")
    more = joins.exclude_overlaps(external, rows) if overlaps else external
    more = more.where(F.col(truth).isin(*CLASSES))
    more = labels.capped_sample(more, most_per_class, truth, key, seed) if most_per_class is not None else more
    columns = [F.col(truth).alias("_y"), *features]
    kind = rows.schema[fold].dataType
    own = stored(rows.select(key, F.col(fold).alias("_fold"), *columns), "augmented_rows")
    both = own.select("_fold", "_y", *features, F.lit(1.0).alias("_w")).unionByName(more.select(F.lit(None).cast(kind).alias("_fold"), *columns, F.lit(float(weight)).alias("_w")))
    model = stored(centroid.fit(both, features, "_y", CLASSES, "_fold", "_w"), "augmented")
    out = centroid.predict(own, model, features, "_fold")
    probs = F.array(*[F.coalesce(F.element_at("probabilities", c), F.lit(0.0)) for c in CLASSES])
    return out.select(key, F.col("_fold").alias(fold), F.col("_y").alias(truth), probs.alias("probs"))

"""Specialists over class probabilities: binary scores that promote and demote, their thresholds, and the search over pairs of these.

Tables are (truth, probs, ...): truth a class name, probs an array in the order of CLASSES. A search over thresholds never repeats rows for
its candidates: rows become counts by score, and running sums of these give every candidate's confusion. Rows of unknown classes don't
count. An empty table has F1 0 everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonspark.operators import metrics
from codonspark.operators.labels import CLASSES
from codonspark.plans.frames import running, stored

SP, MTP, CTP, LTP = (CLASSES.index(c) for c in ("SP", "mTP", "cTP", "lTP"))
#: Fixed: published F1 of the classes, in the order of CLASSES, that margins are taken against.
REFERENCE_F1 = (0.98, 0.98, 0.86, 0.88, 0.75)
#: Fixed grids of the split between cTP and lTP.
GATES, BETAS, SPLITS = (0.0, 0.10, 0.20, 0.30, 0.40, 0.50), (0.0, 0.25, 0.50, 0.75, 1.0), (0.40, 0.50, 0.60, 0.70)


def _place(truth: str) -> Column:
    return (F.array_position(F.array(*map(F.lit, CLASSES)), F.col(truth)) - 1).cast("int")


def best_class(probs: Column, thresholds: Sequence[float] | None = None, without: int | None = None) -> Column:
    """Place of the first class with the highest probability over its threshold (1 where that isn't positive)."""
    limits = [t if t > 0 else 1.0 for t in thresholds or (1.0,) * len(CLASSES)]
    scores = F.array(*[F.lit(float("-inf")) if k == without else F.get(probs, k) / F.lit(float(t)) for k, t in enumerate(limits)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def specialist(predicted: Column, probs: Column, score: Column, threshold: float | Column, positive: int, thresholds: Sequence[float] | None = None) -> Column:
    """Places after a specialist: its class where its score reaches the threshold, and the best other class where that was predicted without."""
    return F.when(score >= threshold, positive).when(predicted == positive, best_class(probs, thresholds, positive)).otherwise(predicted)


def rescue(predicted: Column, score: Column, threshold: float | Column, positive: int, sources: Sequence[int]) -> Column:
    """Places after a rescue: its class where one of ``sources`` was predicted and the score reaches the threshold."""
    return F.when(predicted.isin(*sources) & (score >= threshold), positive).otherwise(predicted)


def _f1(tp: Column, predicted: Column, real: Column) -> Column:
    return F.coalesce(2.0 * tp / F.nullif(predicted + real, F.lit(0)), F.lit(0.0))


def fit_override(rows: DataFrame, after: Column, score: str = "score", truth: str = "truth", before: Column | None = None, grid: Sequence[float] = (), only_grid: bool = False, by: str | None = None) -> DataFrame:
    """One row (threshold, macro_f1): of all distinct scores, and ``grid``, the threshold with the highest macro F1, of equals the lowest.

    ``after``: a row's predicted place where its score reaches the threshold, ``before``: where it doesn't. ``only_grid``: the scores themselves aren't
    tried. ``by``: a row (by, threshold, macro_f1) for each value of that column.
    """
    before = F.lit(0) if before is None else before
    own = rows.select((F.col(by).cast("string") if by else F.lit("")).alias("all"), F.col(score).cast("double").alias("s"), _place(truth).alias("t"), after.cast("int").alias("hi"), before.cast("int").alias("lo")).where("t IS NOT NULL AND s IS NOT NULL")
    classes = range(len(CLASSES))
    moved = [F.count_if(F.col("hi") == k) - F.count_if(F.col("lo") == k) for k in classes]
    won = [F.count_if((F.col("hi") == k) & (F.col("t") == k)) - F.count_if((F.col("lo") == k) & (F.col("t") == k)) for k in classes]
    names = [f"{x}{k}" for x in "mw" for k in classes]
    cells = own.groupBy("all", "s").agg(*[c.alias(n) for c, n in zip(moved + won, names, strict=True)])
    if grid:
        whole = own.select("all").distinct() if by else rows.sparkSession.createDataFrame([("",)], "all string")
        more = whole.select("all", F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("s"), *[F.lit(0).cast("long").alias(n) for n in names])
        cells = cells.union(more).groupBy("all", "s").agg(*[F.sum(n).alias(n) for n in names])
    start = own.groupBy("all").agg(*[F.count_if(F.col("lo") == k).alias(f"m{k}") for k in classes], *[F.count_if((F.col("lo") == k) & (F.col("t") == k)).alias(f"w{k}") for k in classes], *[F.count_if(F.col("t") == k).alias(f"r{k}") for k in classes])
    start = start.select(F.col("all").alias("_all"), *[F.col(f"{x}{k}").alias(f"_{x}{k}") for x in "mwr" for k in classes])
    steps = running(cells, "all", "s", names, True).join(F.broadcast(start), F.col("all") == F.col("_all"), "left")
    with_start = lambda x: F.col(x) + F.coalesce(f"_{x}", F.lit(0))
    f1 = [_f1(with_start(f"w{k}"), with_start(f"m{k}"), F.coalesce(f"_r{k}", F.lit(0))) for k in classes]
    scored = steps.select("all", F.col("s").alias("threshold"), (sum(f1[1:], f1[0]) / float(len(CLASSES))).alias("macro_f1"))
    scored = scored.where(F.col("threshold").isin(*[float(g) for g in grid])) if only_grid else scored
    best = (scored.groupBy(F.col("all").alias(by)) if by else scored.groupBy()).agg(F.max(F.struct("macro_f1", (-F.col("threshold")).alias("low"))).alias("b"))
    return best.select(*([by] if by else []), F.coalesce(-F.col("b.low"), F.lit(0.5)).alias("threshold"), F.coalesce("b.macro_f1", F.lit(0.0)).alias("macro_f1"))


@dataclass(frozen=True)
class Pair:
    """Thresholds of a signal-peptide and an lTP specialist, with what they were chosen by."""

    sp: float
    ltp: float
    rank: tuple[float, ...]
    source: str = "search"


def after_pair(probs: Column, sp: Column, ltp: Column, plant: Column, sp_threshold: float | Column, ltp_threshold: float | Column, thresholds: Sequence[float] | None = None, mass: float = 0.2) -> Column:
    """Places after both: SP where its score says so and no SP elsewhere; of the other plant rows whose cTP and lTP together exceed ``mass``, lTP
    where its score says so, and cTP where either was predicted without."""
    base = best_class(probs, thresholds)
    other = F.when(base == SP, best_class(probs, thresholds, SP)).otherwise(base)
    open_ = F.coalesce(plant, F.lit(False)) & (F.get(probs, CTP) + F.get(probs, LTP) > mass)
    low = F.when(other.isin(CTP, LTP), CTP).otherwise(other)
    return F.when(sp >= sp_threshold, SP).when(open_, F.when(ltp >= ltp_threshold, LTP).otherwise(low)).otherwise(other)


def pair_scores(rows: DataFrame, candidates: Sequence[float], thresholds: Sequence[float] | None = None, mass: float = 0.2, extra_ltp: Sequence[float] = (), truth: str = "truth", probs: str = "probs", sp: str = "sp", ltp: str = "ltp", plant: str = "plant") -> DataFrame:
    """(place, sp_threshold, ltp_threshold, f1 (array by class), accuracy) of each pair: every candidate (place: its order), with every lTP score of plant
    rows under it that are cTP or lTP or whose cTP and lTP exceed ``mass`` (0.5 if there is none), and ``extra_ltp``.

    Rows become cells (candidates reached, lTP score) with counts; a cell goes to the candidates it doesn't reach, and counts run down the
    lTP scores of each. Candidates are few; scores may be as many as rows, and lie in ranges.
    """
    classes, n = range(len(CLASSES)), len(candidates)
    if not n or len(set(candidates)) < n:
        raise ValueError("candidates are different, and there is one at least")
    rising = sorted(candidates)
    p = F.col(probs)
    base = best_class(p, thresholds)
    other = F.when(base == SP, best_class(p, thresholds, SP)).otherwise(base)
    t, green = _place(truth), F.coalesce(F.col(plant), F.lit(False))
    heavy = F.get(p, CTP) + F.get(p, LTP) > mass
    reached = F.size(F.filter(F.array(*[F.lit(float(c)) for c in rising]), lambda c: F.col(sp) >= c))
    own = rows.select(t.alias("t"), reached.alias("reached"), F.when(green & (t.isin(CTP, LTP) | heavy), F.col(ltp).cast("double")).alias("v"), (green & heavy).alias("open"), other.alias("other"))
    own = own.where("t IS NOT NULL").withColumn("low", F.when(F.col("open") & F.col("other").isin(CTP, LTP), CTP).otherwise(F.col("other")))
    cells = stored(own.groupBy("reached", "t", "v", "open", "low").agg(F.count("*").alias("n")), "cells")
    # without any lTP: a few numbers for each candidate
    flat = cells.groupBy("reached").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("t") == SP, F.col("n"))), F.lit(0)).alias("sp"), *[F.coalesce(F.sum(F.when(F.col("low") == k, F.col("n"))), F.lit(0)).alias(f"m{k}") for k in classes],
                                        *[F.coalesce(F.sum(F.when((F.col("low") == k) & (F.col("t") == k), F.col("n"))), F.lit(0)).alias(f"w{k}") for k in classes]).collect()
    real = {r.t: r.n for r in cells.groupBy("t").agg(F.sum("n").alias("n")).collect()}
    total = sum(real.values())
    starts = []
    for k, c in enumerate(rising, 1):
        over, under = [r for r in flat if r.reached >= k], [r for r in flat if r.reached < k]
        m = [sum(r.n for r in over) if x == SP else sum(r[f"m{x}"] for r in under) for x in classes]
        w = [sum(r.sp for r in over) if x == SP else sum(r[f"w{x}"] for r in under) for x in classes]
        starts.append((k, candidates.index(c), float(c), m, w))
    start = rows.sparkSession.createDataFrame(starts, "k int, place int, sp_threshold double, m array<bigint>, w array<bigint>")
    # rows that an lTP threshold moves, by the class that they leave
    lows = [k for k in classes if k not in (SP, LTP)]
    opened = F.when(F.col("open"), F.col("n")).otherwise(0)
    names = [*(f"m{k}" for k in lows), *(f"w{k}" for k in lows), "right"]
    moved = [F.sum(F.when(F.col("low") == k, opened).otherwise(0)) for k in lows] + [F.sum(F.when((F.col("low") == k) & (F.col("t") == k), opened).otherwise(0)) for k in lows] + [F.sum(F.when(F.col("t") == LTP, opened).otherwise(0))]
    by_score = cells.where("v IS NOT NULL").groupBy("reached", "v").agg(*[c.alias(x) for c, x in zip(moved, names, strict=True)])
    under = by_score.where(F.col("reached") < n).select(F.explode(F.sequence(F.col("reached") + 1, F.lit(n))).alias("k"), "v", *names)
    bare = [k for k in range(1, n + 1) if k not in {r.k for r in under.select("k").distinct().collect()}]
    extra = [(k, float(x)) for k in range(1, n + 1) for x in extra_ltp] + [(k, 0.5) for k in bare]
    zeros = rows.sparkSession.createDataFrame(extra, "k int, v double").select("*", *[F.lit(0).cast("long").alias(x) for x in names])
    table = under.union(zeros).groupBy("k", "v").agg(*[F.sum(x).alias(x) for x in names])
    table = running(table, "k", "v", names, True).join(F.broadcast(start), "k")
    m, w = ([F.get(x, k) - (F.col(f"{x}{k}") if k in lows else 0) for k in classes] for x in "mw")
    m[LTP], w[LTP] = F.get("m", LTP) + sum((F.col(f"m{k}") for k in lows[1:]), F.col(f"m{lows[0]}")), F.get("w", LTP) + F.col("right")
    f1 = F.array(*[_f1(w[k], m[k], F.lit(real.get(k, 0))) for k in classes])
    return table.select("place", "sp_threshold", F.col("v").alias("ltp_threshold"), f1.alias("f1"), (sum(w[1:], w[0]) / F.lit(float(max(total, 1)))).alias("accuracy"))


def rank(objective: str) -> list[Column]:
    """What pairs are compared by, from ``f1`` and ``accuracy``: ``margin``, the least lead on REFERENCE_F1 first, or ``macro_f1``."""
    f1 = [F.get("f1", k) for k in range(len(CLASSES))]
    macro = sum(f1[1:], f1[0]) / float(len(CLASSES))
    if objective == "margin":
        return [F.least(*[f - F.lit(r) for f, r in zip(f1, REFERENCE_F1, strict=True)]), macro, f1[SP], f1[LTP], f1[CTP], F.col("accuracy")]
    if objective == "macro_f1":
        return [macro, f1[LTP], f1[SP], f1[MTP], f1[CTP], F.col("accuracy")]
    raise ValueError(f"no such objective: {objective}")


def fit_pair(rows: DataFrame, thresholds: Sequence[float] | None = None, mass: float = 0.2, most: int = 80, objective: str = "margin", extra_sp: Sequence[float] = (), extra_ltp: Sequence[float] = (), fallback: tuple[float, float] | None = None,
             fallback_margin: float | None = None, **columns: str) -> Pair:
    """The pair of the highest rank; of equals the earlier SP threshold in its order (the ``most`` of best binary F1, then ``extra_sp``), then the lower lTP
    threshold. ``fallback`` is taken instead, if it was tried, where the best first rank doesn't exceed ``fallback_margin``."""
    flagged = rows.select((F.col(columns.get("truth", "truth")) == "SP").cast("int").alias("truth"), F.col(columns.get("sp", "sp")).alias("score"))
    best = [r.threshold for r in metrics.f1_thresholds(flagged, most=most).collect()]
    candidates = best + [float(x) for x in dict.fromkeys(extra_sp) if float(x) not in best]
    scored = stored(pair_scores(rows, candidates, thresholds, mass, extra_ltp, **columns), "pairs")
    order = F.struct(*[c.alias(f"r{k}") for k, c in enumerate(rank(objective))], (-F.col("place")).alias("place"), (-F.col("ltp_threshold")).alias("v"))

    def top(table: DataFrame, source: str) -> Pair | None:
        r = table.agg(F.max(F.struct(order.alias("o"), "sp_threshold", "ltp_threshold")).alias("b")).first().b
        return r and Pair(r.sp_threshold, r.ltp_threshold, tuple(r.o)[:-2], source)

    found = top(scored, "search")
    if fallback and fallback_margin is not None and found.rank[0] <= fallback_margin:
        close = lambda c, x: F.abs(F.col(c) - F.lit(float(x))) <= 1e-8 + 1e-5 * abs(x)
        found = top(scored.where(close("sp_threshold", fallback[0]) & close("ltp_threshold", fallback[1])), "fallback") or found
    return found


def _split_shares(mass: Column, own: Sequence[Column], share: Column, beta: float, split: float) -> list[Column]:
    """Parts of ``mass`` that go to cTP and lTP."""
    beta, split = max(0.0, min(1.0, beta)), max(1e-3, min(1 - 1e-3, split))
    mixed = [F.lit(1.0 - beta) * o + F.lit(beta) * F.get(share, k) for k, o in enumerate(own)]
    total = mixed[0] + mixed[1]
    total = F.when(total > 0, total).otherwise(1.0)
    scores = [mixed[0] / total / F.lit(max(1e-6, 1.0 - split)), mixed[1] / total / F.lit(max(1e-6, split))]
    both = scores[0] + scores[1]
    return [mass * (v / F.when(both > 0, both).otherwise(1.0)) for v in scores]


def _plastid(probs: Column) -> tuple[Column, list[Column]]:
    """Mass of cTP and lTP, and their shares of it (halves where there is none)."""
    mass = F.get(probs, CTP) + F.get(probs, LTP)
    return mass, [F.when(mass > 0, F.get(probs, k) / mass).otherwise(0.5) for k in (CTP, LTP)]


def split_plastid(probs: Column, share: Column, gate: float, beta: float, split: float) -> Column:
    """Class probabilities with the mass of cTP and lTP split anew where it reaches ``gate``: their own shares blended with ``share`` (array of cTP and
    lTP) by ``beta``, then weighted against ``split``, the share from which on lTP wins."""
    mass, own = _plastid(probs)
    parts = _split_shares(mass, own, share, beta, split)
    on = (mass > 0) & (mass >= max(0.0, min(1.0, gate)))
    return F.array(*[F.when(on, parts[(CTP, LTP).index(k)]).otherwise(F.get(probs, k)) if k in (CTP, LTP) else F.get(probs, k) for k in range(len(CLASSES))])


def split_scores(rows: DataFrame, truth: str = "truth", probs: str = "probs", share: str = "share", gates: Sequence[float] = GATES, betas: Sequence[float] = BETAS, splits: Sequence[float] = SPLITS) -> DataFrame:
    """(place, gate, beta, split, macro_f1, ltp_precision, ltp_recall, ltp_f1, accuracy) of every setting, in the order of the grid.

    A row's answers to all settings are one string of digits: those of the splits, or of none, for each gate. Rows are counted by truth and answers, which few of are different, before
    the answers are taken apart: one aggregation serves the whole grid.
    """
    grid, classes = list(product(gates, betas, splits)), range(len(CLASSES))
    mass, own = _plastid(F.col(probs))
    rest = F.array(*[F.get(probs, k) for k in classes if k not in (CTP, LTP)])  # CTP and LTP are the last places
    # each name is used by many settings, and so is computed before them
    named = rows.select(_place(truth).alias("t"), F.col(share).alias("share"), mass.alias("mass"), own[0].alias("own0"), own[1].alias("own1"), F.array_max(rest).alias("top"), (F.array_position(rest, F.array_max(rest)) - 1).alias("place"), best_class(F.col(probs)).cast("string").alias("base"))

    def answer(beta: float, split: float) -> Column:
        c, other = _split_shares(F.col("mass"), [F.col("own0"), F.col("own1")], F.col("share"), beta, split)
        return F.when(F.col("top") >= F.greatest(c, other), F.col("place").cast("string")).when(c >= other, str(CTP)).otherwise(str(LTP))

    inside = named.where("t IS NOT NULL").withColumn("split", F.concat(*[answer(b, x) for b, x in product(betas, splits)]))
    shut = F.repeat("base", F.lit(len(betas) * len(splits)))
    answers = F.concat(*[F.when((F.col("mass") > 0) & (F.col("mass") >= max(0.0, min(1.0, g))), F.col("split")).otherwise(shut) for g in gates])
    counts = inside.groupBy("t", answers.alias("answers")).agg(F.count("*").alias("n"))
    single = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(grid) - 1)), lambda k: F.struct(k.alias("place"), F.substr(F.col("answers"), k + 1, F.lit(1)).cast("int").alias("p"))))
    flat = counts.select("t", "n", single.alias("a")).select("t", "n", "a.place", "a.p")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    sums = flat.groupBy("place").agg(F.sum("n").alias("n"), *[count((F.col("p") == k) & (F.col("t") == k)).alias(f"tp{k}") for k in classes], *[count(F.col("p") == k).alias(f"m{k}") for k in classes], *[count(F.col("t") == k).alias(f"r{k}") for k in classes])
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    precision, recall = [ratio(f"tp{k}", f"m{k}") for k in classes], [ratio(f"tp{k}", f"r{k}") for k in classes]
    f1 = [F.coalesce(2.0 * a * b / F.nullif(a + b, F.lit(0.0)), F.lit(0.0)) for a, b in zip(precision, recall, strict=True)]
    settings = rows.sparkSession.createDataFrame([(k, *g) for k, g in enumerate(grid)], "place int, gate double, beta double, split double")
    right = sum((F.col(f"tp{k}") for k in classes[1:]), F.col("tp0"))
    return settings.join(sums, "place").select("place", "gate", "beta", "split", (sum(f1[1:], f1[0]) / float(len(CLASSES))).alias("macro_f1"), precision[LTP].alias("ltp_precision"), recall[LTP].alias("ltp_recall"), f1[LTP].alias("ltp_f1"), (right / F.col("n")).alias("accuracy"))


def fit_split(rows: DataFrame, least_precision: float = 0.0, **options) -> tuple[float, float, float]:
    """(gate, beta, split) of the highest (macro F1, lTP F1, accuracy) among settings whose lTP precision is ``least_precision`` at least, the first of
    equals; (0, 1, 0.5) where no setting has it. ValueError without rows."""
    scored = split_scores(rows, **options).collect()
    if not scored:
        raise ValueError("no rows")
    good = [r for r in scored if r.ltp_precision + 1e-12 >= max(0.0, min(1.0, least_precision))]
    best = max(good, key=lambda r: (r.macro_f1, r.ltp_f1, r.accuracy, -r.place), default=None)
    return (best.gate, best.beta, best.split) if best else (0.0, 1.0, 0.5)

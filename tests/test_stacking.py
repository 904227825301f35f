"""Stacking and cross-fitted specialists against models that are fitted anew for each set of folds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from codonspark.operators import calibration, specialists, stacking
from codonspark.operators.labels import CLASSES


def data(seed=3, n=120, folds=4):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        t = rnd.randrange(5)
        p = [round(rnd.random() + (c == t) * 0.5, 3) for c in range(5)]
        out.append((k, f"f{rnd.randrange(folds)}", CLASSES[t], p, round(rnd.gauss(t == 1, 0.8), 3), round(rnd.random(), 3), 2.0))
    return out


SCHEMA = "row_idx long, fold string, truth string, probs array<double>, a double, b double, c double"


def centroid_score(train, x):
    """P(yes) of x by the centroids of (features, yes) rows."""
    n, width = len(train), len(x)
    mean = [sum(r[0][k] for r in train) / n for k in range(width)]
    std = [math.sqrt(sum((r[0][k] - mean[k]) ** 2 for r in train) / n) for k in range(width)]
    std = [s if s >= 1e-9 else 1.0 for s in std]
    logits = []
    for want in (False, True):
        own = [r[0] for r in train if r[1] == want]
        centre = [(sum(r[k] for r in own) / len(own) - mean[k]) / std[k] for k in range(width)]
        logits.append(-0.5 * sum(((x[k] - mean[k]) / std[k] - centre[k]) ** 2 for k in range(width)) + math.log((len(own) + 1) / (n + 2)))
    return 1 / (1 + math.exp(logits[0] - logits[1]))


def test_each_pair_is_refitted(spark):
    rows = data()
    own, inner = stacking.cross_fit(spark.createDataFrame(rows, SCHEMA).repartition(3), ["a", "b", "c"], F.col("truth") == "SP", ["row_idx"])
    without = lambda *folds: [(r[4:], r[2] == "SP") for r in rows if r[1] not in folds]
    for r in own.collect():
        assert r.fold == rows[r.row_idx][1] and r.score == pytest.approx(centroid_score(without(r.fold), rows[r.row_idx][4:]))
    found = inner.collect()
    assert len(found) == 3 * len(rows) and all(r.outer != r.fold for r in found)
    for r in found:
        assert r.score == pytest.approx(centroid_score(without(r.fold, r.outer), rows[r.row_idx][4:]))


def f1s(pairs):
    out = []
    for c in CLASSES:
        tp, both = sum(t == p == c for t, p in pairs), sum(t == c for t, _ in pairs) + sum(p == c for _, p in pairs)
        out.append(2 * tp / both if both else 0.0)
    return sum(out) / 5


@pytest.mark.parametrize("sources,grid", [(None, ()), (("noTP", "cTP"), (0.2, 0.5, 0.8))])
def test_overrides_by_fold(spark, sources, grid):
    rows = data(7)
    got = {r.row_idx: r for r in stacking.foldwise_override(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "SP", sources=sources, grid=grid).collect()}
    assert got.keys() == {r[0] for r in rows}
    without = lambda *folds: [(r[4:6], r[2] == "SP") for r in rows if r[1] not in folds]

    def after(p, score, t):
        base = max(range(5), key=lambda k: (p[k], -k))
        if sources:
            return "SP" if CLASSES[base] in sources and score >= t else CLASSES[base]
        return "SP" if score >= t else CLASSES[max((k for k in range(5) if k != 1), key=lambda k: (p[k], -k))] if base == 1 else CLASSES[base]

    for outer in sorted({r[1] for r in rows}):
        inner = [(r, centroid_score(without(r[1], outer), r[4:6])) for r in rows if r[1] != outer]
        macro = {t: f1s([(r[2], after(r[3], s, t)) for r, s in inner]) for t in (grid or {s for _, s in inner})}
        best = min(t for t, f in macro.items() if f == pytest.approx(max(macro.values()), abs=1e-12))
        for r in (r for r in rows if r[1] == outer):
            score = centroid_score(without(outer), r[4:6])
            assert got[r[0]].threshold == pytest.approx(best) and got[r[0]].score == pytest.approx(score) and got[r[0]].predicted == after(r[3], score, best)


def test_stacks_and_bad_folds(spark):
    rows = data(2)
    oof = [(s, k, f, t, p if s == "x" else p[::-1]) for k, f, t, p, *_ in rows for s in "xy"]
    wide = calibration.joined_sources(spark.createDataFrame(oof, "source string, row_idx long, fold string, truth string, probs array<double>"), ["x", "y"])
    seen = wide.select("row_idx", *[v.alias(n) for n, v in stacking.stack_features([F.col("p0"), F.col("p1")]).items()]).where("row_idx = 5").first()
    p = rows[5][3]
    assert list(seen)[1:] == pytest.approx([*p, *p[::-1], max(p), p[4] / (p[3] + p[4]), p[3] + p[4], max(p), p[0] / (p[0] + p[1]), p[0] + p[1]])
    out = stacking.stack_oof(wide, 2, n_trees=5, most_depth=4).collect()
    assert len(out) == len(rows) and all(sum(r.probs) == pytest.approx(1) for r in out)
    assert sum(CLASSES[max(range(5), key=lambda k: r.probs[k])] == r.truth for r in out) > len(rows) / 3
    for bad in (spark.createDataFrame(rows, SCHEMA).where("fold IN ('f0', 'f1')"), spark.createDataFrame(rows, SCHEMA).withColumn("fold", F.when(F.col("row_idx") > 3, F.col("fold")))):
        with pytest.raises(ValueError):
            stacking.cross_fit(bad, ["a"], F.col("truth") == "SP", ["row_idx"])
    assert stacking.fold_sets("abc") == [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c")]
    assert specialists.CLASSES is CLASSES


def test_external_rows_are_never_left_out(spark):
    rows = data(4, 90, 3)
    frame = spark.createDataFrame(rows, SCHEMA)
    own, other = frame.where("row_idx < 60"), frame.where("row_idx >= 60").unionByName(frame.limit(1).withColumn("truth", F.lit("unknown")))
    got = {r.row_idx: r for r in stacking.augmented_oof(own, other, ["a", "b"], weight=0.5).collect()}
    assert got.keys() == set(range(60))
    for k, fold, truth, *_ in rows[:60]:
        train = [(r, 1.0) for r in rows[:60] if r[1] != fold] + [(r, 0.5) for r in rows[60:]]
        total = sum(w for _, w in train)
        mean = [sum(w * r[4 + i] for r, w in train) / total for i in (0, 1)]
        std = [math.sqrt(sum(w * (r[4 + i] - mean[i]) ** 2 for r, w in train) / total) for i in (0, 1)]
        logits = []
        for c in CLASSES:
            part = [(r, w) for r, w in train if r[2] == c]
            n = sum(w for _, w in part)
            centre = [sum(w * r[4 + i] for r, w in part) / n for i in (0, 1)]
            logits.append(-0.5 * sum(((rows[k][4 + i] - centre[i]) / std[i]) ** 2 for i in (0, 1)) + math.log((n + 1) / (total + 5)))
        top = [math.exp(v - max(logits)) for v in logits]
        assert got[k].truth == truth and got[k].fold == fold and list(got[k].probs) == pytest.approx([v / sum(top) for v in top])
    few = stacking.augmented_oof(own, other, ["a", "b"], most_per_class=0).collect()
    alone = stacking.augmented_oof(own, other.limit(0), ["a", "b"]).collect()
    assert sorted((r.row_idx, tuple(r.probs)) for r in few) == sorted((r.row_idx, tuple(r.probs)) for r in alone)
    with pytest.raises(ValueError):
        stacking.augmented_oof(own, other, ["a"], weight=0)

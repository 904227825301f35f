"""Specialists and the searches over their thresholds against plain loops over all candidates."""

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from codonspark.operators import specialists as S
from codonspark.operators.labels import CLASSES
from codonspark.plans.frames import running

LIMITS = (1.0, 0.9, 1.2, 1.0, 0.7)


def data(seed, n=90):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        t = rnd.randrange(5)
        p = [round(rnd.random() + (k == t) * 0.4, 2) for k in range(5)]
        out.append((CLASSES[t], p, round(rnd.random() * 0.6 + (t == 1) * 0.3, 1), round(rnd.random() * 0.6 + (t == 4) * 0.4, 1), rnd.random() < 0.7, [round(rnd.random(), 2), round(rnd.random(), 2)]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "truth string, probs array<double>, sp double, ltp double, plant boolean, share array<double>").repartition(3)


def best(p, limits=(1,) * 5, without=None):
    s = [-math.inf if k == without else x / t for k, (x, t) in enumerate(zip(p, limits, strict=True))]
    return s.index(max(s))


def pair(row, x, y, mass=0.2):
    _, p, sp, ltp, plant, _ = row
    base = best(p, LIMITS)
    other = best(p, LIMITS, 1) if base == 1 else base
    if sp >= x:
        return 1
    if plant and p[3] + p[4] > mass:
        return 4 if ltp >= y else 3 if other in (3, 4) else other
    return other


def f1s(truth, predicted):
    out = []
    for k in range(5):
        tp, both = sum(t == p == k for t, p in zip(truth, predicted, strict=True)), sum(t == k for t in truth) + sum(p == k for p in predicted)
        out.append(2 * tp / both if both else 0.0)
    return out


@pytest.mark.parametrize("seed,objective", [(1, "margin"), (2, "macro_f1")])
def test_pairs_equal_a_loop_over_all(spark, seed, objective):
    rows = data(seed)
    truth = [CLASSES.index(r[0]) for r in rows]
    candidates = [0.5, 0.2, 0.9, 1.5, -1.0]
    got = {(r.sp_threshold, r.ltp_threshold): r for r in S.pair_scores(frame(spark, rows), candidates, LIMITS, extra_ltp=(0.33,)).collect()}
    want = {}
    for place, x in enumerate(candidates):
        values = {r[3] for r in rows if r[4] and r[2] < x and (r[0] in ("cTP", "lTP") or r[1][3] + r[1][4] > 0.2)} or {0.5}
        for y in sorted(values | {0.33}):
            own = [pair(r, x, y) for r in rows]
            want[x, y] = (place, f1s(truth, own), sum(a == b for a, b in zip(truth, own, strict=True)) / len(rows))
    assert got.keys() == want.keys()
    for k, (place, f1, accuracy) in want.items():
        assert got[k].place == place and list(got[k].f1) == pytest.approx(f1) and got[k].accuracy == pytest.approx(accuracy)
    macro = lambda f: sum(f) / 5
    def key(k):
        place, f, accuracy = want[k]
        head = [min(a - b for a, b in zip(f, S.REFERENCE_F1, strict=True)), macro(f), f[1], f[4], f[3]] if objective == "margin" else [macro(f), f[4], f[1], f[2], f[3]]
        return [round(v, 10) for v in [*head, accuracy]] + [-place, -k[1]]
    found = S.fit_pair(frame(spark, rows), LIMITS, most=3, objective=objective, extra_sp=candidates, extra_ltp=(0.33,))
    scores = sorted({r[2] for r in rows})
    binary = lambda s: (lambda tp, fp, fn: (2 * tp / (2 * tp + fp + fn) if tp else 0.0, -fp, tp, -s))(sum(t == 1 and r[2] >= s for t, r in zip(truth, rows, strict=True)), sum(t != 1 and r[2] >= s for t, r in zip(truth, rows, strict=True)), sum(t == 1 and r[2] < s for t, r in zip(truth, rows, strict=True)))
    order = sorted(scores, key=binary, reverse=True)[:3]
    order += [c for c in candidates if c not in order]
    want = {}
    for place, x in enumerate(order):
        values = {r[3] for r in rows if r[4] and r[2] < x and (r[0] in ("cTP", "lTP") or r[1][3] + r[1][4] > 0.2)} or {0.5}
        for y in values | {0.33}:
            own = [pair(r, x, y) for r in rows]
            want[x, y] = (place, f1s(truth, own), sum(a == b for a, b in zip(truth, own, strict=True)) / len(rows))
    top = max(want, key=key)
    assert (found.sp, found.ltp) == top and found.source == "search" and list(found.rank) == pytest.approx(key(top)[:-2])
    again = S.fit_pair(frame(spark, rows), LIMITS, most=3, objective=objective, extra_sp=candidates, extra_ltp=(0.33,), fallback=(0.9, 0.33), fallback_margin=9.0)
    assert (again.sp, again.ltp, again.source) == (0.9, 0.33, "fallback")
    applied = frame(spark, rows).select("truth", S.after_pair(F.col("probs"), F.col("sp"), F.col("ltp"), F.col("plant"), *top, LIMITS).alias("p")).collect()
    assert sum(CLASSES.index(r.truth) == r.p for r in applied) == round(want[top][2] * len(rows))


def test_overrides_equal_a_loop(spark):
    rows = data(5)
    truth = [CLASSES.index(r[0]) for r in rows]
    df, p = frame(spark, rows), F.col("probs")
    base = S.best_class(p, LIMITS)
    after = lambda t: S.specialist(base, p, F.col("sp"), t, S.SP, LIMITS)
    got = S.fit_override(df, after(-math.inf), "sp", before=after(math.inf), grid=(0.45,)).first()
    loop = {}
    for t in {r[2] for r in rows} | {0.45}:
        loop[t] = sum(f1s(truth, [1 if r[2] >= t else best(r[1], LIMITS, 1) if best(r[1], LIMITS) == 1 else best(r[1], LIMITS) for r in rows])) / 5
    top = max(loop.values())
    assert got.macro_f1 == pytest.approx(top) and got.threshold == min(t for t, f in loop.items() if f == pytest.approx(top))
    mend = lambda t: S.rescue(base, F.col("ltp"), t, S.LTP, (S.CTP, 0))
    got = S.fit_override(df, mend(-math.inf), "ltp", before=mend(math.inf)).first()
    loop = {t: sum(f1s(truth, [4 if best(r[1], LIMITS) in (0, 3) and r[3] >= t else best(r[1], LIMITS) for r in rows])) / 5 for t in {r[3] for r in rows}}
    assert got.macro_f1 == pytest.approx(max(loop.values())) and loop[got.threshold] == pytest.approx(got.macro_f1)
    assert tuple(S.fit_override(df.limit(0), F.lit(1), "sp").first()) == (0.5, 0.0)


def split(row, gate, beta, at):
    p, share = row[1], row[5]
    mass = p[3] + p[4]
    if not (mass > 0 and mass >= gate):
        return p
    own = [p[3] / mass, p[4] / mass]
    mixed = [(1 - beta) * o + beta * s for o, s in zip(own, share, strict=True)]
    mixed = [m / (sum(mixed) or 1) for m in mixed]
    scores = [mixed[0] / (1 - at), mixed[1] / at]
    return [*p[:3], *(mass * s / (sum(scores) or 1) for s in scores)]


@pytest.mark.parametrize("least", [0.0, 0.55, 1.1])
def test_splits_equal_a_loop(spark, least):
    rows = [(t, [round(v * 0.3, 3) for v in p], *r) for t, p, *r in data(8)] + [("SP", [0.0] * 5, 0.1, 0.1, True, [0.0, 0.0])]
    truth = [CLASSES.index(r[0]) for r in rows]
    grid = list(product(S.GATES, S.BETAS, S.SPLITS))
    got = {r.place: r for r in S.split_scores(frame(spark, rows)).collect()} if not least else {}
    keys = {}
    for k, setting in enumerate(grid):
        own = [best(split(r, *setting)) for r in rows]
        f1, hit = f1s(truth, own), sum(a == b for a, b in zip(truth, own, strict=True)) / len(rows)
        right, all_ = sum(t == p == 4 for t, p in zip(truth, own, strict=True)), own.count(4)
        if got:
            assert (got[k].gate, got[k].beta, got[k].split) == setting and got[k].macro_f1 == pytest.approx(sum(f1) / 5) and got[k].accuracy == pytest.approx(hit) and got[k].ltp_precision == pytest.approx(right / all_ if all_ else 0.0)
        if (right / all_ if all_ else 0.0) >= min(1.0, least):
            keys[k] = (round(sum(f1) / 5, 10), round(f1[4], 10), hit, -k)
    want = grid[max(keys, key=keys.get)] if keys else (0.0, 1.0, 0.5)
    assert S.fit_split(frame(spark, rows), least) == want
    applied = frame(spark, rows).select("probs", "share", S.split_plastid(F.col("probs"), F.col("share"), *want).alias("q")).collect()
    assert all(list(r.q) == pytest.approx(split((0, list(r.probs), 0, 0, 0, list(r.share)), *want)) for r in applied)


def test_bad_input(spark):
    df = frame(spark, data(1, 5))
    for bad in ([], [0.5, 0.5]):
        with pytest.raises(ValueError):
            S.pair_scores(df, bad)
    with pytest.raises(ValueError):
        S.rank("other")
    with pytest.raises(ValueError):
        S.fit_split(df.limit(0))


def test_running_sums(spark):
    rnd = random.Random(3)
    rows = [(k, float(v), rnd.randrange(9)) for k in range(3) for v in rnd.sample(range(500), 80)]
    df = spark.createDataFrame(rows, "k int, v double, n long").repartition(5)
    for down in (False, True):
        got = {(r.k, r.v): r.n for r in running(df, "k", "v", ["n"], down).collect()}
        assert got == {(k, v): sum(n for a, b, n in rows if a == k and (b >= v if down else b <= v)) for k, v, _ in rows}

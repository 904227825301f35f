"""Randomised trees against a recursive twin, and left-out predictions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonspark.operators import trees
from codonspark.operators.labels import CLASSES


def table(spark, rows):
    return spark.createDataFrame([(k, f, y, x) for k, (f, y, x) in enumerate(rows)], "row_idx long, fold string, y int, x array<double>")


def data(seed, n=160, width=6):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        y = rnd.randrange(3)
        x = [rnd.gauss(y if j < 2 else 0, 0.6) for j in range(width - 2)] + [float(rnd.randrange(3)), 1.0]
        out.append((f"f{k % 3}", y, x))
    return out


def grow(rows, seed, weights, n_classes, most_features, depth, least_leaf, node=1):
    """{node: split or leaf} by recursion over lists of rows."""
    counts = [sum(y == c for _, y, _ in rows) for c in range(n_classes)]
    impurity = lambda part: (lambda w: sum(w) - sum(v * v for v in w) / sum(w) if sum(w) else 0.0)([sum(y == c for _, y, _ in part) * weights[c] for c in range(n_classes)])
    features, numbers = trees.draw(seed, node, len(rows[0][2]), most_features)
    best = None
    if depth and sum(n > 0 for n in counts) > 1:
        for f, u in zip(features, numbers, strict=True):
            low, high = min(r[2][f] for r in rows), max(r[2][f] for r in rows)
            cut = low + u * (high - low)
            one, two = [r for r in rows if r[2][f] <= cut], [r for r in rows if r[2][f] > cut]
            if high > low and min(len(one), len(two)) >= least_leaf:
                rest = impurity(one) + impurity(two)
                if best is None or rest < best[0] - 1e-12:
                    best = (rest, int(f), cut, one, two)
    if best is None:
        own = [n * w for n, w in zip(counts, weights, strict=True)]
        return {node: [v / sum(own) for v in own]}
    _, f, cut, one, two = best
    return {node: (f, cut)} | grow(one, seed, weights, n_classes, most_features, depth - 1, least_leaf, 2 * node) | grow(two, seed, weights, n_classes, most_features, depth - 1, least_leaf, 2 * node + 1)


@pytest.mark.parametrize("least_leaf,depth", [(1, 6), (5, 3)])
def test_forest_equals_twin_split_by_split(spark, least_leaf, depth):
    rows = data(3)
    for parts in (1, 5):
        forest = trees.fit(table(spark, rows).repartition(parts), 3, n_trees=2, most_features=3, most_depth=depth, least_leaf=least_leaf, by_fold=True, seed=7)
        assert [t.fold for t in forest] == ["f0", "f0", "f1", "f1", "f2", "f2"]
        for k, tree in enumerate(forest):
            train = [r for r in rows if r[0] != tree.fold]
            n = [sum(y == c for _, y, _ in train) for c in range(3)]
            weights = [len(train) / (3 * v) for v in n]
            want = grow(train, (7, k // 2, k % 2), weights, 3, 3, depth, least_leaf)
            assert {x for x in want if isinstance(want[x], tuple)} == set(tree.splits) and {x for x in want if isinstance(want[x], list)} == set(tree.leaves)
            assert all(tree.splits[x][0] == want[x][0] and tree.splits[x][1] == pytest.approx(want[x][1]) for x in tree.splits)
            assert all(tree.leaves[x] == pytest.approx(want[x]) for x in tree.leaves)


def test_left_out_predictions(spark):
    rows = data(5, 240)
    df = table(spark, rows)
    forest = trees.fit(df, 3, n_trees=8, by_fold=True)
    got = {r.row_idx: r for r in trees.predict(df.repartition(4), forest).collect()}
    for k, (fold, _, x) in enumerate(rows):
        own = []
        for tree in (t for t in forest if t.fold == fold):
            node = 1
            while node in tree.splits:
                f, cut = tree.splits[node]
                node = 2 * node + (x[f] > cut)
            own.append(tree.leaves[node])
        assert got[k].fold == fold and list(got[k].probs) == pytest.approx(np.mean(own, 0).tolist())
    assert sum(int(np.argmax(got[k].probs)) == y for k, (_, y, _) in enumerate(rows)) > 170


def test_ensemble_tables(spark):
    rows = data(6, 120)
    df = table(spark, rows).select("row_idx", "fold", F.get(F.array(*map(F.lit, CLASSES)), F.col("y")).alias("label"), *[F.get("x", k).alias(f"x{k}") for k in range(6)])
    for binary in (False, True):
        out = trees.ensemble_oof(df, [f"x{k}" for k in range(6)], CLASSES, binary=binary, n_trees=5, most_depth=5).collect()
        assert len(out) == 120 and all(sum(r.probs) == pytest.approx(1) and len(r.probs) == 5 and r.probs[3] == r.probs[4] == 0 for r in out)
        assert sum(CLASSES[int(np.argmax(r.probs))] == r.truth for r in out) > 80


def test_forests_of_little_data(spark):
    df = table(spark, data(1, 5))
    assert all(t.leaves == {1: (1 / 3,) * 3} for t in trees.fit(df.limit(0), 3, n_trees=2))
    alone = trees.fit(table(spark, [("a", 1, [1.0]), ("a", 0, [2.0])]), 2, n_trees=1, by_fold=True)
    assert alone[0].leaves == {1: (0.5, 0.5)}
    same = trees.fit(table(spark, [("a", 1, [1.0]), ("b", 0, [1.0]), ("b", 1, [1.0])]), 2, n_trees=1, balanced=False)
    assert same[0].leaves[1] == pytest.approx((1 / 3, 2 / 3)) and not same[0].splits
    with pytest.raises(ValueError):
        trees.fit(table(spark, [("a", 4, [1.0])]), 2)
    with pytest.raises(ValueError):
        trees.fit(df, 3, most_depth=99)

"""Extremely randomised trees: forests of many left-out folds grown level by level, all at once.

Rows stay where they are. A level takes two aggregations for all trees of all folds: the ranges of the features that each open node has
drawn, then the classes on either side of a cut drawn from each range. A task routes its rows through the trees grown so far and adds
counts up in arrays before it emits them; sums and ranges are exact, so a forest doesn't depend on how rows are dealt out. The driver
chooses each node's split from these sums; what it holds is bounded by the number of trees and MOST_DEPTH.

Draws follow the seed, the model and the node alone: a node's features, then one uniform number for each. Nodes are numbered as in
a heap: the root is 1, children of n are 2 n and 2 n + 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonspark.plans.frames import stored

MOST_DEPTH = 20


@dataclass
class Tree:
    """Splits and leaves of one tree by node number. ``fold``: the fold whose rows it must not see, None for none."""

    fold: str | None
    seed: tuple[int, ...]
    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    leaves: dict[int, tuple[float, ...]] = field(default_factory=dict)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number, feature, cut, low child, high child) of nodes in order; leaves and open nodes have feature -1, children are places."""
        nodes = {1, *self.leaves, *self.splits, *(c for n in self.splits for c in (2 * n, 2 * n + 1))}
        order = sorted(nodes)
        at = {n: k for k, n in enumerate(order)}
        child = lambda n, side: at[2 * n + side] if n in self.splits else at[n]
        split = [self.splits.get(n, (-1, 0.0)) for n in order]
        return (np.array(order), np.array([f for f, _ in split]), np.array([c for _, c in split]), np.array([child(n, 0) for n in order]), np.array([child(n, 1) for n in order]))


def draw(seed: tuple[int, ...], node: int, n_features: int, most_features: int) -> tuple[np.ndarray, np.ndarray]:
    """The features that a node tries, and a uniform number for each."""
    rng = np.random.default_rng([*seed, node])
    return rng.permutation(n_features)[:most_features], rng.random(most_features)


def _places(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """Places of the nodes that rows of ``x`` end in."""
    number, feature, cut, low, high = tree
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        f = feature[at]
        moving = f >= 0
        if not moving.any():
            return at
        on = rows[moving]
        goes = x[on, f[moving]] > cut[at[moving]]
        at[on] = np.where(goes, high[at[moving]], low[at[moving]])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _routed(forest: Sequence[Tree], open_: Sequence[Sequence[int]]):
    """A function of a batch (fold, y, x) that gives for each tree its training rows in open nodes: (tree, slots, rows, y, x)."""
    arrays = [t.arrays() for t in forest]
    slots, first = [], 0
    for (number, *_), nodes in zip(arrays, open_, strict=True):
        own = np.full(len(number), -1)
        own[np.searchsorted(number, np.array(nodes, np.int64))] = np.arange(first, first + len(nodes))
        slots.append(own)
        first += len(nodes)

    def of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        folds, y, x = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2))
        for k, tree in enumerate(forest):
            if open_[k]:
                mine = np.flatnonzero(folds != tree.fold) if tree.fold is not None else np.arange(len(x))
                slot = slots[k][_places(x[mine], arrays[k])]
                inside = slot >= 0
                yield k, slot[inside], y[mine[inside]], x[mine[inside]]

    return of, first


def _ranges(rows: DataFrame, forest: Sequence[Tree], open_: Sequence[Sequence[int]], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each open node's features; chosen: (slot, try) -> feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n = _routed(forest, open_)
        low, high = np.full(chosen.shape, np.inf), np.full(chosen.shape, -np.inf)
        for batch in batches:
            for _, slot, _, x in of(batch):
                for k in range(chosen.shape[1]):
                    value = x[np.arange(len(slot)), chosen[slot, k]]
                    np.minimum.at(low[:, k], slot, value)
                    np.maximum.at(high[:, k], slot, value)
        held = np.flatnonzero((low <= high).any(1))
        for at in range(0, len(held), 10_000):
            part = held[at:at + 10_000]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * chosen.shape[1]), pa.array(v[part].reshape(-1))) for v in (low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *lists], ["slot", "low", "high"])

    tries = range(chosen.shape[1])
    found = rows.mapInArrow(run, "slot long, low array<double>, high array<double>")
    found = found.groupBy("slot").agg(*[F.min(F.get("low", k)).alias(f"l{k}") for k in tries], *[F.max(F.get("high", k)).alias(f"h{k}") for k in tries]).toArrow()
    low, high = np.full(chosen.shape, np.inf), np.full(chosen.shape, -np.inf)
    at = found.column("slot").to_numpy()
    for k in tries:
        low[at, k], high[at, k] = found.column(f"l{k}").to_numpy(), found.column(f"h{k}").to_numpy()
    return low, high


def _sides(rows: DataFrame, forest: Sequence[Tree], open_: Sequence[Sequence[int]], chosen: np.ndarray, cuts: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(classes of each slot, classes at or below each cut) as counts."""
    width = chosen.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n = _routed(forest, open_)
        counts = np.zeros((n, width, n_classes), np.int64)
        for batch in batches:
            for _, slot, y, x in of(batch):
                np.add.at(counts, (slot, 0, y), 1)
                for k in range(width - 1):
                    below = x[np.arange(len(slot)), chosen[slot, k]] <= cuts[slot, k]
                    np.add.at(counts, (slot[below], k + 1, y[below]), 1)
        held = np.flatnonzero(counts[:, 0].any(1))
        for at in range(0, len(held), 10_000):
            part = held[at:at + 10_000]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width * n_classes), pa.array(counts[part].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(part), flat], ["slot", "n"])

    cells = width * n_classes
    found = rows.mapInArrow(run, "slot long, n array<long>").groupBy("slot").agg(*[F.sum(F.get("n", k)).alias(f"n{k}") for k in range(cells)]).toArrow()
    out = np.zeros((len(chosen), cells), np.int64)
    out[found.column("slot").to_numpy()] = np.stack([found.column(f"n{k}").to_numpy() for k in range(cells)], 1) if found.num_rows else np.zeros((0, cells), np.int64)
    out = out.reshape(len(chosen), width, n_classes)
    return out[:, 0], out[:, 1:]


def gini(counts: np.ndarray, weights: np.ndarray) -> float:
    """Weighted size times impurity of class counts."""
    own = counts * weights
    total = own.sum()
    return float(total - (own * own).sum() / total) if total else 0.0


def choose(counts: np.ndarray, below: np.ndarray, low: np.ndarray, high: np.ndarray, weights: np.ndarray, least_leaf: int) -> int | None:
    """The try whose sides are purest together, the first of equals; None if no try leaves ``least_leaf`` rows on both sides."""
    best = None
    for k in range(len(below)):
        if high[k] > low[k] and min(below[k].sum(), counts.sum() - below[k].sum()) >= least_leaf:
            rest = gini(below[k], weights) + gini(counts - below[k], weights)
            if best is None or rest < best[0]:
                best = (rest, k)
    return None if best is None else best[1]


def fit(rows: DataFrame, n_classes: int, n_trees: int = 50, most_features: int | None = None, most_depth: int = 12, least_leaf: int = 1, balanced: bool = True, by_fold: bool = False, seed: int = 1) -> list[Tree]:
    """Trees from a stored table (fold, y, x): y a class from 0, x array<double> of one length. With ``by_fold`` a forest for each fold, of the
    rows of all others, else one of all rows.

    A node becomes a leaf when it is pure, at ``most_depth``, or where none of its ``most_features`` (the root of their number) features can
    be cut; its value is the share of each class, weighted against the classes' numbers if ``balanced``. Null labels and features are
    not allowed. Without rows, or without those of other folds, a forest's trees are leaves of equal shares.
    """
    if not 0 < most_depth <= MOST_DEPTH:
        raise ValueError(f"depth is from 1 to {MOST_DEPTH}")
    rows = rows.select(F.col("fold").cast("string").alias("fold"), F.col("y").cast("int").alias("y"), "x")
    sizes = {(r.fold, r.y): r.n for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [Tree(None, (seed, 0, t), leaves={1: (1 / n_classes,) * n_classes}) for t in range(n_trees)]
    if any(y is None or not 0 <= y < n_classes for _, y in sizes):
        raise ValueError(f"labels are from 0 to {n_classes - 1}")
    if by_fold and any(f is None for f, _ in sizes):
        raise ValueError("rows without a fold")
    n_features = rows.select(F.size("x").alias("n")).first().n
    most_features = min(most_features or ceil(sqrt(n_features)), n_features)
    folds = sorted({f for f, _ in sizes}) if by_fold else [None]
    weights = {}
    for f in folds:
        own = np.array([sum(n for (g, y), n in sizes.items() if g != f and y == c) if f is not None else sum(n for (_, y), n in sizes.items() if y == c) for c in range(n_classes)], float)
        weights[f] = np.divide(own.sum(), own * np.count_nonzero(own), out=np.zeros(n_classes), where=own > 0) if balanced else np.ones(n_classes)
    forest = [Tree(f, (seed, k, t)) for k, f in enumerate(folds) for t in range(n_trees)]
    open_: list[list[int]] = [[1] for _ in forest]
    for depth in range(most_depth + 1):
        if not any(open_):
            break
        draws = [draw(t.seed, node, n_features, most_features) for t, nodes in zip(forest, open_, strict=True) for node in nodes]
        chosen = np.stack([f for f, _ in draws])
        low, high = _ranges(rows, forest, open_, chosen)
        with np.errstate(invalid="ignore"):
            cuts = low + np.stack([u for _, u in draws]) * (high - low)
        counts, below = _sides(rows, forest, open_, chosen, cuts, n_classes)
        slot, later = 0, []
        for tree, nodes in zip(forest, open_, strict=True):
            grown = []
            for node in nodes:
                n, w = counts[slot], weights[tree.fold]
                best = choose(n, below[slot], low[slot], high[slot], w, least_leaf) if depth < most_depth and np.count_nonzero(n) > 1 else None
                if best is None:
                    own = n * w
                    tree.leaves[node] = tuple(own / own.sum()) if own.sum() else (1 / n_classes,) * n_classes
                else:
                    tree.splits[node] = (int(chosen[slot, best]), float(cuts[slot, best]))
                    grown += [2 * node, 2 * node + 1]
                slot += 1
            later.append(grown)
        open_ = later
    return forest


def predict(rows: DataFrame, forest: Sequence[Tree], keep: Sequence[str] = ("row_idx",)) -> DataFrame:
    """(keep, fold, probs) of rows (keep, fold, x): the mean of the leaves' shares over the trees that left the row's fold out, or over all
    trees of a forest without folds."""
    own = rows.select(*keep, F.col("fold").cast("string").alias("fold"), "x")
    arrays = [t.arrays() for t in forest]
    values = [np.array([t.leaves[n] if n in t.leaves else (0.0,) * len(next(iter(t.leaves.values()))) for n in a[0].tolist()]) for t, a in zip(forest, arrays, strict=True)]
    left_out = [t.fold for t in forest]
    names = [*keep, "fold", "probs"]
    schema = ", ".join([*(f"{c} {own.schema[c].dataType.simpleString()}" for c in keep), "fold string, probs array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, x = np.array(batch.column(len(keep)).to_pylist(), object), _matrix(batch.column(len(keep) + 1))
            total, n = np.zeros((len(x), values[0].shape[1])), np.zeros(len(x))
            for fold, tree, value in zip(left_out, arrays, values, strict=True):
                mine = np.flatnonzero(folds == fold) if fold is not None else np.arange(len(x))
                total[mine] += value[_places(x[mine], tree)]
                n[mine] += 1
            share = total / np.maximum(n, 1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * share.shape[1]), pa.array(share.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep) + 1)), lists], names)

    return own.mapInArrow(run, schema)


def one_against_rest(rows: DataFrame, n_classes: int, **options) -> list[list[Tree]]:
    """A binary forest for each class: (fold, y, x) with y 1 for the class."""
    seed = options.pop("seed", 1)
    return [fit(rows.withColumn("y", (F.col("y") == c).cast("int")), 2, seed=seed + c, **options) for c in range(n_classes)]


def ensemble_oof(rows: DataFrame, features: Sequence[str] | str, classes: Sequence[str], label: str = "label", fold: str = "fold", key: str = "row_idx", binary: bool = False, **options) -> DataFrame:
    """(key, fold, truth, probs) of every row by forests that left its fold out, probs in the order of ``classes``; ``binary``: a forest for
    each class, their yes-shares scaled to the sum 1. ``features``: columns, or the name of one array column such as ``windows.ensemble_vector``'s."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    x = F.col(features) if isinstance(features, str) else F.array(*[F.col(f).cast("double") for f in features])
    table = stored(rows.select(F.col(key), F.col(fold).cast("string").alias("fold"), F.col(label).alias("truth"), place.cast("int").alias("y"), x.alias("x")), "tree_rows")
    if not binary:
        return predict(table, fit(table, len(classes), by_fold=True, **options), (key, "truth")).select(key, "fold", "truth", "probs")
    out = None
    for k, forest in enumerate(one_against_rest(table, len(classes), by_fold=True, **options)):
        part = predict(table, forest, (key, "truth")).select(key, "fold", "truth", F.get("probs", 1).alias(f"p{k}"))
        out = part if out is None else out.join(part.select(F.col(key), f"p{k}"), key)
    yes = F.array(*[F.col(f"p{k}") for k in range(len(classes))])
    total = F.aggregate(yes, F.lit(0.0), lambda s, v: s + v)
    return out.select(key, "fold", "truth", F.transform(yes, lambda v: v / F.when(total > 0, total).otherwise(1.0)).alias("probs"))

"""Quality classifier: random Fourier features of document statistics, ridge scores from summed normal equations, isotonic calibration.

1. Each text becomes STATISTICS, whole numbers in steps of 2^-16, by one pass over the documents; they are kept as a table.
2. Labelled rows outside the held-out part join their statistics. Sums and sums of squares give mean and spread of each statistic.
3. The features sqrt(2 / D) cos(w x + b), with w normal and b uniform, seeded, have products whose mean is the Gaussian kernel
   exp(-|x - y|^2 / 2 WIDTH^2) of standardised statistics. Each partition sums its normal equations, one sum for each of FOLDS; tasks
   add these up in levels. Features are rounded to steps of 2^-15, so that all sums are of whole numbers: they are exact, and the
   fit doesn't depend on how rows are dealt out.
4. The ridge solution of all folds but one scores that one. Rows are counted by label and score, in steps of 2^-12; pooling
   adjacent violators over these counts, which are bounded by the steps, gives the calibration. The solution of all folds scores documents.

All labelled rows are used; the driver gets sums of a fixed size only. A document's label is the mean of its label rows (null labels
don't count); repeated documents count as often as they stand there. Null and empty texts have statistics of 0 and are scored as
any other; null ids are never labelled, nor held out. Without labels every score is 0.5. Other columns aren't read, and an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_beside, releasing, small_batches, text_or_empty

STEP, FEATURE_STEP, LABEL_STEP, SCORE_STEP = 1 << 16, 1 << 15, 1 << 10, 1 << 12
FEATURES, WIDTH, RIDGE, SEED, FOLDS = 256, 3.0, 1e-4, 20240229, 4
#: Standardised statistics are bounded, so that no outlier is far from all else.
MOST_SPREADS = 5.0
#: Labelled rows of a partition that sums its own, and the levels in which such sums are added up.
ROWS_A_SUM, LEVELS = 50_000, (64, 8, 1)
#: Texts of a batch whose features are held at once.
SLICE = 512
PREDICT_AT = 0.7

UPPER, DIGITS, MARKS, STOPS, SYMBOLS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?", b".,;:", b"#*$%&|<>@~^=+_\\/"
STATISTICS = ("words", "letters a word", "upper case", "digits", "marks", "stops", "symbols", "lone signs", "equal neighbours", "different words", "long words", "words a line", "equal lines")


def statistics(text: bytes) -> list[int]:
    """STATISTICS of a UTF-8 text, rates as square roots, in steps of 1 / STEP."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * len(STATISTICS)
    size = sum(map(len, words))
    held = lambda letters: len(text) - len(text.translate(None, letters))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    rates = (
        held(UPPER) / size, held(DIGITS) / size, held(MARKS) / n, held(STOPS) / n, held(SYMBOLS) / n,
        sum(len(w) == 1 and not w.isalnum() for w in words) / n, sum(map(eq, words, words[1:])) / n, len(set(words)) / n,
        sum(len(w) > 20 for w in words) / n,
    )
    values = (log1p(n) / 4, log1p(size / n), *(min(r, 4.0) ** 0.5 for r in rates), log1p(n / len(lines)) / 2, (1 - len(set(lines)) / len(lines)) ** 0.5)
    return [round(v * STEP) for v in values]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, x) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.array([statistics(t.as_py()) for t in batch.column(2)], np.int32).reshape(-1)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "held_out", "x"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(releasing(run), "doc_id long, held_out boolean, x array<int>")


@dataclass
class Model:
    """What a fit leaves; its size depends on STATISTICS, FEATURES and the steps of a score only."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    calibrated: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([_design(x[k:k + SLICE], self.mean, self.spread) @ self.weights for k in range(0, len(x), SLICE)] or [np.zeros(0)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores: between the centres of two blocks by a straight line. Nine digits, as the last ones of a product
        depend on the rows beside it."""
        return np.round(np.clip(np.interp(self.raw(x), self.at, self.calibrated), 0, 1), 9)


def _directions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((len(STATISTICS), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)


def _design(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """1 and the features of each row, as whole multiples of 1 / FEATURE_STEP."""
    w, b = _directions()
    z = np.clip((x - mean) / spread, -MOST_SPREADS, MOST_SPREADS)
    out = np.empty((len(x), FEATURES + 1))
    out[:, 0] = FEATURE_STEP
    np.rint(np.cos(z @ w + b) * FEATURE_STEP, out=out[:, 1:])
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _added(rows: DataFrame) -> DataFrame:
    """(fold, sums) once for each fold and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(sums.as_py(), np.int64)
                total[fold] = total[fold] + own if fold in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["fold", "sums"])

    return rows.mapInArrow(run, "fold int, sums binary")


def normal_equations(train: DataFrame, mean: np.ndarray, spread: np.ndarray) -> dict[int, np.ndarray]:
    """fold -> exact sums of (1, features, label) times (1, features)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            folds, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            z = _design(_matrix(batch.column(1)), mean, spread)
            for fold in np.unique(folds).tolist():
                own, label = z[folds == fold], y[folds == fold].astype(np.float64)
                # whole numbers under 2^53, so floating sums are exact
                sums = np.concatenate([own.T @ own, (label @ own)[None]]).astype(np.int64).reshape(-1)
                total[fold] = total[fold] + sums if fold in total else sums
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["fold", "sums"])

    sums = train.select("fold", "x", "y").mapInArrow(releasing(run), "fold int, sums binary")
    for n in LEVELS:
        sums = _added(sums.repartition(n))
    return {r.fold: np.frombuffer(r.sums, np.int64).reshape(FEATURES + 2, FEATURES + 1) for r in sums.collect()}


def ridge(sums: np.ndarray) -> np.ndarray:
    """Weights of the features' whole multiples; the constant isn't shrunk."""
    a, b = sums[:-1] / FEATURE_STEP**2, sums[-1] / (FEATURE_STEP * LABEL_STEP)
    scale = np.r_[1.0, np.full(FEATURES, (2 / FEATURES) ** 0.5)]
    a, b = a * scale * scale[:, None], b * scale
    shrink = np.diag(np.r_[0.0, np.full(FEATURES, RIDGE * a[0, 0])])
    return np.linalg.lstsq(a + shrink, b, rcond=None)[0] * scale / FEATURE_STEP


def pool(at: list[float], label: list[float], weight: list[float]) -> tuple[list[float], list[float]]:
    """Pooling adjacent violators: centres and means of the blocks of a rising step function; ``at`` rises."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at, label, weight, strict=True):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return [x / w for x, _, w in blocks], [y / w for _, y, w in blocks]


def fit(stats: DataFrame, labels: DataFrame, work: Workspace) -> Model:
    """``stats``: with_statistics(); ``labels``: (doc_id, label) with labels from 0 to 1."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = work.keep(known.agg(F.floor(F.avg("label") * LABEL_STEP + 0.5).cast("int").alias("y")), "known")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    train = work.keep(join_beside(stats.where("NOT held_out"), known, "doc_id").select(fold, "x", "y"), "train")
    size = len(STATISTICS)
    each = [F.get("x", k).cast("decimal(20,0)") for k in range(size)]
    facts = train.agg(F.count("*"), *[F.sum(c) for c in each], *[F.sum(c * c) for c in each]).first()
    n = facts[0]
    if not n:
        return Model(np.zeros(size), np.ones(size), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    total, squares = ([int(v) for v in facts[1 + k * size:1 + (k + 1) * size]] for k in (0, 1))
    mean = np.array([t / n for t in total])
    spread = np.sqrt(np.array([(n * q - t * t) / (n * n) for t, q in zip(total, squares, strict=True)]).clip(0))
    spread = np.maximum(spread, STEP / 1000)  # a statistic that hardly varies says little
    if n > ROWS_A_SUM:
        train = train.repartition(-(-n // ROWS_A_SUM))
    sums = normal_equations(train, mean, spread)
    whole = sum(sums.values())
    # a fold that holds all labels is scored by its own fit
    rest = {f: ridge(whole - s if (whole - s)[0, 0] > 0 else whole) for f, s in sums.items()}
    models = {f: Model(mean, spread, w, np.zeros(1), np.zeros(1)) for f, w in rest.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            step = np.zeros(len(x), np.int64)
            for f in np.unique(folds).tolist():
                step[folds == f] = np.rint(np.clip(models[f].raw(x[folds == f]), -1, 2) * SCORE_STEP)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column(2)], ["step", "y"])

    counts = train.select("fold", "x", "y").mapInArrow(releasing(run), "step long, y int").groupBy("step").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    counts.sort()
    at, calibrated = pool([r.step / SCORE_STEP for r in counts], [r.y / r.n / LABEL_STEP for r in counts], [r.n for r in counts])
    return Model(mean, spread, ridge(whole), np.array(at), np.array(calibrated))


def score(stats: DataFrame, model: Model, predict_at: float = PREDICT_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(2))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= predict_at).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", "held_out", "x").mapInArrow(releasing(run), "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents; ``labels``: (doc_id, label), learned from where held_out is false."""
    work = work or Workspace(docs.sparkSession, "classifier")
    small_batches(docs.sparkSession)
    stats = work.keep(with_statistics(docs), "stats")
    return score(stats, fit(stats, labels, work))

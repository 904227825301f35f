"""Features of peptide windows: each residue's counts up to every place once, all windows as differences of two of them.

A task takes the first HEAD and last TAIL letters and the length of a batch's sequences as matrices; counts, longest runs and the scan for a
signal peptide's cut are then a few array operations for all rows together. Sequences must be canonical (see ``proteins.canonical``);
null reads as empty. Windows end where the sequence does, and are 0 throughout where it doesn't reach them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonspark.functions import proteins as P
from codonspark.operators import labels

HEAD, TAIL, PLACES = 140, 40, 100
#: Fixed: residues of the groups, and the windows (start, end; both negative or open at the end from the sequence's end) that each block counts.
GROUPS = {"basic": P.BASIC, "acidic": P.ACIDIC, "hydrophobic": P.HYDROPHOBIC, "small": P.SMALL, "ser_thr": P.SER_THR, "aromatic": P.AROMATIC}
TRANSIT_GROUPS = GROUPS | {"arg": "R", "lys": "K", "ala": "A", "ser": "S", "thr": "T", "pro": "P", "gly": "G", "liv": "LIV"}
TRANSIT_WINDOWS = ((0, 20), (0, 40), (0, 60), (0, 80), (0, 100), (0, 120), (20, 80), (40, 120))
WINDOW_GROUPS = GROUPS | {"ala": "A", "gly": "G", "pro": "P", "arg": "R", "lys": "K", "liv": "LIV", "de": "DE", "stnq": "STNQ"}
WINDOWS = (*((0, k) for k in (10, 15, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 100, 120)), (5, 35), (10, 50), (20, 80), (40, 120), (-20, 0), (-40, 0))
SCAN_GROUPS = {"hydrophobic": P.HYDROPHOBIC, "basic": P.BASIC, "acidic": P.ACIDIC, "ser_thr": P.SER_THR, "small": P.SMALL}
PLACE_GROUPS = {"hydrophobic": P.HYDROPHOBIC, "basic": P.BASIC, "acidic": P.ACIDIC, "small": P.SMALL, "ser_thr": P.SER_THR, "pro": "P", "arg": "R", "lys": "K", "ala": "A", "gly": "G"}
CUT_PARTS = ("hydrophobic", "hydrophobic_run", "small_3", "small_1", "ala_1", "proline", "small", "charge", "ser_thr")
SLICE = 2000

_PLACE = np.full(256, len(P.AA), np.uint8)
for _k, _a in enumerate(P.AA):
    _PLACE[ord(_a)] = _k
_HYDROPATHY = np.array([P.HYDROPATHY[a] for a in P.AA])


def _of(letters: str) -> np.ndarray:
    """1 for the residues among ``letters``, in the order of AA; the last place is for all other letters."""
    return np.array([a in letters for a in P.AA] + [False], np.int16)


def _window_names(prefix: str, windows: Sequence[tuple[int, int]], groups: Sequence[str], length: bool, residues: bool) -> list[str]:
    name = lambda a, b: f"{prefix}{a}_{b}" if a >= 0 else f"{prefix}last{-a}"
    parts = [*(["length"] if length else []), "hydropathy", "run", *groups, *(P.AA if residues else "")]
    return [f"{name(a, b)}_{x}" for a, b in windows for x in parts]


def names() -> dict[str, list[str]]:
    """The features of each block, in their order."""
    return {
        "scan": ["score", "cut", "cut_share", *(f"cut_{n}" for n in CUT_PARTS), *_window_names("w", P.SCAN_WINDOWS, list(SCAN_GROUPS), False, False)],
        "transit": _window_names("t", TRANSIT_WINDOWS, list(TRANSIT_GROUPS), False, False),
        "windows": _window_names("f", WINDOWS, list(WINDOW_GROUPS), True, True),
        "places": [f"at{k}_{g}" for k in range(PLACES) for g in PLACE_GROUPS],
    }


class Batch:
    """The letters of some sequences as matrices: ``code`` (rows x width places in AA, 20 for others and beyond the end) and ``size``."""

    def __init__(self, texts: Sequence[bytes], width: int):
        raw = np.zeros((len(texts), width), np.uint8)
        for k, t in enumerate(texts):
            raw[k, :len(t)] = np.frombuffer(t, np.uint8)
        self.code, self.size = _PLACE[raw], np.array([len(t) for t in texts])
        upto = np.cumsum(self.code[:, :, None] == np.arange(len(P.AA)), 1, dtype=np.int16)
        #: counts[row, place, residue] before each place
        self.counts = np.concatenate([np.zeros((len(texts), 1, len(P.AA)), np.int16), upto], 1)
        self.water = _of(P.HYDROPHOBIC)[self.code].astype(bool)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Counts of residues from ``start`` up to ``end``, one of each for each row."""
        row = np.arange(len(self.size))
        return self.counts[row, np.maximum(start, end)] - self.counts[row, start]

    def longest_runs(self, windows: Sequence[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
        """The longest hydrophobic run within each window; windows of one start are read together."""
        out = {}
        for start in {a for a, _ in windows}:
            ends = {b for a, b in windows if a == start}
            now, most = np.zeros(len(self.size), np.int16), np.zeros(len(self.size), np.int16)
            for k in range(start, max(ends)):
                now = (now + 1) * self.water[:, k]
                most = np.maximum(most, now)
                if k + 1 in ends:
                    out[start, k + 1] = most.copy()
        return out

    def windows(self, windows: Sequence[tuple[int, int]], groups: dict[str, str], length: bool = False, residues: bool = False) -> list[np.ndarray]:
        runs, member = self.longest_runs(windows), np.stack([_of(g)[:-1] for g in groups.values()], 1)
        out = []
        for a, b in windows:
            start, end = np.minimum(a, self.size), np.minimum(b, self.size)
            held, n = self.between(start, end), end - start
            share = np.divide(1.0, n, out=np.zeros(len(n)), where=n > 0)[:, None]
            parts = [n[:, None]] if length else []
            parts += [(held @ _HYDROPATHY)[:, None] * share, runs[a, b][:, None], (held @ member) * share]
            out += [*parts, held * share] if residues else parts
        return out


def _scan(batch: Batch, length: np.ndarray) -> list[np.ndarray]:
    """score, cut, relative cut and the nine parts of each row's first best cut."""
    n, weights = len(length), P.CUT_WEIGHTS
    count = {k: np.concatenate([np.zeros((n, 1), np.int16), np.cumsum(_of(g)[batch.code], 1, dtype=np.int16)], 1) for k, g in (("hydrophobic", P.HYDROPHOBIC), ("basic", P.BASIC), ("acidic", P.ACIDIC), ("ser_thr", P.SER_THR), ("small", P.SMALL))}
    letter = lambda g, k: _of(g)[batch.code[:, k]].astype(float)
    best, at, parts = np.full(n, -99.0), np.zeros(n), np.zeros((n, len(CUT_PARTS)))
    spans = [(max(0, cut - 18), cut - 7) for cut in range(P.FIRST_CUT, P.LAST_CUT + 1)]
    runs = batch.longest_runs(spans)
    for cut in range(P.FIRST_CUT, P.LAST_CUT + 1):
        span, head = spans[cut - P.FIRST_CUT], max(1, cut - 18)
        part = lambda k, a, b: (count[k][:, b] - count[k][:, a]) / (b - a)
        own = {"hydrophobic": part("hydrophobic", *span), "hydrophobic_run": runs[span].astype(float), "small_3": letter(P.FITS_3, cut - 3), "small_1": letter(P.FITS_1, cut - 1), "ala_1": letter("A", cut - 1),
               "small": part("small", cut - 7, cut + 2), "charge": part("basic", 0, head) - part("acidic", 0, head), "proline": np.maximum.reduce([letter("P", k) for k in range(cut - 3, cut + 1)]), "ser_thr": part("ser_thr", 0, cut)}
        score = np.zeros(n)
        for name, weight in weights.items():
            score = score + own[name] * weight
        better = np.flatnonzero((score > best) & (length - 2 >= cut))
        best[better], at[better] = score[better], cut
        parts[better] = np.stack([own[k][better] for k in CUT_PARTS], 1)
    return [best[:, None], at[:, None], (at / np.maximum(length, 1))[:, None], parts]


def blocks_of(heads: Sequence[bytes], tails: Sequence[bytes], length: np.ndarray) -> dict[str, np.ndarray]:
    """A matrix for each block of ``names``."""
    head = Batch(heads, HEAD)
    last = {k: Batch([t[-k:] for t in tails], k) for k in (-a for a, _ in WINDOWS if a < 0)}
    out = {"scan": [*_scan(head, length), *head.windows(P.SCAN_WINDOWS, SCAN_GROUPS)], "transit": head.windows(TRANSIT_WINDOWS, TRANSIT_GROUPS)}
    out["windows"] = [x for a, b in WINDOWS for x in (head.windows([(a, b)], WINDOW_GROUPS, True, True) if a >= 0 else last[-a].windows([(0, -a)], WINDOW_GROUPS, True, True))]
    member = np.stack([_of(g) for g in PLACE_GROUPS.values()], 1)
    out["places"] = [member[head.code[:, :PLACES]].reshape(len(length), -1)]
    return {k: np.concatenate(v, 1, dtype=np.float64) for k, v in out.items()}


def with_windows(rows: DataFrame, keep: Sequence[str], seq: str = "seq", blocks: Sequence[str] = ("scan", "transit", "windows", "places")) -> DataFrame:
    """(keep, and an array<double> for each of ``blocks``, see ``names``). Rows aren't shuffled."""
    text = F.coalesce(F.col(seq), F.lit(""))
    own = rows.select(*keep, F.left(text, F.lit(HEAD)).cast("binary").alias("_head"), F.right(text, F.lit(TAIL)).cast("binary").alias("_tail"), F.length(text).alias("_n"))
    columns = [*keep, *blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                heads, tails = (part.column(len(keep) + k).to_pylist() for k in (0, 1))
                found = blocks_of(heads, tails, part.column(len(keep) + 2).to_numpy(zero_copy_only=False).astype(np.int64))
                arrays = [pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * found[b].shape[1]), pa.array(found[b].reshape(-1))) for b in blocks]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *arrays], columns)

    return own.mapInArrow(run, ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep), *(f"{b} array<double>" for b in blocks)]))


def ensemble_vector(rows: DataFrame, key: str = "input_order", seq: str = "seq", group: Column | None = None) -> DataFrame:
    """(key, vector): what a feature ensemble sees of a protein: the broad features, the scan, the broad features again with the transit windows and
    motifs, whether it is a plant's, all windows, and the first hundred places. ``group``: the organism's group."""
    own = rows.withColumn("_group", F.coalesce(labels.organism_group(F.lit("") if group is None else group), F.lit("")))
    broad = P.vector(P.broad_features(F.col(seq), F.col("_group")))
    own = own.select(key, seq, broad.alias("_broad"), P.vector(P.motif_places(F.col(seq))).alias("_motifs"), F.when(F.col("_group") == "plant", 1.0).otherwise(0.0).alias("_plant"))
    found = with_windows(own, [key, "_broad", "_motifs", "_plant"], seq)
    return found.select(key, F.concat("_broad", "scan", "_broad", "transit", "_motifs", F.array("_plant"), "windows", "places").alias("vector"))

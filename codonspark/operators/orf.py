"""Longest open reading frames of both strands and all frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codonspark.functions import codes
from codonspark.functions import sequences as S

CATEGORIES = ("no_start", "partial", "complete")


def _marks(letters: np.ndarray, codons: tuple[str, ...]) -> np.ndarray:
    """Whether one of ``codons`` starts at each place of an array of bytes."""
    out = np.zeros(max(len(letters) - 2, 0), bool)
    for a, b, c in (x.encode() for x in codons):
        out |= (letters[:-2] == a) & (letters[1:-1] == b) & (letters[2:] == c)
    return out


def _best_of_strand(strand: bytes, sign: int, stops: tuple[str, ...], starts: tuple[str, ...]) -> tuple | None:
    """(rank, length, sign, -frame, -start, begin, end) of a strand's best candidate, by that order.

    Stops cut a frame into stretches. In a stretch the first start codon gives the longest ORF; without one, the stretch itself is a
    candidate of rank 0.
    """
    letters, best = np.frombuffer(strand, np.uint8), None
    n, stop_at, start_at = len(letters), _marks(letters, stops), _marks(letters, starts)
    for frame in range(min(3, n)):
        end = frame + (n - frame) // 3 * 3
        closing = frame + 3 * np.flatnonzero(stop_at[frame::3])
        opening, begins, ends = frame + 3 * np.flatnonzero(start_at[frame::3]), np.r_[frame, closing + 3], np.r_[closing, end]
        first = np.r_[opening, end][np.searchsorted(opening, begins)]
        found, closed = first < ends, np.arange(len(ends)) < len(closing)
        begins, ends = np.where(found, first, begins), np.where(found & closed, ends + 3, ends)
        rank = np.where(found, np.where(closed, 2, 1), 0)
        size = ends - begins
        if not (size >= 3).any():
            continue
        start = begins + 1 if sign else n - ends + 1
        k = np.lexsort((-start, size, np.where(size >= 3, rank, -1)))[-1]
        own = (int(rank[k]), int(size[k]), sign, -(frame + 1), -int(start[k]), int(begins[k]), int(ends[k]))
        best = own if best is None else max(best, own)
    return best


def longest_orf(seqs: DataFrame, table: int | str = 1) -> DataFrame:
    """``seqs`` with seq being the longest ORF in upper case, and strand, frame, orf_start, orf_end, category; empty and nulls if none.

    Complete ORFs (start to stop, both included) come before partial ones (start to the frame's end); stretches without a
    stop count only if neither strand has a start codon that begins an ORF. Then come length, the plus strand, the lower
    frame and the lower start. Places of stops and starts are found by comparing whole arrays of letters, a sequence at a time in
    Arrow batches; the work is linear in the letters, and rows don't multiply. A null sequence counts as empty.
    """
    stops, starts = codes.stops(table), codes.starts(table)
    others = [f for f in seqs.schema.fields if f.name != "seq"]
    rows = seqs.select(*[F.col(f"`{f.name}`") for f in others], F.coalesce(F.upper("seq"), F.lit("")).alias("seq")).withColumn("__minus", S.reverse_complement(F.col("seq")))
    added = [T.StructField("seq", T.StringType()), T.StructField("strand", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("orf_start", T.IntegerType()),
             T.StructField("orf_end", T.IntegerType()), T.StructField("category", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for plus, minus in zip(batch.column(len(others)), batch.column(len(others) + 1), strict=True):
                strands = {1: plus.as_py(), 0: minus.as_py()}
                # a letter that isn't ASCII takes one byte here, so that places stay those of letters
                found = [b for sign, s in strands.items() if (b := _best_of_strand(s.encode("ascii", "replace"), sign, stops, starts))]
                if not found:
                    out.append(("", None, None, None, None, None))
                    continue
                rank, _, sign, frame, start, begin, end = max(found)
                out.append((strands[sign][begin:end], "+" if sign else "-", -frame, -start, end if sign else len(strands[sign]) - begin, CATEGORIES[rank]))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(others)], *[pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]], [*[f.name for f in others], *[f.name for f in added]])

    return rows.mapInArrow(run, T.StructType([*others, *added]))


def annotate_name(orfs: DataFrame) -> DataFrame:
    """``orfs`` with id followed by what was found: strand, frame, start, end, lengths and category."""
    n = F.length("seq")
    text = F.concat_ws(" ", "id", F.concat(F.lit("strand="), "strand"), F.concat(F.lit("frame="), F.col("frame").cast("string")), F.concat(F.lit("start="), F.col("orf_start").cast("string")), F.concat(F.lit("end="), F.col("orf_end").cast("string")),
                       F.concat(F.lit("nt_len="), n.cast("string")), F.concat(F.lit("aa_len="), F.floor(n / 3).cast("string")), F.concat(F.lit("category="), "category"))
    return orfs.withColumn("id", F.when(F.col("category").isNotNull(), text).otherwise(F.col("id")))

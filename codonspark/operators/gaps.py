"""Runs of N as gaps of one length, and annotations that follow the edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonspark.functions import sequences as S

EDITS = "array<struct<start:int,delta:int>>"


def justify_gaps(seqs: DataFrame, gap_len: int = 100, gap_just_min: int | None = None, gap_just_max: int | None = None) -> DataFrame:
    """``seqs`` with N-runs between the two bounds made ``gap_len`` long, and ``edits``: start (from 0) and change of each.

    n counts as N and becomes N everywhere.
    """
    for value in (gap_len, gap_just_min, gap_just_max):
        if value is not None and value < 0:
            raise ValueError("gap lengths must not be negative")
    low, high = gap_just_min, gap_just_max
    seq = F.replace(F.col("seq"), F.lit("n"), F.lit("N"))
    inside = lambda n: (F.lit(True) if low is None else n >= low) & (F.lit(True) if high is None else n <= high)
    change = lambda n: inside(n) & (n != gap_len)
    rows = seqs.withColumn("seq", seq).withColumn("_runs", S.runs(seq, "N")).withColumn("_rest", F.split(seq, "N+", -1))
    filled = F.transform("_runs", lambda r: F.repeat(F.lit("N"), F.when(change(r["len"]), F.lit(gap_len)).otherwise(r["len"])))
    new = F.concat(F.get("_rest", F.lit(0)), F.array_join(F.zip_with(filled, F.slice("_rest", 2, F.greatest(F.size("_rest") - 1, F.lit(0))), lambda n, rest: F.concat(n, rest)), ""))
    edits = F.transform(F.filter("_runs", lambda r: change(r["len"])), lambda r: F.struct(r["start"].alias("start"), (F.lit(gap_len) - r["len"]).alias("delta")))
    return rows.withColumn("edits", edits).withColumn("seq", new).drop("_runs", "_rest")


def shift(coordinate: Column, edits: Column) -> Column:
    """A coordinate (from 1) after ordered edits. Each edit tests the coordinate as shifted so far, strictly."""
    zero = F.struct(coordinate.cast("int").alias("pos"), F.lit(0).alias("offset"))
    step = lambda s, e: F.struct(F.when(s["pos"] > e["start"] + 1 + s["offset"], s["pos"] + e["delta"]).otherwise(s["pos"]).alias("pos"), (s["offset"] + e["delta"]).alias("offset"))
    return F.aggregate(edits, zero, step, lambda s: s["pos"])


def shift_annotations(gff: DataFrame, justified: DataFrame) -> DataFrame:
    """``gff`` with start and end moved by the edits of their sequences; annotations of other sequences stay."""
    edits = justified.select(F.col("id").alias("seqid"), "edits")
    rows = gff.join(edits, "seqid", "left").withColumn("edits", F.coalesce(F.array_sort("edits"), F.array().cast(EDITS)))
    return rows.withColumns({"start": shift(F.col("start"), F.col("edits")), "end": shift(F.col("end"), F.col("edits"))}).select(*gff.columns)

"""Checks that a job must pass. Each gives its violations as a frame; ``enforce`` raises with the first of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonspark.functions import sequences as S

DNA = "ACGTRYMKWSBDHVNX-?."
PROTEIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ*-?."
SHOWN = 10


class InvalidInput(ValueError):
    """Input that a check refuses."""


def same_count(a: DataFrame, b: DataFrame) -> None:
    """ValueError if the frames have different numbers of records."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"numbers of records differ: {n} and {m}")


def not_triplets(seqs: DataFrame, ignore_gaps: bool = False) -> DataFrame:
    """(id, length) of sequences whose length, without gaps if asked for, isn't a multiple of three."""
    seq = F.translate("seq", S.GAPS, "") if ignore_gaps else F.col("seq")
    return seqs.select("id", F.length(seq).cast("long").alias("length")).where("length % 3 <> 0")


def unequal_lengths(seqs: DataFrame) -> DataFrame:
    """(length, n) if there is more than one length, else no rows."""
    lengths = seqs.groupBy(F.length("seq").cast("long").alias("length")).agg(F.count("*").alias("n"))
    return lengths.join(F.broadcast(lengths.agg(F.count("*").alias("_k"))), F.col("_k") > 1).drop("_k")  # one row


def bad_characters(seqs: DataFrame, kind: str = "auto") -> DataFrame:
    """(id, characters): sorted characters that the alphabet (dna, protein or auto, their union) lacks."""
    allowed = {"dna": DNA, "protein": PROTEIN, "auto": "".join(sorted(set(DNA + PROTEIN)))}
    if kind not in allowed:
        raise InvalidInput(f"unknown sequence type: {kind}")
    rest = F.translate("seq", allowed[kind] + allowed[kind].lower(), "")
    return seqs.select("id", F.array_join(F.array_sort(F.array_distinct(F.split(rest, ""))), "").alias("characters")).where("characters <> ''")


def repeated_ids(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def unmatched_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, id) of ids that one frame has and the other lacks."""
    one = left.select("id").distinct().join(right.select("id").distinct(), "id", "left_anti").select(F.lit("left").alias("side"), "id")
    return one.unionByName(right.select("id").distinct().join(left.select("id").distinct(), "id", "left_anti").select(F.lit("right").alias("side"), "id"))


def enforce(violations: DataFrame, message: str) -> None:
    """Raises InvalidInput with up to SHOWN of the violations, if there are any."""
    found = violations.orderBy(*violations.columns).limit(SHOWN).collect()
    if found:
        raise InvalidInput(f"{message}: " + "; ".join(", ".join(map(str, r)) for r in found))

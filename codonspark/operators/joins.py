"""Joins of sequences with sequences, annotations and label tables. All are equi-joins; Spark picks the strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonspark.functions import sequences as S
from codonspark.plans.frames import LETTERS

#: Kinds of back-alignment errors.
NOT_TRIPLET, TOO_MANY, TOO_FEW, MISMATCH, INVALID = "not_triplet", "too_many_residues", "too_few_residues", "mismatch", "invalid_codon"


def common_ids(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each side's rows whose id the other has; repeated ids stay."""
    return left.join(right.select("id").distinct(), "id", "left_semi").select(*left.columns), right.join(left.select("id").distinct(), "id", "left_semi").select(*right.columns)


def sequences_with_annotations(seqs: DataFrame, gff: DataFrame) -> DataFrame:
    return seqs.join(gff.select(F.col("seqid").alias("id")).distinct(), "id", "left_semi").select(*seqs.columns)


def clamp_annotations(gff: DataFrame, seqs: DataFrame, fix: bool = True) -> DataFrame:
    """Annotations of sequences in ``seqs``, with start and end moved into 1..length if ``fix``; those with start > end go."""
    rows = gff.join(seqs.select(F.col("id").alias("seqid"), F.length("seq").alias("_n")), "seqid")
    if fix:
        inside = lambda c: F.greatest(F.lit(1), F.least(F.col(c), F.col("_n")))
        rows = rows.withColumns({"start": inside("start"), "end": inside("end")}).where("start <= end")
    return rows.select(*gff.columns)


def exclude_overlaps(rows: DataFrame, others: DataFrame, accession: str = "accession", sequence: str = "sequence") -> DataFrame:
    """Rows that share neither the accession (up to its first dot) nor the sequence with ``others``: two anti joins."""
    own, theirs = F.substring_index(accession, ".", 1), others.select(F.substring_index(accession, ".", 1).alias("_a")).distinct()
    rest = rows.withColumn("_k", own).join(theirs, F.col("_k") == F.col("_a"), "left_anti")
    seqs = others.select(F.upper(sequence).alias("_s")).distinct()
    return rest.withColumn("_u", F.upper(sequence)).join(seqs, F.col("_u") == F.col("_s"), "left_anti").drop("_k", "_u")


def overlap_reasons(rows: DataFrame, others: DataFrame, accession: str = "accession", sequence: str = "sequence") -> DataFrame:
    """(reason, n): rows by accession, sequence, both or none in common with ``others``."""
    a = others.select(F.substring_index(accession, ".", 1).alias("_a")).distinct().withColumn("_has_a", F.lit(True))
    s = others.select(F.sha2(F.upper(sequence), 256).alias("_s")).distinct().withColumn("_has_s", F.lit(True))
    joined = rows.join(a, F.substring_index(accession, ".", 1) == F.col("_a"), "left").join(s, F.sha2(F.upper(sequence), 256) == F.col("_s"), "left")
    reason = F.when(F.col("_has_a") & F.col("_has_s"), "both").when(F.col("_has_a"), "accession").when(F.col("_has_s"), "sequence").otherwise("none")
    return joined.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def label_conflicts(rows: DataFrame, sequence: str = "sequence", label: str = "label") -> DataFrame:
    """(digest, n, n_labels, excess, conflict) of sequences that stand in several rows."""
    groups = rows.groupBy(F.sha2(sequence, 256).alias("digest")).agg(F.count("*").alias("n"), F.count_distinct(label).alias("n_labels")).where("n > 1")
    return groups.select("digest", "n", "n_labels", (F.col("n") - 1).alias("excess"), (F.col("n_labels") > 1).alias("conflict"))


def unique_sequences(rows: DataFrame, order: str, sequence: str = "sequence", label: str = "label") -> DataFrame:
    """The first row of each sequence; sequences with several labels go. Case is that of A to Z: other letters' capitals may be spelled alike (SS)."""
    best = F.min_by(F.struct(*rows.columns), F.col(order)).alias("r")
    return rows.groupBy(F.translate(sequence, LETTERS.lower(), LETTERS).alias("_s")).agg(best, F.count_distinct(label).alias("_k")).where("_k = 1").select("r.*")


def best_hits(hits: DataFrame, query: str = "query", score: str = "bits") -> DataFrame:
    """The hit with the highest score of each query; of equals the smallest by the other columns."""
    rest = [F.col(c) for c in hits.columns if c not in (query, score)]
    best = F.min_by(F.struct(*hits.columns), F.struct((-F.col(score)).alias("_s"), *rest)).alias("r")
    return hits.groupBy(query).agg(best).select("r.*")


def missing_accessions(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Accessions that no record id has as a token between bars, with or without a version."""
    tokens = found.select(F.explode(F.split("id", r"\|")).alias("t"))
    names = tokens.select("t").union(tokens.select(F.substring_index("t", ".", 1))).distinct()
    bare = wanted.withColumn("_bare", F.substring_index("accession", ".", 1))
    return bare.join(names, F.col("_bare") == F.col("t"), "left_anti").join(names, F.col("accession") == F.col("t"), "left_anti").select(*wanted.columns)


def _residue_fits(codon: Column, aa: Column, table: int | str) -> Column:
    own = S.translate_codon(codon, table)
    return (own == aa) | aa.isin("X", "?") | (own == "X")


def back_align(cds: DataFrame, proteins: DataFrame, table: int | str = 1) -> DataFrame:
    """``cds`` rows with seq threaded onto the aligned protein of the same id, and ``error`` (null if there is none).

    A gap becomes ---, each residue the next codon of the gap-free CDS. X and ? fit any codon; one stop codon may be left over
    at the end. ``enforce_aligned`` raises where there are errors.
    """
    seq, aa = F.upper(F.translate("seq", S.GAPS, "")), F.upper("aligned")
    rows = cds.join(proteins.select("id", F.col("seq").alias("aligned")), "id")
    rows = rows.withColumn("_codons", S.codons(seq)).withColumn("_aa", F.filter(F.split(aa, ""), lambda c: c != ""))
    rows = rows.withColumn("_solid", F.filter("_aa", lambda c: ~c.isin("-", "."))).withColumn("_n", F.size("_codons")).withColumn("_k", F.size("_solid"))
    spare = (F.col("_n") == F.col("_k") + 1) & (S.translate_codon(F.get("_codons", F.col("_k")), table) == "*")
    bad_letter = F.exists("_codons", lambda c: F.length(F.translate(c, "ACGTRYMKWSBDHVNX?-.", "")) > 0)
    misfit = F.exists(F.zip_with("_solid", F.slice("_codons", 1, F.col("_k")), lambda a, c: ~_residue_fits(c, a, table)), lambda x: x)
    error = (F.when(F.length(seq) % 3 != 0, NOT_TRIPLET).when(F.col("_k") > F.col("_n"), TOO_MANY).when(bad_letter, INVALID)
             .when((F.col("_k") < F.col("_n")) & ~spare, TOO_FEW).when(misfit, MISMATCH))
    # the gaps before each residue, and after the last one, each with the codon that follows
    before = F.split(aa, "[^-.]", -1)
    threaded = F.array_join(F.zip_with(before, F.slice("_codons", 1, F.col("_k")), lambda g, c: F.concat(F.repeat(F.lit("---"), F.length(g)), F.coalesce(c, F.lit("")))), "")
    rows = rows.withColumn("error", error)
    return rows.withColumn("seq", F.when(F.col("error").isNull(), threaded)).select(*cds.columns, "error")


def benchmark_table(sequences: DataFrame, labels: DataFrame, folds: DataFrame, key: str = "accession") -> DataFrame:
    """Sequences, labels and folds of the same keys in one table. ValueError if a key is repeated or missing on some side."""
    sides = {"sequences": sequences, "labels": labels, "folds": folds}
    seen = None
    for name, df in sides.items():
        counts = df.groupBy(key).agg(F.count("*").alias(f"n_{name}"))
        seen = counts if seen is None else seen.join(counts, key, "full")
    if not seen.where(" OR ".join(f"coalesce(n_{name}, 0) <> 1" for name in sides)).isEmpty():
        raise ValueError("keys are repeated or missing")
    return sequences.join(labels, key).join(folds, key)


def leakage(train: DataFrame, test: DataFrame, accession: str = "accession", sequence: str = "sequence") -> DataFrame:
    """One row: accessions and sequences that two sets have in common."""
    both = lambda c: train.select(c.alias("k")).distinct().join(test.select(c.alias("k")).distinct(), "k").agg(F.count("*"))
    one = both(F.substring_index(accession, ".", 1)).toDF("shared_accessions")
    return one.join(F.broadcast(both(F.sha2(F.upper(sequence), 256)).toDF("shared_sequences")))

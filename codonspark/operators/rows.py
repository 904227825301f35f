"""Operators on single sequences: filters, transforms and statistics. Frames are (input_order, id, seq, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonspark.functions import codes
from codonspark.functions import sequences as S
from codonspark.plans.frames import codon_rows


def full_match(column: Column, pattern: str) -> Column:
    """Whether the pattern matches the whole string, as a full match does: no line feed may follow."""
    return F.regexp_like(column, F.lit(rf"\A(?:{pattern})\z"))


def codon_metrics(seqs: DataFrame, table: int | str = 1, inspect_internal_stop: bool = True) -> DataFrame:
    """``seqs`` with length_nt, tail_nt, non_triplet, internal_stop, counts of codons by class and clean_codon_fraction."""
    n = F.length("seq")
    rows = seqs.withColumn("_cls", S.codon_states(F.col("seq"), table))
    of = lambda name: S.count_chars(F.col("_cls"), name[0])
    total = F.length("_cls").cast("long")
    return rows.withColumns({
        "length_nt": n.cast("long"), "tail_nt": (n % 3).cast("long"), "non_triplet": n % 3 != 0,
        "internal_stop": S.internal_stop(F.col("seq"), table) if inspect_internal_stop else F.lit(False),
        "total_codons": total, "clean_codons": of("clean"), "missing_codons": of("missing"), "ambiguous_codons": of("ambiguous"), "stop_codons": of("stop"),
        "clean_codon_fraction": F.when(total > 0, of("clean") / total).otherwise(F.lit(0.0)),
    }).drop("_cls")


def filter_report(seqs: DataFrame, drop_non_triplet: bool = True, drop_internal_stop: bool = False, min_clean_codon_fraction: float = 0.5, dedup: str = "no", table: int | str = 1) -> DataFrame:
    """codon_metrics() with ``reasons`` (array, empty: kept) and ``kept``. Duplicates are sought among rows that pass the quality rules."""
    if not 0 <= min_clean_codon_fraction <= 1:
        raise ValueError("min_clean_codon_fraction must be between 0 and 1")
    if dedup not in ("no", "keep-first", "keep-longest"):
        raise ValueError(f"unknown dedup mode: {dedup}")
    rows = codon_metrics(seqs, table, drop_internal_stop)
    tests = [F.when(F.col("non_triplet"), "non_triplet")] if drop_non_triplet else []
    tests += [F.when(F.col("internal_stop"), "internal_stop")] if drop_internal_stop else []
    tests += [F.when(F.col("clean_codon_fraction") < min_clean_codon_fraction, "low_clean_fraction")]
    rows = rows.withColumn("reasons", F.array_compact(F.array(*tests)))
    if dedup != "no":
        # one number for each id, combined before it is shuffled: sequences of a frequent id don't meet
        order = ([(-F.col("length_nt")).alias("short")] if dedup == "keep-longest" else []) + [F.col("input_order").alias("first")]
        best = rows.where(F.size("reasons") == 0).groupBy(F.col("id").alias("_id")).agg(F.min(F.struct(*order)).alias("_b")).select("_id", F.col("_b.first").alias("_first"))
        rows = rows.join(best, F.col("id").eqNullSafe(F.col("_id")), "left")
        rows = rows.withColumn("reasons", F.when((F.size("reasons") == 0) & (F.col("input_order") != F.col("_first")), F.array(F.lit("duplicate"))).otherwise(F.col("reasons"))).drop("_id", "_first")
    return rows.withColumn("kept", F.size("reasons") == 0)


def filter_sequences(seqs: DataFrame, **options) -> DataFrame:
    return filter_report(seqs, **options).where("kept").select(*seqs.columns)


def validate_rows(seqs: DataFrame, table: int | str = 1) -> DataFrame:
    """(input_order, id, non_triplet, gap_only, internal_stop, ambiguous_codons, evaluable_codons)."""
    up = F.upper("seq")
    known = F.filter(S.codons(up), lambda c: ~S.has_missing(c))
    bad = S.let(known, lambda k: F.struct(F.size(F.filter(k, lambda c: ~S.unambiguous(c))).cast("long").alias("ambiguous"), F.size(k).cast("long").alias("evaluable")))
    return seqs.select("input_order", "id", F.length("seq").alias("n"), (F.length("seq") % 3 != 0).alias("non_triplet"), S.gap_only(F.col("seq")).alias("gap_only"),
                       S.internal_stop(F.col("seq"), table).alias("internal_stop"), bad.alias("b")).select("*", F.col("b.ambiguous").alias("ambiguous_codons"), F.col("b.evaluable").alias("evaluable_codons")).drop("b")


def validate_summary(seqs: DataFrame, table: int | str = 1) -> DataFrame:
    """One row: counts of each kind of issue, whether the sequences are aligned, and the share of ambiguous codons."""
    rows = validate_rows(seqs, table)
    repeated = rows.groupBy("id").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("duplicate_ids"))
    one = rows.agg(F.count("*").alias("num_sequences"), F.coalesce(F.min("n") == F.max("n"), F.lit(True)).alias("aligned"), F.count_if("non_triplet").alias("non_triplet"), F.count_if("gap_only").alias("gap_only"),
                   F.count_if("internal_stop").alias("internal_stop"), F.coalesce(F.sum("ambiguous_codons"), F.lit(0)).alias("ambiguous_codons"), F.coalesce(F.sum("evaluable_codons"), F.lit(0)).alias("evaluable_codons"))
    rate = F.when(F.col("evaluable_codons") > 0, F.col("ambiguous_codons") / F.col("evaluable_codons")).otherwise(F.lit(0.0))
    return one.join(F.broadcast(repeated)).withColumn("ambiguous_rate", rate)  # both have one row


def print_sequences(seqs: DataFrame, pattern: str = "", show_name: bool = True) -> DataFrame:
    """(input_order, line): FASTA entries on one line each of the records whose id the pattern matches in full."""
    rows = seqs.where(full_match(F.col("id"), pattern))
    return rows.select("input_order", (F.concat(F.lit(">"), "id", F.lit("\n"), "seq") if show_name else F.col("seq")).alias("line"))


def remove_sequences(seqs: DataFrame, pattern: str = "", problematic: str = "NX-?", percent: float = 0) -> DataFrame:
    """Rows whose id isn't matched in full and whose share of problematic letters (any case) is below ``percent``, if that is over 0."""
    if not 0 <= percent <= 100:
        raise ValueError("percent must be between 0 and 100")
    bad = S.count_chars(F.upper("seq"), problematic.upper())
    rate = F.when(F.length("seq") > 0, bad / F.length("seq")).otherwise(F.lit(0.0))
    drop = full_match(F.col("id"), pattern)
    return seqs.where(~(drop | (rate >= percent / 100)) if percent > 0 else ~drop)


def sequence_stats(seqs: DataFrame) -> DataFrame:
    """One row: sequences, length, soft-masked letters, N, gaps and GC percent of all letters."""
    up = F.upper("seq")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    lower = S.count_chars(F.col("seq"), "abcdefghijklmnopqrstuvwxyz")
    rows = seqs.agg(F.count("*").alias("num_sequences"), total(F.length("seq")).alias("total_length"), total(lower).alias("softmasked"), total(S.count_chars(up, "N")).alias("num_n"),
                    total(S.count_chars(F.col("seq"), "-")).alias("num_gap"), total(S.count_chars(up, "GC")).alias("gc"))
    return rows.select("num_sequences", "total_length", "softmasked", "num_n", "num_gap", F.when(F.col("total_length") > 0, F.col("gc") / F.col("total_length") * 100).otherwise(F.lit(0.0)).alias("gc_percent"))


def codon_stats(seqs: DataFrame, table: int | str = 1) -> DataFrame:
    """(input_order, seq_id, nt_length, codon counts, GC percent in all and by codon position) of each sequence."""
    up = F.upper("seq")
    # one letter for each codon: what it is; a small one where it is incomplete
    kind = lambda c: F.when(F.length(c) < 3, F.when(S.has_missing(c), "m").otherwise("p")).when(S.has_missing(c), "M").when(~S.unambiguous(c), "A").when(c.isin(*codes.stops(table)), "S").otherwise("C")
    every = lambda k: F.regexp_replace(up, "(?s)" + "." * (k - 1) + ("(.)" if k == 3 else "(.).{0," + str(3 - k) + "}"), "$1")
    rows = seqs.select("input_order", F.col("id").alias("seq_id"), F.length("seq").cast("long").alias("nt_length"), F.array_join(F.transform(S.chunks(up), kind), "").alias("_kinds"),
                       *[F.when(F.length("seq") >= k, F.substr(every(k), F.lit(1), F.floor((F.length("seq") + 3 - k) / 3).cast("int"))).otherwise("").alias(f"_p{k}") for k in (1, 2, 3)])
    percent = lambda g, n: F.when(n > 0, g / n * 100).otherwise(F.lit(0.0))
    gc, acgt = [S.count_chars(F.col(f"_p{k}"), "GC") for k in (1, 2, 3)], [S.count_chars(F.col(f"_p{k}"), "ACGT") for k in (1, 2, 3)]
    of = lambda letters: S.count_chars(F.col("_kinds"), letters)
    return rows.select("input_order", "seq_id", "nt_length", of("MASC").alias("codons_total"), of("ASC").alias("codons_complete"), of("Mm").alias("codons_missing"),
                       of("A").alias("codons_ambiguous"), of("S").alias("codons_stop"),
                       percent(gc[0] + gc[1] + gc[2], acgt[0] + acgt[1] + acgt[2]).alias("gc_all"), *[percent(gc[k], acgt[k]).alias(f"gc{k + 1}") for k in range(3)])


def codon_usage(seqs: DataFrame, table: int | str = 1) -> DataFrame:
    """(codon, aa, n, fraction) of codons of A, C, G and T, at most 64 rows."""
    rows = codon_rows(seqs).where(S.unambiguous(F.col("codon"))).groupBy("codon").agg(F.count("*").alias("n"))
    return rows.select("codon", S.residue(F.col("codon"), table).alias("aa"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("fraction")).orderBy("codon")


def strip_names(name: Column, patterns: list[str]) -> Column:
    for p in patterns:
        name = F.regexp_replace(name, p, "")
    return name


def longest_of_group(seqs: DataFrame, patterns: list[str]) -> DataFrame:
    """The longest record (the first of equals) of each group of names that are equal once the patterns are removed.

    Records keep their own ids; groups stand in the order of their first members, as ``group_order``. Without patterns
    all rows pass.
    """
    if not patterns:
        return seqs.withColumn("group_order", F.col("input_order"))
    best = F.max_by(F.struct(*seqs.columns), F.struct(F.length("seq"), -F.col("input_order"))).alias("r")
    rows = seqs.groupBy(strip_names(F.col("id"), patterns).alias("_group")).agg(best, F.min("input_order").alias("group_order"))
    return rows.select("r.*", "group_order")


def relabel(seqs: DataFrame, replace_chars: str = "", clip_len: int = 0, unique: bool = False) -> DataFrame:
    """Ids with characters replaced (``FROM--TO``, TO one character), clipped, and suffixed by _1, _2, ... where they repeat."""
    name = F.col("id")
    if replace_chars:
        old, _, new = replace_chars.partition("--")
        if not old or len(new) != 1:
            raise ValueError("replace_chars must be FROM--TO with one character as TO")
        name = F.translate(name, old, new * len(old))
    if clip_len < 0:
        raise ValueError("clip_len must not be negative")
    rows = seqs.withColumn("id", F.left(name, F.lit(clip_len)) if clip_len else name)
    if unique:
        same = Window.partitionBy("id")
        rows = rows.withColumn("_k", F.row_number().over(same.orderBy("input_order"))).withColumn("_n", F.count("*").over(same))
        rows = rows.withColumn("id", F.when(F.col("_n") > 1, F.concat("id", F.lit("_"), F.col("_k").cast("string"))).otherwise(F.col("id"))).drop("_k", "_n")
    return rows


def mask(seqs: DataFrame, char: str = "N", ambiguous: bool = True, stop: bool = True, table: int | str = 1) -> DataFrame:
    return seqs.withColumn("seq", S.mask(F.col("seq"), char, ambiguous, stop, table))


def pad(seqs: DataFrame, char: str = "N", no_pseudo: bool = False, table: int | str = 1) -> DataFrame:
    """``seqs`` in frame, with head, tail and padded; ``no_pseudo`` leaves out those that keep internal stops."""
    rows = seqs.withColumn("_p", S.pad(F.col("seq"), char, table)).withColumn("seq", F.col("_p.seq"))
    rows = rows.where("_p.stops = 0") if no_pseudo else rows
    return rows.select(*seqs.columns, F.col("_p.head").alias("head"), F.col("_p.tail").alias("tail"), F.col("_p.padded").alias("padded"))


def translate(seqs: DataFrame, to_stop: bool = False, table: int | str = 1) -> DataFrame:
    return seqs.withColumn("seq", S.translate_cds(F.col("seq"), table, to_stop))


def split_positions(seqs: DataFrame) -> dict[str, DataFrame]:
    """A frame for each codon position: 1st, 2nd and 3rd."""
    return {name: seqs.withColumn("seq", S.position(F.col("seq"), k)) for k, name in ((1, "1st"), (2, "2nd"), (3, "3rd"))}


def top_ambiguous(seqs: DataFrame, n: int) -> DataFrame:
    """(id, ambiguous_codons) of the n sequences with most ambiguous codons, then by id."""
    return validate_rows(seqs).where("ambiguous_codons > 0").orderBy(F.desc("ambiguous_codons"), "id", "input_order").limit(n).select("input_order", "id", "ambiguous_codons")

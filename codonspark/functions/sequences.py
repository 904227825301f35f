"""Column functions on nucleotide sequences and codons. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes

MISSING = "-?."  # of a codon
GAP_ONLY = "-?.NXnx"
GAPS = "-."


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def chunks(seq: Column) -> Column:
    """Codons of a sequence, an incomplete last one included; no codons of an empty sequence."""
    return F.regexp_extract_all(seq, F.lit("(?s).{1,3}"), F.lit(0))


def codons(seq: Column) -> Column:
    """Complete codons of a sequence."""
    return F.regexp_extract_all(seq, F.lit("(?s).{3}"), F.lit(0))


def has_missing(codon: Column) -> Column:
    return F.length(F.translate(codon, MISSING, "")) < F.length(codon)


def unambiguous(codon: Column) -> Column:
    """Whether an upper-case codon has no letter but A, C, G and T."""
    return F.length(F.translate(codon, "ACGT", "")) == 0


def codon_class(codon: Column, table: int | str = 1) -> Column:
    """missing, ambiguous, stop or clean."""
    up = F.upper(codon)
    return F.when(has_missing(up), "missing").when(~unambiguous(up), "ambiguous").when(up.isin(*codes.stops(table)), "stop").otherwise("clean")


def codon_states(seq: Column, table: int | str = 1) -> Column:
    """A letter for each complete codon: m missing, a ambiguous, s stop, c clean. One pass over the codons serves all counts."""
    letter = lambda c: F.when(has_missing(c), "m").when(~unambiguous(c), "a").when(c.isin(*codes.stops(table)), "s").otherwise("c")
    return F.array_join(F.transform(codons(F.upper(seq)), letter), "")


def _digit(codon: Column, k: int, letters: str) -> Column:
    return F.instr(F.lit(letters), F.substring(codon, k, 1)) - 1


def residue(codon: Column, table: int | str = 1) -> Column:
    """Residue of an upper-case codon of A, C, G and T, * for a stop, null for others."""
    index = _digit(codon, 1, codes.BASES) * 16 + _digit(codon, 2, codes.BASES) * 4 + _digit(codon, 3, codes.BASES)
    return F.when(unambiguous(codon) & (F.length(codon) == 3), F.substr(F.lit(codes.CODES[codes.table_id(table)][1]), index + 1, F.lit(1)))


def translate_codon(codon: Column, table: int | str = 1) -> Column:
    """Residue of an aligned codon: - for gaps only, X for a codon with some gap or ?, else its residue, X if that isn't certain."""
    letters = "".join(codes.IUPAC)
    index = (_digit(codon, 1, letters) * 225 + _digit(codon, 2, letters) * 15 + _digit(codon, 3, letters)).cast("int")
    known = F.length(F.translate(codon, letters, "")) == 0
    # most codons are of A, C, G and T: they come first, so that the tests for the others aren't made for them
    return F.coalesce(residue(codon, table), F.when(F.length(F.translate(codon, GAPS, "")) == 0, "-").when(has_missing(codon), "X").when(unambiguous(codon), F.lit(None).cast("string"))
                      .when(known, F.substr(F.lit(codes.ambiguous_residues(table)), index + 1, F.lit(1))).otherwise("X"))


def translate_cds(seq: Column, table: int | str = 1, to_stop: bool = False) -> Column:
    """Residues of a coding sequence's complete codons; up to the first stop, which is left out, if ``to_stop``."""
    out = F.array_join(F.transform(codons(F.upper(seq)), lambda c: translate_codon(c, table)), "")
    return F.substring_index(out, "*", 1) if to_stop else out


def reverse_complement(seq: Column) -> Column:
    """Upper-case reverse complement; letters that aren't IUPAC codes stay."""
    return F.reverse(F.translate(F.upper(seq), "ACGTRYMKWSBDHVN", "TGCAYRKMWSVHDBN"))


def gap_only(seq: Column) -> Column:
    return (F.length(seq) > 0) & (F.length(F.translate(seq, GAP_ONLY, "")) == 0)


def internal_stop(seq: Column, table: int | str = 1) -> Column:
    """Whether a stop codon stands before the last codon without missing characters."""
    known = F.filter(codons(F.upper(seq)), lambda c: ~has_missing(c))
    return let(known, lambda k: F.exists(F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0))), lambda c: c.isin(*codes.stops(table))))


def stops_before_last(seq: Column, table: int | str = 1) -> Column:
    """Number of in-frame stop codons that start before the last three characters."""
    return let(codons(F.upper(seq)), lambda k: F.size(F.filter(F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0))), lambda c: c.isin(*codes.stops(table)))))


def count_class(seq: Column, name: str, table: int | str = 1) -> Column:
    return F.size(F.filter(codons(seq), lambda c: codon_class(c, table) == name)).cast("long")


def count_chars(seq: Column, chars: str) -> Column:
    """Characters of ``seq`` that are in ``chars``."""
    return (F.length(seq) - F.length(F.translate(seq, chars, ""))).cast("long")


def position(seq: Column, k: int) -> Column:
    """The k-th (1 to 3) characters of all codons, an incomplete last one included."""
    return F.array_join(F.transform(chunks(seq), lambda c: F.substring(c, k, 1)), "")


def mask(seq: Column, char: str = "N", ambiguous: bool = True, stop: bool = True, table: int | str = 1) -> Column:
    """Codons that are partly gaps, and ambiguous or stop codons if asked for, replaced by three times ``char``; --- stays."""
    stop_codons = codes.stops(table)

    def one(c: Column) -> Column:
        up = F.upper(c)
        bad = (F.instr(up, "-") > 0) & (up != "---")
        if stop:
            bad = bad | up.isin(*stop_codons)
        if ambiguous:
            bad = bad | ((up != "---") & ~(unambiguous(up) & (F.length(up) == 3)))
        return F.when(bad, F.lit(char * 3)).otherwise(c)

    return F.array_join(F.transform(chunks(seq), one), "")


def pad(seq: Column, char: str = "N", table: int | str = 1) -> Column:
    """struct(seq, head, tail, stops, padded): the sequence in frame, with as few internal stops as head and tail padding allow.

    A sequence in frame without internal stops stays as it is. Else X counts as N, and of the candidates, in their order, the
    first with the fewest internal stops is taken.
    """
    clean = F.translate(seq, "X", "N")
    n = F.length(seq)
    missing = F.pmod(3 - n % 3, F.lit(3))
    at = lambda h, t: F.concat(F.lit(char * h), clean, F.lit(char * t))
    tail = F.rpad(clean, n + missing, char)
    option = lambda k, h, t: F.struct(stops_before_last(at(h, t), table).alias("stops"), F.lit(k).alias("k"), F.lit(h).alias("head"), F.lit(t).alias("tail"), at(h, t).alias("seq"))
    options = (F.when(missing == 0, F.array(option(0, 0, 0), option(1, 1, 2), option(2, 2, 1)))
               .when(missing == 1, F.array(option(0, 0, 1), option(1, 1, 0), option(2, 2, 2)))
               .otherwise(F.array(option(0, 0, 2), option(1, 2, 0), option(2, 1, 1))))
    inner = stops_before_last(tail, table)
    only_tail = F.struct(F.lit(0).alias("stops"), F.lit(0).alias("k"), F.lit(0).alias("head"), missing.cast("int").alias("tail"), tail.alias("seq"))
    best = F.when(inner > 0, F.array_min(options)).when(missing > 0, only_tail)
    return let(best, lambda b: F.struct(F.coalesce(b["seq"], seq).alias("seq"), F.coalesce(b["head"], F.lit(0)).alias("head"), F.coalesce(b["tail"], F.lit(0)).alias("tail"),
                                        F.coalesce(b["stops"], F.lit(0)).alias("stops"), b.isNotNull().alias("padded")))


def runs(seq: Column, chars: str) -> Column:
    """array<struct<start,len>> of the maximal runs of ``chars``, start from 0."""
    regex = f"[{chars}]+"
    gaps = F.transform(F.split(seq, regex, -1), lambda x: F.length(x))
    own = F.transform(F.regexp_extract_all(seq, F.lit(regex), F.lit(0)), lambda x: F.length(x))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,len:int>>").alias("out"))
    step = lambda s, x: F.struct((s["pos"] + x["gap"] + x["len"]).alias("pos"), F.concat(s["out"], F.array(F.struct((s["pos"] + x["gap"]).alias("start"), x["len"].alias("len")))).alias("out"))
    return F.aggregate(F.arrays_zip(F.slice(gaps, 1, F.size(own)).alias("gap"), own.alias("len")), zero, step, lambda s: s["out"])

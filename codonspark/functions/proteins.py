"""Protein features as columns: fractions, hydropathy, runs, motifs and signals of a peptide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sequences as S

AA = "ACDEFGHIKLMNPQRSTVWY"
HYDROPHOBIC, BASIC, BASIC_STRICT, ACIDIC, SER_THR, AROMATIC, SMALL = "AILMFWVY", "KRH", "KR", "DE", "ST", "FWY", "AGSTCP"
#: Hydropathy of the residues in the order of AA.
HYDROPATHY = dict(zip(AA, (1.8, 2.5, -3.5, -3.5, 2.8, -0.4, -3.2, 4.5, -3.9, 3.8, 1.9, -3.5, -1.6, -3.5, -4.5, -0.8, -0.7, 4.2, -0.9, -1.3), strict=True))
#: Fixed patterns.
PTS1, PTS2 = "[ASNCGTP][KRHQ][LIVMF]$", "[RK][LIVQ].{4}[HQ][LA]"
RR_HYDROPHOBIC = "RR.{0,12}[AILMFWVY]{5,}"
NLS, NLS_BIPARTITE = "[KR]{3,}", "[KR]{2}.{8,12}[KR]{3,}"
NES = "[LIVMF].{1,4}[LIVMF].{1,4}[LIVMF].{1,4}[LIVMF]"


def canonical(aa: Column) -> Column:
    """Upper-case residues without blanks and one last stop; letters that aren't one of the twenty become X. Raises if a stop is inside."""
    up = F.regexp_replace(F.replace(F.upper(aa), F.lit(" "), F.lit("")), r"\*\z", "")
    return F.when(F.instr(up, "*") > 0, F.raise_error(F.lit("a stop inside a protein")).cast("string")).otherwise(F.regexp_replace(up, f"[^{AA}]", "X"))


def count(seq: Column, chars: str) -> Column:
    """Residues of ``seq`` that are among ``chars``. Counts of single residues are shared by all features of a window."""
    return sum((F.length(seq) - F.length(F.replace(seq, F.lit(c), F.lit(""))) for c in chars[1:]), F.length(seq) - F.length(F.replace(seq, F.lit(chars[0]), F.lit(""))))


def fraction(seq: Column, chars: str) -> Column:
    """Share of ``chars``; 0 for an empty sequence. Without a condition, so that what features share is computed once."""
    return count(seq, chars) / F.greatest(F.length(seq), F.lit(1))


def hydropathy(seq: Column) -> Column:
    """Mean hydropathy; residues without one count 0."""
    by_value: dict[float, str] = {}
    for aa, value in HYDROPATHY.items():
        by_value[value] = by_value.get(value, "") + aa
    total = sum((count(seq, chars) * F.lit(value) for value, chars in by_value.items()), F.lit(0.0))
    return total / F.greatest(F.length(seq), F.lit(1))


def longest_run(seq: Column, chars: str = HYDROPHOBIC) -> Column:
    found = F.transform(F.regexp_extract_all(seq, F.lit(f"[{chars}]+"), F.lit(0)), lambda x: F.length(x))
    return F.coalesce(F.array_max(found), F.lit(0)).cast("double")


def flag(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def pts1(seq: Column) -> Column:
    return F.regexp_like(seq, F.lit(PTS1))


def pts2(seq: Column) -> Column:
    return F.regexp_like(F.left(seq, F.lit(40)), F.lit(PTS2))


def signal_type(seq: Column) -> Column:
    return F.when(pts1(seq), "PTS1").when(pts2(seq), "PTS2").otherwise("none")


def base_features(seq: Column) -> dict[str, Column]:
    """The 33 base features of a canonical sequence."""
    left, right = (lambda k: F.left(seq, F.lit(k))), (lambda k: F.right(seq, F.lit(k)))
    n20, n40, n60, c10 = left(20), left(40), left(60), right(10)
    out = {"aa_len": F.length(seq).cast("double")}
    out |= {f"n20_{k}_frac": fraction(n20, v) for k, v in (("basic", BASIC), ("acidic", ACIDIC), ("hydrophobic", HYDROPHOBIC), ("ser_thr", SER_THR), ("pro", "P"))}
    out |= {f"n40_{k}_frac": fraction(n40, v) for k, v in (("basic", BASIC), ("acidic", ACIDIC), ("hydrophobic", HYDROPHOBIC), ("ser_thr", SER_THR), ("arg", "R"), ("lys", "K"), ("ala", "A"), ("pro", "P"), ("gly", "G"), ("aromatic", AROMATIC))}
    out |= {"n40_hydropathy_mean": hydropathy(n40), "n40_hydrophobic_run": longest_run(n40), "signal_peptide_like": flag(longest_run(F.substring(seq, 7, 24)) >= 7),
            "rr_motif": flag(F.instr(n40, "RR") > 0), "rr_hydrophobic_after": flag(F.regexp_like(n60, F.lit(RR_HYDROPHOBIC))), "cleavage_zone_small_frac": fraction(F.substring(seq, 19, 17), SMALL)}
    out |= {f"global_{k}_frac": fraction(seq, v) for k, v in (("basic", BASIC), ("acidic", ACIDIC), ("hydrophobic", HYDROPHOBIC), ("ser_thr", SER_THR), ("x", "X"))}
    out |= {f"c10_{k}_frac": fraction(c10, v) for k, v in (("basic", BASIC_STRICT), ("acidic", ACIDIC), ("hydrophobic", HYDROPHOBIC))}
    return out | {"pts1_match": flag(pts1(seq)), "pts1_skl": flag(right(3) == "SKL"), "pts2_match": flag(pts2(seq))}


def kingdom_flags(kingdom: Column) -> dict[str, Column]:
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(kingdom, F.lit("")))), r"[\s\-]+", "_")
    metazoa = text.isin("metazoa", "animal", "animals") | text.contains("metazoa")
    plant = text.isin("plant", "plants", "viridiplantae", "plantae") | text.contains("viridiplantae") | text.contains("plantae")
    fungi = text.isin("fungi", "fungus") | text.contains("fungi")
    other = (~text.isin("", "unknown", "auto") & ~(metazoa | plant | fungi)) | text.isin("non_plant", "nonplant", "other")
    return {"kingdom_metazoa": flag(metazoa), "kingdom_viridiplantae": flag(plant), "kingdom_fungi": flag(fungi), "kingdom_other": flag(other)}


def broad_features(seq: Column, kingdom: Column | None = None) -> dict[str, Column]:
    """The base features and 25 more."""
    left, right = (lambda k: F.left(seq, F.lit(k))), (lambda k: F.right(seq, F.lit(k)))
    out = base_features(seq)
    for k in (60, 100):
        out |= {f"n{k}_{name}_frac": fraction(left(k), v) for name, v in (("basic", BASIC), ("acidic", ACIDIC), ("hydrophobic", HYDROPHOBIC), ("ser_thr", SER_THR))}
    clusters = F.regexp_count(seq, F.lit(NLS)).cast("double")
    out |= {"global_hydropathy_mean": hydropathy(seq), "global_hydrophobic_run": longest_run(seq), "hydrophobic_segment_count": F.regexp_count(seq, F.lit(f"[{HYDROPHOBIC}]{{17,}}")).cast("double"),
            "nls_basic_cluster_count": clusters, "nls_basic_cluster_match": flag(clusters > 0), "nls_bipartite_match": flag(F.regexp_like(seq, F.lit(NLS_BIPARTITE))), "nes_like_match": flag(F.regexp_like(seq, F.lit(NES))),
            "er_kdel_hdel": flag(right(4).isin("KDEL", "HDEL")), "er_kkxx": flag((F.length(seq) >= 4) & F.substring(right(4), 1, 2).eqNullSafe("KK")), "gpi_like_ctail": flag(longest_run(right(40)) >= 12),
            "c20_hydrophobic_run": longest_run(right(20)), "c20_basic_frac": fraction(right(20), BASIC_STRICT), "c20_acidic_frac": fraction(right(20), ACIDIC)}
    return out | kingdom_flags(F.lit("") if kingdom is None else kingdom)


def perox_features(seq: Column, kingdom: Column | None = None) -> dict[str, Column]:
    """The broad features, windows of the end, and the last twelve residues as 0 and 1: 325 in all."""
    right = lambda k: F.right(seq, F.lit(k))
    out = broad_features(seq, kingdom)
    for k in (3, 4, 12, 40):
        out |= {f"c{k}_{name}_frac": fraction(right(k), v) for name, v in (("basic", BASIC_STRICT), ("acidic", ACIDIC), ("hydrophobic", HYDROPHOBIC), ("ser_thr", SER_THR), ("small", SMALL))}
        out[f"c{k}_hydropathy_mean"] = hydropathy(right(k))
    long = F.length(seq) >= 3
    out |= {"pts1_relaxed_match": flag(F.regexp_like(seq, F.lit("[A-Z][KRHQ][LIVMFY]$"))), "pts1_hydrophobic_terminal": flag(long & F.regexp_like(seq, F.lit(f"[{HYDROPHOBIC}]$"))), "pts2_nterm_match": flag(pts2(seq))}
    for k in range(12, 0, -1):
        aa = F.when(F.length(seq) >= k, F.substring(right(k), 1, 1)).otherwise("X")
        out |= {f"tail_pos-{k}_{x}": flag(aa == x) for x in AA}
    return out


def vector(features: dict[str, Column]) -> Column:
    """The features as array<double>, in their order."""
    return F.array(*features.values())


def residue_codes(seq: Column, length: int, from_end: bool = False) -> Column:
    """array<int> of ``length``: places of residues in AA from 1, 21 for others, 0 after (or before) the sequence's end."""
    part = F.right(seq, F.lit(length)) if from_end else F.left(seq, F.lit(length))
    own = F.transform(F.filter(F.split(part, ""), lambda c: c != ""), lambda c: F.when(F.instr(F.lit(AA), c) > 0, F.instr(F.lit(AA), c)).otherwise(21))
    blank = F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(length) - F.length(part)))
    return F.concat(blank, own) if from_end else F.concat(own, blank)


#: Fixed: residues that fit at -3 and -1 of a signal peptide's cut, the weights of a cut's nine terms (see ``operators.windows``), and
#: the cuts that are tried.
FITS_3, FITS_1 = "AVSGTC", "ASGTC"
CUT_WEIGHTS = {"hydrophobic": 2.2, "hydrophobic_run": 0.15, "small_3": 0.8, "small_1": 1.0, "ala_1": 0.4, "small": 0.5, "charge": 0.4, "proline": -0.9, "ser_thr": -0.25}
FIRST_CUT, LAST_CUT = 12, 44


#: Fixed windows (start, end) whose composition follows the scan.
SCAN_WINDOWS = ((0, 15), (0, 25), (0, 35), (0, 50), (0, 80), (5, 30), (20, 60), (40, 100))


#: Fixed: motifs whose first places are features of transit peptides.
TRANSIT_MOTIFS = ("RR", "KR", "RK", "KK", "RA", "RS", "SR", "ST", "TS", "SS", "TP", "SP")


def motif_places(seq: Column, within: int = 140) -> dict[str, Column]:
    """Whether each motif stands among the first residues, and where (from 0; 999: nowhere)."""
    out: dict[str, Column] = {}
    for motif in TRANSIT_MOTIFS:
        at = F.instr(F.left(seq, F.lit(within)), motif)
        out |= {f"{motif}_found": flag(at > 0), f"{motif}_at": F.when(at > 0, at - 1).otherwise(999).cast("double")}
    return out


#: Fixed: substitution scores of residues (rows and columns in the order of BLOSUM_ORDER).
BLOSUM_ORDER = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""


def blosum_codes(seq: Column, length: int) -> Column:
    """array<array<int>> of ``length``: the scores of each residue with all twenty; zeros for other letters and after the end."""
    rows = [[int(x) for x in line.split()] for line in BLOSUM62.strip().splitlines()]
    scores = F.array(*[F.array(*map(F.lit, r)) for r in [[0] * len(BLOSUM_ORDER), *rows]])
    places = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda k: F.when(k <= F.length(seq), F.instr(F.lit(BLOSUM_ORDER), F.substr(seq, k, F.lit(1)))).otherwise(F.lit(0)))
    return F.get(F.transform(F.array(scores), lambda m: F.transform(places, lambda i: F.get(m, i))), 0)


#: Fixed: letters that a nucleotide sequence may have.
DNA_LETTERS = "ACGTRYSWKMBDHVNXacgtryswkmbdhvnx?.-"


def is_dna_like(seq: Column) -> Column:
    return (F.length(seq) > 0) & (F.length(F.translate(seq, DNA_LETTERS, "")) == 0)


def protein_of(seq: Column, mode: str = "auto", table: int | str = 1) -> Column:
    """The canonical protein of a row. ``mode``: dna (a coding sequence in frame), protein, or auto: dna where the letters allow it and the
    length is a multiple of three. Raises where a coding sequence isn't in frame, or a stop stands inside."""
    if mode not in ("auto", "dna", "protein"):
        raise ValueError(f"no such mode: {mode}")
    whole = F.when(F.length(seq) % 3 == 0, F.upper(seq)).otherwise(F.raise_error(F.lit("a coding sequence's length isn't a multiple of three")).cast("string"))
    coded = canonical(S.translate_cds(whole, table))
    if mode != "auto":
        return coded if mode == "dna" else canonical(seq)
    return F.when(is_dna_like(seq) & (F.length(seq) % 3 == 0), canonical(S.translate_cds(F.upper(seq), table))).otherwise(canonical(seq))

"""Row operators: literal cases, edge cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from codonspark.functions import codes
from codonspark.functions import proteins as P
from codonspark.functions import sequences as S
from codonspark.operators import checks, gaps, orf, rows


def seqs(spark, items):
    return spark.createDataFrame([(k, i, s) for k, (i, s) in enumerate(items)], "input_order long, id string, seq string")


def texts(df, column="seq"):
    return [r[column] for r in df.orderBy("input_order").collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_genetic_codes():
    assert codes.residues(1)["ATG"] == "M" and codes.residues(2)["TGA"] == "W" and codes.residues(1)["TGA"] == "*"
    assert all(len(aas) == 64 for _, aas, _ in codes.CODES.values())
    assert codes.table_id("standard") == 1 and codes.table_id("11") == 11
    for bad in (99, "none", "-1"):
        with pytest.raises(ValueError):
            codes.table_id(bad)
    letters = list(codes.IUPAC)
    at = lambda c: codes.ambiguous_residues(1)[letters.index(c[0]) * 225 + letters.index(c[1]) * 15 + letters.index(c[2])]
    assert [at(c) for c in ("NNN", "GCN", "TAR", "RAY", "SAR", "TRA", "MGR", "YTA")] == ["X", "A", "*", "B", "Z", "*", "R", "L"]


def test_codon_stats(spark):
    got = rows.codon_stats(seqs(spark, [("p", "GGATGCTACTTT"), ("q", "CATRYKTGAACC"), ("e", ""), ("t", "AT"), ("g", "A-GATGA-")])).orderBy("input_order").collect()
    assert tuple(got[0])[1:7] == ("p", 12, 4, 4, 0, 0) and got[0].codons_stop == 0
    assert [round(got[0][k], 6) for k in ("gc_all", "gc1", "gc2", "gc3")] == [41.666667, 25, 50, 50]
    assert (got[1].nt_length, got[1].codons_total, got[1].codons_complete, got[1].codons_missing, got[1].codons_ambiguous, got[1].codons_stop) == (12, 4, 4, 0, 1, 1)
    assert (got[2].codons_total, got[2].gc_all) == (0, 0.0)
    assert (got[4].codons_total, got[4].codons_missing) == (2, 2)  # an incomplete codon with a gap counts as missing


def test_codon_usage(spark):
    got = rows.codon_usage(seqs(spark, [("a", "ATGATGTTT"), ("b", "ATGTTTTTT"), ("c", "NNN---")])).collect()
    assert [tuple(r) for r in got] == [("ATG", "M", 3, 0.5), ("TTT", "F", 3, 0.5)]


def test_filter(spark):
    df = seqs(spark, [("keep", "ATGAAACCC"), ("tail", "ATGAAAC"), ("stop", "ATGTAACCC"), ("dup", "ATGAAACCC"), ("dup", "ATGAAACCCAAA"), ("low", "NNNNNN---ATG"), ("empty", "")])
    kept = rows.filter_sequences(df, drop_internal_stop=True, min_clean_codon_fraction=0.8, dedup="keep-longest").orderBy("input_order").collect()
    assert [(r.id, r.seq) for r in kept] == [("keep", "ATGAAACCC"), ("dup", "ATGAAACCCAAA")]
    report = {(r.input_order): (list(r.reasons), r.internal_stop) for r in rows.filter_report(df, min_clean_codon_fraction=0.8, dedup="keep-first").collect()}
    assert report[1][0] == ["non_triplet"] and report[4][0] == ["duplicate"] and report[2] == (["low_clean_fraction"], False) and report[6][0] == ["low_clean_fraction"]
    for bad in ({"dedup": "some"}, {"min_clean_codon_fraction": 2}):
        with pytest.raises(ValueError):
            rows.filter_report(df, **bad)


def test_validate(spark):
    df = seqs(spark, [("a", "ATGAAACCC"), ("b", "ATGTAACCC"), ("b", "ATGAAACCC"), ("c", "ATGRRRCCC"), ("d", "---NNN"), ("e", "ATGA"), ("f", "ATGTAACCCA--")])
    r = rows.validate_summary(df).first()
    assert (r.num_sequences, r.aligned, r.non_triplet, r.gap_only, r.internal_stop, r.duplicate_ids) == (7, False, 1, 1, 2, 1)
    assert {x.id: x.internal_stop for x in rows.validate_rows(df).where("input_order = 6").collect()} == {"f": True}
    empty = rows.validate_summary(df.limit(0)).first()
    assert (empty.num_sequences, empty.aligned, empty.ambiguous_rate) == (0, True, 0.0)


def test_translate_and_mask(spark):
    df = seqs(spark, [("a", "ATG???TGA"), ("b", "ATG...TGA"), ("c", "ATGTGA"), ("d", "atgGCNtar"), ("e", "A-G---NNN")])
    assert texts(rows.translate(df)) == ["MX*", "M-*", "M*", "MA*", "X-X"]
    assert texts(rows.translate(df, to_stop=True)) == ["MX", "M-", "M", "MA", "X-X"]
    assert texts(rows.translate(df, table=2))[2] == "MW"
    df = seqs(spark, [("a", "GCA---TAGGCTTGACC-GGC"), ("b", "A-GNNNatgAA"), ("c", "")])
    assert texts(rows.mask(df)) == ["GCA---NNNGCTNNNNNNGGC", "NNNNNNatgNNN", ""]
    assert texts(rows.mask(df, "-", ambiguous=False, stop=False)) == ["GCA---TAGGCTTGA---GGC", "---NNNatgAA", ""]


def pad_by_brute_force(seq):
    clean, n = seq.replace("X", "N"), len(seq)
    stops = lambda s: sum(s[k:k + 3].upper() in ("TAA", "TAG", "TGA") for k in range(0, len(s) - 3, 3))
    missing = (3 - n % 3) % 3
    inner = stops(clean + "N" * missing)
    if not inner and not missing:
        return seq
    options = [[(0, 0), (1, 2), (2, 1)], [(0, 1), (1, 0), (2, 2)], [(0, 2), (2, 0), (1, 1)]][missing] if inner else [(0, missing)]
    best = min(options, key=lambda o: stops("N" * o[0] + clean + "N" * o[1]))
    return "N" * best[0] + clean + "N" * best[1]


def test_pad(spark):
    rnd = random.Random(1)
    items = ["", "A", "XX", "ATGTAAATG", "TAATAATAA", "ATGX", "atgtaaatgc"] + ["".join(rnd.choice("ACGTTAXN-") for _ in range(rnd.randint(1, 40))) for _ in range(150)]
    df = seqs(spark, [("s", x) for x in items])
    assert texts(rows.pad(df)) == [pad_by_brute_force(x) for x in items]
    assert all(S_ == 0 for S_ in [r.k for r in rows.pad(df, no_pseudo=True).select(S.stops_before_last(F.col("seq")).alias("k")).collect()])


def test_names(spark):
    df = seqs(spark, [("gene_A.1", "ATGAAA"), ("gene_A.2", "ATGAAACCC"), ("gene_B.1", "ATG"), ("gene_A.3", "CCCAAAATG")])
    got = rows.longest_of_group(df, [r"\.[0-9]+$"]).orderBy("group_order").collect()
    assert [(r.id, len(r.seq)) for r in got] == [("gene_A.2", 9), ("gene_B.1", 3)]
    assert rows.longest_of_group(df, []).count() == 4
    df = seqs(spark, [("dup", "A"), ("dup", "C"), ("uniq", "G")])
    assert texts(rows.relabel(df, unique=True), "id") == ["dup_1", "dup_2", "uniq"]
    assert texts(rows.relabel(df, "du--x", 2), "id") == ["xx", "xx", "xn"]
    for bad in ({"replace_chars": "ab"}, {"replace_chars": "a--bc"}, {"clip_len": -1}):
        with pytest.raises(ValueError):
            rows.relabel(df, **bad)


def test_print_and_remove(spark):
    df = seqs(spark, [("seq1", "ATGNNN"), ("seq12", "ATGNNA"), ("seq1\n", "ATG"), ("", "")])
    assert [r.line for r in rows.print_sequences(df, "seq1").collect()] == [">seq1\nATGNNN"]
    assert [r.line for r in rows.print_sequences(df, "", False).collect()] == [""]
    assert texts(rows.remove_sequences(df, "x", percent=50), "id") == ["seq12", "seq1\n", ""]
    assert texts(rows.remove_sequences(df, "seq.*"), "id") == ["seq1\n", ""]
    with pytest.raises(ValueError):
        rows.remove_sequences(df, percent=101)


def test_stats(spark):
    r = rows.sequence_stats(seqs(spark, [("x1", "GGGAAATTTT"), ("x2", "CATCATTTAA")])).first()
    assert tuple(r) == (2, 20, 0, 0, 0, 25.0)
    assert tuple(rows.sequence_stats(seqs(spark, [("x3", "ggATnN--CAAA")])).first()) == (1, 12, 3, 2, 2, 25.0)
    assert tuple(rows.sequence_stats(seqs(spark, []).limit(0)).first()) == (0, 0, 0, 0, 0, 0.0)


def test_split_and_reverse(spark):
    parts = rows.split_positions(seqs(spark, [("a", "ABCDEFGH"), ("b", "")]))
    assert [texts(parts[k])[0] for k in ("1st", "2nd", "3rd")] == ["ADG", "BEH", "CF"]
    assert value(spark, S.reverse_complement(F.lit("acgtRYN-"))) == "-NRYACGT"


def orf_by_brute_force(seq):
    up = seq.upper()
    minus = up.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    found = []
    for sign, s in ((1, up), (0, minus)):
        for f in range(3):
            end, opened = len(s) - (len(s) - f) % 3, f
            stops = [k for k in range(f, end - 2, 3) if s[k:k + 3] in codes.stops()]
            for k in range(f, end - 2, 3):
                if s[k:k + 3] in codes.starts():
                    later = [x for x in stops if x > k]
                    found.append((2 if later else 1, k, later[0] + 3 if later else end, sign, f))
            for x in [*stops, end]:
                if x - opened >= 3:
                    found.append((0, opened, x, sign, f))
                opened = x + 3
    found = [x for x in found if x[0] > 0] or found
    if not found:
        return ""
    n = len(seq)
    key = lambda x: (x[0], x[2] - x[1], x[3], -x[4], -(x[1] + 1 if x[3] else n - x[2] + 1))
    best = max(found, key=key)
    return (up if best[3] else minus)[best[1]:best[2]]


def test_longest_orf(spark):
    items = {"TTCATGGCATGAGTT": "ATGGCATGA", "GATGTCTTGA": "ATGTCTTGA", "AACTCAGGCCATAAC": "ATGGCCTGA", "ATGTCTTGAATGTCTGGTTAG": "ATGTCTGGTTAG", "TCTATGTCTGGT": "ATGTCTGGT", "GGTGGTGGT": "GGTGGTGGT", "GC": "", "": ""}
    got = orf.longest_orf(seqs(spark, [("s", k) for k in items])).orderBy("input_order").collect()
    assert [r.seq for r in got] == list(items.values())
    assert (got[0].strand, got[0].frame, got[0].orf_start, got[0].orf_end, got[0].category) == ("+", 1, 4, 12, "complete")
    assert (got[2].strand, got[2].category, got[6].strand) == ("-", "complete", None)
    rnd = random.Random(7)
    many = ["".join(rnd.choice("ACGTTGA") for _ in range(rnd.randint(1, 70))) for _ in range(300)]
    assert texts(orf.longest_orf(seqs(spark, [("s", x) for x in many]))) == [orf_by_brute_force(x) for x in many]
    assert orf.annotate_name(orf.longest_orf(seqs(spark, [("s", "TTCATGGCATGAGTT")]))).first().id == "s strand=+ frame=1 start=4 end=12 nt_len=9 aa_len=3 category=complete"


def test_gaps(spark):
    df = seqs(spark, [("a", "ACNNGTnnnnAC"), ("b", "NNN"), ("c", "ACGT"), ("d", "")])
    got = gaps.justify_gaps(df, 5).orderBy("input_order").collect()
    assert [r.seq for r in got] == ["ACNNNNNGTNNNNNAC", "NNNNN", "ACGT", ""]
    assert [(e.start, e.delta) for e in got[0].edits] == [(2, 3), (6, 1)]
    assert texts(gaps.justify_gaps(df, 5, 3)) == ["ACNNGTNNNNNAC", "NNNNN", "ACGT", ""]
    assert texts(gaps.justify_gaps(df, 0, None, 3)) == ["ACGTNNNNAC", "", "ACGT", ""]
    with pytest.raises(ValueError):
        gaps.justify_gaps(df, -1)


@pytest.mark.parametrize("edits,before,after", [
    ([(5, 10), (30, 5)], [10, 50, 20, 60], [20, 65, 30, 75]),
    ([(10, -15), (20, 5)], [8, 30, 9, 35], [13, 20, 14, 25]),
    ([(16, -4), (42, 8), (114, 13), (124, 15), (179, -10), (197, -18)], [180, 198], [212, 220]),
])
def test_coordinates_follow_edits(spark, edits, before, after):
    df = spark.createDataFrame([(k, p, edits) for k, p in enumerate(before)], "input_order long, p int, edits array<struct<start:int,delta:int>>")
    assert texts(df.select("input_order", gaps.shift(F.col("p"), F.col("edits")).alias("seq"))) == after


def test_annotations_of_other_sequences_stay(spark):
    gff = spark.createDataFrame([("a", 1, 12), ("z", 5, 9)], "seqid string, start int, `end` int")
    just = gaps.justify_gaps(seqs(spark, [("a", "ACNNGTACGTAC")]), 4)
    assert {tuple(r) for r in gaps.shift_annotations(gff, just).collect()} == {("a", 1, 14), ("z", 5, 9)}


def test_checks(spark):
    df = seqs(spark, [("a", "ACGT"), ("a", "AC!T$"), ("b", "EFG")])
    assert {r.id: r.characters for r in checks.bad_characters(df, "dna").collect()} == {"a": "!$", "b": "EF"}
    assert checks.bad_characters(df, "protein").count() == 1 and checks.repeated_ids(df).count() == 1
    assert checks.unequal_lengths(df).count() == 3 and checks.unequal_lengths(df.limit(1)).count() == 0
    with pytest.raises(checks.InvalidInput, match="a, 4"):
        checks.enforce(checks.not_triplets(df), "not in frame")
    checks.enforce(checks.not_triplets(df.limit(0)), "not in frame")


def test_protein_features(spark):
    assert len(P.base_features(F.lit("M"))) == 33 and len(P.broad_features(F.lit("M"))) == 58 and len(P.perox_features(F.lit("M"))) == 325
    got = spark.createDataFrame([("MSKL",), ("",), ("MRRAAAAAAWFLVIYSRL",)], "s string").select("s", P.canonical(F.col("s")).alias("c"), *[v.alias(k) for k, v in P.broad_features(P.canonical(F.col("s"))).items()]).collect()
    assert got[0].pts1_match == 1.0 and got[0].pts1_skl == 1.0 and got[1].aa_len == 0.0 and got[1].n20_basic_frac == 0.0 and got[2].rr_hydrophobic_after == 1.0
    assert value(spark, P.canonical(F.lit("mk b*"))) == "MKX" and value(spark, P.canonical(F.lit("M*"))) == "M"
    with pytest.raises(Exception, match="stop inside"):
        value(spark, P.canonical(F.concat(F.lit("M*"), F.lit("K"))))
    assert value(spark, P.hydropathy(F.lit("AR"))) == pytest.approx(-1.35)


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitions(spark, partitions):
    items = [(f"s{k % 5}.{k}", "ACGTTAN-"[k % 8:] * (k % 4)) for k in range(40)]
    df = seqs(spark, items).repartition(partitions)
    assert texts(rows.pad(df)) == [pad_by_brute_force(s) for _, s in items]
    assert rows.longest_of_group(df, [r"\.[0-9]+$"]).count() == 5

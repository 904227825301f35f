"""Sequence formats: round trips, files cut at many places, features with nested locations."""

import random

import pytest
from pyspark.sql import functions as F

from codonspark.sources import formats as R


@pytest.fixture
def cut(spark):
    """Lets files be read in blocks of so many bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield to
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_fastq_cut_anywhere(spark, tmp_path, cut):
    rnd = random.Random(1)
    reads = [(f"r{k}", "".join(rnd.choices("ACGTN", k=rnd.randint(0, 12)))) for k in range(12)]
    whole = [(name, seq, "".join(rnd.choices("@+!I;5", k=len(seq)))) for name, seq in reads]  # qualities that look like heads
    text = ["".join(f"@{n} d{n}\n{s}\n+\n{q}\n" for n, s, q in part) for part in (whole[:7], whole[7:])]
    (tmp_path / "a.fq").write_text(text[0])
    (tmp_path / "b.fq").write_text(text[1].replace("\n", "\r\n") + "\n\n")
    for size in (1000, 37, 23, 11, 5):
        cut(size)
        rows = R.read_fastq(spark, f"{tmp_path}/*.fq").orderBy("input_order").collect()
        assert [(r.id, r.seq, r.quality) for r in rows] == whole and rows[3].description == "r3 dr3", size
    R.write_fastq(R.read_fastq(spark, f"{tmp_path}/a.fq"), f"{tmp_path}/out")
    assert [(r.id, r.seq, r.quality) for r in R.read_fastq(spark, f"{tmp_path}/out").orderBy("input_order").collect()] == whole[:7]
    (tmp_path / "bad").write_text("@a\nACG\n+\nII\n")
    with pytest.raises(Exception, match="no FASTQ record: @a"):
        R.read_fastq(spark, f"{tmp_path}/bad").collect()


EMBL = """ID   X56734; SV 1; linear; mRNA; STD; PLN; 30 BP.
XX
DE   A made-up record,
DE   of two lines
FT   source          1..30
FT                   /organism="Some plant"
FT   CDS             complement(join(3..5,
FT                   10..12))
FT                   /note="said ""so"" in
FT                   two lines"
SQ   Sequence 30 BP;
     acgtacgtac gtacgtacgt        20
     acgtacgtaa                   30
//
ID   Y1; 4 BP.
SQ   Sequence 4 BP;
     ttgg
//
"""

GENBANK = """LOCUS       A1        24 bp
DEFINITION  one.
FEATURES             Location/Qualifiers
     gene            <1..>9
     CDS             join(1..3,complement(7..9),J00194.1:5..6)
                     /codon_start=1
                     /pseudo
                     /db_xref="A:1"
                     /db_xref="B:2"
                     /translation="MK
                     VL"
     misc_feature    order(2,complement(4..5))
ORIGIN
        1 acgtacgtac gtacgtacgt acgt
//
LOCUS       A2        3 bp
ORIGIN
        1 acg
//
"""


def test_embl_and_features(spark, tmp_path, cut):
    (tmp_path / "x.embl").write_text(EMBL)
    for size in (10000, 61, 17):
        cut(size)
        rows = R.read_embl(spark, f"{tmp_path}/x.embl").orderBy("input_order").collect()
        assert [(r.id, r.name, r.description, r.seq) for r in rows] == [("X56734.1", "X56734", "A made-up record, of two lines", "ACGTACGTACGTACGTACGTACGTACGTAA"), ("Y1", "Y1", "", "TTGG")]
        both = R.read_embl(spark, f"{tmp_path}/x.embl").join(R.read_features(spark, f"{tmp_path}/x.embl"), "input_order").orderBy("input_order")
        one = both.first()
        assert [(f.type, f.location, [tuple(p) for p in f.parts]) for f in one.features] == [("source", "1..30", [(1, 30, 1, "", False)]), ("CDS", "complement(join(3..5,10..12))", [(10, 12, -1, "", False), (3, 5, -1, "", False)])]
        assert one.features[1].qualifiers == {"note": ['said "so" in two lines']} and one.features[0].qualifiers == {"organism": ["Some plant"]}
        stretch = both.limit(1).select(R.cut_feature(F.col("seq"), F.get("features", 1)["parts"]).alias("s")).first().s
        assert stretch == "ACGTAC"
    R.write_embl(R.read_embl(spark, f"{tmp_path}/x.embl"), f"{tmp_path}/out")
    again = R.read_embl(spark, f"{tmp_path}/out").orderBy("input_order").collect()
    assert [(r.id, r.description, r.seq) for r in again] == [(r.id, r.description, r.seq) for r in rows]


def test_genbank_features(spark, tmp_path):
    (tmp_path / "x.gb").write_text(GENBANK.replace("\n", "\r\n"))
    rows = R.read_features(spark, f"{tmp_path}/x.gb").orderBy("input_order").collect()
    gene, cds, misc = rows[0].features
    assert rows[1].features == [] and tuple(gene.parts[0]) == (1, 9, 1, "", True)
    assert [tuple(p) for p in cds.parts] == [(1, 3, 1, "", False), (7, 9, -1, "", False), (5, 6, 1, "J00194.1", False)]
    assert cds.qualifiers == {"codon_start": ["1"], "pseudo": [""], "db_xref": ["A:1", "B:2"], "translation": ["MKVL"]}
    assert [tuple(p) for p in misc.parts] == [(2, 2, 1, "", False), (4, 5, -1, "", False)]
    cut = spark.createDataFrame([("ACGTACGTAC", cds.parts), ("ACGTACGTAC", misc.parts)], f"seq string, parts array<{R.PART}>").select(R.cut_feature(F.col("seq"), F.col("parts")).alias("s")).collect()
    assert [r.s for r in cut] == [None, "CTA"]


@pytest.mark.parametrize("text,parts", [
    ("5", [(5, 5, 1, "", False)]), ("3^4", [(3, 4, 1, "", True)]), ("(1.5)..10", [(1, 10, 1, "", True)]), ("complement(<7..9)", [(7, 9, -1, "", True)]), ("complement(complement(1..2))", [(1, 2, 1, "", False)]),
    ("join(complement(order(1..2,5..6)),X.1:8)", [(5, 6, -1, "", False), (1, 2, -1, "", False), (8, 8, 1, "X.1", False)]), ("one-of(1..2,\n4..5)", [(1, 2, 1, "", False), (4, 5, 1, "", False)]), ("2.6", [(2, 6, 1, "", True)]),
])
def test_locations(text, parts):
    assert R.location_parts(text) == parts


def test_bad_locations():
    for bad in ("", "x", "join(1..2", "1...2", "gap(5)"):
        with pytest.raises(ValueError):
            R.location_parts(bad)


ALIGNED = [("s1", "ACGT-ACGTA"), ("s2", "AC--TACG-A"), ("long_name9", "NNNNTACGTA")]
TEXTS = {
    "stockholm": "# STOCKHOLM 1.0\n#=GF ID x\ns1  ACGT-\ns2  AC--T\nlong_name9  NNNNT\n\ns1  ACGTA\ns2  ACG-A\nlong_name9  ACGTA\n#=GC ss ....\n//\n# STOCKHOLM 1.0\na A\nb C\n//\n",
    "clustal": "CLUSTAL W (1.83)\n\ns1          ACGT- 4\ns2          AC--T 3\nlong_name9  NNNNT 5\n            *  .\n\ns1          ACGTA 9\ns2          ACG-A 7\nlong_name9  ACGTA 10\n",
    "phylip": " 3 10\ns1        ACGT-\ns2        AC--T\nlong_name9NNNNT\n\nACGTA\nACG-A\nACGTA\n",
    "phylip-relaxed": "3 10\ns1 ACGT-\nACGTA\ns2 AC--T ACG-A\nlong_name9   NNNNT\n ACGTA\n",
    "nexus": "#NEXUS\n[a comment]\nBegin data;\nFormat datatype=dna gap=- matchchar=.;\nMatrix\ns1 ACGT-\n's2' .C--T\nlong_name9 NNNNT\n\ns1 ACGTA\ns2 ...-.\nlong_name9 [5] .....\n;\nEnd;\n",
}


@pytest.mark.parametrize("form", sorted(TEXTS))
def test_alignments(spark, tmp_path, form, cut):
    (tmp_path / "a").write_text(TEXTS[form])
    (tmp_path / "b").write_text(TEXTS[form].replace("\n", "\r\n"))
    cut(64)
    got = R.read_alignments(spark, f"{tmp_path}/[ab]", form).orderBy("alignment_id", "input_order").collect()
    first = sorted({r.alignment_id for r in got})
    by = {a: [(r.id, r.seq) for r in got if r.alignment_id == a] for a in first}
    assert [by[a] for a in first if len(by[a]) == 3] == [ALIGNED] * 2 and len(first) == (4 if form == "stockholm" else 2)
    kept = R.read_alignments(spark, f"{tmp_path}/a", form)
    R.write_alignments(kept, f"{tmp_path}/out", form)
    again = R.read_alignments(spark, f"{tmp_path}/out" + ("" if form == "stockholm" else "/*"), form)
    assert sorted((r.input_order, r.id, r.seq) for r in again.collect()) == sorted((r.input_order, r.id, r.seq) for r in kept.collect())


def test_alignments_that_do_not_fit(spark, tmp_path):
    (tmp_path / "a").write_text("CLUSTAL\n\na ACG\nb AC\n")
    with pytest.raises(Exception, match="different lengths"):
        R.read_alignments(spark, f"{tmp_path}/a", "clustal").collect()
    for bad in ("2 4\na ACGT\n", "x\n", "1 5\na ACG\n"):
        with pytest.raises(ValueError):
            R.parse_phylip(bad)
    with pytest.raises(ValueError):
        R.parse_nexus("#NEXUS\n")
    with pytest.raises(ValueError):
        R.alignment_text(spark.createDataFrame([(0, 0, "a", "A")], "alignment_id long, input_order long, id string, seq string"), "other")

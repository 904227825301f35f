"""Column operators, joins, labels, metrics, models and sources."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from codonspark import catalog
from codonspark.operators import centroid, joins, labels, metrics, rows, sites
from codonspark.sources import fasta, tables
from codonspark.streaming import kernels


def align(spark, *groups):
    data = [(a, 100 * a + k, f"s{k}", s) for a, group in enumerate(groups) for k, s in enumerate(group)]
    return spark.createDataFrame(data, "alignment_id long, input_order long, id string, seq string").repartition(3)


def texts(df):
    return [r.seq for r in df.orderBy("alignment_id", "input_order").collect()]


def test_trim(spark):
    df = align(spark, ["ATGAAACCCGGG", "ATGNNNCCC---", "ATGAAACCC---"], ["TAA", "ATG"], ["---"])
    assert texts(sites.trim_codons(df, 0.67)) == ["ATGCCC"] * 3 + ["", ""] + [""]
    with pytest.raises(ValueError):
        sites.trim_codons(df, 1.5)
    assert sites.trim_codons(df.limit(0)).count() == 0


def hammer_by_brute_force(group, nail, prevent):
    from codonspark.functions import codes
    cod = [[s[k:k + 3] for k in range(0, len(s), 3)] for s in group]
    aa = lambda c: "-" if set(c) <= set("-.") else "X" if set(c) & set("-?.") else codes.residues()[c] if set(c) <= set("ACGT") else "X"
    occupied = [sum(aa(r[k]) not in "-?X*" for r in cod) for k in range(len(cod[0]))]
    top = len(group) if nail == "all" else min(nail, len(group))
    for n in range(top, 0, -1):
        kept = [k for k, o in enumerate(occupied) if o >= n]
        if not prevent or all(any(not set(r[k]) <= set("-?.NXnx") for k in kept) for r in cod):
            break
    return ["".join(r[k] for k in kept) for r in cod]


@pytest.mark.parametrize("nail,prevent", [(4, True), (2, False), ("all", True), (1, True)])
def test_hammer(spark, nail, prevent):
    rnd = random.Random(5)
    groups = [["ATG---TGA"] * 3 + ["ATGCCCTGA"] * 3, ["---ATG", "---NNN", "ATGATG"]] + [["".join(rnd.choice(["ATG", "---", "NNN", "A-G", "TAA", "CCC"]) for _ in range(6)) for _ in range(rnd.randint(1, 6))] for _ in range(20)]
    assert texts(sites.hammer(align(spark, *groups), nail, prevent)) == [s for g in groups for s in hammer_by_brute_force(g, nail, prevent)]
    with pytest.raises(ValueError):
        sites.hammer_sites(align(spark, ["ATG"]), 0)


def test_degeneracy(spark):
    df = align(spark, ["GCTTTTATA", "GCCTTCATC"], ["GCT", "GAT"], ["GCT", "---"])
    of = lambda fold: texts(sites.degenerate_sequences(df, fold))
    assert of(0)[:2] == ["GCTTAT", "GCTTAT"] and of(2)[:2] == ["T", "C"] and of(3)[:2] == ["A", "C"] and of(4)[:2] == ["T", "C"]
    assert of(0)[2:4] == ["GC", "GA"]
    assert of(4)[2:] == ["", "", "T", "-"]
    with pytest.raises(ValueError):
        sites.degenerate_sequences(df, 1)


def exact_by_brute_force(group, missing="-?."):
    n, columns = len(group), [{k for k, s in enumerate(group) if not set(s[c:c + 3]) & set(missing)} for c in range(0, len(group[0]), 3)]
    best = None
    for size in range(1, n + 1):
        for kept in itertools.combinations(range(n), size):
            area = size * sum(set(kept) <= c for c in columns)
            key = (-area, -size, kept)
            best = key if best is None or key < best else best
    return list(best[2]), -best[0]


def random_alignments(seed, n=12, most=6):
    rnd = random.Random(seed)
    return [["".join(rnd.choice(["ATG", "CCC", "---", "A-G"]) for _ in range(6)) for _ in range(rnd.randint(1, most))] for _ in range(n)]


def test_largest_area(spark):
    groups = [["ATGAAACCCGGG"] * 3 + ["---AAA---GGG"], ["ATGAAA", "ATG---", "---AAA"], ["---"]] + random_alignments(3)
    got = {r.alignment_id: r for r in sites.largest_area(align(spark, *groups)).collect()}
    for a, group in enumerate(groups):
        kept, area = exact_by_brute_force(group)
        assert (list(got[a].kept_orders), got[a].area) == ([100 * a + k for k in kept], area), group
    assert texts(sites.max_align(align(spark, *groups[:2]))) == ["ATGAAACCCGGG"] * 3 + ["ATG", "ATG"]
    assert texts(sites.max_align(align(spark, ["ATGAAACCC", "ATGA-ACCC", "ATGA-ACCC"]))) == ["ATGCCC"] * 3
    kept = sites.largest_area(align(spark, groups[1]), keep="s2").first()
    assert 2 in kept.kept_orders
    assert sites.largest_area(align(spark, groups[0]), max_removed=0).first().kept == 4
    uneven = align(spark, ["ATGAAA"] * 18, groups[1])
    with pytest.raises(ValueError, match="16 sequences"):
        sites.largest_area(uneven)
    assert sorted((r.alignment_id, r.mode, r.kept) for r in sites.largest_area(uneven, over_limit="row").collect()) == [(0, "over the limit", None), (1, "exact", 2)]
    with pytest.raises(Exception, match="more than 63 sequences"):
        sites.presence(align(spark, ["ATG"] * 70)).collect()
    assert sites.presence(align(spark, ["ATG"] * 63)).first().mask == (1 << 63) - 1


def test_greedy_area(spark):
    groups = [["ATGAAACCCGGG"] * 3 + ["---AAA---GGG"]] + random_alignments(8)
    got = {r.alignment_id: r for r in sites.greedy_area(align(spark, *groups)).collect()}
    for a, group in enumerate(groups):
        whole = len(group) * sum(not any(set(s[c:c + 3]) & set("-?.") for s in group) for c in range(0, len(group[0]), 3))
        assert whole <= got[a].area <= exact_by_brute_force(group)[1]
    assert list(got[0].kept_orders) == [0, 1, 2]
    assert all(len(r.kept_orders) == len(groups[r.alignment_id]) for r in sites.greedy_area(align(spark, *groups), max_removed=0).collect())


def greedy_by_brute_force(group, max_removed=None, keep=(), missing="-?."):
    columns = [{k for k, s in enumerate(group) if set(s[c:c + 3]) & set(missing)} for c in range(0, len(group[0]), 3)]
    active, area = set(range(len(group))), len(group) * sum(not c for c in columns)
    while len(active) > 1:
        left = len(group) if max_removed is None else max_removed - len(group) + len(active)
        order, best = list(dict.fromkeys(frozenset(c & active) for c in columns)), None
        order = [s for s in order if s and len(s) <= left and not s & set(keep)]
        for i in range(len(order) - 1, -1, -1):
            for drop in [order[i], *(order[i] | order[j] for j in range(i - 1, -1, -1))]:
                if len(drop) > left:
                    continue
                won = sum(bool(c & active) and c & active <= drop for c in columns)
                new = (len(active) - len(drop)) * (sum(not c & active for c in columns) + won)
                if best is None or ((new - area) / len(drop), won) > best[0]:
                    best = ((new - area) / len(drop), won), new, drop
        if best is None or best[1] <= area:
            break
        active, area = active - best[2], best[1]
    return sorted(active), area


def uneven_alignments(seed, n=20):
    """Up to 40 sequences, many of them equal, with gaps at random and at their ends."""
    rnd = random.Random(seed)
    one = lambda w: ("".join(rnd.choice(["ATG"] * 9 + ["A-G"]) for _ in range(w - rnd.choice([0, 0, 0, 1, 2, 5]))) + "---" * w)[:3 * w]
    return [[rnd.choice(pool) for _ in range(rnd.randint(2, 40))] for pool in ([one(w) for _ in range(rnd.randint(2, 25))] for w in [rnd.randint(6, 14) for _ in range(n)])]


@pytest.mark.parametrize("max_removed", [None, 4])
def test_greedy_rounds_equal_one_task(spark, max_removed):
    groups = uneven_alignments(5) + random_alignments(6, 6)
    few = groups[:6] + groups[-2:]
    whole, rounds = (sites.greedy_area(align(spark, *g), max_removed=max_removed, task_cells=c).collect() for g, c in ((groups, sites.TASK_CELLS), (few, 0)))
    for own, got in ((groups, whole), (few, rounds)):
        assert len(got) == len(own)
        for r in got:
            kept, area = greedy_by_brute_force(own[r.alignment_id], max_removed)
            assert ([k - 100 * r.alignment_id for k in r.kept_orders], r.area) == (kept, area)


def test_max_align_of_all_sizes(spark):
    groups = random_alignments(11, 3) + [g for g in uneven_alignments(12, 12) if len(g) > 16][:4]
    lost = [next(k for k, s in enumerate(g) if k not in greedy_by_brute_force(g)[0]) for g in groups[3:] if len(greedy_by_brute_force(g)[0]) < len(g)]
    assert lost
    for pattern, keep in ((None, ()), (f"s{lost[0]}", (lost[0],))):
        got = {}
        for r in sites.max_align(align(spark, *groups), keep=pattern).collect():
            got.setdefault(r.alignment_id, {})[r.input_order - 100 * r.alignment_id] = r.seq
        for a, group in enumerate(groups):
            if len(group) <= 16 and keep:
                continue
            kept = greedy_by_brute_force(group, keep=keep)[0] if len(group) > 16 else exact_by_brute_force(group)[0]
            whole = [c for c in range(0, len(group[0]), 3) if not any(set(group[k][c:c + 3]) & set("-?.") for k in kept)]
            assert got[a] == {k: "".join(group[k][c:c + 3] for c in whole) for k in kept}
    small = groups[3:4]
    rounds = sites.greedy_area(align(spark, *small), keep=f"s{lost[0]}", task_cells=0).first()
    assert list(rounds.kept_orders) == greedy_by_brute_force(small[0], keep=(lost[0],))[0]


def test_reports(spark):
    df = align(spark, ["ATGAAA---", "ATG---TTT", "ATGNAATTT", "ATGTAATTT"])
    one, columns = sites.trim_report(df, 0.5)
    assert tuple(one.first())[1:] == (4, 3, 2, 1, 0.5)
    assert [tuple(r)[1:] for r in columns.orderBy("codon_site_1based").collect()] == [(1, 1.0, 4, 0, 0, 0, 0, True), (2, 0.25, 1, 3, 1, 1, 1, False), (3, 0.75, 3, 1, 1, 0, 0, True)]
    assert tuple(sites.degeneracy_report(df).first())[1:5] == (4, 9, 3, 0)
    r = sites.max_align_report(df).first()
    assert (r.mode, r.num_input_sequences, r.initial_complete_codon_sites, r.initial_area) == ("exact", 4, 1, 4)
    assert (r.final_area, r.area_delta) == (6, 2) and r.num_kept_sequences * r.final_complete_codon_sites == 6 and r.num_removed_sequences == 4 - r.num_kept_sequences
    large = sites.max_align_report(align(spark, [*["ATGAAA"] * 17, "ATG---"])).first()
    assert (large.mode, large.num_kept_sequences, large.final_area, large.area_delta) == ("greedy", 17, 34, 16)


def test_folds_take_bounded_tasks(spark):
    df = spark.range(3000).select(F.col("id").alias("input_order"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("label"))
    folds = labels.stratified_folds(df, 7)
    plan = folds._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(label#" in plan and "_bucket#" in plan.split("row_number() windowspecdefinition(")[1].split("_h#")[0]
    want = {}
    h = F.conv(F.substring(F.md5(F.concat(F.lit("1/"), F.col("input_order").cast("string"))), 1, 15), 16, 10).cast("long")
    for r in df.withColumn("h", h).orderBy("h").collect():
        want.setdefault(r.label, []).append(r.input_order)
    assert {r.input_order: r.fold for r in folds.collect()} == {x: k % 7 for v in want.values() for k, x in enumerate(v)}


def test_consensus_and_logo(spark):
    df = align(spark, ["ATGCCC---N-A", "ATGCCA---NTA", "CCCCCA---NTC"])
    got = [(r.codon, r.aa) for r in sites.consensus(df).orderBy("site").collect()]
    assert got == [("ATG", "M"), ("CCA", "P"), ("---", "-"), ("NTA", "?")]
    assert {(r.site, r.aa): r.n for r in sites.logo(df).collect()} == {(0, "M"): 2, (0, "P"): 1, (1, "P"): 3}
    assert sites.state_matrix(df).orderBy("input_order").first().states == "ccmm"


def test_back_trim(spark):
    cds = align(spark, ["GCTCCTGCC", "GCTTGTGCA"], ["GCTCCT", "GCTTGT"], ["ATGATG", "ATGATG"], ["ATGCCC", "ATGCCC"])
    pep = align(spark, ["PA", "CA"], ["PA", "CA"], ["M", "M"], ["XW", "XW"])
    assert texts(sites.back_trim(cds, pep)) == ["CCTGCC", "TGTGCA", "CCT", "TGT", "ATG", "ATG", "", ""]


def test_back_trim_of_many_equal_columns_and_digests_in_parts(spark, monkeypatch):
    pairs = [("AAAA" * 3000, "ABAA" * 2000), ("ABC", ""), ("", "A"), ("AABAB", "BBBA"), ("ÄAÄ", "Ä")]
    for codon, aa in pairs:  # the rule word by word: the next column after the last taken one
        last, kept = -1, []
        for x in aa:
            last_ = codon.find(x, last + 1)
            if last_ >= 0:
                last = last_
                kept.append(last)
        assert sites._next_sites(*("".join(c.rjust(sites.KEY, "_") for c in w).encode("latin-1") for w in (codon, aa))) == kept
    rnd = random.Random(5)
    cds = align(spark, *[["".join(rnd.choice(("GCT", "TGT", "GCA", "---", "NNN")) for _ in range(9)) for _ in range(7)] for _ in range(4)])
    trimmed = rows.translate(sites.trim_codons(cds))
    whole = texts(sites.back_trim(cds, trimmed))
    monkeypatch.setattr(sites, "HELD_COLUMNS", 5)
    assert texts(sites.back_trim(cds, trimmed)) == whole and any(whole)


def seqs(spark, items):
    return spark.createDataFrame([(k, i, s) for k, (i, s) in enumerate(items)], "input_order long, id string, seq string")


@pytest.mark.parametrize("cds,aa,want,error", [
    ("ATGAAACCC", "MK-P", "ATGAAA---CCC", None), ("ATGAAACCC", "mk.p", "ATGAAA---CCC", None), ("ATGAAACCC", "MX?", "ATGAAACCC", None), ("ATGAAATAA", "MK", "ATGAAA", None), ("ATGAAATAA", "MK*", "ATGAAATAA", None), ("ATG---AAA", "MK", "ATGAAA", None),
    ("ATGAAA", "MKA", None, joins.TOO_MANY), ("ATGAAA", "MQ", None, joins.MISMATCH), ("ATG@@@", "MK", None, joins.INVALID), ("ATGAAA", "M", None, joins.TOO_FEW), ("ATGAAACCC", "M", None, joins.TOO_FEW), ("ATGA", "M", None, joins.NOT_TRIPLET), ("", "", "", None),
])
def test_back_align(spark, cds, aa, want, error):
    r = joins.back_align(seqs(spark, [("x", cds)]), seqs(spark, [("x", aa)])).first()
    assert (r.seq, r.error) == (want, error)


def test_joins(spark):
    one, two = seqs(spark, [("a", "A"), ("b", "C"), ("b", "G")]), seqs(spark, [("b", "T"), ("c", "T")])
    left, right = joins.common_ids(one, two)
    assert sorted(r.seq for r in left.collect()) == ["C", "G"] and [r.id for r in right.collect()] == ["b"]
    gff = spark.createDataFrame([("seq1", 0, 5), ("seq1", 11, 15), ("seq1", -3, -1), ("seq1", 3, 20), ("other", 1, 2)], "seqid string, start int, `end` int")
    got = joins.clamp_annotations(gff, seqs(spark, [("seq1", "A" * 10)]))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(1, 1), (1, 5), (3, 10), (10, 10)]
    acc = lambda rows_: spark.createDataFrame(rows_, "accession string, sequence string, label string")
    own, others = acc([("A.1", "MK", "x"), ("B", "mp", "x"), ("C", "MV", "x"), (None, None, "x")]), acc([("A.2", "QQ", "x"), ("Z", "MP", "x")])
    assert [r.accession for r in joins.exclude_overlaps(own, others).collect()] in ([None, "C"], ["C", None])
    assert {r.reason: r.n for r in joins.overlap_reasons(own, others).collect()} == {"accession": 1, "sequence": 1, "none": 2}
    both = acc([("A", "MK", "x"), ("B", "MK", "y"), ("C", "MV", "x"), ("D", "mv", "x")])
    assert [(r.n, r.conflict) for r in joins.label_conflicts(both).collect()] == [(2, True)]
    assert [r.accession for r in joins.unique_sequences(both, "accession").collect()] == ["C"]
    hits = spark.createDataFrame([("q", "t1", 5.0), ("q", "t2", 7.0), ("r", "t1", 1.0)], "query string, target string, bits double")
    assert {r["query"]: r.target for r in joins.best_hits(hits).collect()} == {"q": "t2", "r": "t1"}
    wanted = spark.createDataFrame([("AB1.2",), ("CD",), ("EF.1",)], "accession string")
    assert [r.accession for r in joins.missing_accessions(wanted, seqs(spark, [("gi|AB1.1|x", ""), ("CD.3", "")])).collect()] == ["EF.1"]


def test_unique_sequences_takes_other_alphabets_as_they_are(spark, tmp_path):
    docs = spark.createDataFrame([(1, "straße", "de"), (2, "STRASSE", "en"), (3, "été", "fr"), (4, "ÉTÉ", "en"), (5, "Été", "fr"), (6, "mk", "en"), (7, "MK", "fr"), (8, None, "en")], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(r.doc_id for r in catalog.QUERIES["unique_sequences"](spark, str(tmp_path)).collect())
    assert got == sorted(r[0] for r in con.execute(catalog.ORACLES["unique_sequences"]).fetchall()) == [1, 2, 3, 4, 5, 8]


def test_labels(spark):
    text = lambda t: spark.range(1).select(labels.from_location_text(F.lit(t)).alias("x")).first().x
    assert tuple(text("Chloroplast thylakoid lumen")) == ("lTP", "no", False) and tuple(text("Mitochondrion; chloroplast")) == ("cTP", "no", True) and tuple(text(None)) == ("noTP", "no", False)
    strict = lambda t, g: tuple(spark.range(1).select(labels.strict_label(F.lit(t), F.lit(g)).alias("x")).first().x)
    assert strict("thylakoid membrane, lumen", "plant") == (None, "ltp_membrane_noise") and strict("plastid", "fungi") == (None, "nonplant_plastid") and strict("", "plant") == (None, "missing_location_text") and strict("chloroplast thylakoid", "plant") == (None, "thylakoid_not_lumen")
    rows_ = spark.createDataFrame([(1, "2759 33090"), (2, "2759 33208"), (3, "2759;4751"), (4, "2759 5794"), (5, ""), (6, "2")], "k int, lineage_ids string")
    got = {}
    for r in labels.split_by_preset(rows_).collect():
        got.setdefault(r.preset, []).append(r.k)
    assert {k: len(v) for k, v in got.items()} == {"viridiplantae": 1, "metazoa": 1, "fungi": 1, "non_viridiplantae_euk": 3, "protist_core": 1}
    folds = labels.stratified_folds(spark.range(23).select(F.col("id").alias("input_order"), (F.col("id") % 2).alias("label")), 5)
    assert max(r["count"] for r in folds.groupBy("label", "fold").count().collect()) == 3
    assert labels.capped_sample(folds.drop("fold"), 4).count() == 8
    one = lambda v: spark.range(1).select(labels.organism_group(F.lit(v)).alias("g")).first().g
    assert one("Non-Plant") == "non_plant" and one(" Plants ") == "plant" and one("?") is None
    yes = spark.createDataFrame([("TRUE",), ("",), (None,), ("Peroxisome",), ("not_peroxisomal",)], "v string").select(labels.yes_no(F.col("v")).alias("y")).collect()
    assert [r.y for r in yes] == ["yes", "no", "no", "yes", "no"]
    of = spark.createDataFrame([("own", "Fungi", ""), (" ", "Viridiplantae", "2759"), (None, "Fungi", ""), ("", "x", "1 2759 33090"), ("", "", "2759 4751"), ("", None, "2")], "organism_group string, kingdom string, lineage_ids string")
    assert [r.g for r in of.select(labels.organism_group_of(of).alias("g")).collect()] == ["own", "plant", "non_plant", "plant", "non_plant", "unknown"]
    assert of.drop("organism_group", "kingdom").select(labels.organism_group_of(of.drop("organism_group", "kingdom")).alias("g")).first().g == "unknown"


def test_metrics(spark):
    df = spark.createDataFrame(list(zip(["noTP", "SP", "SP", "mTP", "mTP"], ["noTP", "noTP", "SP", "mTP", "SP"], strict=True)), "truth string, predicted string")
    got = {r.label: r for r in metrics.class_metrics(df, labels.CLASSES).collect()}
    assert got["noTP"].tp == 1 and (got["SP"].tp, got["SP"].fp) == (1, 1) and got["mTP"].fn == 1 and got["lTP"].f1 == 0.0
    assert metrics.overall(df, labels.CLASSES).first().accuracy == pytest.approx(0.6)
    score = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.3)], "truth int, score double")
    r = metrics.binary(score).first()
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in (0.9, 0.8, 0.3) for b in (0.8, 0.1)]
    assert r.auroc == pytest.approx(sum(pairs) / 6) and r.auprc == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 4)
    assert metrics.binary(score.where("truth = 1")).first().auroc is None
    grid = [k / 100 for k in range(1, 100)]
    f1 = lambda t: (lambda tp, fp, fn: 2 * tp / (2 * tp + fp + fn))(*(sum(1 for y, s in ((1, .9), (0, .8), (1, .8), (0, .1), (1, .3)) if (s >= t) == p and y == q) for p, q in ((True, 1), (True, 0), (False, 1))))
    best = max(grid, key=lambda t: (round(f1(t), 12), -abs(t - 0.5), -t))
    assert metrics.best_threshold(score).first().threshold == pytest.approx(best)
    multi = spark.createDataFrame([(["a", "b"], ["a"]), ([], []), (["b"], ["a", "b"]), (None, ["a"])], "truth array<string>, predicted array<string>")
    by, one = metrics.multilabel(multi, ("a", "b", "c"))
    assert [tuple(r)[:6] for r in by.collect()] == [("a", 1, 1, 2, 0, 1), ("b", 2, 1, 0, 1, 2), ("c", 0, 0, 0, 0, 4)]
    r = one.first()
    assert (r.subset_accuracy, r.jaccard, r.hamming_loss) == (pytest.approx(0.25), pytest.approx((0.5 + 1 + 0.5 + 0) / 4), pytest.approx(3 / 12))


def test_centroids(spark):
    rnd = random.Random(1)
    data = [(k, c, x + rnd.gauss(0, 1), 3 * x + rnd.gauss(0, 1), 7.0, k % 4) for k in range(200) for c, x in [(("u", 0), ("v", 4))[k % 2]]]
    df = spark.createDataFrame(data, "k int, label string, f double, g double, h double, fold int")
    model = centroid.fit(df, ("f", "g", "h"), classes=("u", "v"))
    import numpy as np
    x = np.array([r[2:5] for r in data])
    std = np.where(x.std(0) < 1e-9, 1, x.std(0))
    for r in model.collect():
        own = x[[k for k, d in enumerate(data) if d[1] == r["class"]]]
        assert np.allclose(r.centroid, (own.mean(0) - x.mean(0)) / std) and r.log_prior == pytest.approx(np.log(101 / 202))
    hit = lambda out: out.where("label = predicted").count()
    assert hit(centroid.predict(df, model, ("f", "g", "h"))) > 190
    folds = centroid.fit(df, ("f", "g", "h"), classes=("u", "v"), fold="fold")
    assert folds.count() == 8 and hit(centroid.predict(df, folds, ("f", "g", "h"), fold="fold")) > 190
    p = {c: F.lit(v) for c, v in zip(labels.CLASSES, (0.1, 0.2, 0.1, 0.4, 0.2), strict=True)}
    row = spark.range(1).select(centroid.choose(centroid.constrain(p, F.lit("non_plant"))).alias("a"), centroid.choose(p, {"cTP": 4.0}).alias("b"), centroid.choose(centroid.scale(p, 0.5)).alias("c"), centroid.two_stage(F.lit(0.8), {c: F.lit(0.25) for c in labels.CLASSES[1:]})["SP"].alias("d")).first()
    assert (row.a, row.b, row.c) == ("SP", "SP", "cTP") and row.d == pytest.approx(0.2)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("\n>s1 first one\nACGT\nAC GT\n\n>s2\r\nAC\r\n>empty\n>s>3 x>y\nAA")
    got = fasta.read_fasta(spark, f"{tmp_path}/a.fa").orderBy("input_order").collect()
    assert [(r.id, r.description, r.seq) for r in got] == [("s1", "s1 first one", "ACGTACGT"), ("s2", "s2", "AC"), ("empty", "empty", ""), ("s>3", "s>3 x>y", "AA")]
    # small files first by name, large ones first for Spark
    (tmp_path / "many").mkdir()
    wanted = []
    for name, n in (("a", 3), ("b", 4000), ("c", 40), ("d", 20000)):
        ids = [f"{name}{k}" for k in range(n)]
        wanted += ids
        (tmp_path / f"many/{name}.fa").write_text("".join(f">{x}\nACGTACGTACGTACGTACGT\n" for x in ids))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = fasta.read_fasta(spark, f"{tmp_path}/many").orderBy("input_order").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [r.id for r in got] == wanted and [r.input_order for r in got] == list(range(len(wanted)))
    df = seqs(spark, [(f"r{k}", "ACGT" * k) for k in range(50)])
    fasta.write_fasta(df, f"{tmp_path}/out")
    back = fasta.read_fasta(spark, f"{tmp_path}/out").orderBy("input_order").collect()
    assert [(r.id, r.seq) for r in back] == [(f"r{k}", "ACGT" * k) for k in range(50)]


GENBANK = """LOCUS       AB1 12 bp DNA
DEFINITION  Some gene of
            something.
ACCESSION   AB1 AB2
VERSION     AB1.3
  ORGANISM  Homo sapiens
            Eukaryota.
FEATURES             Location/Qualifiers
     source          1..12
     CDS             complement(join(1..3,
                     7..9))
                     /gene="x"
ORIGIN
        1 atgcccaaag gg
//
LOCUS       NO1 3 bp DNA
ACCESSION   NO1
ORIGIN
        1 acg
//
"""


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gb").write_text(GENBANK)
    got = fasta.read_genbank(spark, f"{tmp_path}/a.gb")
    r = got.orderBy("input_order").collect()
    assert [(x.id, x.seq, x.cds) for x in r] == [("AB1.3", "ATGCCCAAAGGG", "complement(join(1..3,7..9))"), ("NO1", "ACG", "")]
    assert r[0].description == "Some gene of something"
    named = got.select("input_order", fasta.record_name(F.col("annotations")).alias("n")).orderBy("input_order").first().n
    assert named == "Homo_sapiens_AB1"
    with pytest.raises(Exception, match="no annotation"):
        got.select(fasta.record_name(F.col("annotations"), "organism_taxonomy")).collect()
    assert [x.seq for x in fasta.extract_cds(got).collect()] == ["TTTCAT"]


def test_tables(spark, tmp_path):
    (tmp_path / "a.gff").write_text("##gff-version 3\ns1\tx\tgene\t1\t9\t.\t+\t.\tID=a\n\n \t\n#note\ns2\tx\tCDS\t5\t7\t.\t-\t0\tID=b;c\n")
    gff, header = tables.read_gff(spark, f"{tmp_path}/a.gff")
    assert [(r.seqid, r.start, r.end, r.attributes) for r in gff.orderBy("line_no").collect()] == [("s1", 1, 9, "ID=a"), ("s2", 5, 7, "ID=b;c")] and header.count() == 2
    tables.write_gff(gff, f"{tmp_path}/out", header)
    again, _ = tables.read_gff(spark, f"{tmp_path}/out")
    assert sorted(map(str, again.drop("line_no").collect())) == sorted(map(str, gff.drop("line_no").collect()))
    (tmp_path / "l.txt").write_text("AB1\n\n\t CD2 \t\r\n \t \nEF3\n")
    lines = tables.read_lines(spark, f"{tmp_path}/l.txt")
    assert sorted(list(r.accessions) for r in tables.batches(lines, 2).collect()) == [["AB1", "CD2"], ["EF3"]]
    many = spark.range(1000).selectExpr("id * 3 AS line_no", "concat('v', id) AS value").repartition(7)
    assert {r.batch: list(r.accessions) for r in tables.batches(many, 64).collect()} == {k: [f"v{x}" for x in range(64 * k, min(1000, 64 * k + 64))] for k in range(16)}
    (tmp_path / "t.tsv").write_text("id\tsequence\na\tMK\nb\t\n")
    assert [tuple(r) for r in tables.read_tsv(spark, f"{tmp_path}/t.tsv", ("id",)).collect()] == [("a", "MK"), ("b", "")]
    with pytest.raises(ValueError):
        tables.read_tsv(spark, f"{tmp_path}/t.tsv", ("fold",))
    base = spark.createDataFrame([(k, "x", 0.1) for k in range(4)], "row_idx int, truth string, p double")
    new = spark.createDataFrame([(2, "x", 0.9)], base.schema)
    assert sorted(r.p for r in tables.replace_folds(base, new).collect()) == [0.1, 0.1, 0.1, 0.9]
    for bad in (new.union(new), spark.createDataFrame([(2, "y", 0.9)], base.schema)):
        with pytest.raises(ValueError):
            tables.replace_folds(base, bad)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text(">a\nATGTAAATG\n>b\nNNNATG\n")
    q = kernels.run_kernel(kernels.stream_fasta(spark, f"{tmp_path}/in"), "mask", f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert sorted(r.seq for r in fasta.read_fasta(spark, f"{tmp_path}/out").collect()) == ["ATGNNNATG", "NNNATG"]
    with pytest.raises(ValueError):
        kernels.run_kernel(None, "hammer", "", "")
    totals = kernels.stream_stats(kernels.stream_fasta(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    totals.awaitTermination(60)
    assert {r.id: r.gc for r in spark.table("totals").collect()} == {"a": 2, "b": 1}


def test_rows_and_columns_compose(spark):
    df = align(spark, ["ATGTAA", "ATGCCC"])
    assert texts(rows.mask(sites.trim_codons(df, 0.5))) == ["ATGNNN", "ATGCCC"]

"""Localisation as a whole, thresholds over all scores, and tables of benchmarks."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from codonspark import catalog
from codonspark.operators import centroid, checks, labels, localize, metrics
from codonspark.sources import benchmarks, tables
from tests.conftest import SMALL


def proteins(spark, n=120, seed=2):
    rnd = random.Random(seed)
    heads = {"SP": "MKKLLLLLLLLLLLLLLAGA", "mTP": "MLRRARRSRRSSRRLSRRAA", "noTP": "MDEEDDEEDKEEDDEEDEDE"}
    rows = []
    for k in range(n):
        label = ("SP", "mTP", "noTP")[k % 3]
        rows.append((k, f"a{k}", heads[label] + "".join(rnd.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(60)) + ("SKL" if k % 2 else "DDD"), label, "yes" if k % 2 else "no", k % 4))
    return spark.createDataFrame(rows, "input_order int, accession string, sequence string, localization string, peroxisome string, part int")


def test_learn_and_localize(spark):
    table = proteins(spark)
    model, left_out, report = localize.learn(table, 4, mode="protein")
    assert left_out.count() == 120 and {r.fold for r in left_out.collect()} == {0, 1, 2, 3}
    by_class = {r.label: r for r in report.collect()}
    assert by_class["SP"].f1 > 0.9 and by_class["mTP"].support == 40 and by_class["cTP"].support == 0
    seqs = table.select("input_order", F.col("accession").alias("id"), F.col("sequence").alias("seq"))
    out = localize.localize(seqs, model, "protein", features=True)
    assert out.columns[:9] == ["input_order", "seq_id", "predicted_class", "p_noTP", "p_SP", "p_mTP", "p_cTP", "p_lTP", "p_peroxisome"] and len(out.columns) == 10 + 33
    want = {r.input_order: (r.localization, r.peroxisome) for r in table.collect()}
    got = out.collect()
    assert sum(r.predicted_class == want[r.input_order][0] for r in got) > 110
    assert sum((r.p_peroxisome > 0.5) == (want[r.input_order][1] == "yes") for r in got) > 110
    assert all(r.perox_signal_type == ("PTS1" if want[r.input_order][1] == "yes" else r.perox_signal_type) and abs(sum(r[f"p_{c}"] for c in labels.CLASSES) - 1) < 1e-9 for r in got)
    names = localize.feature_names()
    rows = localize.with_features(seqs, "protein")
    plain = {r.input_order: r.predicted for r in centroid.predict(rows, model.classes, names).collect()}
    assert all(plain[r.input_order] == r.predicted_class for r in got)
    assert localize.localize(seqs.limit(0), model, "protein").count() == 0


def test_folds_and_groups(spark, tmp_path):
    table = proteins(spark, 60)
    model, left_out, _ = localize.learn(table, mode="protein", fold="part")
    seqs = table.select("input_order", F.col("accession").alias("id"), F.col("sequence").alias("seq"))
    for own in (model, localize.Model(model.classes, model.perox, 0.5, {"cTP": 2.0})):
        localize.save(own, f"{tmp_path}/model")
        again = localize.load(spark, f"{tmp_path}/model")
        assert (again.temperature, again.thresholds) == (own.temperature, own.thresholds)
        assert sorted(map(tuple, localize.localize(seqs, again, "protein").collect())) == sorted(map(tuple, localize.localize(seqs, own, "protein").collect()))
    assert {(r.accession, r.fold) for r in left_out.collect()} == {(f"a{k}", k % 4) for k in range(60)}
    for bad in (F.lit("x"), F.lit(1)):
        with pytest.raises(ValueError):
            localize.predefined_folds(table.withColumn("part", bad), "part")
    with pytest.raises(ValueError):
        localize.training_rows(table.drop("localization"))
    text = spark.createDataFrame([("MKV", "Secreted"), ("MKV", "Mitochondrion. Secreted"), ("MKV", "Peroxisome")], "sequence string, cc_subcellular_location string")
    assert [(r.label, r.perox) for r in localize.training_rows(text, mode="protein").collect()] == [("SP", "no"), ("noTP", "yes")]
    names = [("MKV", "Mitochondrion", "peroxisomal"), ("MKV", " thylakoid ", None), ("MKV", "signal-peptide", "na"), ("MKV", "no_TP", "F")]
    table = spark.createDataFrame(names, "sequence string, localization string, peroxisome string")
    assert [(r.label, r.perox) for r in localize.training_rows(table, mode="protein").collect()] == [("mTP", "yes"), ("lTP", "no"), ("SP", "no"), ("noTP", "no")]
    for bad, what in ((("MKV", "bogus", "no"), "no such localization: bogus"), (("MKV", None, "no"), "no such localization"), (("MKV", "SP", "maybe"), "neither yes nor no: maybe"), ((" ", "SP", "no"), "empty sequence")):
        with pytest.raises(Exception, match=what):
            localize.training_rows(spark.createDataFrame([names[0], bad], table.schema), mode="protein").collect()
    coded = spark.createDataFrame([(0, "s", "ATGAAATAA")], "input_order int, id string, seq string")
    row = localize.localize(coded, localize.Model(model.classes, model.perox, 0.5, {"cTP": 9.0}), "dna", group=F.lit("non_plant")).first()
    assert row.p_cTP == row.p_lTP < 1e-20 and row.predicted_class in ("noTP", "SP", "mTP")


def thresholds_by_brute_force(rows):
    out, total = [], sum(t == 1 for t, _ in rows)
    for s in sorted({s for _, s in rows}):
        tp, fp = sum(t == 1 and x >= s for t, x in rows), sum(t != 1 and x >= s for t, x in rows)
        out.append((2 * tp / (tp + fp + total) if tp + fp + total else 0.0, s, tp, fp, total - tp))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_thresholds_over_all_scores(spark, seed):
    rnd = random.Random(seed)
    rows = [(int(rnd.random() < 0.3), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "truth int, score double").repartition(5)
    every = thresholds_by_brute_force(rows)
    best = metrics.best_f1_threshold(df).first()
    assert tuple(best) == pytest.approx((lambda x: (x[1], x[0], *x[2:]))(max(every, key=lambda x: (x[0], x[1]))))
    top = [tuple(r) for r in metrics.f1_thresholds(df, most=7).collect()]
    want = sorted(every, key=lambda x: (-x[0], x[3], -x[2], x[1]))[:7]
    assert [t[0] for t in top] == [w[1] for w in want] and [t[2:] for t in top] == [w[2:] for w in want]


def test_thresholds_without_positives_or_rows(spark):
    df = spark.createDataFrame([(0, 0.25), (0, 0.75), (0, None)], "truth int, score double")
    assert tuple(metrics.best_f1_threshold(df).first()) == (0.75, 0.0, 0, 0, 0)
    assert tuple(metrics.best_f1_threshold(df.limit(0)).first()) == (0.5, 0.0, 0, 0, 0)
    assert [tuple(r) for r in metrics.f1_thresholds(df.limit(0)).collect()] == [(0.5, 0.0, 0, 0, 0)]


def test_benchmark_tables(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">A x\nMK\nV\n>B\nMV\n")
    (tmp_path / "t.tab").write_text("A\tSP\t20\n\nB\tmTP\t0\textra\r\n")
    (tmp_path / "f.tsv").write_text("ids\tfold\torg\ty_type\nA\t0\t1\t2\nB\t1\t0\t3\n")
    got = benchmarks.read_benchmark(spark, f"{tmp_path}/s.fa", f"{tmp_path}/t.tab", f"{tmp_path}/f.tsv")
    assert sorted((r.accession, r.sequence, r.label, r.fold) for r in got.collect()) == [("A", "MKV", "SP", 0), ("B", "MV", "mTP", 1)]
    (tmp_path / "bad.tab").write_text("A\tSP\n")
    with pytest.raises(Exception, match="three cells"):
        benchmarks.read_annotations(spark, f"{tmp_path}/bad.tab").collect()
    (tmp_path / "m.csv").write_text("id,sequence,Nuc,Cyt,Er\na,MK,1,0.0,\nb,,1,1,\nc,MV,0,yes,1.0\nd,MV,0,0,no\n")
    rows = benchmarks.read_multilabel(spark, f"{tmp_path}/m.csv", {"nucleus": ["Nuc"], "inside": ["Cyt", "Er", "none"]})
    assert {r.id: list(r.labels) for r in rows.collect()} == {"a": ["nucleus"], "b": ["nucleus", "inside"], "c": ["inside"], "d": []}
    plain = tables.read_tsv(spark, f"{tmp_path}/m.csv", (), ",").withColumn("labels_text", F.when(F.col("id") == "c", "Er;Other").otherwise(""))
    kept = benchmarks.multilabel_rows(plain, ("Nuc", "Er"))
    assert {r.id: list(r.labels) for r in kept.collect()} == {"a": ["Nuc"], "c": ["Er"]}
    assert tuple(benchmarks.multilabel_summary(rows, ("nucleus", "inside")).first()) == (4, 1, 2, 2)


def test_exports_and_unions(spark, tmp_path):
    (tmp_path / "u.tsv").write_text("Entry\tSequence\tSubcellular location [CC]\nP1\tMK\tSecreted\nP2\tMV\n")
    rows = benchmarks.read_protein_export(spark, f"{tmp_path}/u.tsv")
    assert rows.columns == list(tables.UNIPROT) and sorted((r.accession, r.cc_subcellular_location, r.lineage_ids) for r in rows.collect()) == [("P1", "Secreted", ""), ("P2", "", "")]
    benchmarks.write_protein_export(rows.drop("organism_id"), f"{tmp_path}/out")
    assert sorted(map(tuple, benchmarks.read_protein_export(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, rows.collect()))
    both = benchmarks.union_sources({"x": rows, "y": rows.select("accession")}, ("accession", "sequence"))
    assert sorted((r.source_name, r.accession, r.sequence or "") for r in both.collect()) == [("x", "P1", "MK"), ("x", "P2", "MV"), ("y", "P1", ""), ("y", "P2", "")]
    checks.same_count(rows, rows)
    with pytest.raises(ValueError):
        checks.same_count(rows, both)


def test_query_with_texts_without_letters(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(900001, "", "en", "a", 0), (900002, None, "fr", "a", 0), (900003, "12 --", "es", "a", 5), (900004, "12", None, "a", 2)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    plain = lambda rows: sorted(tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows)
    got = catalog.QUERIES["localize"](spark, str(tmp_path))
    assert plain(got.collect()) == plain(con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES['localize']})").fetchall())

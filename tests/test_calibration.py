"""Calibration, blending, splits and multilabel centroids."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from codonspark.functions import proteins as P
from codonspark.operators import calibration as C
from codonspark.operators import centroid, joins, windows

CLASSES = ("a", "b", "c")


def table(seed, n=120, sharp=3.0):
    rnd, out = random.Random(seed), []
    for k in range(n):
        truth = rnd.choice(CLASSES)
        w = [math.exp(sharp * ((c == truth) * 0.6 + rnd.gauss(0, 0.5))) for c in CLASSES]
        out.append((f"s{seed}", k, k % 3, truth, [x / sum(w) for x in w]))
    return out


SCHEMA = "source string, row_idx int, fold int, truth string, probs array<double>"


def macro(pairs):
    f1 = []
    for c in CLASSES:
        tp, fp, n = sum(t == p == c for t, p in pairs), sum(p == c != t for t, p in pairs), sum(t == c for t, _ in pairs)
        f1.append(2 * tp / (tp + fp + n) if tp else 0.0)
    return sum(f1) / len(f1)


def test_temperature(spark):
    rows = table(1)
    def score(t):
        total = 0
        for r in rows:
            v = [math.log(max(p, 1e-12)) / t for p in r[4]]
            total += v[CLASSES.index(r[3])] - max(v) - math.log(sum(math.exp(x - max(v)) for x in v))
        return total / len(rows)
    want = min(C.TEMPERATURES, key=lambda t: (-round(score(t), 12), abs(t - 1), t))
    df = spark.createDataFrame(rows, SCHEMA)
    assert C.fit_temperature(df, CLASSES) == want and C.fit_temperature(df.limit(0), CLASSES) == 1.0


def test_thresholds_never_lose(spark):
    df = spark.createDataFrame(table(2), SCHEMA)
    found = C.fit_thresholds(df, CLASSES, sweeps=2)
    pairs = lambda t: [(r.truth, CLASSES[r.g]) for r in df.select("truth", C.guess(F.col("probs"), t).alias("g")).collect()]
    assert macro(pairs(found)) >= macro(pairs(None)) and all(x > 0 for x in found)


def test_blends(spark):
    one, two = table(3), table(4)
    two = [("s4", r[1], r[2], one[k][3], r[4]) for k, r in enumerate(two)]
    wide = C.joined_sources(spark.createDataFrame(one + two, SCHEMA), ("s3", "s4"))
    best = C.fit_blend(wide, 2, CLASSES, 4)
    score = lambda w: macro([(a[3], CLASSES[max(range(3), key=lambda i: (w[0] * a[4][i] + w[1] * b[4][i], -i))]) for a, b in zip(one, two, strict=True)])
    assert score(best) == pytest.approx(max(map(score, C.weight_grid(2, 4))))
    by_class = C.fit_blend_by_class(wide, 2, CLASSES, 2)
    mixed = lambda w: macro([(a[3], CLASSES[max(range(3), key=lambda i: (w[i][0] * a[4][i] + w[i][1] * b[4][i], -i))]) for a, b in zip(one, two, strict=True)])
    grid = C.weight_grid(2, 2)
    assert mixed(by_class) >= max(mixed([w] * 3) for w in grid) and all(mixed(by_class) >= mixed([*by_class[:k], w, *by_class[k + 1:]]) - 1e-12 for k in range(3) for w in grid)
    both = C.foldwise_blend(wide, 2, CLASSES, 1, by_class=True)
    assert both.count() == 120 and both.where("predicted IS NULL").count() == 0
    out = C.foldwise_blend(wide, 2, CLASSES, 2)
    assert out.count() == 120 and out.where("predicted IS NULL").count() == 0
    with pytest.raises(ValueError):
        C.joined_sources(spark.createDataFrame(one + two[1:], SCHEMA), ("s3", "s4"))
    assert len(C.weight_grid(3, 4)) == 15
    mean = {r.row_idx: r.probs for r in C.average_folds(spark.createDataFrame(one + two, SCHEMA)).collect()}
    assert mean[0] == pytest.approx([(a + b) / 2 for a, b in zip(one[0][4], two[0][4], strict=True)])


def test_overrides(spark):
    df = spark.createDataFrame([("a", 0.9, True), ("b", 0.9, True), ("a", 0.1, True), ("a", 0.9, False)], "p string, s double, plant boolean")
    got = df.select(C.override(F.col("p"), F.col("s"), 0.5, "c", ["a"], F.col("plant")).alias("x")).collect()
    assert [r.x for r in got] == ["c", "b", "a", "a"]


def test_splits(spark):
    rows = spark.createDataFrame([(f"m{k % 20}", k % 20 < 5) for k in range(60)], "sequence string, label boolean")
    out = C.split_by_hash(rows, 0.2)
    assert out.groupBy(F.upper("sequence")).agg(F.count_distinct("is_valid").alias("n")).where("n > 1").count() == 0
    assert out.where("is_valid").select("sequence").distinct().count() == 4
    data = [(c, k < p) for c, p, n in (("x", 2, 5), ("y", 1, 4), ("z", 0, 9), ("w", 0, 1)) for k in range(n)]
    folds = {r.cluster: r.fold for r in C.cluster_folds(spark.createDataFrame(data, "cluster string, positive boolean"), 2).collect()}
    assert folds == {"x": 0, "y": 1, "z": 1, "w": 0}


def test_multilabel_centroids(spark):
    rnd = random.Random(3)
    data = [(k, [x for x, on in (("u", k % 2), ("v", k % 3 == 0)) if on], 5.0 * (k % 2) + rnd.gauss(0, 1), 5.0 * (k % 3 == 0) + rnd.gauss(0, 1)) for k in range(120)]
    df = spark.createDataFrame(data, "k int, labels array<string>, f double, g double")
    out = centroid.predict_multilabel(df, centroid.fit_multilabel(df, ("f", "g"), ("u", "v")), ("f", "g"))
    assert out.where(F.size("predicted") == 0).count() == 0
    assert out.where((F.size("labels") > 0) & (F.array_sort("predicted") == F.array_sort("labels"))).count() > 70
    high = centroid.predict_multilabel(df, centroid.fit_multilabel(df, ("f", "g"), ("u", "v")), ("f", "g"), {"u": 1.0, "v": 1.0})
    assert high.where(F.size("predicted") != 1).count() < 20


def test_model_files(spark, tmp_path):
    df = spark.createDataFrame([(k, "uv"[k % 2], float(k % 2) + k / 100) for k in range(40)], "k int, label string, f double")
    model = centroid.fit(df, ("f",), classes=("u", "v"))
    centroid.save(model, f"{tmp_path}/m")
    one, two = (sorted((r.k, r.predicted) for r in centroid.predict(df, m, ("f",)).collect()) for m in (model, centroid.load(spark, f"{tmp_path}/m").drop("fold")))
    assert one == two


def test_benchmark_tables(spark):
    s = spark.createDataFrame([("A", "MK"), ("B", "MV")], "accession string, sequence string")
    lab, fold = spark.createDataFrame([("A", "SP"), ("B", "mTP")], "accession string, label string"), spark.createDataFrame([("A", 0), ("B", 1)], "accession string, fold int")
    assert sorted(map(tuple, joins.benchmark_table(s, lab, fold).collect())) == [("A", "MK", "SP", 0), ("B", "MV", "mTP", 1)]
    for bad in (lab.union(lab), lab.limit(1)):
        with pytest.raises(ValueError):
            joins.benchmark_table(s, bad, fold)
    r = joins.leakage(s, spark.createDataFrame([("A.2", "QQ"), ("Z", "mv")], s.schema)).first()
    assert (r.shared_accessions, r.shared_sequences) == (1, 1)


def test_residue_codes_and_cuts(spark):
    got = spark.createDataFrame([("ACX",), ("",), ("ACDEFG",)], "s string").select(P.residue_codes(F.col("s"), 4).alias("a"), P.residue_codes(F.col("s"), 4, True).alias("b")).collect()
    assert [list(r.a) for r in got] == [[1, 2, 21, 0], [0, 0, 0, 0], [1, 2, 3, 4]] and [list(r.b) for r in got] == [[0, 1, 2, 21], [0, 0, 0, 0], [3, 4, 5, 6]]


def cut_by_brute_force(s):
    share = lambda piece, letters: sum(c in letters for c in piece) / len(piece) if piece else 0.0
    best = (-99.0, 0)
    for cut in range(12, min(45, len(s) - 1)):
        core, around, head = s[max(0, cut - 18):max(0, cut - 7)], s[max(0, cut - 7):cut + 2], s[:max(1, cut - 18)]
        run = max((len(x) for x in re.findall("[AILMFWVY]+", core)), default=0)
        score = 2.2 * share(core, "AILMFWVY") + 0.15 * run + 0.8 * (s[cut - 3] in "AVSGTC") + (s[cut - 1] in "ASGTC") + 0.4 * (s[cut - 1] == "A") + 0.5 * share(around, "AGSTCP")
        score += 0.4 * (share(head, "KRH") - share(head, "DE")) - 0.9 * ("P" in s[cut - 3:cut + 1]) - 0.25 * share(s[:cut], "ST")
        if score > best[0] + 1e-12:
            best = (score, cut)
    return best


def test_signal_scan(spark):
    rnd = random.Random(3)
    items = ["MKKLLLLLLLLLLLLLLAGARRRRRRRRRRRR", "MK", "", "M" * 13, "M" * 14] + ["".join(rnd.choice("ACDEFGHIKLMNPQRSTVWYX") for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    names = windows.names()
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(items)], "k int, s string").repartition(3)
    got = windows.with_windows(rows, ["k"], "s", ("scan",)).select("k", *[F.get("scan", k).alias(n) for k, n in enumerate(names["scan"])]).orderBy("k").collect()
    assert len(got[0]) == 69
    for r in got:
        score, cut = cut_by_brute_force(items[r.k])
        assert r.score == pytest.approx(score) and r["cut"] == cut and r.cut_share == pytest.approx(cut / max(1, len(items[r.k]))), items[r.k]
    assert got[2].w0_15_basic == 0.0 and got[1].w0_15_basic == 0.5
    motifs = spark.createDataFrame([("MAARRKK",), ("",)], "s string").select(*[v.alias(n) for n, v in P.motif_places(F.col("s")).items()]).collect()
    assert (motifs[0].RR_found, motifs[0].RR_at, motifs[0].RK_at, motifs[0].SP_at, motifs[1].RR_at) == (1.0, 3.0, 4.0, 999.0, 999.0)


def window_by_brute_force(piece, groups, more):
    share = lambda letters: sum(c in letters for c in piece) / len(piece) if piece else 0.0
    run = max((len(x) for x in re.findall("[AILMFWVY]+", piece)), default=0)
    out = [len(piece)] if more else []
    return [*out, sum(P.HYDROPATHY.get(c, 0) for c in piece) / max(1, len(piece)), run, *map(share, groups.values()), *(map(share, P.AA) if more else [])]


def test_windows_equal_brute_force(spark):
    rnd = random.Random(8)
    items = ["", "M", "MKX", "A" * 140] + ["".join(rnd.choice(P.AA + "XAAVL") for _ in range(rnd.randint(1, 200))) for _ in range(40)]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate([*items, None])], "k int, s string")
    got = {r.k: r for r in windows.with_windows(rows.repartition(2), ["k"], "s").collect()}
    assert list(got[len(items)].windows) == list(got[0].windows)
    for k, s in enumerate(items):
        piece = lambda a, b: s[a:b] if a >= 0 else s[a:]  # noqa: B023, E731
        want = [x for a, b in windows.TRANSIT_WINDOWS for x in window_by_brute_force(piece(a, b), windows.TRANSIT_GROUPS, False)]
        assert list(got[k].transit) == pytest.approx(want), s
        want = [x for a, b in windows.WINDOWS for x in window_by_brute_force(piece(a, b), windows.WINDOW_GROUPS, True)]
        assert list(got[k].windows) == pytest.approx(want), s
        assert list(got[k].places) == [float(i < len(s) and s[i] in g) for i in range(100) for g in windows.PLACE_GROUPS.values()]
    assert {b: len(n) for b, n in windows.names().items()} == {"scan": 68, "transit": 128, "windows": 740, "places": 1000}
    vectors = windows.ensemble_vector(rows.where("s <> ''").withColumnRenamed("k", "input_order").withColumnRenamed("s", "seq"), group=F.lit("plant")).collect()
    broad = rows.where("k = 30").select(P.vector(P.broad_features(F.col("s"), F.lit("plant"))).alias("v")).first().v
    one = next(r.vector for r in vectors if r.input_order == 30)
    assert len(one) == 58 + 68 + 58 + 128 + 24 + 1 + 740 + 1000 and list(one[:58]) == list(broad) == list(one[126:184]) and one[336] == 1.0


def test_blosum_and_proteins(spark):
    got = spark.createDataFrame([("AW-",)], "s string").select(P.blosum_codes(F.col("s"), 4).alias("b")).first().b
    at = P.BLOSUM_ORDER.index
    assert len(got) == 4 and got[0][at("A")] == 4 and got[1][at("W")] == 11 and got[1][at("A")] == -3 and set(got[2]) == set(got[3]) == {0}
    table = [[int(x) for x in line.split()] for line in P.BLOSUM62.strip().splitlines()]
    assert len(table) == 20 and all(table[i][j] == table[j][i] for i in range(20) for j in range(20))
    one = lambda s, mode="auto": spark.createDataFrame([(s,)], "s string").select(P.protein_of(F.col("s"), mode).alias("p")).first().p
    assert one("ATGAAATAA") == "MK" and one("ATGAAATAA", "protein") == "ATGAAATAA" and one("ATGA") == "ATGA" and one("MKX*") == "MKX" and one("atgnnn", "dna") == "MX"
    for bad, mode in (("ATGA", "dna"), ("ATGTAAATG", "auto"), ("M*K", "auto")):
        with pytest.raises(Exception, match="stop inside|multiple of three"):
            one(bad, mode)
    with pytest.raises(ValueError):
        one("A", "x")

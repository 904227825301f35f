"""Sharding, mixing, the Jaccard join, archives, URL classes and the pipeline against brute force."""

import base64
import gzip
import hashlib
import io
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codonspark.llm import common, jaccard, mixing, oracles, queries, sharding, urls, warc
from codonspark.llm.common import Workspace, components, word_count
from tests.conftest import SMALL
from tests.llm.fixtures import awkward, frame, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- sharding


def test_sharding(spark, tmp_path):
    rows = awkward(plain=300)
    got = queries.op1_sharding(spark, table(spark, tmp_path, rows)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_loads_are_bounded_and_moves_limited(spark):
    rows = [(k, "x" * (k % 50)) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, again = (sorted(sharding.shard(df.repartition(n), 8).collect()) for n in (3, 5))
    assert one == again
    loads = Counter()
    for r in one:
        loads[r.shard] += r["size"]
    mean = sum(loads.values()) / 8
    assert max(loads.values()) <= mean * (1 + sharding.SLACK) and min(loads.values()) >= mean * (1 - 8 * sharding.SLACK)
    assert all(r.shard == r.home_shard for r in one if r.passed == 0)
    m = sharding.moved(df, 8, 9).first()
    assert m.n_rows == 4000 and m.n_moved < 4000 * 0.3
    assert sharding.shard(df.limit(0), 8).count() == 0


def shards_by_brute_force(rows, shards):
    """Ring, virtual nodes and bounded loads once more: the heaviest places first, each to the first shard clockwise that has room."""
    place = lambda shard, k: int.from_bytes(hashlib.sha256(f"{shard}/{k}".encode()).digest()[:8], "big") % sharding.POSITIONS
    ring = sorted((place(s, k), s) for s in range(shards) for k in range(sharding.VIRTUAL_NODES))
    loads = Counter()
    for at, size in rows:
        loads[at] += size
    most = (1 + sharding.SLACK) * sum(loads.values()) / shards
    full, to = Counter(), {}
    for at, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        clockwise = [s for p, s in ring if p >= at] + [s for _, s in ring]
        fits = [s for s in clockwise if full[s] + load <= most]
        to[at] = fits[0] if fits else min(range(shards), key=lambda s: (full[s], s))
        full[to[at]] += load
    return to


def test_shards_equal_brute_force(spark):
    rows = [(k, "x" * (k * 7919 % 400)) for k in range(3000)] + [(9000, None), (9001, "é" * 5000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5).collect()
    want = shards_by_brute_force([(r.place, r["size"]) for r in got], 5)
    assert len(got) == len(rows) and all(r.shard == want[r.place] for r in got)
    places = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.place, r.doc_id)):
        places[r.shard].append(r.slot)
    assert all(x == list(range(len(x))) for x in places.values())


def test_overfull_shards_pass_keys_on():
    loads = {k: 100 for k in range(0, 1000, 10)} | {5: 100000}
    to = sharding.walk(loads, 4, positions=1000)
    assert set(to) == set(loads) and to[5][0] in range(4)
    assert len({s for s, _, _ in to.values()}) >= 3


# --- mixing


def wanted_targets(sizes, share=1.5, most=2.0):
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(keys)}
    left, open_, target = share * sum(sizes.values()), set(keys), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if over else level * weight[s]
            left -= target[s]
        open_ -= over or open_
    return target


def seats_by_quotients(weight, house, most):
    """One seat after the other to the highest weight / (2k - 1), equal ones to the smaller party."""
    seats = dict.fromkeys(weight, 0)
    for _ in range(house):
        open_ = [k for k in weight if weight[k] > 0 and seats[k] < most[k]]
        if not open_:
            break
        seats[min(open_, key=lambda k: (-weight[k] / (2 * seats[k] + 1), k))] += 1
    return seats


def taken_by_brute_force(rows, block, shards=8, seed=17):
    """Words that the mix takes of each (id, text, source), word by word, in the order of the rows."""
    md5 = lambda *x: hashlib.md5("/".join(map(str, x)).encode()).hexdigest()
    key = lambda s: "b" if s is None else "a" + s
    lines = defaultdict(list)
    for place, (k, text, source) in enumerate(rows):
        mark = md5(seed, k, text or "")
        bucket = int(mark[:15], 16) % mixing.BUCKETS
        lines[key(source), bucket % shards].append((bucket, mark, place, len(WORDS.findall(text or ""))))
    words = {c: sum(x[3] for x in line) for c, line in lines.items()}
    sizes = Counter()
    for (s, _), n in words.items():
        sizes[s] += n
    target = {key(s): v for s, v in wanted_targets({None if s == "b" else s[1:]: n for s, n in sizes.items()}).items()}
    blocks = {c: -(-n // block) for c, n in words.items()}
    most = {s: 2 * sum(n for (k, _), n in blocks.items() if k == s) for s in sizes}
    due = {s: target[s] * (most[s] // 2) / sizes[s] if sizes[s] else 0.0 for s in sizes}
    per_source = seats_by_quotients(due, int(sum(due.values()) + 0.5), most)
    taken = {}
    for s, seats in per_source.items():
        own = {c: n for c, n in blocks.items() if c[0] == s}
        for c, q in seats_by_quotients(own, seats, {c: 2 * blocks[c] for c in own}).items():
            first = int(md5(seed, c[1], s)[:15], 16) % blocks[c] if blocks[c] else 0
            times = [0] * blocks[c]
            for k in range(q):
                times[(first + k) % blocks[c]] += 1
            at = 0
            for _, _, place, n in sorted(lines[c]):
                taken[place] = sum(times[w // block] for w in range(at, at + n))
                at += n
    return [taken[k] for k in range(len(rows))], per_source


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, tmp_path, monkeypatch, seed):
    rows = [r for r in awkward(seed, plain=200) if r[0] != 7 and r[3] not in ("lonely", "")]
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 4)
    folder = table(spark, tmp_path, rows)
    got = {r.doc_id: r for r in queries.op7_mixing(spark, folder).collect()}
    source, sizes, taken = {r[0]: r[3] for r in rows}, Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    target, block = wanted_targets(sizes), min(512, min(n for n in sizes.values() if n) // 4)
    assert len(got) == len(rows) and block > 10
    want, _ = taken_by_brute_force([(r[0], r[1], r[3]) for r in rows], block)
    assert [got[r[0]].taken for r in rows] == want
    for r in got.values():
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= (block if target[s] == 2 * sizes[s] else 5 * block), s
    again = queries.op7_mixing(spark, folder).repartition(7).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got.values()), key=str)


def test_small_sources_come_near_their_targets(spark, tmp_path):
    rows = awkward(3, plain=200)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    source = {r[0]: r[3] for r in rows}
    for r in queries.op7_mixing(spark, table(spark, tmp_path, rows)).collect():
        taken[source[r.doc_id]] += r.taken
    target = wanted_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= 1 + 0.01 * sizes[s] for s in sizes)


@pytest.mark.parametrize("house", [0, 1, 7, 100, 100000])
def test_seats_go_to_the_highest_quotients(spark, house):
    rnd = random.Random(house)
    parties = [(g, k, rnd.choice([0, 1, 5, 5, 17, 1000]), rnd.choice([3, 50, 100000])) for g in range(4) for k in range(9)]
    df = spark.createDataFrame(parties, "g int, k int, w long, most long")
    got = {(r.g, r.k): r.seats for r in mixing.apportion(df, ["g"], "k", "w", F.lit(house), "most", house).collect()}
    for g in range(4):
        own = [x for x in parties if x[0] == g]
        weight, most = {x[1]: x[2] for x in own}, {x[1]: x[3] for x in own}
        seats = {k: got[g, k] for k in weight}
        assert sum(seats.values()) == min(house, sum(most[k] for k in weight if weight[k]))
        if house < 1000:
            assert seats == seats_by_quotients(weight, house, most)


def test_quotas_add_up(spark):
    lines = spark.createDataFrame([(s, k, n * (k + 3)) for s, n in (("aa", 1000), ("ab", 5000), ("ac", 0), ("b", 70)) for k in range(7)], "key string, shard int, words long")
    seats = defaultdict(list)
    for r in mixing.quotas(lines, shards=7).collect():
        seats[r.key, r.source_seats, r.target, r.source_size].append((r.seats, r.n_blocks))
    for (_, whole, target, size), own in seats.items():
        blocks = sum(n for _, n in own)
        assert sum(q for q, _ in own) == whole and all(q <= 2 * n for q, n in own) and (not size or abs(whole - target * blocks / size) <= 1)
        assert not whole or all(abs(q - whole * n / blocks) < 1.5 for q, n in own)
    assert mixing.quotas(lines.limit(0)).count() == 0


def test_pieces_are_what_was_taken(spark):
    rows = {r[0]: r for r in awkward(plain=150) if r[0] != 7}
    df = frame(spark, list(rows.values()))
    mixed = Workspace(spark, "t").keep(mixing.mix(df), "mixed")
    out = defaultdict(list)
    for r in mixing.pieces(mixed, df).collect():
        assert r.place == 1 and r.key == "k"
        out[r.doc_id].append(r.text)
    for r in mixed.collect():
        assert sum(len(WORDS.findall(t)) for t in out[r.doc_id]) == r.taken
        if r.taken == 2 * r["size"] > 0:
            assert out[r.doc_id] == [rows[r.doc_id][1]] * 2


def test_sql_twin_of_the_mix(spark, tmp_path):
    rows = awkward(4, plain=150)
    rows = [r for r in rows if r[0] != 7]
    folder = table(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.execute(oracles.MIXING_SQL).fetchall()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_mixing(spark, folder).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][:2] + got[k][3:] == want[k][:2] + want[k][3:] and got[k][2] == pytest.approx(want[k][2]) for k in got)


def test_hub_of_links(spark, monkeypatch):
    """Ten thousand pages whose canonical links lead to one hub, which a rule blocks, and as many to one that is allowed."""
    monkeypatch.setattr(common, "SPLIT_ROWS", 500)
    rows = [(k, f"http://a{k}.org/x", f'<link rel="canonical" href="http://{"example.com/en/" if k % 2 else "www.example.com/en/"}hub">') for k in range(10_000)]
    rows += [(-1, "http://example.com/en/hub", ""), (-2, "http://www.example.com/en/hub", ""), (-3, None, None), (-4, "http://b.org/", "")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(got[k] == ("block" if k % 2 else "allow") for k in range(10_000))
    assert (got[-1], got[-2], got[-3], got[-4]) == ("block", "allow", "allow", "allow")


def test_word_count(spark):
    texts = [None, "", " ", "a", " a\tb\x0bc ", "\u00a0x \u2003 y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n for r in df.select(word_count(F.col("text")).alias("n")).collect()] == [len(WORDS.findall(t or "")) for t in texts]


# --- Jaccard join


def components_by_brute_force(rows, n, num, den):
    sets = []
    for _, text in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    low = {i: min(rows[k][0] for k in g) for g in groups.values() for i in g}
    return Counter((rows[i][0], len(sets[i]), low[i]) for i in range(len(rows)))


def near_copies(seed, groups=6, copies=30, length=60, passage=True):
    rnd = random.Random(seed)
    word = lambda: "w" + str(rnd.randrange(5000))
    common = [word() for _ in range(40)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(rnd.choice([8, 12, length, 2 * length]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rnd.randrange(len(w))] = word()
            out.append(" ".join(w[: len(w) - rnd.choice([0, 0, 1, 3])]))
    for _ in range(40):
        out.append(" ".join([word() for _ in range(rnd.randint(2, 40))] + (common if passage else []) + [word() for _ in range(rnd.randint(0, 12))]))
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("n,threshold,small", [(3, "0.9", 512), (3, "0.9", 8), (5, "0.8", 512), (5, "0.8", 10)])
def test_join_equals_brute_force(spark, n, threshold, small):
    rows = near_copies(n * small)
    t = Fraction(threshold)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.near_duplicates(df, n=n, threshold=threshold, small=small, salt=3000).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_brute_force(rows, n, t.numerator, t.denominator)


def test_blocks_after_the_last_round(spark):
    rows = near_copies(5, groups=2, copies=60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_duplicates(df, n=3, threshold="0.9", small=5, most_rounds=0).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_brute_force(rows, 3, 9, 10)


def variants(seed, members=60, length=120, twins=12):
    """Texts that share most of one passage but don't link, and near copies of some of them, which do."""
    rnd = random.Random(seed)
    word = lambda: "w" + str(rnd.randrange(5000))
    base, out = [word() for _ in range(length)], []
    for k in range(members):
        w = list(base)
        for at in rnd.sample(range(length), 6):
            w[at] = word()
        out.append(" ".join(w))
        if k < twins:
            w[rnd.randrange(length)] = word()
            out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize("most_blocks", [10, 1])
def test_regions_of_a_few_blocks_are_not_dealt_out(spark, monkeypatch, most_blocks):
    rows, dealt = variants(3), []
    old = jaccard.JaccardJoin.around_pivots
    monkeypatch.setattr(jaccard.JaccardJoin, "around_pivots", lambda self, *a: dealt.append(1) or old(self, *a))
    limit = {"most_blocks": 1} if most_blocks == 1 else {}
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=3, threshold="0.9", small=10, salt=3000, **limit).collect()
    want = {k: low for k, _, low in components_by_brute_force(rows, 3, 9, 10)}
    assert {r.doc_id: r.component_id for r in got} == want and 40 < len(set(want.values())) < len(want)
    assert bool(dealt) == (most_blocks == 1)


def test_only_the_rarest_cells_lead_to_pivots(spark):
    rows, t = near_copies(9, length=200) + [(1000 + k, x) for k, x in variants(4)], Fraction("0.8")
    join = jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), n=3, threshold="0.8")
    sets, cells = join.sets()
    met = join.met(cells)
    regions = {}
    for r in join.edges(met).collect():
        regions.setdefault(r.node, set()).add(r.region)
    lows = jaccard.rings(t)
    held, kept = (Counter((r.node, r.cell % jaccard.RINGS) for r in df.collect()) for df in (met, spark.read.parquet(join.work.path("rest"))))
    spare = {key: jaccard.spare(key[1], t, lows) if key[1] else 0 for key in held}
    assert max(spare.values()) > 2 and all(kept[key] == max(0, n - spare[key]) for key, n in held.items())
    node = {r.id: r.node for r in sets.collect()}
    shingle_sets = {k: {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} for k, x in rows for w in [x.split()]}
    pairs = [(a, b) for a in node for b in node if a < b and node[a] != node[b] and 10 * len(shingle_sets[a] & shingle_sets[b]) >= 8 * len(shingle_sets[a] | shingle_sets[b])]
    assert len(pairs) > 100 and all(regions[node[a]] & regions[node[b]] for a, b in pairs)


def test_join_bears_awkward_rows(spark, tmp_path):
    rows = awkward()
    got = queries.op3_jaccard_join(spark, table(spark, tmp_path, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_brute_force([(r[0], r[1]) for r in rows], 3, 9, 10)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")
    assert Counter((r.doc_id, r.component_id) for r in jaccard.near_duplicates(nulls).collect()) == Counter([(None, 1), (1, 1), (None, None)])


def test_driver_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op3_jaccard_join(spark, SMALL).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_brute_force(rows, 3, 9, 10)


def test_every_linked_pair_shares_a_cell():
    rnd = random.Random(9)
    for t in (Fraction(9, 10), Fraction(4, 5)):
        linked_pairs_share_cells(rnd, t)


def linked_pairs_share_cells(rnd, t):
    lows = jaccard.rings(t)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(20):
            x = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
            common = rnd.randint(int((float(t) - 0.02) * n), n)
            y = np.unique(np.concatenate((x[:common], np.array([rnd.getrandbits(64) for _ in range(rnd.randint(0, int(n * (1 - t)) + 1))], np.uint64))))
            if jaccard.linked(len(np.intersect1d(x, y)), len(x), len(y), t) and not np.array_equal(x, y):
                both = np.intersect1d(jaccard.cells(x, t, lows), jaccard.cells(y, t, lows))
                per_ring = Counter((both % np.uint64(jaccard.RINGS)).tolist())
                assert any(m > jaccard.spare(r, t, lows) for r, m in per_ring.items()), (len(x), len(y))


@pytest.mark.parametrize("n,threshold,small", [(3, "0.9", 512), (5, "0.8", 10)])
def test_link_counts(spark, n, threshold, small):
    rows, t = near_copies(n + small, groups=4), Fraction(threshold)
    rows.append((9000, rows[0][1]))
    sets = {k: {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} for k, text in rows if (w := text.split())}
    links = lambda x, y: t.denominator * len(x & y) >= t.numerator * len(x | y)
    want = {k: sum(links(x, y) for m, y in sets.items() if m != k) for k, x in sets.items()}
    df = spark.createDataFrame([*rows, (9001, None)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_links for r in jaccard.JaccardJoin(df, n=n, threshold=threshold, small=small, salt=3000).link_counts().collect()}
    assert got == want | {9001: 0} and max(want.values()) > 5


def test_frequent_cells_and_hubs_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_HITS", 2)
    monkeypatch.setattr(jaccard, "CELL_SAMPLE", 2)
    monkeypatch.setattr(common, "SPLIT_ROWS", 3)
    rows = near_copies(11, groups=3, copies=50)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.near_duplicates(df, n=3, threshold="0.9", small=8, salt=2000).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_brute_force(rows, 3, 9, 10)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


# --- archives


def pages_table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string, path string, content string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


PAGES = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "same"), (3, None, "same"), (4, "http://a/4\r\nX: y", ""), (5, "http://a/5", None), (6, "u", "x" * 200_000), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (2, "http://a/2", "same")]


def test_archives_round_trip(spark, tmp_path):
    got = queries.op4_warc(spark, pages_table(spark, tmp_path, [(*r, "p", "c") for r in PAGES])).collect()
    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    first = {}
    for k, _, html in PAGES:
        first[html or ""] = min(k, first.get(html or "", k))
    want = Counter((k, len((h or "").encode()), sha((h or "").encode()), "response" if first[h or ""] == k else "revisit", None if first[h or ""] == k else first[h or ""]) for k, _, h in PAGES)
    assert Counter(map(tuple, got)) == want


def test_archives_keep_payloads(spark):
    df = spark.createDataFrame([(k, f"u{k}", "y" * k) for k in range(50)] + [(None, "n", "none")], "page_id long, url string, html string")
    work = lambda: Workspace(spark, "t")
    archives = warc.write_archives(df, work(), archive_bytes=2000)
    assert archives.count() > 3
    out = warc.read_archives(archives, payloads=True)
    assert sorted((r.payload.decode(), r.uri) for r in out.collect()) == sorted([("y" * k, f"u{k}") for k in range(50)] + [("none", "n")])
    assert warc.read_archives(warc.write_archives(df.limit(0), work())).count() == 0
    small = warc.read_archives(warc.write_archives(df.union(df.where("page_id is null")), work(), least=5)).where("record_type = 'revisit'")
    assert small.count() == 0


def test_copies_are_found_by_key(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "SPLIT_ROWS", 2)
    df = spark.createDataFrame([(k, "u", "same" if k % 2 else f"x{k}") for k in range(20)] + [(None, "u", "same")] * 2, "page_id long, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df, Workspace(spark, "t"))).collect())
    assert got == Counter([(k, "revisit" if k % 2 and k > 1 else "response", 1 if k % 2 and k > 1 else None) for k in range(20)] + [(None, "revisit", 1)] * 2)


def test_zip64_files(spark, tmp_path):
    raw = [("u", warc.record(1, "u", b"one")), ("v", warc.record(2, "v", b"one", 1, True))]
    rows = []
    for name, force in (("a.wacz", False), ("b.wacz", True)):
        content = warc.pack(raw, force)
        assert zipfile.ZipFile(io.BytesIO(content)).testzip() is None
        (tmp_path / name).write_bytes(content)
        rows.append((f"file://{tmp_path}/{name}", len(content)))
    got = warc.read_archives(spark.createDataFrame(rows, "path string, size long")).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter({(1, "response", None, 3): 2, (2, "revisit", 1, 3): 2})


def test_archives_of_others():
    made = lambda kind, block, *more: b"\r\n".join([b"WARC/1.0", b"warc-type: " + kind, b"WARC-Record-ID: <urn:uuid:1-2>", *more, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"
    http = b"Content-Type: application/http;msgtype=response"
    own = [made(b"warcinfo", b"software: x"), gzip.compress(made(b"response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody", http, b"WARC-Target-URI: http://a/")), made(b"request", b"GET / HTTP/1.1\r\n\r\n", http), made(b"revisit", b"HTTP/1.1 200 OK\r\n\r\n", http)]
    offsets = [sum(map(len, own[:k])) for k in range(len(own))]
    index = "\n".join(["!meta {}", *(f'com,a)/ 2020 {{"offset": "{at}", "length": "{len(r)}", "filename": "d.warc.gz"}}' for at, r in zip(offsets, own, strict=True))])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in (("archive/other.warc", b""), ("archive/d.warc.gz", b"".join(own)), ("indexes/index.cdx.gz", gzip.compress(index.encode())), ("datapackage.json", b"{}")):
            z.writestr(name, body)
    content = out.getvalue()
    for range_bytes in (1, 1 << 20):
        got = list(warc.records(lambda at, n: content[at:at + n], len(content), range_bytes))
        assert [(r["type"], r["payload"], r["payload_bytes"]) for r in got] == [("warcinfo", b"software: x", 11), ("response", b"body", 4), ("request", b"", 0), ("revisit", None, None)]
    assert got[1]["uri"] == "http://a/" and got[1]["page_id"] is None and got[1]["record_id"] == "<urn:uuid:1-2>"
    for bad in (b"", b"WARC/1.0\r\nwarc-type: x\r\n\r\n", b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_only_asked_for_ranges_are_read():
    raw = [(f"u{k}", warc.record(k, f"u{k}", b"x" * 5000)) for k in range(40)]
    content, asked = warc.pack(raw), []
    got = warc.records(lambda at, n: asked.append((at, n)) or content[at:at + n], len(content), 12_000)
    assert next(got)["page_id"] == 0 and max(n for at, n in asked[1:]) <= 12_000 and sum(n for _, n in asked) < len(content) * 0.6
    assert len(list(got)) == 39


def test_zip64_directory_and_broken_archives(monkeypatch):
    body = warc.pack([("u", warc.record(1, "u", b"one"))])
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    wide = warc.pack([("u", warc.record(1, "u", b"one"))], True)
    assert b"PK\x06\x06" in wide and b"PK\x06\x06" not in body
    for content in (body, wide):
        asked = []
        read = lambda at, n, c=content: asked.append(n) or c[at:at + n]
        assert [r["payload"] for r in warc.records(read, len(content))] == [b"one"]
    for bad in (b"", body[:-30], body.replace(b"PK\x01\x02", b"PK\x01\x09")):
        with pytest.raises(ValueError):
            list(warc.records(lambda at, n, c=bad: c[at:at + n], len(bad)))


# --- URL classes


def test_rules(spark, tmp_path):
    cases = [("http://WWW.Example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://a.example.com/en/?q", "a.example.com", "/en/", "example.com/en/", "block"),
             ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("x.net/es/", "", "", None, "allow"), ("ftp://net/es/#a", "net", "/es/", "net/es/", "block"),
             ("http://example.com", "example.com", "", None, "allow"), ("http://example.com?x=/en/", "example.com", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://x.net/fr/é", "x.net", "/fr/é", "net/fr/", "block"), ("http://a/b://c.net/es/", "a", "/b://c.net/es/", None, "allow")]
    got = queries.op5_url_filter(spark, pages_table(spark, tmp_path, [(k, c[0], None, "p", "c") for k, c in enumerate(cases)])).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {k: c[1:] for k, c in enumerate(cases)}


def test_classes_propagate_blocks(spark):
    link = lambda u: f'<html><link rel="canonical" href="{u}">'
    rows = [(1, "http://a.org/1", link("http://b.net/es/1")), (2, "http://c.org/2", link("http://a.org/1#x")), (3, "http://d.org/3", '<meta http-equiv="refresh" content="0; url=/4">'), (4, "http://d.org/4", None),
            (5, "http://e.org/5", link("http://b.net/fr/5")), (6, "http://f.org/6", link("http://e.org/5")), (7, "http://x.com/7", link("http://e.org/5")), (8, "http://g.org/8", link("9")), (9, "http://G.org/9", "canonical"), (10, None, link("http://b.net/es/1")), (2, "http://c.org/2", None)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # 7 is allowed by a rule, so its class (5, 6) is allowed as well
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow"}
    moved = spark.createDataFrame([("http://g.org/8", "http://y.net/fr/"), (None, "x")], "source string, target string")
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), moved).collect()}
    assert got[8] == got[9] == "block"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_forms_of_link_targets(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    base = "http://a.org/x/y/p?q=1"
    want = {link("http://b.org/?page=2&amp;ref=x"): "http://b.org/?page=2&ref=x", link("/a&#38;b&#x3D;&#233;&amp;amp;&#0;"): "http://a.org/a&b=é&amp;&#0;", '<meta http-equiv="refresh" content="5; url=/z">': "http://a.org/z", link("../k/./l?u=../v"): "http://a.org/x/k/l?u=../v",
            link("../../../k"): "http://a.org/k", link(".."): "http://a.org/x/", link("?page=2"): "http://a.org/x/y/p?page=2", link("#top"): base, link("k"): "http://a.org/x/y/k", link("/m/../n"): "http://a.org/n", link("//c.org/1"): "http://c.org/1", link("/go?to=http://b.org/"): "http://a.org/go?to=http://b.org/"}
    df = spark.createDataFrame([(h, base) for h in want], "html string, url string")
    got = df.select("html", F.explode(urls.link_targets(F.col("html"))).alias("t"), "url").select("html", urls.resolve(F.col("url"), F.col("t")).alias("t"))
    assert {r.html: r.t for r in got.collect()} == want

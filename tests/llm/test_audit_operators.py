"""Divergence audit, quality classifier and conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from codonspark.llm import classifier, divergence, oracles, queries, repair
from codonspark.llm.common import Workspace
from tests.conftest import SMALL
from tests.llm.fixtures import awkward, frame

# --- divergence audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def audit_by_brute_force(rows, least=3, top=200):
    seen, counts, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", TERM.findall(lowered(text))
        groups[lang].add(source)
        seen.update((lang, t) for t in set(found))
        counts.update((lang, source, t) for t in found)
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in seen.items() if x == lang and n >= least]
        of = lambda s, lang=lang: [counts[lang, s, t] for t in kept]
        share = lambda n, kept=kept: [1 + 10**9 * (c + 1) // (sum(n) + len(kept)) for c in n]
        p = {s: share(of(s)) for s in sources}
        whole = share([sum(x) for x in zip(*map(of, sources), strict=True)])
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(map(f, p[s], p[o])), o.encode()) for o in sources if o != s]
            terms = [(-f(a, b), t.encode()) for t, a, b, n in zip(kept, p[s], whole, of(s), strict=True) if n and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def plain(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def small_bounds(monkeypatch):
    for name, value in (("HELD_TERMS", 30), ("HELD_PAIRS", 20), ("HELD_CANDIDATES", 12), ("PAIR_CHUNK", 10)):
        monkeypatch.setattr(divergence, name, value)


def test_audit_equals_brute_force(spark, small_bounds):
    rnd = random.Random(5)
    words = ["the", "The", "a", "bé", "É", "été", "zeta", "日本", "q1x", "x", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(" ".join(rnd.choice(words) + rnd.choice(["", ".", "'s"]) for _ in range(rnd.randrange(30))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", "S", None])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "fr", "alone"), ("once only", "fr", "two"), ("1 2 3", "it", "x"), (" ".join(["hot"] * 5000), "en", "s1")] + [("same row again", "es", "s1")] * 4
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert plain(divergence.audit(df, top=4)) == audit_by_brute_force(rows, top=4)
    assert divergence.audit(df.limit(0)).count() == 0


def test_audit_of_awkward_documents(spark):
    rows = awkward()
    assert plain(divergence.audit(frame(spark).repartition(3))) == audit_by_brute_force([r[1:4] for r in rows])


def test_shares_are_exact():
    rnd = random.Random(1)
    total = [rnd.randrange(1, 9 * 10**15) for _ in range(300)] + [1, 2]
    count = [rnd.randrange(t) for t in total]
    assert divergence.share(np.array(count), np.array(total)).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count, total, strict=True)]


def test_pairs_of_runs_in_chunks(monkeypatch):
    monkeypatch.setattr(divergence, "PAIR_CHUNK", 4)
    found = [x for i, j in divergence._pairs_of_runs(np.array([0, 1, 4]), np.array([1, 3, 2])) for x in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(found) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (4, 5), (5, 4)]


# --- quality classifier


def test_classifier_on_held_out_rows(spark):
    folder = SMALL.replace("sf0.001", "sf0.1")
    rows = queries.op12_classifier(spark, folder).select("doc_id", "held_out", "score", "predicted").collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{folder}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    unseen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(unseen) > 500 and sum(p == q for p, q in unseen) / len(unseen) > 0.98
    assert sum(p for p, q in unseen if q == 0) / sum(q == 0 for _, q in unseen) < 0.1


def test_normal_equations_equal_a_dense_fit(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 17, (400, len(classifier.STATISTICS)))
    y = (x[:, 0] > x[:, 1]).astype(int) * classifier.LABEL_STEP
    mean, spread = x.mean(0), x.std(0)
    train = spark.createDataFrame([(k % 3, a.tolist(), b) for k, (a, b) in enumerate(zip(x, y.tolist(), strict=True))], "fold int, x array<int>, y int")
    found = [classifier.normal_equations(train.repartition(n), mean, spread) for n in (1, 7)]
    z = classifier._design(x.astype(float), mean, spread)
    for sums in found:
        assert sorted(sums) == [0, 1, 2]
        assert np.array_equal(sum(sums.values()), np.concatenate([z.T @ z, (y @ z)[None]]).astype(np.int64))
    phi = np.c_[np.ones(400), (2 / classifier.FEATURES) ** 0.5 * z[:, 1:] / classifier.FEATURE_STEP]
    shrink = np.diag(np.r_[0, np.full(classifier.FEATURES, classifier.RIDGE * 400)])
    want = phi @ np.linalg.solve(phi.T @ phi + shrink, phi.T @ (y / classifier.LABEL_STEP))
    assert np.allclose(z @ classifier.ridge(sum(found[0].values())), want, atol=1e-6)
    near, far = x[:1] + 2.0, x[:1] + 2.5 * spread  # the features' products are the kernel
    for other in (near, far):
        own = classifier._design(np.concatenate([x[:1], other]).astype(float), mean, spread)[:, 1:] / classifier.FEATURE_STEP
        d = (np.clip((x[:1] - mean) / spread, -5, 5) - np.clip((other - mean) / spread, -5, 5)) ** 2
        assert abs(2 / classifier.FEATURES * own[0] @ own[1] - np.exp(-d.sum() / (2 * classifier.WIDTH**2))) < 0.2


def test_pooling_violators():
    rnd = random.Random(3)
    for _ in range(50):
        n = rnd.randrange(1, 12)
        at, y, w = list(range(n)), [rnd.random() for _ in range(n)], [rnd.randrange(1, 5) for _ in range(n)]
        centres, means = classifier.pool(at, y, w)
        assert centres == sorted(centres) and all(a < b for a, b in zip(means, means[1:], strict=False))
        # each fitted value is the least, over starts after it, of the greatest mean that ends there: the min-max rule
        mean = lambda i, j: sum(a * b for a, b in zip(y[i:j], w[i:j], strict=True)) / sum(w[i:j])  # noqa: E731, B023
        want = [max(min(mean(i, j) for j in range(k + 1, n + 1)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(sorted(set(np.round(want, 9))), np.unique(np.round(means, 9)))


def test_classifier_bears_awkward_rows(spark, tmp_path):
    rows = awkward()
    docs = frame(spark, [*rows, (None, "no id", "en", "x", 5, 1, "k", 2, 3, 4, 5)]).repartition(3)
    labels = spark.createDataFrame([(r[0], k % 2 * 1.0) for k, r in enumerate(rows)] + [(None, 1.0), (5, None), (10**6, 0.0)], "doc_id long, label double")
    got = classifier.classify(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter([*(r[0] for r in rows), None])
    assert not next(r.held_out for r in got if r.doc_id is None)
    by_text = defaultdict(set)
    texts = dict((r[0], r[1] or "") for r in rows)
    for r in got:
        if r.doc_id is not None:
            by_text[texts[r.doc_id]].add(r.score)
    assert all(len(x) == 1 for x in by_text.values())
    again = classifier.classify(docs.repartition(7), labels.repartition(2)).collect()
    assert sorted((r.doc_id or -1, r.score) for r in got) == sorted((r.doc_id or -1, r.score) for r in again)
    none = classifier.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    one = classifier.classify(docs, labels.where("doc_id = 1")).collect()
    assert len(one) == len(rows) + 1 and all(0 <= r.score <= 1 for r in one)
    assert classifier.classify(docs.limit(0), labels).count() == 0


# --- conversation repair

STEPS = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}


def cheapest(letters):
    """Cost and audit by Dijkstra's search over (rows done, state), audits spelled out."""
    heap, done = [(0, "", 0, "E")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(letters) and state in "EA":
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        to = lambda role, state=state: STEPS.get((state, role))
        heap_add = lambda *x: heapq.heappush(heap, x)
        for role in "ua":
            if to(role):
                heap_add(cost + 3, audit + "I", i, to(role))
        if i < len(letters):
            own = letters[i]
            heap_add(cost + 4, audit + "D", i + 1, state)
            more = 3 * own.isupper()
            if to(own.lower()):
                heap_add(cost + more, audit + "K", i + 1, to(own.lower()))
            for role in "ua":
                if own != "d" and to(role):
                    heap_add(cost + 3 + more, audit + "R", i + 1, to(role))
    raise AssertionError


def test_trie_equals_search_and_shares_prefixes():
    rnd = random.Random(1)
    signatures = sorted({"".join(rnd.choice("dsuaoSUAO") for _ in range(rnd.randint(0, 8))) for _ in range(1500)})
    trie = repair.Trie()
    for s in signatures:
        assert trie.insert(s) == cheapest(s), s
    assert trie.computed == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})  # one layer for each node


def repaired_by_brute_force(rows):
    text = lambda v: " " if v is None else str(v)
    by_conv = defaultdict(list)
    for conv, turn, role, body in rows:
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, body = text(role), text(body)
        by_conv[conv]  # every conversation is listed
        if kind == 0:
            continue
        body = "" if kind == 1 else re.sub("[.!?]", "", body) if kind == 2 else body
        by_conv[conv] += [(turn, "user" if kind == 4 else role, body)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, letters, seen = Counter(), "", set()
        for turn, role, body in own:
            ends = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", body)
            fault = "blank" if not ends else "duplicate" if (role, body) in seen else "truncated" if ends[1] not in ".!?" else ""
            seen.add((role, body))
            faults[fault] += 1
            own_role = role[:1] if role[:1] and role[:1] in "sua" else "o"
            letters += "d" if fault in ("blank", "duplicate") else own_role.upper() if fault else own_role
        initials = [r[1][:1] for r in own]
        turns = {r[0] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = cheapest(letters)
        left, done = list(own), []
        for edit in audit:
            row = None if edit == "I" else left.pop(0)
            due = "assistant" if done and done[-1].startswith("u") else "user"
            if edit != "D":
                done.append(f"{row[1]}:{row[2]}" if edit == "K" else f"{due}:{row[2] if row else ''}")
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=2, n=120):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "Why?", "cut", "  ", "", None, "é. \n", "two\nlines.", "日本?"]
    rows = [(conv, turn, rnd.choice(roles[:2] if rnd.random() < 0.7 else roles), rnd.choice(texts) if rnd.random() < 0.5 else f"text {rnd.randrange(99)}.") for conv in range(n) for turn in range(rnd.randrange(1, 9))]
    rows += [(500, None, "user", "Null turn."), (500, None, "user", "Null turn."), (500, 3, "user", "Null turn."), (500, 9, "assistant", "Gap."), (None, 1, "user", "No id."), (None, None, None, None)]
    rows += [(501, 4, "user", "Tie."), (501, 4, "assistant", "Tie."), (501, 4, "user", "Tie."), (501, -3, "user", "x " * 20000)]
    rows += [(502, t, "user" if t % 2 else "assistant", f"{t % 7}.") for t in range(800)]
    rows += [(c, 0, "user", "Only.") for c in range(600, 640)]
    return rows


def test_repair_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, copies int, fault string, cost int").repartition(5)
    want = repaired_by_brute_force(rows)
    assert sorted(map(tuple, repair.repair(repair.damage(df)).collect()), key=str) == want
    assert any(not r[7] for r in want)  # a conversation that lost all its rows
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in rows if r[0] != 502 or r[1] < 60])
    short = repaired_by_brute_force([r for r in rows if r[0] != 502 or r[1] < 60])
    assert sorted(con.execute(oracles.REPAIR_SQL).fetchall(), key=str) == short
    assert repair.repair(repair.damage(df.limit(0))).count() == 0


def test_repair_joins_many_answers(spark, monkeypatch):
    monkeypatch.setattr(repair, "BROADCAST_BYTES", 10)
    rows = conversations(seed=9, n=30)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, repair.repair(repair.damage(df), Workspace(spark, "own")).collect()), key=str) == repaired_by_brute_force(rows)

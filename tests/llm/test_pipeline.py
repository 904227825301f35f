"""The pipeline's stages against plain versions of what they decide."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from codonspark.llm import bpe, mixing, queries, secrets
from tests.llm.fixtures import SCHEMA, awkward
from tests.llm.test_corpus_operators import components_by_brute_force, near_copies
from tests.llm.test_text_operators import counts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_pipeline(spark, tmp_path):
    rnd = random.Random(2)
    rows = [r for r in awkward() if r[0] != 7]
    rows += [(1000 + k, t + (' token = "abcdefghij1234"' if k % 5 == 0 else ""), "en", f"src{k % 4}", len(t), 1, "k", 2, 3, 4, 5) for k, t in near_copies(8, length=90)]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, frames = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append({r.doc_id: r for r in docs.collect()} if k < 3 else docs.collect())

    def good(text):
        n, chars, symbols, dup, repeat = counts(text or "")
        return not (n < 50 or 2 * repeat > n or 2 * symbols > 3 * n or 10 * dup > 3 * n or chars > 20 * n or chars < 2 * n)

    kept = [r for r in rows if good(r[1])]
    assert set(frames[0]) == {r[0] for r in kept}
    firsts = {low for _, _, low in components_by_brute_force([(r[0], r[1]) for r in kept], 5, 8, 10)}
    assert set(frames[1]) == firsts and 0 < len(firsts) < len(kept)
    text = {r[0]: r[1] for r in rows}
    assert set(frames[2]) == firsts
    for k, r in frames[2].items():
        want = re.sub(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""", "[SECRET]", text[k])
        assert r.text == want and r.n_chars == len(want)
    sizes, taken = Counter(), Counter()
    for r in frames[2].values():
        sizes[r.source] += len(WORDS.findall(r.text))
    pieces = defaultdict(list)
    for r in frames[3]:
        taken[r.source] += len(WORDS.findall(r.text))
        pieces[r.doc_id].append(r.text)
    target = {r.key[1:] or None: r.target for r in mixing.targets(spark.createDataFrame([("a" + k if k is not None else "b", v) for k, v in sizes.items()], "key string, source_size long")).collect()}
    assert all(abs(taken[s] - target[s]) <= max(40, 0.03 * sizes[s]) for s in sizes)
    assert all(len(v) <= 2 for v in pieces.values())
    tok = bpe.tokenizer(queries.vocabulary())
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in frames[4]) == Counter((r.doc_id, tuple(ids := tok.encode(r.text)), len(ids)) for r in frames[3])
    assert sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, tuple(r.ids)) for r in frames[4])
    assert secrets.PATTERNS and [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

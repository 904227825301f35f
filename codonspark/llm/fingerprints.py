"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words.

A text's sections end at blank lines, its paragraphs at line feeds, and a paragraph is cut into runs of ``RUN`` words. Cuts
keep every character, so the leaves put together are the text. A leaf's digest is that of its characters; a node's is that
of its children's digests. Equal roots mean equal texts; below unequal roots, equal branches are passed over whole and the
others lead to the edited leaves.

A fingerprint is written ``root;section[paragraph(leaf,leaf)paragraph(...)]section[...]``: the root in 32 hex digits, the rest in
eight to a node. Likeness and edits are found from two fingerprints alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing, text_or_empty

RUN = 8
SHORT = 8  # hex digits of a node below the root
ROWS_OF_A_BUCKET = 1000
MOST_BUCKETS = 20_000
BUCKETS_OF_A_TASK = 2
OUT_ROWS = 500
KNOWN = 1_000_000  # letters of texts whose paragraphs' and leaves' digests a task holds
#: What sections, paragraphs, runs and a written tree's branches are; _sections, _paragraphs and _branches cut the same, faster.
_SECTION = re.compile(r"(?s).+?(?:\n[ \t\r]*\n\s*|\Z)")
_PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+")
_BLANK = re.compile(r"\n[ \t\r]*\n\s*")
_RUN = re.compile(r"\s*+(?:\S++\s*+){1,%d}+|\s++" % RUN)  # possessive: words and gaps have no letter in common
_TREE = re.compile(r"([0-9a-f]{8})\[(.*?)\]")
_BRANCH = re.compile(r"([0-9a-f]{8})\((.*?)\)")


def _digest(data: str, size: int = SHORT // 2) -> str:
    return blake2b(data.encode(), digest_size=size).hexdigest()


def _sections(text: str) -> Iterator[str]:
    """Up to the end of each blank line that has something before it, and the rest."""
    start = 0
    while start < len(text):
        found = _BLANK.search(text, start + 1)
        end = found.end() if found else len(text)
        yield text[start:end]
        start = end


def _paragraphs(section: str) -> list[str]:
    *whole, last = section.split("\n")
    return [f"{p}\n" for p in whole] + ([last] if last else [])


def fingerprint(text: str, known: tuple[dict[str, str], dict[str, str]] | None = None) -> str:
    """The text's tree, written out. The empty text has a root and no sections.

    ``known`` has paragraphs and leaves of other texts with what was written for them, and gets this one's.
    """
    out = []
    whole, digests = known or ({}, {})
    for section in _sections(text):
        body = []
        for paragraph in _paragraphs(section):
            written = whole.get(paragraph)
            if written is None:
                leaves = []
                for run in _RUN.findall(paragraph):
                    leaf = digests.get(run)
                    if leaf is None:
                        leaf = digests[run] = _digest(run)
                    leaves.append(leaf)
                leaves = ",".join(leaves)
                written = whole[paragraph] = f"{_digest(leaves)}({leaves})"
            body.append(written)
        body = "".join(body)
        out.append(f"{_digest(body)}[{body}]")
    # the root is of the text itself: 128 bits stand for equality
    return f"{_digest(text, 16)};{''.join(out)}"


def _branches(written: str, closes: str) -> list[tuple[str, str]]:
    """(digest, body) of the branches in ``written``, a tree after its root or a branch's body."""
    return [(x[:SHORT], x[SHORT + 1:]) for x in written.split(closes)[:-1]]


def _rest(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """The bodies of the branches of each side that have no equal on the other."""
    keys, others = dict(a), dict(b)
    if len(keys) == len(a) and len(others) == len(b):
        return [body for k, body in a if k not in others], [body for k, body in b if k not in keys]
    here, there = Counter(k for k, _ in a), Counter(k for k, _ in b)
    only, other = here - there, there - here
    out = ([], [])
    for side, branches, more in ((0, a, only), (1, b, other)):
        for key, body in reversed(branches):
            if more[key] > 0:
                more[key] -= 1
                out[side].append(body)
    return out


def likeness(a: str, b: str) -> float:
    """Share of leaves that two trees have in common: 2 * common / all, 1 for equal texts, from the fingerprints alone.

    Equal sections are passed over whole, then equal paragraphs of the rest, then leaves are matched.
    """
    if a[:32] == b[:32]:
        return 1.0
    total = a.count(",") + a.count("(") + b.count(",") + b.count("(")
    if not total:
        return 0.0
    left, right = _rest(_branches(a[33:], "]"), _branches(b[33:], "]"))
    left, right = _rest(_branches("".join(left), ")"), _branches("".join(right), ")"))
    x, y = (",".join(side).split(",") if side else [] for side in (left, right))
    held, other = set(x), set(y)
    both = held & other
    if both and (len(held) < len(x) or len(other) < len(y)):
        n, m = Counter(x), Counter(y)
        same = sum(min(n[k], m[k]) for k in both)
    else:
        same = len(both)
    return (total - (len(x) + len(y) - 2 * same)) / total


def _aligned(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
    """(place in a, body, body in b or '') of the branches of ``a`` that have no equal in order in ``b``: a changed run of branches meets
    the run that stands in its place, so that inserted branches don't shift the later ones."""
    match, out = SequenceMatcher(None, [k for k, _ in a], [k for k, _ in b], autojunk=False), []
    for kind, i, j, m, n in match.get_opcodes():
        if kind in ("replace", "delete"):
            out += [(k, a[k][1], b[m + k - i][1] if m + k - i < n else "") for k in range(i, j)]
    return out


def differing(a: str, b: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, leaf) of the leaves of ``a`` that ``b`` does not have in that place, found below differing branches only."""
    if a[:32] == b[:32]:
        return []
    out = []
    for i, body, other in _aligned(_branches(a[33:], "]"), _branches(b[33:], "]")):
        for j, leaves, held in _aligned(_branches(body, ")"), _branches(other, ")")):
            pairs = [[(x, "") for x in side.split(",") if x] for side in (leaves, held)]
            out += [(i, j, k) for k, _, _ in _aligned(*pairs)]
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row; a null text counts as empty. Other columns aren't read."""
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(fingerprint, texts), pa.string())], ["id", "n_chars", "fingerprint"])

    out = rows.mapInArrow(releasing(run), f"id {rows.schema['id'].dataType.simpleString()}, n_chars long, fingerprint string")
    return out.withColumnRenamed("id", id_col)


def in_turn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, spare, id, text), placed and sorted so that a task that reads on finds each row's next one right after it.

    The order is by falling id, equal ids by a hash of the text, null ids last; after the last row comes the first. Buckets
    are ranges of ids; a bucket's first row is repeated, as spare, at the end of the bucket before it. One shuffle moves
    each text once. The bounds are a sketch's quantiles over all ids, at most MOST_BUCKETS.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    n = rows.count()
    buckets = max(1, min(MOST_BUCKETS, n // ROWS_OF_A_BUCKET))
    cuts = rows.agg(F.percentile_approx("id", [k / buckets for k in range(1, buckets)], 20 * buckets)).first()[0] if n and buckets > 1 else []
    bounds = sorted(set(cuts or []))

    # a search by halves over the bounds, whose places below an id are counted
    table, below, step = F.array(*map(F.lit, bounds)).cast("array<bigint>"), F.lit(0), 1 << len(bounds).bit_length()

    def further(n: int) -> Callable[[Column], Column]:
        # of one argument: Spark gives a second one, even one with a default, the element's place
        return lambda at: F.when(F.coalesce(F.get(table, at + (n - 1)) < F.col("id"), F.lit(False)), at + n).otherwise(at)

    while step := step >> 1:
        below = F.get(F.transform(F.array(below), further(step)), 0)
    bucket = F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - below).cast("int")
    placed = rows.select(bucket.alias("bucket"), "id", "text", "h")
    first = placed.groupBy("bucket").agg(F.max(F.struct("id", "h")).alias("top")).orderBy("bucket").collect()
    before = [(r.bucket, r.top.id, r.top.h, first[k - 1].bucket) for k, r in enumerate(first)]
    table = spark.createDataFrame(before, "b int, top long, top_h long, before int")
    match = (F.col("bucket") == F.col("b")) & F.col("id").eqNullSafe(F.col("top")) & (F.col("h") == F.col("top_h"))
    both = placed.join(F.broadcast(table), match, "left")
    own = F.struct("bucket", F.lit(0).alias("spare"))
    at = F.explode(F.when(F.col("b").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(1).alias("spare"))))).alias("at")
    out = both.select(at, "id", "text", "h").select("at.bucket", "at.spare", "id", "text", "h")
    # a fixed number of partitions, which aren't put together by the bytes they read: the work on a text takes longer than to read it
    return out.repartition(max(1, buckets // BUCKETS_OF_A_TASK), "bucket").sortWithinPartitions("bucket", "spare", F.col("id").desc_nulls_last(), F.col("h").desc())


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def against_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    near_edited: likeness to the fingerprint of ``edited`` with the next row's text; near_next: to the next row's. A single
    row is its own next one. Null texts count as empty, empty texts are like each other (1) and unlike others (0).
    """
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in schema.split(", ")]
        out, now, known, held = [], None, ({}, {}), 0
        for batch in batches:
            for bucket, spare, key, text, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # an edited text has most paragraphs and leaves of its two texts
                following = (bucket, key, text, fingerprint(text, known))
                if now and now[0] == bucket:
                    new = edited(now[2], text)
                    tree = fingerprint(new, known)
                    out.append((now[1], len(now[2]), hashlib.sha256(new.encode()).hexdigest(), now[3], tree, likeness(now[3], tree), likeness(now[3], following[3])))
                now = None if spare else following
                held += 2 * len(text)
                if held > KNOWN:
                    known, held = ({}, {}), 0
                if len(out) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return in_turn(df, id_col, text_col).mapInArrow(releasing(run), schema).withColumnRenamed("id", id_col)

"""Source divergence audit: how far the term shares of a language's sources lie from each other, by sort-based streaming.

Terms are runs of letters ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lowered. A language keeps the terms that at least MIN_DOCUMENTS
of its documents hold; a document is a row. For a group (a source, or the whole language) a kept term with c >= 0 occurrences has
the share p = 1 + floor(10^9 (c + 1) / (N + V)): N are the group's occurrences of kept terms, V the language's kept terms. All numbers are integers.

1. Each task tokenises its rows and combines the sorted (lang, source, term, document) records that lie in it: all of a document's
   words are there, so documents and occurrences are counted before anything is shuffled. The counts are flushed at a bound.
2. The partial runs are dealt out by (lang, term, source) and sorted so; a scan adds up runs of equal keys. A frequent term has one
   row here from each flush and source, and its sources lie in different tasks.
3. They are dealt out by (lang, term) and sorted by source: one row for each source. A scan over each run yields the document
   frequency, and the rows of kept terms with the language's count beside them. N and V are sums of these.
4. With N and V beside them, the rows are streamed by (lang, term, source) once more. Each run emits partial pairs, for the sources
   that hold the term, and terms. A task adds its pairs up before they leave it, and holds the best terms of each group only.

A pair's value is a sum over all kept terms, also those that one or both sources lack. With f(p, q) = floor((p - q)^2 / q) and a0, b0
the shares of no occurrence, it is V f(a0, b0) + sum over a's terms of f(p, b0) - f(a0, b0) + the same for b's + sum over shared terms of
f(p, q) - f(p, b0) - f(a0, q) + f(a0, b0). The last sum comes from the runs; the others depend on how many terms of a group have each
share, so the runs also emit these counts. Work grows with the pairs of sources that share a term, and the result with the pairs
of a language's sources, as the report lists them all.

Null text, lang and source read as ''. A group without kept terms takes part with N = 0; where V = 0 all values are 0. Empty tables give no
rows; repeated rows are documents of their own; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Workspace, releasing, small_batches, text_or_empty

SCALE, MIN_DOCUMENTS, TOP_TERMS = 1_000_000_000, 3, 200
#: Counts of terms that a task holds before it flushes them; pairs of sources, and candidates of the term report.
HELD_TERMS, HELD_PAIRS, HELD_CANDIDATES = 800_000, 1_000_000, 400_000
#: The sort's columns: the term first, as a sort compares the first eight bytes of its first column at once, and languages are few.
ORDER = ("term", "lang", "source")
#: Rows of an Arrow batch: texts on the way in, and short rows in the scans.
BATCH = 5000
#: Pairs of rows that are worked out at once.
PAIR_CHUNK = 1_000_000
#: Documents share one integer with occurrences while they are counted.
DOCUMENT = 1 << 40
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_LETTERS).split()


def partial_runs(docs: DataFrame) -> DataFrame:
    """(lang, term, source, docs, n): document frequencies and occurrences of each task's rows, combined."""
    names = ["lang", "term", "source", "docs", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, int]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in groups.items():
                packed = np.fromiter(counts.values(), np.int64, len(counts))
                own = [pa.repeat(lang, len(counts)), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.repeat(source, len(counts))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(packed // DOCUMENT), pa.array(packed % DOCUMENT)], names)
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts = groups.setdefault((lang, source), {})
                before = len(counts)
                for term, n in Counter(terms(text.as_py())).items():
                    counts[term] = counts.get(term, 0) + DOCUMENT + n
                held += len(counts) - before
                if held >= HELD_TERMS:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(releasing(run), "lang string, term string, source string, docs long, n long")


def _starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Which rows of a sorted batch differ from the row before in the first ``keys`` columns; the first does."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        column = batch.column(k)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return new


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches, cut so that no run of equal first ``keys`` columns is split. A run's rows are held until it ends:
    one for each of a language's sources."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(np.flatnonzero(_starts(batch, keys))[-1])
        joins = rest and all(rest[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in range(keys))
        if rest and not joins:
            yield _joined(rest)
            rest = []
        if last:
            yield _joined([*rest, batch.slice(0, last)])
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield _joined(rest)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def _long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def summed_runs(rows: DataFrame) -> DataFrame:
    """(lang, term, source, docs, n), once for each key: a scan over rows sorted by it that adds up each run as it passes."""
    names = ["lang", "term", "source", "docs", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.RecordBatch | None = None  # the sum so far of the run that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            if open_ is not None:
                batch = pa.concat_batches([open_, batch])
            at = np.flatnonzero(_starts(batch, 3))
            sums = [pa.array(np.add.reduceat(_long(batch.column(k)), at)) for k in (3, 4)]
            keys = batch.select(names[:3]).take(pa.array(at))
            out = pa.RecordBatch.from_arrays([*keys.columns, *sums], names)
            yield out.slice(0, out.num_rows - 1)
            open_ = out.slice(out.num_rows - 1)
        if open_ is not None:
            yield open_

    return rows.repartition("lang", "term", "source").sortWithinPartitions(*ORDER).mapInArrow(releasing(run), "lang string, term string, source string, docs long, n long")


def kept_terms(rows: DataFrame, least: int) -> DataFrame:
    """(lang, term, source, n, all_n, first): rows of terms in at least ``least`` documents of their language; all_n is the language's
    count, first marks one row of each term."""
    names = ["lang", "term", "source", "n", "all_n", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(batches, 2):
            new = _starts(batch, 2)
            at, own = np.flatnonzero(new), np.cumsum(new) - 1
            docs, n = (np.add.reduceat(_long(batch.column(k)), at)[own] for k in (3, 4))
            keep = pa.array(docs >= least)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(keep) for k in (0, 1, 2, 4)), pa.array(n).filter(keep), pa.array(new).filter(keep)], names)

    ordered = rows.repartition("lang", "term").sortWithinPartitions(*ORDER)
    return ordered.mapInArrow(releasing(run), "lang string, term string, source string, n long, all_n long, first boolean")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total) exactly, by long division in base 1000: count < total < 9 * 10^15."""
    rest, out = count + 1, np.zeros_like(count)
    whole, rest = np.divmod(rest, total)
    out = whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _PairSums:
    """Sums by (language, source, source); sorted and added up when many are held."""

    def __init__(self) -> None:
        self.names: dict[tuple[str, str], int] = {}
        self.keys, self.values, self.held = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        self.keys.append(np.stack([a, b], 1))
        self.values.append(value)
        self.held += len(value)
        if self.held > 2 * PAIR_CHUNK:
            self.settle()

    def settle(self) -> int:
        keys, values = np.concatenate(self.keys), np.concatenate(self.values)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, values = keys[order], values[order]
        at = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.values = [keys[at]], [np.add.reduceat(values, at) if len(at) else values]
        self.held = 0
        return len(at)

    def flush(self) -> pa.RecordBatch:
        self.settle()
        of = list(self.names)
        a, b = self.keys[0][:, 0].tolist(), self.keys[0][:, 1].tolist()
        out = _rows("pair", [of[k] for k in a], [of[k][1] for k in b], self.values[0])
        self.keys, self.values = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
        return out


def _rows(kind: str, groups: list[tuple[str, str]], items: list[str] | pa.Array, values: np.ndarray) -> pa.RecordBatch:
    columns = [pa.repeat(kind, len(groups)), *(pa.array([g[k] for g in groups], pa.string()) for k in (0, 1)), items if isinstance(items, pa.Array) else pa.array(items, pa.string()), pa.array(values, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "lang", "source", "item", "value"])


def _pairs_of_runs(at: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes (i, j) of all ordered pairs of different rows in each run, at most about PAIR_CHUNK at a time."""
    start = np.repeat(at, size)  # of each row's run
    width = np.repeat(size, size)
    done = 0
    ends = np.cumsum(width)
    while done < len(width):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIR_CHUNK, "right")))
        own = width[done:stop]
        i = np.repeat(np.arange(done, stop), own)
        j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(start[done:stop], own)
        yield i[i != j], j[i != j]
        done = stop


def run_reports(rows: DataFrame, top: int) -> DataFrame:
    """(kind, lang, source, item, value) that the runs of a language's terms emit; rows: (lang, term, source, n, all_n, total, all_total).

    ``pair``: partial sums over shared terms; ``share``: how many terms of the source have the share ``item``; ``term``: each task's
    best terms of a group, ``top`` at most (ties by term), which hold the best of all tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shares = _PairSums(), Counter()
        best: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # group, value, term; terms of a group stand in order
        held = 0

        def cut() -> None:
            if not best:
                return
            group, value = (np.concatenate([x[k] for x in best]) for k in (0, 1))
            term = pa.concat_arrays([x[2] for x in best])
            order = np.lexsort((np.arange(len(group)), -value, group))
            sorted_ = group[order]
            place = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
            keep = np.sort(order[place < top])  # in the order they came
            best[:] = [(group[keep], value[keep], term.take(pa.array(keep)))]

        def flush() -> Iterator[pa.RecordBatch]:
            yield sums.flush()
            of = list(sums.names)
            some = list(shares.items())
            yield _rows("share", [of[g] for (g, _), _ in some], [str(p) for (_, p), _ in some], np.array([n for _, n in some], np.int64))
            shares.clear()

        def flush_terms() -> Iterator[pa.RecordBatch]:
            cut()
            of = list(sums.names)
            for group, value, term in best:
                yield _rows("term", [of[g] for g in group.tolist()], term, value)
            best.clear()

        for batch in _whole_runs(batches, 2):
            new = _starts(batch, 2)
            at = np.flatnonzero(new)
            size = np.diff(np.r_[at, len(new)])
            group = np.fromiter((sums.names.setdefault(x, len(sums.names)) for x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)), np.int64, len(new))
            n, all_n, total, all_total = (_long(batch.column(k)) for k in (3, 4, 5, 6))
            p, zero, q = share(n, total), share(np.zeros_like(n), total), share(all_n, all_total)
            for x in zip(*(y.tolist() for y in _counted(group, p)), strict=True):
                shares[x[0], x[1]] += x[2]
            over = np.flatnonzero(p > q)
            best.append((group[over], divergence(p[over], q[over]), batch.column(1).take(pa.array(over))))
            held += len(over)
            if held > HELD_CANDIDATES:
                cut()
                held = 0
                if len(best[0][0]) > HELD_CANDIDATES // 2:
                    yield from flush_terms()
            for i, j in _pairs_of_runs(at, size):
                sums.add(group[i], group[j], divergence(p[i], p[j]) - divergence(p[i], zero[j]) - divergence(zero[i], p[j]) + divergence(zero[i], zero[j]))
            if len(shares) > HELD_PAIRS or len(sums.values[0]) > HELD_PAIRS:
                yield from flush()
        yield from flush()
        yield from flush_terms()

    ordered = rows.select("lang", "term", "source", "n", "all_n", "total", "all_total").repartition("lang", "term").sortWithinPartitions(*ORDER)
    return ordered.mapInArrow(releasing(run), "kind string, lang string, source string, item string, value long")


def _counted(group: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((p, group))
    group, p = group[order], p[order]
    at = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (p[1:] != p[:-1])]) if len(p) else np.zeros(0, np.int64)
    return group[at], p[at], np.diff(np.r_[at, len(p)])


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(df: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP_TERMS, work: Workspace | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for each other source of the language, ``term`` rows for the ``top`` terms
    whose share is over the language's; ranks from 1 by value (descending) and item."""
    work = work or Workspace(df.sparkSession, "divergence")
    small_batches(df.sparkSession, BATCH)
    docs = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text_or_empty("text").alias("text"))
    kept = work.keep(kept_terms(summed_runs(partial_runs(docs)), least), "kept")
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum(F.when(F.col("first"), F.col("all_n"))).alias("all_held"))
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(held, ["lang", "source"], "left")
    v = F.coalesce("v", F.lit(0))
    groups = groups.select("lang", "source", v.alias("v"), (F.coalesce("held", F.lit(0)) + v).alias("total"), (F.coalesce("all_held", F.lit(0)) + v).alias("all_total"))
    groups = work.keep(groups.withColumn("zero", F.when(F.col("v") > 0, 1 + F.call_function("div", F.lit(SCALE).cast("long"), F.col("total")))), "groups")
    beside = F.broadcast if groups.count() <= BROADCAST_ROWS else lambda x: x
    found = work.keep(run_reports(kept.join(beside(groups.select("lang", "source", "total", "all_total")), ["lang", "source"]), top), "found")
    a, b = (groups.select("lang", *(F.col(c).alias(f"{c}_{side}") for c in ("source", "zero")), *(["v"] if side == "a" else [])) for side in "ab")
    shares = found.where("kind = 'share'").groupBy("lang", F.col("source").alias("source_a"), F.col("item").cast("long").alias("p")).agg(F.sum("value").alias("terms"))
    alone = shares.join(beside(a), ["lang", "source_a"]).join(beside(b), "lang").where("source_a <> source_b")
    p, za, zb, n = (F.col(c) for c in ("p", "zero_a", "zero_b", "terms"))
    # a source's terms beside another's zero share, and the other way round
    of_a = alone.select("lang", "source_a", "source_b", (n * (_f(p, zb) - _f(za, zb))).alias("value"))
    of_b = alone.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), (n * (_f(zb, p) - _f(zb, za))).alias("value"))
    shared = found.where("kind = 'pair'").select("lang", F.col("source").alias("source_a"), F.col("item").alias("source_b"), "value")
    none = a.join(beside(b), "lang").where("source_a <> source_b").select("lang", "source_a", "source_b", F.coalesce(F.col("v") * _f(za, zb), F.lit(0)).alias("value"))
    pairs = shared.union(of_a).union(of_b).union(none).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    rows = pairs.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value")
    rows = rows.union(found.where("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank.cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")

"""N-gram Jaccard join as a metric-space join: pivot documents, Voronoi regions, windows from the triangle inequality, recursion.

A document is its set of distinct n-word shingles (64-bit hashes of them); two link when |x & y| / |x | y| is at least the
threshold t, that is when their Jaccard distance d(x, y), a metric, is at most 1 - t. Equal sets are one node.

Documents without common shingles all have distance 1, so pivots drawn from all documents would separate nothing. A pre-filter
therefore leaves pairs out that can't link, and proposes pivots; all that follows is decided by distances.

0. Pre-filter. Rings of sizes split the documents; a document also goes to the rings above that a linked one may lie in. A ring
   cuts the shingle space into parts by hash. A linked pair differs in D shingles at most, so of any D + 1 parts one is equal in
   both. A document has a cell for each of its first D + 1 + spare parts that aren't empty, named by the part's content: a linked
   pair shares 1 + spare cells at least. Cells that one set only has are dropped, and with them most documents. A document that has
   k cells left in a ring keeps the k - spare rarest: the rarest cell that a linked pair shares is among these in both.
1. The pivot of a cell is the document with the least hash in it. A linked pair shares a cell, so both meet its pivot. The
   distances of all documents to the pivots that they share a cell with are counted exactly; those within 1 - t are links.
2. A document's Voronoi region is that of its nearest pivot, and is joined first. Around a pivot p, shells of width 1 - t hold the
   documents by d(x, p): as d(x, y) >= |d(x, p) - d(y, p)|, a partner lies in the same shell or the next. A document goes to its
   region only if these shells hold one that it isn't connected with yet.
3. Windows: a document is replicated to each of its other pivots whose region the same inequality does not rule out.
4. A small region is joined exactly in one task, one of a few times that size in blocks: each member then goes to at most MOST_BLOCKS
   tasks, while dealing texts that share most of a passage, as below, may repeat them many times more. In a larger region
   every member is compared with the pivot p, in salted groups.
   Members linked to p form its ball and need no comparison with each other. For x outside the ball, the symmetric difference
   D(x, p) = |x ^ p|, a metric too, is over the bound of a link, so x and any partner y must share elements of x ^ p and y ^ p, at
   least half the excess; members are dealt out by the first such elements (as many as the bound demands; those that p lacks come
   first) to smaller regions of differences, in which the same metric holds, and step 4 recurs there with the member nearest
   to p as pivot. Regions whose members are all connected by then are dropped.
5. Beyond MOST_ROUNDS, or where dealing makes regions grow fourfold, members are compared exactly in blocks. Work then grows with
   the square of the region: it takes thousands of texts that share most words of a passage, yet are no copies of each other.

Only pairs that connect something are returned (a spanning forest of each region), so the output is linear in the documents;
``link_counts`` compares all pairs of a region instead, and gives each document's number of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Workspace, components, join_beside, releasing, small_batches, split_limit, text_or_empty

#: Members and elements of a region that one task joins; elements of a large region's group that one task compares with the pivot.
SMALL, SMALL_ELEMENTS, SALT = 512, 1_000_000, 1_000_000
COLUMNS = 8192
#: Regions of so many blocks of small regions' size are compared in blocks at once.
MOST_BLOCKS = 8
RING, RINGS = 1.7, 64
#: Linked pairs share one cell more for each so many shingles in which they may differ.
SPARE = 6
MOST_ROUNDS = 5
KNOWN_WORDS = 60_000
#: Sets that a task remembers, so that copies in it give their cells once.
KNOWN_NODES = 100_000
#: Frequent cells are found in one of so many documents' cells; the others need no pre-aggregation.
CELL_SAMPLE, CELL_HITS = 16, 64
#: Rows of an Arrow batch that are worked on at once.
SLICE = 256
U = np.uint64


class Hashes(dict):
    """Words -> 64-bit hashes; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which all bits depend on all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: bytes, known: Hashes, n: int = 3) -> np.ndarray:
    """The sorted distinct shingle hashes of a UTF-8 text: A-Z lowered, words between ASCII white space."""
    words = text.lower().split()
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    if not width:
        return codes
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out + codes[k:len(codes) - width + 1 + k] * U(2 * k + 3))
    return np.unique(out)


def bound(total: int, t: Fraction) -> int:
    """Largest symmetric difference of a linked pair whose sizes sum up to ``total``."""
    return int(total * (1 - t) / (1 + t))


def rings(t: Fraction, most: int = 1 << 40) -> list[int]:
    """Lower ends of the size rings. Sets so small that a link means equality share ring 0."""
    first = 1
    while bound(2 * first, t) == 0:
        first += 1
    out = [0, first - 1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * RING)))
    return out


def spare(ring: int, t: Fraction, lows: list[int]) -> int:
    """Cells beyond the first that any linked pair shares in a ring: the same for all documents in it."""
    return bound(2 * ceil(lows[ring] * t), t) // SPARE


def cells(s: np.ndarray, t: Fraction, lows: list[int]) -> np.ndarray:
    """Keys of the cells that a set of shingles has, over all rings that its window reaches; keys end in the ring's number.

    Parts are taken in order until enough aren't empty. Of a linked pair take the one that ends first: of its parts D at most
    differ from the other's, and the other took all of the rest. A set with too few parts that aren't empty gives all, empty
    ones included; where both do, they agree in all parts but D.
    """
    n, out = len(s), []
    ring = int(np.searchsorted(lows, n, "right")) - 1
    last = int(np.searchsorted(lows, int(n / t), "right")) - 1
    spread = mixed(s + U(0x9E3779B97F4A7C15))
    for r in range(max(ring, 1), last + 1):
        top, more = lows[r + 1] - 1, spare(r, t, lows)
        parts = bound(2 * top, t) + 2 + more
        blank = parts * exp(-top / parts)  # parts expected to be empty
        parts += ceil(blank + 4 * sqrt(blank))
        part = (spread >> U(20)) % U(parts)
        at = np.argsort(part, kind="stable")
        own = part[at]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        keys = mixed(np.add.reduceat(mixed(spread[at]), starts) + mixed(own[starts] + U(r << 32)))
        want = bound(n + min(int(n / t), top), t) + 1 + more
        if len(keys) < want:
            keys = np.concatenate((keys, mixed(mixed(np.setdiff1d(np.arange(parts, dtype=np.uint64), own) + U(r << 32)))))
        else:
            keys = keys[:want]
        out.append(keys // U(RINGS) * U(RINGS) + U(r % RINGS))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def linked(common: int, a: int, b: int, t: Fraction) -> bool:
    return common * t.denominator >= t.numerator * (a + b - common)


def _links(d: int, a: int, b: int, t: Fraction) -> bool:
    """Whether sets of sizes a and b that differ in d elements link."""
    return linked((a + b - d) // 2, a, b, t)


def _common(rows: list[np.ndarray], columns: list[np.ndarray] | None = None) -> np.ndarray:
    """Number of common elements of each row with each column (of each pair of rows if there are none), counted over COLUMNS
    elements at a time."""
    both = rows if columns is None else [*rows, *columns]
    n = len(rows)
    out = np.zeros((n, len(both) - (n if columns is not None else 0)), np.float32)
    values, owner = np.concatenate(both), np.repeat(np.arange(len(both), dtype=np.int32), [len(x) for x in both])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, bool)
    alone = new & np.r_[new[1:], True]
    del values, order
    code, owner = np.cumsum(new & ~alone)[~alone] - 1, owner[~alone]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, (low, low + COLUMNS))
        at = np.zeros((len(both), min(COLUMNS, int(code[-1]) + 1 - low)), np.float32)
        at[owner[a:b], code[a:b] - low] = 1
        out += at[:n] @ (at if columns is None else at[n:]).T
    return out.astype(np.int64)


def _spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a symmetric boolean matrix that connect all that it connects."""
    unseen, out = np.ones(len(link), bool), []
    for root in range(len(link)):
        if unseen[root]:
            unseen[root], todo = False, [root]
            while todo:
                i = todo.pop()
                found = np.flatnonzero(link[i] & unseen)
                unseen[found] = False
                out += [(i, j) for j in found.tolist()]
                todo += found.tolist()
    return out


def join_small(members: list[tuple[int, int, int, np.ndarray]], t: Fraction, others: list | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Links that connect (node, class, size, elements) rows as far as their links do, among all pairs of rows.

    With ``others``, pairs of a member and one of these only; with ``every``, all links.
    """
    both = members if others is None else others
    if not both or not members:
        return []
    common = _common([m[3] for m in members], None if others is None else [m[3] for m in both])
    k, n = ([np.array([f(m) for m in side], np.int64) for side in (members, both)] for f in (lambda m: len(m[3]), lambda m: m[2]))
    inside = (n[0][:, None] + n[1] - (k[0][:, None] + k[1] - 2 * common)) // 2
    link = inside * t.denominator >= t.numerator * (n[0][:, None] + n[1] - inside)
    if every:
        pairs = np.argwhere(np.triu(link, 1) if others is None else link).tolist()
        return [(members[i][0], both[j][0]) for i, j in pairs if members[i][0] != both[j][0]]
    if others is not None:
        whole = np.zeros((len(members) + len(both),) * 2, bool)
        whole[:len(members), len(members):], whole[len(members):, :len(members)] = link, link.T
        link = whole
    rows = members if others is None else [*members, *others]
    return [(rows[i][0], rows[j][0]) for i, j in _spanning(link) if rows[i][1] != rows[j][1]]


def shared_with_any(k: int, n: int, pivot_n: int, near: bool, t: Fraction) -> int:
    """Elements, of the k by which a set of size n differs from the pivot, that it shares with any partner at least.

    For a set outside the ball, any partner y of size n / t at most, which differs from the pivot by 1 element and by the
    excess of k over the bound at least; for one in the ball, partners outside, whose elements exceed their bound with p.
    """
    c = (1 - t) / (1 + t)
    if near:
        return max(1, -(-(k + 1 - ceil(c * max(0, n - pivot_n))) // 2))
    most = bound(n + int(n / t), t)
    return max(1, -(-(k + 1 - most) // 2), k - most)


def _array(x) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).view(np.uint64)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``keys`` columns in sorted batches; an array column comes as uint64 numpy arrays."""
    now, rows = None, []
    for batch in batches:
        columns = [[_array(v) if v.is_valid else None for v in c] if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])


class JaccardJoin:
    """The join of one table. ``links`` gives its links, ``classes`` a row for each document."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: str = "0.9", work: Workspace | None = None, small: int = SMALL, most_rounds: int = MOST_ROUNDS,
                 salt: int = SALT, most_blocks: int = MOST_BLOCKS):
        self.t, self.n, self.small, self.most_rounds, self.salt, self.most_blocks = Fraction(threshold), n, small, most_rounds, salt, most_blocks
        self.spark, self.id_col = df.sparkSession, id_col
        self.work = work or Workspace(self.spark, "jaccard")
        small_batches(self.spark)
        docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
        #: mark tells rows apart that have no id
        self.docs = docs.select("id", F.xxhash64("id", "text").alias("mark"), F.col("text").cast("binary").alias("text"))

    def sets(self) -> tuple[DataFrame, DataFrame]:
        """(id, mark, node, n_shingles) and (node, cells, n_cells): node stands for the set itself, equal sets are one node.

        A task gives the cells of equal sets once, so that a large group of copies shrinks before the shuffle.
        """
        t, n, lows = self.t, self.n, rings(self.t)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, seen, none = Hashes(), set(), np.zeros(0, np.uint64)
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    nodes, sizes, own = [], [], []
                    for text in batch.column(2):
                        s = shingles(text.as_py(), known, n)
                        node = xxhash.xxh3_64_intdigest(s.tobytes())
                        own.append(none if node in seen else cells(s, t, lows))
                        nodes.append(node)
                        sizes.append(len(s))
                        if len(seen) >= KNOWN_NODES:
                            seen.clear()
                        seen.add(node)
                    offsets = np.cumsum([0, *map(len, own)]).astype(np.int32)
                    flat = pa.array(np.concatenate([none, *own]).view(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat),
                                                      pa.array(list(map(len, own)), pa.int32())], ["id", "mark", "node", "n_shingles", "cells", "n_cells"])

        wide = self.work.keep(self.docs.mapInArrow(releasing(run), "id long, mark long, node long, n_shingles long, cells array<long>, n_cells int"), "wide")
        return self.work.keep(wide.select("id", "mark", "node", "n_shingles"), "sets"), wide.where("n_cells > 0").select("node", "cells", "n_cells")

    def met(self, cells: DataFrame) -> DataFrame:
        """(cell, node, rows) without repeats, of the cells with several nodes; rows: how frequent the cell is, the same for its nodes.

        One exchange by cell finds them. Cells of very many nodes, known from a sample of the nodes, are dealt with on the way
        there: they are surely shared, and their rows are spread by node.
        """
        total = cells.agg(F.sum("n_cells")).first()[0] or 0
        rows = cells.select("node", F.explode("cells").alias("cell"))
        sample = cells.where(F.pmod(F.xxhash64("node"), F.lit(CELL_SAMPLE)) == 0).select("node", F.explode("cells").alias("cell"))
        hits = max(CELL_HITS, split_limit(total) // CELL_SAMPLE)
        hot = self.work.keep(sample.groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where((F.col("n") >= hits) & (F.col("low") < F.col("high"))).select("cell", (F.col("n") * CELL_SAMPLE).alias("rows")), "hot_cells")
        by_cell = Window.partitionBy("cell")
        cold = rows.join(F.broadcast(hot), "cell", "left_anti").select("cell", "node", F.min("node").over(by_cell).alias("low"), F.max("node").over(by_cell).alias("high"), F.count("*").over(by_cell).alias("rows"))
        found = cold.where("low < high").select("cell", "node", "rows").distinct()
        if not hot.isEmpty():
            found = found.union(rows.join(F.broadcast(hot), "cell").select("cell", "node", "rows").distinct())
        return self.work.keep(found, "met")

    def edges(self, met: DataFrame) -> DataFrame:
        """(region, node): the pivots that a document shares a cell with, each named by itself; a pivot has an edge to itself.

        A node that shares fewer cells in a ring than any linked pair of it must share is dropped from it first. Of the others' cells
        the most frequent are left out, one fewer than such a pair shares, so that one shared cell stays in both: passages that many
        documents have would else bring them to the same pivots.
        """
        lows = rings(self.t)
        least = F.array(*[F.lit(1 + spare(r, self.t, lows) if r else 1) for r in range(min(RINGS, len(lows) - 1))])
        ring = F.pmod("cell", F.lit(RINGS)).cast("int")
        # a node's cells in a ring are no more than its shingles
        own = Window.partitionBy("node", "ring")
        places = met.select("cell", "node", "rows", ring.alias("ring")).withColumn("n", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("rows", "cell")))
        rest = self.work.keep(places.where(F.col("rank") <= F.col("n") - F.get(least, F.col("ring")) + 1).select("cell", "node"), "rest")
        pivots = self.work.keep(rest.groupBy("cell").agg(F.min("node").alias("region"), F.max("node").alias("high")).where("region < high").select("cell", "region"), "pivots")
        return self.work.keep(join_beside(rest, pivots, "cell").select("region", "node").distinct(), "edges")

    def elements(self, sets: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, size, elements) of ``nodes``, from one document of each."""
        chosen = join_beside(sets.where("n_shingles > 0"), self.work.keep(nodes, "wanted"), "node", "left_semi").groupBy("node").agg(F.min("mark").alias("mark"))
        chosen, n = self.work.keep(chosen, "chosen"), self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Hashes()
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    found = [(int(k), shingles(x.as_py(), known, n)) for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
                    # repeated rows, or another row with an equal mark, may come along
                    found = [(k, s) for k, s in found if np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64) == k]
                    offsets = np.cumsum([0, *(len(s) for _, s in found)]).astype(np.int32)
                    flat = pa.array(np.concatenate([s for _, s in found] or [np.zeros(0, np.uint64)]).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["node", "size", "elements"])

        texts = join_beside(self.docs, chosen, "mark").select("node", "text")
        found = self.work.keep(texts.mapInArrow(releasing(run), "node long, size long, elements array<long>"), "elements")
        return self.work.keep(found.dropDuplicates(["node"]), "elements_once") if found.count() > chosen.count() else found

    def groups(self, places: DataFrame, pivot: str) -> DataFrame:
        """(region, node, salt, after) from kept (region, node, k) places: members in salted groups, each led by the pivot's row.

        k: elements of the member. ``pivot``: ``region`` where that names it, or ``least``: the member with the fewest elements.
        """
        facts = places.groupBy("region").agg(F.sum(F.col("k") + 1).alias("held"), F.min(F.struct("k", "node")).alias("p"))
        facts = facts.select("region", F.col("region" if pivot == "region" else "p.node").alias("pivot"), F.ceil(F.col("held") / self.salt).cast("int").alias("salts"))
        facts = self.work.keep(facts if pivot != "region" else facts.where("salts > 1"), "salts")
        rows = join_beside(places, facts, "region", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("pivot", F.coalesce("pivot", "region"))
        own = F.array(F.struct(F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("after")))
        lead = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda k: F.struct(k.alias("salt"), F.lit(0).alias("after")))
        rows = rows.select("region", "node", F.explode(F.when(F.col("node") == F.col("pivot"), lead).otherwise(own)).alias("at"))
        return self.work.keep(rows.select("region", "node", "at.salt", "at.after"), "groups")

    def distances(self, edges: DataFrame, elements: DataFrame) -> DataFrame:
        """(region, node, distance, shell, linked): exact Jaccard distances of all edges, counted in groups led by the pivot."""
        t = self.t
        groups = self.groups(join_beside(edges, elements.select("node", F.col("size").alias("k")), "node"), "region")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivot, at = None, None
            for batch in batches:
                out = []
                for region, salt, after, node, elements in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                    e = _array(elements)
                    if not after:
                        pivot, at = e.copy(), (region, salt)
                        if salt:
                            continue
                    if at != (region, salt):
                        raise RuntimeError("a group came without its pivot")
                    common = int(np.count_nonzero(pivot[np.minimum(np.searchsorted(pivot, e), len(pivot) - 1)] == e))
                    union = len(e) + len(pivot) - common
                    shell = (union - common) * t.denominator // (union * (t.denominator - t.numerator)) if t < 1 else 0
                    out.append((region, node, 1 - common / union, shell, linked(common, len(e), len(pivot), t)))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["region", "node", "distance", "shell", "linked"])

        rows = self.with_elements(groups, elements).select("region", "salt", "after", "node", "elements")
        rows = rows.repartition("region", "salt").sortWithinPartitions("region", "salt", "after")
        return self.work.keep(rows.mapInArrow(releasing(run), "region long, node long, distance double, shell int, linked boolean"), "distances")

    @staticmethod
    def with_elements(places: DataFrame, elements: DataFrame) -> DataFrame:
        """Kept places joined with their nodes' elements; a node has a bounded number of places."""
        return elements.join(F.broadcast(places) if places.count() <= BROADCAST_ROWS else places, "node")

    def undecided(self, distances: DataFrame, classes: DataFrame, name: str) -> DataFrame:
        """(region, node, class) of the members whose own and next shells hold members of several classes, and of their pivots."""
        rows = self.work.keep(join_beside(distances, classes, "node", "left").select("region", "node", "shell", F.coalesce("root", "node").alias("class")), f"{name}_classed")
        reach = rows.select("region", "class", F.explode(F.sequence(F.col("shell") - 1, F.col("shell") + 1)).alias("shell"))
        open_ = reach.groupBy("region", "shell").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
        key = F.xxhash64("region", "shell")  # an equal key of another shell only keeps more
        open_ = self.work.keep(open_.select("region", key.alias("at")), f"{name}_open")
        members = join_beside(rows.withColumn("at", key), open_.select("at"), "at", "left_semi").where("node <> region")
        pivots = join_beside(rows.where("node = region"), open_.select("region"), "region", "left_semi")
        return members.select("region", "node", "class").union(pivots.select("region", "node", "class"))

    def join_regions(self, rows: DataFrame, every: bool = False) -> DataFrame:
        """Links inside small regions; rows: (region, node, class, size, elements)."""
        t = self.t

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, members in _groups(batches, 1):
                if found := join_small(members, t, None, every):
                    yield _pairs(found)

        return rows.repartition("region").sortWithinPartitions("region").mapInArrow(releasing(run), "a long, b long")

    def large(self, facts: DataFrame) -> DataFrame:
        """(region, m, blocks) of the large regions of (region, node, k) places: members, and blocks of a small region's size."""
        count = facts.groupBy("region").agg(F.count("*").alias("m"), F.sum("k").alias("held"))
        count = count.where((F.col("m") > self.small) | (F.col("held") > SMALL_ELEMENTS))
        return count.select("region", "m", F.greatest(F.ceil(F.col("m") / self.small), F.ceil(F.col("held") / SMALL_ELEMENTS)).cast("int").alias("blocks"))

    def join_blocks(self, rows: DataFrame, counts: DataFrame, every: bool = False) -> DataFrame:
        """Links inside regions of any size, by exact comparison of all pairs of blocks of members; counts: (region, blocks) of all."""
        t = self.t
        rows = join_beside(rows, counts.select("region", "blocks"), "region").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        with_all = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))).alias("at")
        rows = rows.select("region", with_all, "block", "node", "class", "size", "elements").select("region", "at.i", "at.j", "block", "node", "class", "size", "elements")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (_, i, j), members in _groups(batches, 3):
                left, right = [m[1:] for m in members if m[0] == i], [m[1:] for m in members if m[0] == j]
                if found := join_small(left, t, None, every) if i == j else join_small(left, t, right, every):
                    yield _pairs(found)

        return rows.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j").mapInArrow(releasing(run), "a long, b long")

    def around_pivots(self, rows: DataFrame, places: DataFrame, named: bool) -> DataFrame:
        """(region, node, class, size, elements, near, pivot, first) of a large region's members but the pivot.

        elements: the difference to the pivot, near: linked to it, first: the elements by which the member is dealt out.
        The pivot gives the region its name where ``named``, else it is the member with the fewest elements, the nearest to
        the pivot before. ``places`` has (region, node, k) of the same rows.
        """
        t = self.t
        groups = self.groups(self.work.keep(places.select("region", "node", "k"), "around"), "region" if named else "least")
        groups = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
        rows = rows.join(groups, ["region", "node"]).select("region", "salt", "after", "node", "class", "size", "elements")
        names = ["region", "node", "class", "size", "elements", "near", "pivot", "first"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivot, at = None, None
            for batch in batches:
                out = []
                for region, part, after, node, own, size, e in zip(*[[_array(v) for v in c] if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns], strict=True):
                    if not after:
                        pivot, at = (node, size, e.copy()), (region, part)
                        continue
                    if at != (region, part):
                        raise RuntimeError("a group came without its pivot")
                    diff = np.setxor1d(e, pivot[2], assume_unique=True)
                    near = _links(len(diff), size, pivot[1], t)
                    take = len(diff) - shared_with_any(len(diff), size, pivot[1], near, t) + 1
                    held = np.isin(diff, pivot[2], assume_unique=True)
                    order = np.lexsort((mixed(diff), held))
                    out.append((region, node, own, size, diff.view(np.int64), near, pivot[0], diff[order[:max(take, 0)]].view(np.int64)))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

        schema = "region long, node long, class long, size long, elements array<long>, near boolean, pivot long, first array<long>"
        return rows.repartition("region", "salt").sortWithinPartitions("region", "salt", "after").mapInArrow(releasing(run), schema)

    def deal(self, near: DataFrame) -> DataFrame:
        """Smaller regions of differences: (region, node, class, size, elements), by the elements that partners must share.

        A region of one class, or of the ball's members only, has nothing left to find.
        """
        seen = near.select(F.col("region").alias("old"), "node", "class", "near", F.explode("first").alias("e")).select(F.xxhash64("old", "e").alias("region"), "old", "node", "class", "near")
        use = seen.groupBy("region").agg(F.min("near").alias("all_near"), F.min("class").alias("low"), F.max("class").alias("high")).where("NOT all_near AND low < high").select("region")
        dealt = join_beside(seen, self.work.keep(use, "dealt"), "region").select("region", "old", "node")
        return dealt.join(near.select(F.col("region").alias("old"), "node", "class", "size", "elements"), ["old", "node"]).select("region", "node", "class", "size", "elements")

    def prepare(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(sets, edges, elements): documents, the pivots that the pre-filter leaves them, and the sets of those that have one."""
        sets, cells = self.sets()
        met = self.met(cells)
        self.work.drop("wide")
        edges = self.edges(met)
        self.work.drop("met", "rest")
        return sets, edges, self.elements(sets, edges.select("node").distinct())

    def links(self, edges: DataFrame, elements: DataFrame) -> DataFrame:
        """(a, b) pairs of nodes whose sets link, enough of them to connect all that is connected."""
        work = self.work
        distances = self.distances(edges, elements)
        out = distances.where("linked AND node <> region").select(F.col("node").alias("a"), F.col("region").alias("b"))
        classes = work.keep(components(out, work, "cc_pivots_"), "classes_pivots")
        by_node = Window.partitionBy("node").orderBy("distance", "region")
        home = distances.withColumn("rank", F.row_number().over(by_node)).where("rank = 1").drop("rank")
        out = out.union(self.resolve(self.undecided(home, classes, "home"), elements, out, "home"))
        classes = work.keep(components(out, work, "cc_home_"), "classes_home")
        return out.union(self.resolve(self.undecided(distances, classes, "window"), elements, out, "window"))

    def resolve(self, places: DataFrame, elements: DataFrame, known: DataFrame, name: str) -> DataFrame:
        """Links inside regions, given (region, node, class) places, the nodes' elements, and the links known so far."""
        work, out, before = self.work, self.spark.createDataFrame([], "a long, b long"), None
        own = work.keep(places, f"{name}_places")
        if own.isEmpty():
            return out
        rows = self.with_elements(own, elements).select("region", "node", "class", "size", "elements")
        facts = join_beside(own, elements.select("node", F.col("size").alias("k")), "node").select("region", "node", "k")
        for step in range(self.most_rounds + 1):
            large = work.keep(self.large(facts), f"{name}_large{step}")
            deep = F.col("blocks") > self.most_blocks
            n_large, total = large.agg(F.count("*"), F.coalesce(F.sum(F.when(deep, F.col("m"))), F.lit(0))).first()
            small = rows if not n_large else join_beside(rows, large, "region", "left_anti")
            out = out.union(work.keep(self.join_regions(small), f"{name}_links{step}"))
            if not n_large:
                break
            last = not total or step == self.most_rounds or before is not None and total > 4 * before
            out = out.union(work.keep(self.join_blocks(rows, large if last else large.where(~deep)), f"{name}_blocks{step}"))
            if last:
                break
            before, largest = total, large.where(deep).select("region")
            big = join_beside(rows, largest, "region", "left_semi")
            near = work.keep(self.around_pivots(big, join_beside(facts, largest, "region", "left_semi"), step == 0), f"{name}_near{step}")
            out = out.union(work.keep(near.where("near").select(F.col("node").alias("a"), F.col("pivot").alias("b")), f"{name}_ball{step}"))
            roots = work.keep(components(known.union(out), work, f"{name}_cc{step}_"), f"{name}_classes{step}")
            near = near.drop("class").join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
            rows = work.keep(self.deal(near), f"{name}_rows{step + 1}")
            facts = rows.select("region", "node", F.size("elements").alias("k"))
            work.drop(f"{name}_near{step}", f"{name}_rows{step}")
        return out

    def lowest(self, sets: DataFrame, links: DataFrame) -> DataFrame:
        """(node, low) of the sets that several documents have or that are linked: the smallest id of their component."""
        work = self.work
        roots = work.keep(components(links, work, "all_"), "roots")
        nodes = join_beside(sets.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n")), roots, "node", "left").where("n > 1 OR root IS NOT NULL")
        nodes = work.keep(nodes.select("node", "low", F.coalesce("root", "node").alias("root")), "nodes")
        lows = work.keep(nodes.groupBy("root").agg(F.min("low").alias("lowest")), "lows")
        low = work.keep(join_beside(nodes, lows, "root").select("node", F.col("lowest").alias("low")), "lowest")
        work.only("sets", "lowest")
        return low

    def classes(self) -> DataFrame:
        """(id, n_shingles, component_id) of every document: component_id is the smallest id reachable by links, itself included.

        Documents without words or text link with nothing; a null id that nothing with an id is linked with has a null
        component. Equal sets are linked.
        """
        sets, edges, elements = self.prepare()
        low = self.lowest(sets, self.links(edges, elements))
        rows = join_beside(sets, low, "node", "left")
        return rows.select(F.col("id").alias(self.id_col), "n_shingles", F.coalesce("low", "id").alias("component_id"))

    def link_counts(self) -> DataFrame:
        """(id, n_shingles, n_links) of every document: how many other documents it links with, copies included.

        All members of a region are compared, and a pair that meets in several regions counts once. The number of pairs of
        different sets is part of the work: a group of m near copies has up to m * m / 2.
        """
        sets, edges, elements = self.prepare()
        work, places = self.work, edges.withColumn("class", F.col("node"))
        large = work.keep(self.large(join_beside(edges, elements.select("node", F.col("size").alias("k")), "node")), "large")
        rows = self.with_elements(places, elements).select("region", "node", "class", "size", "elements")
        pairs = work.keep(self.join_regions(join_beside(rows, large, "region", "left_anti"), True), "pairs").union(work.keep(self.join_blocks(rows, large, True), "pairs_of_blocks"))
        pairs = work.keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "all_pairs")
        both = work.keep(pairs.union(pairs.select("b", "a").toDF("a", "b")).toDF("node", "other"), "both")
        copies = work.keep(sets.where("n_shingles > 0").groupBy("node").agg(F.count("*").alias("n")), "copies")
        met = join_beside(both, copies.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("n").alias("linked"))
        known = work.keep(copies.join(met, "node", "left").where("n > 1 OR linked IS NOT NULL").select("node", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links")), "counts")
        return join_beside(sets, known, "node", "left").select(F.col("id").alias(self.id_col), "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: str = "0.8", **options) -> DataFrame:
    """(id, n_shingles, component_id): groups of documents whose word shingles link, five words and 0.8 by default.

    An empty table gives no rows; null and empty texts are on their own; other columns aren't read.
    """
    return JaccardJoin(df, id_col, text_col, n, threshold, **options).classes()

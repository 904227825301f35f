"""Operators on alignment columns. Frames are (alignment_id, input_order, id, seq); sequences of one alignment have one length.

Many alignments are worked on at once, grouped by alignment_id. Codons become rows only to count them by column: these
aggregations combine before the shuffle, and a column's figures don't grow with the number of sequences. Sequences are
then cut by the kept columns without being taken apart.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonspark.functions import codes
from codonspark.functions import sequences as S
from codonspark.plans.frames import codon_rows, keep_sites, stored

A = "alignment_id"


def site_summary(seqs: DataFrame, table: int | str = 1) -> DataFrame:
    """(alignment_id, site, n, clean, missing, ambiguous, stop, clean_fraction) of each codon column."""
    cls = S.codon_class(F.col("codon"), table)
    rows = codon_rows(seqs, (A,)).select(A, "site", cls.alias("cls")).groupBy(A, "site").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("cls") == k).alias(k) for k in ("clean", "missing", "ambiguous", "stop")])
    return rows.withColumn("clean_fraction", F.col("clean") / F.col("n"))


def trim_codons(seqs: DataFrame, min_clean_fraction: float = 0.5, table: int | str = 1) -> DataFrame:
    """``seqs`` with the codon columns in which at least this share of codons is clean."""
    if not 0 <= min_clean_fraction <= 1:
        raise ValueError("min_clean_fraction must be between 0 and 1")
    return keep_sites(seqs, sites_of(site_summary(seqs, table).where(F.col("clean_fraction") >= min_clean_fraction)))


def sites_of(rows: DataFrame) -> DataFrame:
    """(alignment_id, sites): the sites of each alignment in order; as many as it has columns at most."""
    return rows.groupBy(A).agg(F.array_sort(F.collect_list("site")).alias("sites"))


def hammer_sites(seqs: DataFrame, nail: int | str = 4, prevent_gap_only: bool = True, table: int | str = 1) -> DataFrame:
    """(alignment_id, nail, sites): columns with at least ``nail`` residues ('all': as many as sequences).

    With ``prevent_gap_only`` the highest nail at or below this is taken that leaves no sequence with gaps only; if none
    does, nail 1. For each sequence the highest occupancy among its columns that aren't gaps only decides that.
    """
    if nail != "all" and int(nail) <= 0:
        raise ValueError("nail must be over 0")
    # a digit for each codon: 0 for gaps only, 2 for a residue, 1 for others
    digit = lambda c: F.when(~S.translate_codon(c, table).isin("-", "?", "X", "*"), "2").when(S.gap_only(c), "0").otherwise("1")
    rows = stored(seqs.select(A, F.array_join(F.transform(S.codons(F.upper("seq")), digit), "").alias("digits")), "hammer")
    occupied = rows.select(A, F.posexplode(F.split("digits", "")).alias("site", "digit")).where("digit <> ''").groupBy(A, "site").agg(F.count_if(F.col("digit") == "2").cast("int").alias("occupied"))
    per_site = occupied.groupBy(A).agg(F.transform(F.array_sort(F.collect_list(F.struct("site", "occupied"))), lambda x: x["occupied"]).alias("occupied"))
    most = rows.groupBy(A).agg(F.count("*").alias("n"))
    most = most.select(A, (F.col("n") if nail == "all" else F.least(F.lit(int(nail)), F.col("n"))).cast("long").alias("nail")).join(per_site, A, "left")
    if prevent_gap_only:
        # a sequence has no gap-only rest under nail k if one of its columns with letters has an occupancy of k or more
        best = F.array_max(F.zip_with(F.split("digits", ""), "occupied", lambda d, k: F.when(d.isin("1", "2"), k)))
        reach = rows.join(per_site, A, "left").groupBy(A).agg(F.min(F.coalesce(best, F.lit(0))).alias("reach"))
        most = most.join(reach, A).select(A, F.greatest(F.lit(1), F.least("nail", "reach")).cast("long").alias("nail"), "occupied")
    kept = F.filter(F.transform("occupied", lambda k, site: F.when(k >= F.col("nail"), site)), lambda x: x.isNotNull())
    return most.select(A, "nail", F.coalesce(kept, F.array().cast("array<int>")).alias("sites"))


def hammer(seqs: DataFrame, nail: int | str = 4, prevent_gap_only: bool = True, table: int | str = 1) -> DataFrame:
    return keep_sites(seqs, hammer_sites(seqs, nail, prevent_gap_only, table))


def degeneracy_columns(seqs: DataFrame, table: int | str = 1) -> DataFrame:
    """(alignment_id, site, position, fold, status): fold of each nucleotide column if all codons that have one agree.

    status: assigned, conflict (several folds) or unassigned (none); position 0 to 2.
    """
    index = (F.instr(F.lit(codes.BASES), F.substring("codon", 1, 1)) - 1) * 16 + (F.instr(F.lit(codes.BASES), F.substring("codon", 2, 1)) - 1) * 4 + F.instr(F.lit(codes.BASES), F.substring("codon", 3, 1)) - 1
    code = F.when(S.unambiguous(F.col("codon")), F.substr(F.lit(codes.folds(table)), index * 3 + 1, F.lit(3)))
    rows = codon_rows(seqs, (A,)).groupBy(A, "site", "codon").count().select(A, "site", code.alias("code"))
    rows = rows.select(A, "site", F.nullif("code", F.lit("   ")).alias("code"))
    digits = [F.nullif(F.substring("code", k, 1), F.lit(" ")) for k in (1, 2, 3)]
    sums = rows.groupBy(A, "site").agg(*[f(d).alias(f"{name}{k}") for k, d in enumerate(digits) for name, f in (("low", F.min), ("high", F.max))])
    columns = sums.select(A, "site", F.explode(F.array(*[F.struct(F.lit(k).alias("position"), F.col(f"low{k}").alias("low"), F.col(f"high{k}").alias("high")) for k in range(3)])).alias("c"))
    status = F.when(F.col("c.low").isNull(), "unassigned").when(F.col("c.low") == F.col("c.high"), "assigned").otherwise("conflict")
    return columns.select(A, "site", "c.position", F.when(status == "assigned", F.col("c.low").cast("int")).alias("fold"), status.alias("status"))


def degenerate_sequences(seqs: DataFrame, fold: int, table: int | str = 1) -> DataFrame:
    """``seqs`` with the nucleotide columns of one fold (0, 2, 3 or 4)."""
    if fold not in (0, 2, 3, 4):
        raise ValueError(f"no such fold: {fold}")
    at = degeneracy_columns(seqs, table).where(F.col("fold") == fold).groupBy(A).agg(F.array_sort(F.collect_list(F.col("site") * 3 + F.col("position") + 1)).alias("columns"))
    rows = seqs.join(at, A, "left")
    return rows.withColumn("seq", F.coalesce(F.array_join(F.transform("columns", lambda k: F.substr(F.col("seq"), k, F.lit(1))), ""), F.lit(""))).select(*seqs.columns)


def consensus(seqs: DataFrame, table: int | str = 1) -> DataFrame:
    """(alignment_id, site, codon, aa): the most frequent codon of A, C, G and T, the smallest of equals.

    A column without any has --- if it is all gaps, else the most frequent letter that isn't a gap at each position.
    """
    counts = codon_rows(seqs, (A,)).groupBy(A, "site", "codon").agg(F.count("*").alias("n"))
    best = lambda test, what: F.min(F.when(test, F.struct((-F.col("n")).alias("k"), what.alias("v"))))["v"]
    codon = F.col("codon")
    known = S.unambiguous(codon)
    # columns without a codon of A, C, G and T need their letters; all figures of a column come from its few different codons
    own = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.substr(codon, k, F.lit(1)))
    whole = counts.groupBy(A, "site").agg(best(known, codon).alias("whole"), F.every(F.length(F.translate(codon, "-?.", "")) == 0).alias("gaps"),
                                          F.collect_list(F.when(~known, F.struct("n", own.alias("letters")))).alias("others"))

    def letter(k: int):
        """The most frequent letter of a position that isn't a gap, the smallest of equals."""
        there = F.filter(F.transform("others", lambda x: F.struct(F.get(x["letters"], k).alias("c"), x["n"].alias("n"))), lambda x: ~x["c"].isin("-", "?", "."))
        kinds = F.array_distinct(F.transform(there, lambda x: x["c"]))
        total = lambda c: F.aggregate(F.filter(there, lambda x: x["c"] == c), F.lit(0).cast("long"), lambda s, x: s + x["n"])
        return F.array_min(F.transform(kinds, lambda c: F.struct((-total(c)).alias("n"), c.alias("c"))))["c"]

    whole = whole.select(A, "site", F.when(F.col("whole").isNotNull(), F.col("whole")).when(F.col("gaps"), "---").otherwise(F.concat(*[F.coalesce(letter(k), F.lit("-")) for k in range(3)])).alias("codon"))
    return whole.withColumn("aa", msa_residue(F.col("codon"), table))


def msa_residue(codon, table: int | str = 1):
    """Residue shown for a codon: - if some of it is missing, ? if it is ambiguous, * for a stop."""
    return F.when(S.has_missing(codon), "-").otherwise(F.coalesce(S.residue(codon, table), F.lit("?")))


def logo(seqs: DataFrame, table: int | str = 1) -> DataFrame:
    """(alignment_id, site, aa, n, fraction) of the residues of codons of A, C, G and T."""
    rows = codon_rows(seqs, (A,)).where(S.unambiguous(F.col("codon"))).groupBy(A, "site", S.residue(F.col("codon"), table).alias("aa")).agg(F.count("*").alias("n"))
    return rows.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(A, "site")))


def state_matrix(seqs: DataFrame, table: int | str = 1) -> DataFrame:
    """(alignment_id, input_order, id, states): a letter for each codon: m missing, s stop, a ambiguous, c clean."""
    return seqs.select(A, "input_order", "id", S.codon_states(F.col("seq"), table).alias("states"))


#: Sequences that one mask has bits for.
MOST_BITS = 63


def presence(seqs: DataFrame, missing: str = "-?.") -> DataFrame:
    """(alignment_id, mask, sites): how many codon columns have the same sequences present.

    Bit k of ``mask`` stands for the k-th sequence in input order; alignments of more than MOST_BITS sequences raise in the job.
    Equal columns are merged before any search for a subset.
    """
    rank = F.row_number().over(Window.partitionBy(A).orderBy("input_order")) - 1
    fits = F.when(rank < MOST_BITS, rank).otherwise(F.raise_error(F.lit(f"an alignment of more than {MOST_BITS} sequences")).cast("int"))
    rows = seqs.withColumn("_bit", F.call_function("shiftleft", F.lit(1).cast("long"), fits.cast("int")))
    rows = rows.select(A, "_bit", F.posexplode(S.codons(F.col("seq"))).alias("site", "codon"))
    held = F.when(F.length(F.translate("codon", missing, "")) == F.length("codon"), F.col("_bit")).otherwise(F.lit(0).cast("long"))
    masks = rows.groupBy(A, "site").agg(F.bit_or(held).alias("mask"))
    return masks.groupBy(A, "mask").agg(F.count("*").alias("sites"))


def largest_area(seqs: DataFrame, missing: str = "-?.", most_sequences: int = 16, max_removed: int | None = None, keep: str | None = None,
                 over_limit: str = "raise") -> DataFrame:
    """(alignment_id, mode, kept, complete_sites, area, kept_orders): the subset of sequences with the largest kept * complete columns.

    Of equal areas more sequences win, then the lexicographically smallest list of places. All subsets of alignments of at
    most ``most_sequences`` are tried: 2^n for each against its merged columns. ``greedy_area`` serves larger alignments; here they raise
    ValueError, or with ``over_limit="row"`` have a row of the mode ``over the limit`` with nulls. ``keep``: a pattern of ids that must stay.
    """
    if over_limit not in ("raise", "row"):
        raise ValueError(f"over_limit is raise or row: {over_limit}")
    size = seqs.groupBy(A).agg(F.count("*").alias("n"))
    beyond = size.where(F.col("n") > most_sequences).select(A)
    if over_limit == "raise" and not beyond.isEmpty():
        raise ValueError(f"alignments of more than {most_sequences} sequences need greedy_area")
    fits = seqs.join(size.where(F.col("n") <= most_sequences).select(A), A, "left_semi")
    rank = F.row_number().over(Window.partitionBy(A).orderBy("input_order")) - 1
    placed = fits.select(A, "input_order", "id", rank.alias("place"))
    must = F.regexp_like("id", F.lit(rf"\A(?:{keep})\z")) if keep else F.lit(False)
    own = placed.groupBy(A).agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("place", "input_order"))).alias("members"),
                                F.coalesce(F.bit_or(F.when(must, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").cast("int")))), F.lit(0).cast("long")).alias("must"))
    support = presence(fits, missing).groupBy(A).agg(F.collect_list(F.struct("mask", "sites")).alias("support"))  # at most 2^n structs
    rows = own.join(support, A, "left").withColumn("subset", F.explode(F.sequence(F.lit(1).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1)))
    kept = F.bit_count("subset").cast("long")
    rows = rows.where(F.col("subset").bitwiseAND(F.col("must")) == F.col("must"))
    rows = rows.where(F.col("n") - kept <= max_removed) if max_removed is not None else rows
    complete = F.aggregate(F.coalesce("support", F.array().cast("array<struct<mask:bigint,sites:bigint>>")), F.lit(0).cast("long"), lambda s, x: s + F.when(x["mask"].bitwiseAND(F.col("subset")) == F.col("subset"), x["sites"]).otherwise(F.lit(0)))
    rows = rows.select(A, "members", kept.alias("kept"), complete.alias("complete_sites"), "subset")
    places = F.transform(F.filter("members", lambda m: F.call_function("shiftright", F.col("subset"), m["place"].cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1), lambda m: m["place"])
    best = rows.groupBy(A).agg(F.min(F.struct((-F.col("kept") * F.col("complete_sites")).alias("area"), (-F.col("kept")).alias("kept"), places.alias("places"), "complete_sites", "members")).alias("b"))
    orders = F.transform("b.places", lambda p: F.get(F.col("b.members"), p)["input_order"])
    found = best.select(A, F.lit("exact").alias("mode"), (-F.col("b.kept")).alias("kept"), F.col("b.complete_sites").alias("complete_sites"), (-F.col("b.area")).alias("area"), orders.alias("kept_orders"))
    nothing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns[2:]]
    return found if over_limit == "raise" else found.union(beyond.select(A, F.lit("over the limit"), *nothing))


def complete_columns(seqs: DataFrame, missing: str = "-?.") -> DataFrame:
    """``seqs`` with the codon columns that no sequence misses."""
    rows = codon_rows(seqs, (A,)).groupBy(A, "site").agg(F.every(F.length(F.translate("codon", missing, "")) == F.length("codon")).alias("ok")).where("ok")
    return keep_sites(seqs, sites_of(rows))


def max_align(seqs: DataFrame, missing: str = "-?.", most_sequences: int = 16, **options) -> DataFrame:
    """Sequences of the largest-area subset, with their complete columns: exact up to ``most_sequences``, greedy beyond.

    ``keep`` (a pattern of ids that must stay) and ``max_removed`` hold in both.
    """
    exact = largest_area(seqs, missing, most_sequences, over_limit="row", **options)
    small = seqs.join(exact.select(A, F.explode("kept_orders").alias("input_order")), [A, "input_order"], "left_semi")
    large = seqs.join(seqs.groupBy(A).agg(F.count("*").alias("_n")).where(F.col("_n") > most_sequences).select(A), A, "left_semi")
    return complete_columns(small.unionByName(_greedy_rows(large, missing, **options).drop("area")), missing)


#: Classes of equal sequences times columns of an alignment that one task may get.
TASK_CELLS = 4_000_000
#: Unions whose gain is counted at once.
PAIRS = 512


def _shortlist(shared: np.ndarray, sites: np.ndarray, n: int, base: int, left: int | None) -> list[tuple[float, int, int]]:
    """(bound, i, j): the best single set as (i, i), and unions (i, j) of two sets, i > j, whose area a head may reach its.

    ``shared[i, j]`` sequences are in both sets; sets are in order, and all can be dropped. A set that lies in neither of two
    can lie in their union only if its parts in both come to its size, one of them to half of it. That bounds what a union
    wins, first for all pairs by products of matrices, then for those left. Highest bounds come first.
    """
    size, area = np.diag(shared), n * base
    inside, half = shared == size[:, None], 2 * shared >= size[:, None]  # [k, i]: set k lies in set i
    won = sites @ inside
    rate = ((n - size) * (base + won) - area) / size
    top = max(range(len(size)), key=lambda i: (rate[i], won[i], i))
    part = (shared > 0) & ~inside
    more, full, own = (x.astype(np.float32) for x in (part & half, part, inside))
    weigh = lambda x, y: np.rint((x * sites[:, None].astype(np.float32)).T @ y).astype(int)
    cross = weigh(more, full)
    most = won[:, None] + won - weigh(own, own) + cross + cross.T - weigh(more, more)
    drop = size[:, None] + size - shared
    hope = np.tril(((n - drop) * (base + most) - area) / drop >= rate[top], -1) & (True if left is None else drop <= left)
    out = [(rate[top], top, top)]
    for i in np.flatnonzero(hope.any(axis=1)):
        js, ks = np.flatnonzero(hope[i]), np.flatnonzero(shared[:, i])
        least = won[js] + sites[ks] @ ((shared[np.ix_(ks, js)] + shared[ks, i][:, None] >= size[ks][:, None]) & ~inside[np.ix_(ks, js)])
        bound = ((n - drop[i, js]) * (base + least) - area) / drop[i, js]
        out += [(float(x), int(i), int(j)) for x, j in zip(bound, js, strict=True) if x >= rate[top]]
    return sorted(out, key=lambda x: -x[0])


def _search(absent: np.ndarray, weight: np.ndarray, must: np.ndarray, total: int, width: int, most: int | None, area: int) -> tuple[list[int], int]:
    """(cut, area) after all rounds, from classes (rows) by the columns that some class misses, in order of site."""
    cut: list[int] = []
    active = np.ones(len(weight), bool)
    while (n := int(weight[active].sum())) > 1:
        left = None if most is None else most - (total - n)
        kinds: dict[bytes, list[int]] = {}
        for k, column in enumerate(np.ascontiguousarray(absent[active].T)):
            if column.any():
                kinds.setdefault(column.tobytes(), []).append(k)
        base = width - sum(map(len, kinds.values()))
        first, sites = np.array([k[0] for k in kinds.values()], int), np.array([len(k) for k in kinds.values()], int)
        sets, w = absent[active][:, first], weight[active]
        fits = ~sets[must[active]].any(axis=0) & (True if left is None else w @ sets <= left)
        first, sites, sets = first[fits], sites[fits], sets[:, fits]
        if not len(first):
            break
        shared = np.rint((sets * w[:, None].astype(float)).T @ sets.astype(float)).astype(int)
        best, found = None, _shortlist(shared, sites, n, base, left)
        for at in range(0, len(found), PAIRS):
            if best is not None and found[at][0] < best[0]:
                break
            i, j = (np.array([x[k] for x in found[at:at + PAIRS]]) for k in (1, 2))
            drop = sets[:, i] | sets[:, j]
            dropped, won = w @ drop, sites @ ~((sets.T.astype(np.float32) @ ~drop) > 0)
            new = (n - dropped) * (base + won)
            own = max(zip(((new - area) / dropped).tolist(), won.tolist(), i.tolist(), (i == j).tolist(), j.tolist(), new.tolist(), strict=True))
            best = own if best is None or own > best else best
        if best[-1] <= area:
            break
        cut, area = cut + [int(first[best[2]]), int(first[best[4]])], best[-1]
        active = ~absent[:, cut].any(axis=1)
    return cut, area


def greedy_cuts(seqs: DataFrame, missing: str = "-?.", max_removed: int | None = None, keep: str | None = None, task_cells: int = TASK_CELLS) -> tuple[DataFrame, DataFrame]:
    """(``seqs`` with ``gone``, cuts): the columns that each sequence misses, and (alignment_id, cut, area).

    The search drops all sequences that miss a column of ``cut``, so no ids go through it, and sequences that miss the same
    columns are one class with a weight. An alignment of at most ``task_cells`` classes times columns is searched in one
    task. Of a larger one no task gets more than figures of pairs of columns: each round counts columns, the sequences that
    two of them share and the shortlisted unions by aggregations over the classes, until the rest is small enough or no
    area is won.
    """
    codons = S.codons(F.col("seq"))
    lacks = F.transform(codons, lambda c, k: F.when(F.length(F.translate(c, missing, "")) < F.length(c), k))
    placed = seqs.withColumn("gone", F.array_compact(lacks).cast("array<int>"))
    must = F.regexp_like("id", F.lit(rf"\A(?:{keep})\z")) if keep else F.lit(False)
    classes = placed.select(A, "gone", F.size(codons).alias("width"), F.coalesce(must, F.lit(False)).alias("must"))
    classes = stored(classes.groupBy(A, "gone").agg(F.count("*").alias("w"), F.max("width").alias("width"), F.max("must").alias("must")), "classes")
    whole = classes.groupBy(A).agg(F.sum("w").alias("total"), F.max("width").alias("width"))
    missed = classes.select(A, F.explode("gone").alias("k")).groupBy(A, "k").count().groupBy(A).agg(F.count("*").alias("missed"))
    area = F.col("total") * (F.col("width") - F.coalesce("missed", F.lit(0)))
    state = stored(whole.join(missed, A, "left").select(A, "total", "width", F.array().cast("array<int>").alias("cut"), area.cast("bigint").alias("area"), F.lit(False).alias("done")), "state")
    while True:
        rest = classes.drop("width").join(state.where("NOT done"), A).where(~F.arrays_overlap("gone", "cut"))
        large = stored(rest.groupBy(A).agg((F.count("*") * F.max("width")).alias("cells")).where(F.col("cells") > task_cells).select(A), "large")
        if large.isEmpty():
            break
        state = stored(_round(stored(rest.join(large, A, "left_semi"), "live"), state, max_removed), "state")
    kind = seqs.schema[A].dataType.simpleString()

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        columns = np.unique(np.concatenate([*rows["gone"]])).astype(int)
        absent = np.zeros((len(rows), len(columns)), bool)
        for k, gone in enumerate(rows["gone"]):
            absent[k, np.searchsorted(columns, gone)] = True
        one = rows.iloc[0]
        cut, area = _search(absent, rows["w"].to_numpy(), rows["must"].to_numpy(bool), int(one["total"]), int(one["width"]), max_removed, int(one["area"]))
        return pd.DataFrame({A: [key[0]], "cut": [[*map(int, one["cut"]), *(int(columns[k]) for k in cut)]], "area": [area]})

    small = rest.groupBy(A).applyInPandas(solve, f"{A} {kind}, cut array<int>, area bigint")
    return placed, state.where("done").select(A, "cut", "area").unionByName(small)


def _round(live: DataFrame, state: DataFrame, most: int | None) -> DataFrame:
    """``state`` after a round of the alignments in ``live``, the classes that are left of them."""
    digest = lambda seed: F.sum(F.xxhash64("gone", F.lit(seed)).cast("decimal(38,0)"))
    columns = live.select(A, "w", "must", "gone", F.explode("gone").alias("k")).groupBy(A, "k").agg(F.sum("w").alias("size"), F.max("must").alias("held"), digest(1).alias("d1"), digest(2).alias("d2"))
    sets = columns.groupBy(A, "size", "d1", "d2").agg(F.min("k").alias("k"), F.count("*").alias("sites"), F.max("held").alias("held"))
    head = live.groupBy(A).agg(F.sum("w").alias("n"), F.first("total").alias("total"), F.first("width").alias("width"), F.first("area").alias("area"))
    head = head.join(sets.groupBy(A).agg(F.sum("sites").alias("open")), A).select(A, "n", "area", (F.col("width") - F.col("open")).alias("base"), (F.lit(most).cast("bigint") - F.col("total") + F.col("n")).alias("left"))
    sets = stored(sets.join(head, A).where("NOT held AND (left IS NULL OR size <= left)"), "sets")
    own = live.join(sets.groupBy(A).agg(F.collect_list("k").alias("firsts")), A).select(A, "w", "gone", F.array_intersect("gone", "firsts").alias("own"))
    pairs = own.select(A, "w", "own", F.explode("own").alias("x")).select(A, "w", "x", F.explode("own").alias("y")).where("x <= y").groupBy(A, "x", "y").agg(F.sum("w").alias("shared"))

    def shortlist(key: tuple, pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        sets = sets.sort_values("k")
        first, one = sets["k"].to_numpy(), sets.iloc[0]
        shared = np.zeros((len(first), len(first)), int)
        x, y = (np.searchsorted(first, pairs[c].to_numpy()) for c in "xy")
        shared[x, y] = shared[y, x] = pairs["shared"].to_numpy()
        found = _shortlist(shared, sets["sites"].to_numpy(), int(one["n"]), int(one["base"]), None if most is None else int(one["left"]))
        return pd.DataFrame([(key[0], int(first[i]), int(first[j]), int(shared[i, i] + shared[j, j] - shared[i, j])) for _, i, j in found], columns=[A, "x", "y", "dropped"])

    kind = live.schema[A].dataType.simpleString()
    short = stored(pairs.groupBy(A).cogroup(sets.groupBy(A)).applyInPandas(shortlist, f"{A} {kind}, x int, y int, dropped bigint"), "short")
    hit = own.join(short, A).where(F.array_contains("gone", F.col("x")) | F.array_contains("gone", F.col("y")))
    won = hit.select(A, "x", "y", "dropped", "w", F.explode("own").alias("k")).groupBy(A, "x", "y", "dropped", "k").agg(F.sum("w").alias("part")).join(sets, [A, "k"]).where("part = size")
    won = won.groupBy(A, "x", "y", "dropped", "n", "base", "area").agg(F.sum("sites").alias("won"))
    won = won.withColumn("new", (F.col("n") - F.col("dropped")) * (F.col("base") + F.col("won")))
    rank = F.struct(((F.col("new") - F.col("area")) / F.col("dropped")).alias("rate"), "won", "x", (F.col("x") == F.col("y")).alias("single"), "y", "new")
    best = won.groupBy(A).agg(F.max(rank).alias("b"))
    tried = state.join(live.select(A, F.lit(True).alias("tried")).distinct(), A, "left").join(best, A, "left")
    wins = F.col("b.new") > F.col("area")
    return tried.select(A, "total", "width", F.when(wins, F.array_distinct(F.concat("cut", F.array("b.x", "b.y")))).otherwise(F.col("cut")).alias("cut"),
                        F.when(wins, F.col("b.new")).otherwise(F.col("area")).alias("area"), (F.col("done") | (F.col("tried").isNotNull() & ~F.coalesce(wins, F.lit(False)))).alias("done"))


def _greedy_rows(seqs: DataFrame, *places, **options) -> DataFrame:
    """``seqs`` that the greedy search keeps, with ``area``."""
    placed, cuts = greedy_cuts(seqs, *places, **options)
    return placed.join(cuts, A).where(~F.arrays_overlap("gone", "cut")).select(*seqs.columns, "area")


def greedy_area(seqs: DataFrame, missing: str = "-?.", max_removed: int | None = None, keep: str | None = None, task_cells: int = TASK_CELLS) -> DataFrame:
    """(alignment_id, kept_orders, area): drops, as long as the area grows, the set of sequences that wins most area a head.

    Candidates are the sets of sequences that some column lacks, and unions of two; of equal gains the set that completes
    more columns wins, then the one met first, from the last column's set back. The ids are gathered for the result only.
    No set with a sequence whose id fits ``keep`` is dropped.
    """
    return _greedy_rows(seqs, missing, max_removed, keep, task_cells).groupBy(A).agg(F.array_sort(F.collect_list("input_order")).alias("kept_orders"), F.first("area").alias("area"))


def back_trim(cds: DataFrame, trimmed: DataFrame, table: int | str = 1) -> DataFrame:
    """Codon alignments cut to the columns of their trimmed protein alignments, (alignment_id, id, seq) matched by id.

    A protein column takes the next codon column after the last taken one that translates to the same residues. A column is
    a digest over its sequences in input order; a task gets an alignment's two lists of digests, no sequences.
    """
    left = cds.select(A, "id", "input_order", S.translate_cds(F.col("seq"), table).alias("aa"))
    right = trimmed.select(A, "id", F.upper("seq").alias("aa")).join(cds.select(A, "id", "input_order"), [A, "id"])
    kind = cds.schema[A].dataType.simpleString()

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({A: batch[A], "sites": [_next_sites(*keys) for keys in zip(batch["codon_keys"], batch["aa_keys"], strict=True)]})

    sites = _column_keys(left, "codon_keys").join(_column_keys(right, "aa_keys"), A).mapInPandas(match, f"{A} {kind}, sites array<int>")
    return keep_sites(cds, sites)


#: Columns whose sums a task holds before it hands them on, and bytes of a column's digest.
HELD_COLUMNS, KEY = 1_000_000, 16


def _next_sites(codon_keys: bytes, aa_keys: bytes) -> list[int]:
    """For each protein column the next codon column after the last taken one with its digest, where there is one."""
    places: dict[bytes, list[int]] = {}
    for site in range(len(codon_keys) // KEY):
        places.setdefault(codon_keys[site * KEY:(site + 1) * KEY], []).append(site)
    last, kept = -1, []
    for at in range(0, len(aa_keys), KEY):
        own = places.get(aa_keys[at:at + KEY], ())
        later = bisect_right(own, last)
        if later < len(own):
            last = own[later]
            kept.append(last)
    return kept


def _column_keys(rows: DataFrame, name: str) -> DataFrame:
    """(alignment_id, name): the digests of all columns of ``aa``, put together.

    A column's digest is two sums of numbers that row, letter and sum give, so its letters needn't be in one place: tasks add
    up their rows' columns, and one task adds up the sums of an alignment, a vector at a time.
    """
    kind = rows.schema[A].dataType.simpleString()
    numbers = rows.select(A, "aa", *[F.xxhash64("input_order", F.lit(k)).alias(f"h{k}") for k in (1, 2)])
    kinds = pa.schema([(A, numbers.limit(0).select(A).toArrow().schema.field(0).type), ("sums", pa.binary())])

    def cells(aa: str, seeds: tuple[int, int]) -> np.ndarray:
        letters = np.frombuffer(aa.encode("utf-32-le"), np.uint32)
        own, at = (np.arange(128, dtype=np.uint64), letters) if letters.max() < 128 else np.unique(letters.astype(np.uint64), return_inverse=True)
        x = np.array(seeds, np.int64).view(np.uint64)[:, None] + (own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))).T[at]

    def add(sums: np.ndarray | None, more: np.ndarray) -> np.ndarray:
        if sums is None or len(sums) < len(more):
            sums, more = more.copy(), sums
        if more is not None:
            sums[:len(more)] += more  # modulo 2^64
        return sums

    def batch_of(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), kinds.field(0).type), pa.array([v.tobytes() for v in held.values()], pa.binary())], schema=kinds)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for batch in batches:
            for key, aa, *seeds in zip(*(batch.column(k) for k in range(4)), strict=True):
                if not (aa := aa.as_py()):  # a filter would translate once more
                    continue
                key = key.as_py()
                before = len(held.get(key, ()))
                held[key] = add(held.get(key), cells(aa, tuple(x.as_py() for x in seeds)))
                size += len(held[key]) - before
                if size > HELD_COLUMNS:
                    yield batch_of(held)
                    held, size = {}, 0
        yield batch_of(held)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for batch in batches:
            for key, own in zip(batch.column(0), batch.column(1), strict=True):
                key = key.as_py()
                if sums is not None and key != now:
                    yield batch_of({now: sums})
                    sums = None
                now, sums = key, add(sums, np.frombuffer(own.as_py(), np.uint64).reshape(-1, 2))
        if sums is not None:
            yield batch_of({now: sums})

    schema = f"{A} {kind}, sums binary"
    return numbers.mapInArrow(partial, schema).repartition(A).sortWithinPartitions(A).mapInArrow(whole, schema).withColumnRenamed("sums", name)


def trim_report(seqs: DataFrame, min_clean_fraction: float = 0.5, table: int | str = 1) -> tuple[DataFrame, DataFrame]:
    """(one row an alignment, one row a codon column) of what trim_codons does.

    (alignment_id, num_sequences, num_input_codon_sites, num_output_codon_sites, num_removed_codon_sites, min_clean_fraction), and
    (alignment_id, codon_site_1based, clean_fraction, clean_codons, unclean_codons, missing_codons, ambiguous_codons, stop_codons, keep).
    """
    keep = F.col("clean_fraction") >= min_clean_fraction
    columns = site_summary(seqs, table).select(
        A, (F.col("site") + 1).alias("codon_site_1based"), "clean_fraction", F.col("clean").alias("clean_codons"), (F.col("n") - F.col("clean")).alias("unclean_codons"), F.col("missing").alias("missing_codons"),
        F.col("ambiguous").alias("ambiguous_codons"), F.col("stop").alias("stop_codons"), keep.alias("keep"))
    sums = columns.groupBy(A).agg(F.count("*").alias("k"), F.count_if("keep").alias("kept"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = seqs.groupBy(A).agg(F.count("*").alias("num_sequences")).join(sums, A, "left")
    return rows.select(A, "num_sequences", n("k").alias("num_input_codon_sites"), n("kept").alias("num_output_codon_sites"), (n("k") - n("kept")).alias("num_removed_codon_sites"),
                       F.lit(float(min_clean_fraction)).alias("min_clean_fraction")), columns


def degeneracy_report(seqs: DataFrame, table: int | str = 1) -> DataFrame:
    """(alignment_id, num_sequences, num_input_nt_sites, num_input_codon_sites, num_conflict_sites, num_unassigned_sites, num_0fold_sites, num_2fold_sites,
    num_3fold_sites, num_4fold_sites) of each alignment; sites are nucleotide columns of complete codons."""
    columns = degeneracy_columns(seqs, table)
    counts = columns.groupBy(A).agg(*[F.count_if(F.col("status") == s).alias(f"num_{s}_sites") for s in ("conflict", "unassigned")], *[F.count_if(F.col("fold") == k).alias(f"num_{k}fold_sites") for k in (0, 2, 3, 4)])
    rows = seqs.groupBy(A).agg(F.count("*").alias("num_sequences"), F.max(F.length("seq")).cast("long").alias("num_input_nt_sites"))
    rows = rows.withColumn("num_input_codon_sites", F.floor(F.col("num_input_nt_sites") / 3)).join(counts, A, "left")
    return rows.select(A, "num_sequences", "num_input_nt_sites", "num_input_codon_sites", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts.columns if c != A])


def max_align_report(seqs: DataFrame, missing: str = "-?.", most_sequences: int = 16, **options) -> DataFrame:
    """(alignment_id, mode, num_input_sequences, num_kept_sequences, num_removed_sequences, initial_complete_codon_sites, final_complete_codon_sites,
    initial_area, final_area, area_delta) of what max_align does; mode: exact or greedy."""
    whole = F.length(F.translate("codon", missing, "")) == F.length("codon")
    complete = codon_rows(seqs, (A,)).groupBy(A, "site").agg(F.every(whole).alias("ok")).groupBy(A).agg(F.count_if("ok").alias("before"))
    kept = max_align(seqs, missing, most_sequences, **options).groupBy(A).agg(F.count("*").alias("kept"), F.floor(F.max(F.length("seq")) / 3).alias("after"))
    rows = seqs.groupBy(A).agg(F.count("*").alias("n")).join(complete, A, "left").join(kept, A, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    first, last = n("n") * n("before"), n("kept") * n("after")
    return rows.select(A, F.when(F.col("n") <= most_sequences, "exact").otherwise("greedy").alias("mode"), n("n").alias("num_input_sequences"), n("kept").alias("num_kept_sequences"),
                       (n("n") - n("kept")).alias("num_removed_sequences"), n("before").alias("initial_complete_codon_sites"), n("after").alias("final_complete_codon_sites"), first.alias("initial_area"),
                       last.alias("final_area"), (last - first).alias("area_delta"))

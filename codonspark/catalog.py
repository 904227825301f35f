"""The queries over the driver's tables and their DuckDB twins.

``query`` registers a function of (spark, sf_dir) under its name with its SQL, None where SQL can't express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonspark.functions import codes
from codonspark.functions import proteins as P
from codonspark.functions import sequences as S
from codonspark.operators import calibration, centroid, checks, gaps, joins, labels, metrics, orf, rows, similarity, sites, specialists, stacking, trees, windows
from codonspark.operators import localize as localize_
from codonspark.plans.frames import AS_BASES, AS_RESIDUES, LETTERS, document_alignments, document_sequences, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- SQL fragments

_ID = "concat(coalesce(source, 'none'), '_', (doc_id % 40)::VARCHAR, '.', (doc_id % 3)::VARCHAR)"
_LETTERS = "regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')"
SEQS = f"SELECT doc_id AS input_order, {_ID} AS id, lang, translate(upper({_LETTERS}), '{LETTERS}', '{AS_BASES}') AS seq FROM documents"
PROTEINS = f"SELECT doc_id AS input_order, {_ID} AS id, lang, translate(upper({_LETTERS}), '{LETTERS}', '{AS_RESIDUES}') AS seq FROM documents"
CASED = f"SELECT doc_id AS input_order, {_ID} AS id, translate({_LETTERS}, '{LETTERS}{LETTERS.lower()}', '{AS_BASES}{AS_BASES.lower()}') AS seq FROM documents"
ALIGNED = f"SELECT ceil(length(seq) / 60)::BIGINT AS alignment_id, input_order, id, rpad(seq, (ceil(length(seq) / 60) * 60)::INT, '-') AS seq FROM ({SEQS}) WHERE length(seq) > 0"
CODON = "substr(seq, (3 * k + 1)::INT, 3)"


def codon_rows_sql(frame: str, keys: str) -> str:
    return f"SELECT {keys}, k AS site, {CODON} AS codon FROM (SELECT *, unnest(range(length(seq) // 3)) AS k FROM ({frame}))"


def cls_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[-?.]') THEN 'missing' WHEN regexp_matches({c}, '[^ACGT]') THEN 'ambiguous' WHEN {c} IN ('TAA', 'TAG', 'TGA') THEN 'stop' ELSE 'clean' END"


def aa_sql(c: str) -> str:
    at = lambda k: f"(instr('TCAG', substr({c}, {k}, 1)) - 1)"
    return f"substr('{codes.CODES[1][1]}', ({at(1)} * 16 + {at(2)} * 4 + {at(3)} + 1)::INT, 1)"


def iupac_sql(c: str) -> str:
    letters = "".join(codes.IUPAC)
    at = lambda k: f"(instr('{letters}', substr({c}, {k}, 1)) - 1)"
    known = f"substr('{codes.ambiguous_residues(1)}', ({at(1)} * 225 + {at(2)} * 15 + {at(3)} + 1)::INT, 1)"
    return f"CASE WHEN regexp_full_match({c}, '[-.]+') THEN '-' WHEN regexp_matches({c}, '[-?.]') THEN 'X' ELSE {known} END"


CS = "regexp_extract_all(seq, '.{3}')"
CHUNKS = "regexp_extract_all(seq, '.{1,3}')"
TAA = "c IN ('TAA', 'TAG', 'TGA')"


def n_of(test: str, codons: str = CS) -> str:
    return f"len(list_filter({codons}, lambda c: {test}))::BIGINT"


KNOWN = f"list_filter({CS}, lambda c: NOT regexp_matches(c, '[-?.]'))"
INTERNAL = f"coalesce(len(list_filter(list_slice({KNOWN}, 1, len({KNOWN}) - 1), lambda c: {TAA})) > 0, false)"


# --- rows

@query(f"""SELECT codon, {aa_sql('codon')} AS aa, n, round(n / sum(n) OVER (), 6) AS fraction FROM (SELECT codon, count(*) AS n FROM ({codon_rows_sql(SEQS, 'input_order')}) WHERE regexp_full_match(codon, '[ACGT]{{3}}') GROUP BY codon)""")
def codon_usage(spark, sf_dir):
    return rows.codon_usage(document_sequences(spark, sf_dir)).withColumn("fraction", r6("fraction"))


@query(f"""SELECT count(*) AS num_sequences, coalesce(sum(length(seq)), 0)::BIGINT AS total_length, coalesce(sum(length(regexp_replace(seq, '[^a-z]', '', 'g'))), 0)::BIGINT AS softmasked,
coalesce(sum(length(regexp_replace(seq, '[^Nn]', '', 'g'))), 0)::BIGINT AS num_n, coalesce(sum(length(regexp_replace(seq, '[^-]', '', 'g'))), 0)::BIGINT AS num_gap,
round(sum(length(regexp_replace(seq, '[^GCgc]', '', 'g'))) / sum(length(seq)) * 100, 6) AS gc_percent FROM ({CASED})""")
def sequence_stats(spark, sf_dir):
    return rows.sequence_stats(document_sequences(spark, sf_dir, keep_case=True)).withColumn("gc_percent", r6("gc_percent"))


def _gc(k: str) -> str:
    joined = {"all": "seq"}.get(k, f"list_aggregate(list_transform({CHUNKS}, lambda c: substr(c, {k[-1]}, 1)), 'string_agg', '')")
    g, n = (f"length(regexp_replace(coalesce({joined}, ''), '[^{x}]', '', 'g'))" for x in ("GC", "ACGT"))
    return f"round(CASE WHEN {n} = 0 THEN 0.0 ELSE {g} / {n} * 100 END, 6) AS gc{k[-1] if k != 'all' else '_all'}"


@query(f"""SELECT input_order, id AS seq_id, length(seq)::BIGINT AS nt_length, (length(seq) // 3)::BIGINT AS codons_total, len({KNOWN})::BIGINT AS codons_complete, {n_of("regexp_matches(c, '[-?.]')", CHUNKS)} AS codons_missing,
{n_of("NOT regexp_matches(c, '[-?.]') AND regexp_matches(c, '[^ACGT]')")} AS codons_ambiguous, {n_of(TAA)} AS codons_stop, {_gc('all')}, {_gc('1')}, {_gc('2')}, {_gc('3')} FROM ({SEQS})""")
def codon_stats(spark, sf_dir):
    out = rows.codon_stats(document_sequences(spark, sf_dir))
    return out.withColumns({c: r6(c) for c in ("gc_all", "gc1", "gc2", "gc3")})


_METRICS = f"""SELECT input_order, id, length(seq)::BIGINT AS length_nt, (length(seq) % 3)::BIGINT AS tail_nt, length(seq) % 3 <> 0 AS non_triplet, {INTERNAL} AS internal_stop, (length(seq) // 3)::BIGINT AS total_codons,
{n_of(cls_sql('c') + " = 'clean'")} AS clean_codons, {n_of(cls_sql('c') + " = 'missing'")} AS missing_codons, {n_of(cls_sql('c') + " = 'ambiguous'")} AS ambiguous_codons, {n_of(cls_sql('c') + " = 'stop'")} AS stop_codons FROM ({SEQS})"""
_REPORT = f"""SELECT *, CASE WHEN total_codons > 0 THEN clean_codons / total_codons ELSE 0.0 END AS f FROM ({_METRICS})"""


def _filter_sql(internal: bool, dedup: str) -> str:
    stop = "internal_stop" if internal else "false"
    first = f"concat_ws(',', CASE WHEN non_triplet THEN 'non_triplet' END, CASE WHEN {stop} THEN 'internal_stop' END, CASE WHEN f < 0.8 THEN 'low_clean_fraction' END)"
    order = "length_nt DESC, input_order" if dedup == "keep-longest" else "input_order"
    return f"""SELECT input_order, id, length_nt, tail_nt, non_triplet, {stop} AS internal_stop, total_codons, clean_codons, missing_codons, ambiguous_codons, stop_codons, round(f, 6) AS clean_codon_fraction, CASE WHEN r = '' AND k > 1 THEN 'duplicate' ELSE r END AS reasons, r = '' AND k = 1 AS kept
FROM (SELECT *, row_number() OVER (PARTITION BY id, r = '' ORDER BY {order}) AS k FROM (SELECT *, {first} AS r FROM ({_REPORT})))"""


def _filtered(spark, sf_dir, internal, dedup):
    out = rows.filter_report(document_sequences(spark, sf_dir), drop_internal_stop=internal, min_clean_codon_fraction=0.8, dedup=dedup)
    return out.drop("seq", "lang").withColumn("reasons", F.array_join("reasons", ",")).withColumn("clean_codon_fraction", r6("clean_codon_fraction"))


@query(_filter_sql(True, "keep-longest"))
def filter_keep_longest(spark, sf_dir):
    return _filtered(spark, sf_dir, True, "keep-longest")


@query(_filter_sql(False, "keep-first"))
def filter_keep_first(spark, sf_dir):
    return _filtered(spark, sf_dir, False, "keep-first")


_GAPONLY = "regexp_full_match(seq, '[-?.NXnx]+')"
_VALID = f"""SELECT input_order, id, length(seq)::BIGINT AS n, length(seq) % 3 <> 0 AS non_triplet, {_GAPONLY} AS gap_only, {INTERNAL} AS internal_stop, {n_of("NOT regexp_matches(c, '[-?.]') AND regexp_matches(c, '[^ACGT]')")} AS ambiguous_codons, len({KNOWN})::BIGINT AS evaluable_codons FROM ({SEQS})"""


@query(_VALID)
def validate_rows(spark, sf_dir):
    return rows.validate_rows(document_sequences(spark, sf_dir)).withColumn("n", F.col("n").cast("long"))


@query(f"""SELECT count(*) AS num_sequences, min(n) = max(n) AS aligned, count(*) FILTER (non_triplet) AS non_triplet, count(*) FILTER (gap_only) AS gap_only, count(*) FILTER (internal_stop) AS internal_stop, sum(ambiguous_codons)::BIGINT AS ambiguous_codons, sum(evaluable_codons)::BIGINT AS evaluable_codons,
(SELECT count(*) FROM (SELECT id FROM ({SEQS}) GROUP BY id HAVING count(*) > 1)) AS duplicate_ids, round(sum(ambiguous_codons) / sum(evaluable_codons), 6) AS ambiguous_rate FROM ({_VALID})""")
def validate_summary(spark, sf_dir):
    return rows.validate_summary(document_sequences(spark, sf_dir)).withColumn("ambiguous_rate", r6("ambiguous_rate"))


@query(f"SELECT input_order, concat('>', id, chr(10), seq) AS line FROM ({SEQS}) WHERE regexp_full_match(id, 'src1_[0-9]+\\.[01]')")
def print_sequences(spark, sf_dir):
    return rows.print_sequences(document_sequences(spark, sf_dir), r"src1_[0-9]+\.[01]")


@query(f"SELECT input_order, id FROM ({SEQS}) WHERE NOT (regexp_full_match(id, 'src0_1.*') OR (CASE WHEN length(seq) = 0 THEN 0.0 ELSE length(regexp_replace(seq, '[^-NX?]', '', 'g')) / length(seq) END) >= 0.02)")
def remove_sequences(spark, sf_dir):
    return rows.remove_sequences(document_sequences(spark, sf_dir), "src0_1.*", percent=2).select("input_order", "id")


@query(f"""SELECT input_order, id, length(seq)::BIGINT AS n, group_order FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY length(seq) DESC, input_order) AS k, min(input_order) OVER (PARTITION BY g) AS group_order FROM (SELECT *, regexp_replace(id, '\\.[0-9]+$', '') AS g FROM ({SEQS}))) WHERE k = 1""")
def aggregate_longest(spark, sf_dir):
    return rows.longest_of_group(document_sequences(spark, sf_dir), [r"\.[0-9]+$"]).select("input_order", "id", F.length("seq").cast("long").alias("n"), "group_order")


@query(f"""SELECT input_order, CASE WHEN n > 1 THEN concat(id, '_', k::VARCHAR) ELSE id END AS id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY input_order) AS k, count(*) OVER (PARTITION BY id) AS n FROM (SELECT input_order, substr(translate(id, 's.', 'xx'), 1, 6) AS id FROM ({SEQS})))""")
def label_ids(spark, sf_dir):
    return rows.relabel(document_sequences(spark, sf_dir), "s.--x", 6, True).select("input_order", "id")


_BAD = "(c LIKE '%-%' AND c <> '---') OR c IN ('TAA', 'TAG', 'TGA') OR (c <> '---' AND NOT regexp_full_match(c, '[ACGT]{3}'))"


@query(f"SELECT input_order, coalesce(list_aggregate(list_transform({CHUNKS}, lambda c: CASE WHEN {_BAD} THEN 'NNN' ELSE c END), 'string_agg', ''), '') AS seq FROM ({SEQS})")
def mask_codons(spark, sf_dir):
    return rows.mask(document_sequences(spark, sf_dir)).select("input_order", "seq")


def _stops(s: str) -> str:
    return f"len(list_filter(list_slice(regexp_extract_all({s}, '.{{3}}'), 1, greatest(len(regexp_extract_all({s}, '.{{3}}')) - 1, 0)), lambda c: {TAA}))"


def _pads(options) -> str:
    return "[" + ", ".join(f"struct_pack(stops := {_stops(f'concat(repeat(chr(78), {h}), seq, repeat(chr(78), {t}))')}, k := {k}, head := {h}, tail := {t})" for k, (h, t) in enumerate(options)) + "]"


@query(f"""SELECT input_order, concat(repeat('N', head), seq, repeat('N', tail)) AS seq, head, tail, padded FROM (SELECT input_order, seq, inner_stops > 0 OR m > 0 AS padded,
CASE WHEN inner_stops > 0 THEN list_min(o).head ELSE 0 END AS head, CASE WHEN inner_stops > 0 THEN list_min(o).tail ELSE m END AS tail FROM (SELECT *, {_stops("concat(seq, repeat('N', m))")} AS inner_stops, CASE m WHEN 0 THEN {_pads([(0, 0), (1, 2), (2, 1)])} WHEN 1 THEN {_pads([(0, 1), (1, 0), (2, 2)])} ELSE {_pads([(0, 2), (2, 0), (1, 1)])} END AS o FROM (SELECT input_order, seq, ((3 - length(seq) % 3) % 3)::INT AS m FROM ({SEQS}))))""")
def pad_sequences(spark, sf_dir):
    return rows.pad(document_sequences(spark, sf_dir)).select("input_order", "seq", "head", "tail", "padded")


_TRANSLATED = f"coalesce(list_aggregate(list_transform({CS}, lambda c: {iupac_sql('c')}), 'string_agg', ''), '')"


@query(f"SELECT input_order, {_TRANSLATED} AS seq FROM ({SEQS})")
def translate_sequences(spark, sf_dir):
    return rows.translate(document_sequences(spark, sf_dir)).select("input_order", "seq")


@query(f"SELECT input_order, string_split({_TRANSLATED}, '*')[1] AS seq FROM ({SEQS})")
def translate_to_stop(spark, sf_dir):
    return rows.translate(document_sequences(spark, sf_dir), to_stop=True).select("input_order", "seq")


@query(" UNION ALL ".join(f"SELECT '{n}' AS part, input_order, coalesce(list_aggregate(list_transform({CHUNKS}, lambda c: substr(c, {k}, 1)), 'string_agg', ''), '') AS seq FROM ({SEQS})" for k, n in ((1, "1st"), (2, "2nd"), (3, "3rd"))))
def split_positions(spark, sf_dir):
    parts = [df.select(F.lit(name).alias("part"), "input_order", "seq") for name, df in rows.split_positions(document_sequences(spark, sf_dir)).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT input_order, reverse(translate(seq, 'ACGTRYMKWSBDHVN', 'TGCAYRKMWSVHDBN')) AS seq FROM ({SEQS})")
def reverse_complements(spark, sf_dir):
    return document_sequences(spark, sf_dir).select("input_order", S.reverse_complement(F.col("seq")).alias("seq"))


@query(f"SELECT input_order, id, ambiguous_codons FROM ({_VALID}) WHERE ambiguous_codons > 0 ORDER BY ambiguous_codons DESC, id, input_order LIMIT 20")
def most_ambiguous(spark, sf_dir):
    return rows.top_ambiguous(document_sequences(spark, sf_dir), 20)


@query(f"SELECT input_order, string_agg(concat(k::VARCHAR, '+', n::VARCHAR), ',' ORDER BY k) AS runs FROM (SELECT input_order, k, length(regexp_extract(substr(seq, (k + 1)::INT), '^N+')) AS n FROM (SELECT input_order, seq, unnest(range(length(seq))) AS k FROM ({SEQS})) WHERE substr(seq, (k + 1)::INT, 1) = 'N' AND (k = 0 OR substr(seq, k::INT, 1) <> 'N')) GROUP BY input_order")
def n_runs(spark, sf_dir):
    found = document_sequences(spark, sf_dir).select("input_order", S.runs(F.col("seq"), "N").alias("r")).where(F.size("r") > 0)
    return found.select("input_order", F.array_join(F.transform("r", lambda x: F.concat(x["start"].cast("string"), F.lit("+"), x["len"].cast("string"))), ",").alias("runs"))


# --- checks

@query(f"SELECT id, length(seq)::BIGINT AS length FROM ({SEQS}) WHERE length(seq) % 3 <> 0")
def check_triplets(spark, sf_dir):
    return checks.not_triplets(document_sequences(spark, sf_dir))


@query(f"SELECT id, length(replace(seq, '-', ''))::BIGINT AS length FROM ({SEQS}) WHERE length(replace(seq, '-', '')) % 3 <> 0")
def check_triplets_without_gaps(spark, sf_dir):
    return checks.not_triplets(document_sequences(spark, sf_dir), ignore_gaps=True)


@query(f"SELECT length(seq)::BIGINT AS length, count(*) AS n FROM ({SEQS}) GROUP BY 1")
def check_aligned(spark, sf_dir):
    return checks.unequal_lengths(document_sequences(spark, sf_dir))


@query("SELECT page_id::VARCHAR AS id, list_aggregate(list_sort(list_distinct(string_split(regexp_replace(coalesce(url, ''), '[A-Za-z*?.-]', '', 'g'), ''))), 'string_agg', '') AS characters FROM pages WHERE regexp_replace(coalesce(url, ''), '[A-Za-z*?.-]', '', 'g') <> ''")
def check_alphabet(spark, sf_dir):
    return checks.bad_characters(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.coalesce("url", F.lit("")).alias("seq")))


@query(f"SELECT id, count(*) AS n FROM ({SEQS}) GROUP BY id HAVING count(*) > 1")
def check_unique_ids(spark, sf_dir):
    return checks.repeated_ids(document_sequences(spark, sf_dir))


@query("SELECT 'left' AS side, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def check_same_ids(spark, sf_dir):
    return checks.unmatched_ids(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


# --- columns of alignments

_COLS = codon_rows_sql(ALIGNED, "alignment_id, input_order")
_SITES = f"SELECT alignment_id, site, count(*) AS n, " + ", ".join(f"count(*) FILTER (c = '{k}') AS {k}" for k in ("clean", "missing", "ambiguous", "stop")) + f" FROM (SELECT *, {cls_sql('codon')} AS c FROM ({_COLS})) GROUP BY alignment_id, site"


def _kept_sql(kept: str) -> str:
    return f"SELECT a.alignment_id, a.input_order, coalesce(string_agg(r.codon, '' ORDER BY r.site), '') AS seq FROM ({ALIGNED}) a LEFT JOIN (SELECT c.* FROM ({_COLS}) c JOIN ({kept}) s ON c.alignment_id = s.alignment_id AND c.site = s.site) r ON a.input_order = r.input_order GROUP BY a.alignment_id, a.input_order"


@query(f"SELECT *, round(clean / n, 6) AS clean_fraction FROM ({_SITES})")
def site_summary(spark, sf_dir):
    return sites.site_summary(document_alignments(spark, sf_dir)).withColumn("clean_fraction", r6("clean_fraction"))


@query(f"SELECT alignment_id, max(n) AS num_sequences, count(*) AS num_input_codon_sites, count(*) FILTER (clean / n >= 0.5) AS num_output_codon_sites, count(*) FILTER (clean / n < 0.5) AS num_removed_codon_sites, 0.5::DOUBLE AS min_clean_fraction FROM ({_SITES}) GROUP BY alignment_id")
def trim_report(spark, sf_dir):
    return sites.trim_report(document_alignments(spark, sf_dir))[0]


@query(f"SELECT alignment_id, site + 1 AS codon_site_1based, round(clean / n, 6) AS clean_fraction, clean AS clean_codons, n - clean AS unclean_codons, missing AS missing_codons, ambiguous AS ambiguous_codons, stop AS stop_codons, clean / n >= 0.5 AS keep FROM ({_SITES})")
def trim_report_columns(spark, sf_dir):
    return sites.trim_report(document_alignments(spark, sf_dir))[1].withColumn("clean_fraction", r6("clean_fraction"))


@query(_kept_sql(f"SELECT alignment_id, site FROM ({_SITES}) WHERE clean / n >= 0.5"))
def trim_codons(spark, sf_dir):
    return sites.trim_codons(document_alignments(spark, sf_dir)).select("alignment_id", "input_order", "seq")


_OCC = f"SELECT alignment_id, site, count(*) FILTER ({iupac_sql('codon')} NOT IN ('-', '?', 'X', '*')) AS occupied FROM ({_COLS}) GROUP BY alignment_id, site"
_NAIL = f"""SELECT alignment_id, CASE WHEN max(k) FILTER (ok) IS NULL THEN 1 ELSE max(k) FILTER (ok) END AS nail FROM (SELECT alignment_id, k, bool_and(solid) AS ok FROM (SELECT c.alignment_id, c.input_order, k, coalesce(bool_or(o.occupied >= k AND NOT regexp_full_match(c.codon, '[-?.NXnx]+')), false) AS solid
FROM ({_COLS}) c JOIN (SELECT alignment_id, unnest(range(1, least(4, count(*)) + 1)) AS k FROM ({ALIGNED}) GROUP BY alignment_id) t ON c.alignment_id = t.alignment_id JOIN ({_OCC}) o ON c.alignment_id = o.alignment_id AND c.site = o.site GROUP BY c.alignment_id, c.input_order, k) GROUP BY alignment_id, k) GROUP BY alignment_id"""


@query(_kept_sql(f"SELECT o.alignment_id, o.site FROM ({_OCC}) o JOIN ({_NAIL}) n ON o.alignment_id = n.alignment_id WHERE o.occupied >= n.nail"))
def hammer(spark, sf_dir):
    return sites.hammer(document_alignments(spark, sf_dir)).select("alignment_id", "input_order", "seq")


_FOLD = f"CASE WHEN regexp_full_match(codon, '[ACGT]{{3}}') THEN nullif(substr('{codes.folds(1)}', (3 * ((instr('TCAG', substr(codon, 1, 1)) - 1) * 16 + (instr('TCAG', substr(codon, 2, 1)) - 1) * 4 + instr('TCAG', substr(codon, 3, 1)) - 1) + p + 1)::INT, 1), ' ') END"
_DEG = f"""SELECT alignment_id, site, p AS position, CASE WHEN count(DISTINCT f) = 1 THEN min(f)::INT END AS fold, CASE count(DISTINCT f) WHEN 0 THEN 'unassigned' WHEN 1 THEN 'assigned' ELSE 'conflict' END AS status FROM (SELECT alignment_id, site, p, {_FOLD} AS f FROM ({_COLS}), (SELECT unnest([0, 1, 2])::INT AS p)) GROUP BY alignment_id, site, p"""


_FOLD_COUNTS = ", ".join(f"count(*) FILTER (fold = {k}) AS num_{k}fold_sites" for k in (0, 2, 3, 4))


@query(f"SELECT a.alignment_id, num_sequences, num_input_nt_sites, num_input_nt_sites // 3 AS num_input_codon_sites, count(*) FILTER (status = 'conflict') AS num_conflict_sites, count(*) FILTER (status = 'unassigned') AS num_unassigned_sites, {_FOLD_COUNTS} "
       f"FROM (SELECT alignment_id, count(*) AS num_sequences, max(length(seq)) AS num_input_nt_sites FROM ({ALIGNED}) GROUP BY alignment_id) a JOIN ({_DEG}) d ON a.alignment_id = d.alignment_id GROUP BY a.alignment_id, num_sequences, num_input_nt_sites")
def degeneracy_report(spark, sf_dir):
    return sites.degeneracy_report(document_alignments(spark, sf_dir))


@query(_DEG)
def degeneracy_columns(spark, sf_dir):
    return sites.degeneracy_columns(document_alignments(spark, sf_dir))


@query(f"SELECT a.alignment_id, a.input_order, coalesce(string_agg(substr(a.seq, (d.site * 3 + d.position + 1)::INT, 1), '' ORDER BY d.site, d.position), '') AS seq FROM ({ALIGNED}) a LEFT JOIN (SELECT * FROM ({_DEG}) WHERE fold = 4) d ON a.alignment_id = d.alignment_id GROUP BY a.alignment_id, a.input_order")
def fourfold_sites(spark, sf_dir):
    return sites.degenerate_sequences(document_alignments(spark, sf_dir), 4).select("alignment_id", "input_order", "seq")


_CONSENSUS = f"""WITH c AS ({_COLS}), v AS (SELECT alignment_id, site, codon, count(*) AS n FROM c WHERE regexp_full_match(codon, '[ACGT]{{3}}') GROUP BY ALL),
b AS (SELECT alignment_id, site, codon FROM (SELECT *, row_number() OVER (PARTITION BY alignment_id, site ORDER BY n DESC, codon) AS k FROM v) WHERE k = 1),
l AS (SELECT alignment_id, site, p, x, count(*) AS n FROM (SELECT alignment_id, site, p, substr(codon, p, 1) AS x FROM c, (SELECT unnest([1, 2, 3])::INT AS p)) WHERE x NOT IN ('-', '?', '.') GROUP BY ALL),
s AS (SELECT alignment_id, site, p, x FROM (SELECT *, row_number() OVER (PARTITION BY alignment_id, site, p ORDER BY n DESC, x) AS k FROM l) WHERE k = 1),
g AS (SELECT alignment_id, site, bool_and(regexp_full_match(codon, '[-?.]{{3}}')) AS gaps FROM c GROUP BY alignment_id, site),
r AS (SELECT g.alignment_id, g.site, CASE WHEN b.codon IS NOT NULL THEN b.codon WHEN gaps THEN '---' ELSE concat(coalesce(s1.x, '-'), coalesce(s2.x, '-'), coalesce(s3.x, '-')) END AS codon FROM g LEFT JOIN b ON g.alignment_id = b.alignment_id AND g.site = b.site
LEFT JOIN (SELECT * FROM s WHERE p = 1) s1 ON g.alignment_id = s1.alignment_id AND g.site = s1.site LEFT JOIN (SELECT * FROM s WHERE p = 2) s2 ON g.alignment_id = s2.alignment_id AND g.site = s2.site LEFT JOIN (SELECT * FROM s WHERE p = 3) s3 ON g.alignment_id = s3.alignment_id AND g.site = s3.site)
SELECT *, CASE WHEN regexp_matches(codon, '[-?.]') THEN '-' WHEN regexp_matches(codon, '[^ACGT]') THEN '?' ELSE {aa_sql('codon')} END AS aa FROM r"""


@query(_CONSENSUS)
def consensus(spark, sf_dir):
    return sites.consensus(document_alignments(spark, sf_dir))


@query(f"SELECT alignment_id, site, aa, n, round(n / sum(n) OVER (PARTITION BY alignment_id, site), 6) AS fraction FROM (SELECT alignment_id, site, {aa_sql('codon')} AS aa, count(*) AS n FROM ({_COLS}) WHERE regexp_full_match(codon, '[ACGT]{{3}}') GROUP BY ALL)")
def logo(spark, sf_dir):
    return sites.logo(document_alignments(spark, sf_dir)).withColumn("fraction", r6("fraction"))


@query(f"SELECT alignment_id, input_order, id, list_aggregate(list_transform({CS}, lambda c: substr({cls_sql('c')}, 1, 1)), 'string_agg', '') AS states FROM ({ALIGNED})")
def state_matrix(spark, sf_dir):
    return sites.state_matrix(document_alignments(spark, sf_dir))


#: Alignments of at most this many sequences have their subsets searched exactly, as the option's default says.
_EXACT = 16
_SMALL = f"SELECT *, row_number() OVER (PARTITION BY alignment_id ORDER BY input_order) - 1 AS place, count(*) OVER (PARTITION BY alignment_id) AS m FROM ({ALIGNED}) QUALIFY m <= {_EXACT}"
_AREA = f"""WITH a AS ({_SMALL}), c AS (SELECT alignment_id, k AS site, bit_or(CASE WHEN regexp_matches({CODON}, '[-?.]') THEN 0::BIGINT ELSE 1::BIGINT << place END) AS mask FROM (SELECT *, unnest(range(length(seq) // 3)) AS k FROM a) GROUP BY ALL),
s AS (SELECT alignment_id, mask, count(*) AS sites FROM c GROUP BY ALL), n AS (SELECT alignment_id, max(m) AS m FROM a GROUP BY ALL), u AS (SELECT alignment_id, m, unnest(range(1, 1::BIGINT << m)) AS subset FROM n),
x AS (SELECT u.alignment_id, u.subset, bit_count(u.subset)::BIGINT AS kept, coalesce(sum(sites) FILTER ((mask & u.subset) = u.subset), 0)::BIGINT AS complete_sites, list_filter(range(m), lambda i: (u.subset >> i) & 1 = 1) AS places FROM u JOIN s ON u.alignment_id = s.alignment_id GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY alignment_id ORDER BY kept * complete_sites DESC, kept DESC, places) AS r FROM x)
SELECT b.alignment_id, 'exact' AS mode, kept, complete_sites, kept * complete_sites AS area, (SELECT string_agg(input_order::VARCHAR, ',' ORDER BY place) FROM a WHERE a.alignment_id = b.alignment_id AND (b.subset >> place) & 1 = 1) AS kept_orders FROM b WHERE r = 1
UNION ALL SELECT alignment_id, 'over the limit', NULL, NULL, NULL, NULL FROM ({ALIGNED}) GROUP BY alignment_id HAVING count(*) > {_EXACT}"""


@query(_AREA)
def largest_area(spark, sf_dir):
    return sites.largest_area(document_alignments(spark, sf_dir), most_sequences=_EXACT, over_limit="row").withColumn("kept_orders", F.array_join("kept_orders", ","))


@query(None)
def greedy_area(spark, sf_dir):
    return sites.greedy_area(document_alignments(spark, sf_dir)).withColumn("kept_orders", F.array_join("kept_orders", ","))


@query(None)
def max_align(spark, sf_dir):
    return sites.max_align(document_alignments(spark, sf_dir), most_sequences=_EXACT).select("alignment_id", "input_order", "seq")


@query(f"SELECT alignment_id, input_order, seq FROM ({_kept_sql(f'SELECT alignment_id, site FROM ({_SITES}) WHERE missing = 0')})")
def complete_columns(spark, sf_dir):
    return sites.complete_columns(document_alignments(spark, sf_dir)).select("alignment_id", "input_order", "seq")


@query(None)
def back_trim(spark, sf_dir):
    # read five times, made once
    cds = stored(document_alignments(spark, sf_dir).withColumn("id", F.col("input_order").cast("string")), "alignments")
    return sites.back_trim(cds, rows.translate(sites.trim_codons(cds))).select("alignment_id", "input_order", "seq")


# --- joins

_GFF = "SELECT event_id AS line_no, concat('doc', user_id::VARCHAR) AS seqid, event_type AS type, (event_id % 400 - 40)::INT AS start, (event_id % 400 - 40 + event_id % 97)::INT AS \"end\" FROM events"
_DOCS = f"SELECT input_order, concat('doc', input_order::VARCHAR) AS id, seq FROM ({SEQS})"


def _gff(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("line_no"), F.concat(F.lit("doc"), F.col("user_id").cast("string")).alias("seqid"), F.col("event_type").alias("type"), (e % 400 - 40).cast("int").alias("start"), (e % 400 - 40 + e % 97).cast("int").alias("end"))


def _docs(spark, sf_dir):
    return document_sequences(spark, sf_dir).withColumn("id", F.concat(F.lit("doc"), F.col("input_order").cast("string")))


@query(f"SELECT input_order, id FROM ({_DOCS}) WHERE id IN (SELECT concat('doc', doc_id::VARCHAR) FROM labels)")
def common_sequences(spark, sf_dir):
    other = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"))
    return joins.common_ids(_docs(spark, sf_dir), other)[0].select("input_order", "id")


@query(f"SELECT input_order, id FROM ({_DOCS}) WHERE id IN (SELECT seqid FROM ({_GFF}))")
def annotated_sequences(spark, sf_dir):
    return joins.sequences_with_annotations(_docs(spark, sf_dir), _gff(spark, sf_dir)).select("input_order", "id")


@query(f"SELECT line_no, seqid, type, greatest(1, least(start, n))::INT AS start, greatest(1, least(\"end\", n))::INT AS \"end\" FROM ({_GFF}) g JOIN (SELECT id, length(seq)::INT AS n FROM ({_DOCS})) d ON g.seqid = d.id WHERE greatest(1, least(start, n)) <= greatest(1, least(\"end\", n))")
def clamp_annotations(spark, sf_dir):
    return joins.clamp_annotations(_gff(spark, sf_dir), _docs(spark, sf_dir))


_ACC = "SELECT doc_id, concat('A', (doc_id % 300)::VARCHAR, '.', (doc_id % 4)::VARCHAR) AS accession, coalesce(text, '') AS sequence FROM documents"
_OTHER = "SELECT concat('A', (item_id * 7)::VARCHAR, '.1') AS accession, coalesce(text, '') AS sequence FROM benchmark UNION ALL SELECT concat('L', doc_id::VARCHAR), coalesce(text, '') FROM documents WHERE lang = 'es'"


def _accessions(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    own = docs.select("doc_id", F.concat(F.lit("A"), (F.col("doc_id") % 300).cast("string"), F.lit("."), (F.col("doc_id") % 4).cast("string")).alias("accession"), F.coalesce("text", F.lit("")).alias("sequence"))
    other = bench.select(F.concat(F.lit("A"), (F.col("item_id") * 7).cast("string"), F.lit(".1")).alias("accession"), F.coalesce("text", F.lit("")).alias("sequence"))
    return own, other.unionByName(docs.where("lang = 'es'").select(F.concat(F.lit("L"), F.col("doc_id").cast("string")).alias("accession"), F.coalesce("text", F.lit("")).alias("sequence")))


_HAS = f"SELECT d.doc_id, string_split(accession, '.')[1] IN (SELECT string_split(accession, '.')[1] FROM ({_OTHER})) AS a, sequence IN (SELECT sequence FROM ({_OTHER})) AS s FROM ({_ACC}) d"


@query(f"SELECT doc_id FROM ({_HAS}) WHERE NOT a AND NOT s")
def exclude_overlaps(spark, sf_dir):
    return joins.exclude_overlaps(*_accessions(spark, sf_dir)).select("doc_id")


@query(f"SELECT CASE WHEN a AND s THEN 'both' WHEN a THEN 'accession' WHEN s THEN 'sequence' ELSE 'none' END AS reason, count(*) AS n FROM ({_HAS}) GROUP BY 1")
def overlap_reasons(spark, sf_dir):
    return joins.overlap_reasons(*_accessions(spark, sf_dir))


@query("SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n, count(DISTINCT source) AS n_labels, count(*) - 1 AS excess, count(DISTINCT source) > 1 AS conflict FROM documents GROUP BY 1 HAVING count(*) > 1")
def label_conflicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("sequence"), F.col("source").alias("label"))
    return joins.label_conflicts(docs)


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') HAVING count(DISTINCT lang) = 1")
def unique_sequences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), LETTERS.lower(), LETTERS).alias("sequence"), F.col("lang").alias("label"))
    return joins.unique_sequences(docs, "doc_id").select("doc_id")


@query("SELECT user_id AS query, event_id AS target, value AS bits FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def best_hits(spark, sf_dir):
    return joins.best_hits(table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("target"), F.col("value").alias("bits")))


@query(f"SELECT concat('doc', doc_id::VARCHAR, '.1') AS accession FROM documents WHERE concat('doc', doc_id::VARCHAR) NOT IN (SELECT seqid FROM ({_GFF}))")
def missing_accessions(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".1")).alias("accession"))
    return joins.missing_accessions(wanted, _gff(spark, sf_dir).select(F.concat(F.lit("gb|"), "seqid", F.lit("|")).alias("id")))


_CODING = f"SELECT input_order, concat('doc', input_order::VARCHAR) AS id, regexp_replace(substr(seq, 1, (length(seq) // 3 * 3)::INT), '-', 'A', 'g') AS seq FROM ({SEQS})"


@query(f"SELECT input_order, concat(seq, '---') AS seq, NULL::VARCHAR AS error FROM (SELECT input_order, coalesce(list_aggregate(list_transform(cs, lambda c, i: concat(CASE WHEN (i - 1) % 5 = 2 THEN '---' ELSE '' END, c)), 'string_agg', ''), '') AS seq FROM (SELECT input_order, {CS} AS cs FROM ({_CODING})))")
def back_align(spark, sf_dir):
    n = F.floor(F.length("seq") / 3) * 3
    cds = _docs(spark, sf_dir).withColumn("seq", F.replace(F.substr(F.col("seq"), F.lit(1), n.cast("int")), F.lit("-"), F.lit("A")))
    aa = F.split(S.translate_cds(F.col("seq")), "")
    gapped = F.concat(F.array_join(F.transform(F.filter(aa, lambda a: a != ""), lambda a, i: F.concat(F.when(i % 5 == 2, F.lit("-")).otherwise(F.lit("")), a)), ""), F.lit("-"))
    return joins.back_align(cds, cds.select("id", gapped.alias("seq"))).select("input_order", "seq", "error")


# --- gaps and frames

_JUST = f"SELECT input_order, id, regexp_replace(seq, 'N+', 'NNNNN', 'g') AS seq FROM ({_DOCS})"


@query(_JUST)
def justify_gaps(spark, sf_dir):
    return gaps.justify_gaps(_docs(spark, sf_dir), 5).select("input_order", "id", "seq")


_N_RUNS = f"SELECT id, w[i] AS own, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT id, regexp_extract_all(seq, 'N+') AS w, string_split_regex(seq, 'N+') AS g FROM ({_DOCS})))"
_EDITS = f"SELECT id AS seqid, list({{'s': s, 'd': 5 - length(own)}} ORDER BY s) AS edits FROM ({_N_RUNS}) WHERE length(own) <= 2 GROUP BY id"
_EVENT_ROWS = "SELECT event_id AS line_no, concat('doc', user_id::VARCHAR) AS seqid, event_type AS type, (event_id % 400 - 40)::BIGINT AS a, (event_id % 400 - 40 + event_id % 97)::BIGINT AS b FROM events"


def _shifted(x: str) -> str:
    step = "{'pos': CASE WHEN t.pos > e.s + 1 + t.off THEN t.pos + e.d ELSE t.pos END, 'off': t.off + e.d}"
    return f"CASE WHEN edits IS NULL THEN {x} ELSE struct_extract(list_reduce(edits, lambda t, e: {step}, {{'pos': {x}, 'off': 0::BIGINT}}), 'pos') END::INT"


@query(f"SELECT line_no, v.seqid, type, {_shifted('a')} AS start, {_shifted('b')} AS \"end\" FROM ({_EVENT_ROWS}) v LEFT JOIN ({_EDITS}) d ON v.seqid = d.seqid")
def shift_annotations(spark, sf_dir):
    return gaps.shift_annotations(_gff(spark, sf_dir), gaps.justify_gaps(_docs(spark, sf_dir), 5, 1, 2))


#: Codons of all frames of both strands; stops cut a frame into stretches, whose first start or whole length is a candidate.
_STRANDS = f"SELECT input_order, id, lang, length(seq) AS n, unnest([1, 0]) AS sign, unnest([seq, reverse(translate(seq, 'ACGTRYMKWSBDHVN', 'TGCAYRKMWSVHDBN'))]) AS s FROM ({SEQS})"
_CODONS = f"SELECT input_order, n, sign, k % 3 AS frame, k, substr(s, k::INT + 1, 3) AS codon FROM (SELECT *, unnest(range(length(s) - 2)) AS k FROM ({_STRANDS}))"
_STRETCHES = (f"SELECT *, coalesce(sum((codon IN ('TAA', 'TAG', 'TGA'))::INT) OVER (PARTITION BY input_order, sign, frame ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM ({_CODONS})")
_ORFS = ("SELECT input_order, n, sign, frame, min(k) AS opened, min(k) FILTER (codon IN ('" + "', '".join(codes.starts(1)) + "')) AS first, bool_or(codon IN ('TAA', 'TAG', 'TGA')) AS closed, max(k) + 3 AS past "
         f"FROM ({_STRETCHES}) GROUP BY input_order, n, sign, frame, part")
_CANDIDATES = ("SELECT *, CASE WHEN first IS NULL THEN 0 WHEN closed THEN 2 ELSE 1 END AS rank, coalesce(first, opened) AS a, CASE WHEN first IS NULL AND closed THEN past - 3 ELSE past END AS b FROM (" + _ORFS + ")")
_BEST_ORF = ("SELECT *, CASE WHEN sign = 1 THEN a + 1 ELSE n - b + 1 END AS spot, CASE WHEN sign = 1 THEN b ELSE n - a END AS until FROM (" + _CANDIDATES + ") WHERE b - a >= 3 "
             "QUALIFY row_number() OVER (PARTITION BY input_order ORDER BY rank DESC, b - a DESC, sign DESC, frame, spot) = 1")


@query(f"WITH s AS ({_STRANDS}), o AS ({_BEST_ORF}), r AS (SELECT DISTINCT input_order, id, lang FROM s) SELECT r.input_order, r.id, r.lang, coalesce(substr(s.s, o.a::INT + 1, (o.b - o.a)::INT), '') AS seq, CASE o.sign WHEN 1 THEN '+' WHEN 0 THEN '-' END AS strand, "
       "(o.frame + 1)::INT AS frame, o.spot::INT AS orf_start, o.until::INT AS orf_end, CASE o.rank WHEN 2 THEN 'complete' WHEN 1 THEN 'partial' WHEN 0 THEN 'no_start' END AS category "
       "FROM r LEFT JOIN o ON r.input_order = o.input_order LEFT JOIN s ON s.input_order = o.input_order AND s.sign = o.sign")
def longest_orf(spark, sf_dir):
    return orf.longest_orf(document_sequences(spark, sf_dir))


# --- proteins

_AA = f"SELECT input_order, lang, seq FROM ({PROTEINS})"


def _frac(s: str, chars: str) -> str:
    return f"CASE WHEN length({s}) = 0 THEN 0.0 ELSE length(regexp_replace({s}, '[^{chars}]', '', 'g')) / length({s}) END"


def _hyd(s: str) -> str:
    total = " + ".join(f"({v}) * length(regexp_replace({s}, '[^{k}]', '', 'g'))" for k, v in P.HYDROPATHY.items())
    return f"CASE WHEN length({s}) = 0 THEN 0.0 ELSE ({total}) / length({s}) END"


def _run(s: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({s}, '[{P.HYDROPHOBIC}]+'), lambda x: length(x))), 0)::DOUBLE"


def _flag(test: str) -> str:
    return f"CASE WHEN {test} THEN 1.0 ELSE 0.0 END"


_L, _R = (lambda k: f"left(seq, {k})"), (lambda k: f"right(seq, {k})")
_GROUPS = {"basic": P.BASIC, "acidic": P.ACIDIC, "hydrophobic": P.HYDROPHOBIC, "ser_thr": P.SER_THR}
_BASE = ({"aa_len": "length(seq)::DOUBLE"} | {f"n20_{k}_frac": _frac(_L(20), v) for k, v in (_GROUPS | {"pro": "P"}).items()}
         | {f"n40_{k}_frac": _frac(_L(40), v) for k, v in (_GROUPS | {"arg": "R", "lys": "K", "ala": "A", "pro": "P", "gly": "G", "aromatic": P.AROMATIC}).items()}
         | {"n40_hydropathy_mean": _hyd(_L(40)), "n40_hydrophobic_run": _run(_L(40)), "signal_peptide_like": _flag(f"{_run('substr(seq, 7, 24)')} >= 7"), "rr_motif": _flag("left(seq, 40) LIKE '%RR%'"),
            "rr_hydrophobic_after": _flag(f"regexp_matches(left(seq, 60), '{P.RR_HYDROPHOBIC}')"), "cleavage_zone_small_frac": _frac("substr(seq, 19, 17)", P.SMALL)}
         | {f"global_{k}_frac": _frac("seq", v) for k, v in (_GROUPS | {"x": "X"}).items()} | {f"c10_{k}_frac": _frac(_R(10), v) for k, v in {"basic": P.BASIC_STRICT, "acidic": P.ACIDIC, "hydrophobic": P.HYDROPHOBIC}.items()}
         | {"pts1_match": _flag(f"regexp_matches(seq, '{P.PTS1}')"), "pts1_skl": _flag("right(seq, 3) = 'SKL'"), "pts2_match": _flag(f"regexp_matches(left(seq, 40), '{P.PTS2}')")})
_BROAD = (_BASE | {f"n{n}_{k}_frac": _frac(_L(n), v) for n in (60, 100) for k, v in _GROUPS.items()}
          | {"global_hydropathy_mean": _hyd("seq"), "global_hydrophobic_run": _run("seq"), "hydrophobic_segment_count": f"len(regexp_extract_all(seq, '[{P.HYDROPHOBIC}]{{17,}}'))::DOUBLE", "nls_basic_cluster_count": f"len(regexp_extract_all(seq, '{P.NLS}'))::DOUBLE",
             "nls_basic_cluster_match": _flag(f"regexp_matches(seq, '{P.NLS}')"), "nls_bipartite_match": _flag(f"regexp_matches(seq, '{P.NLS_BIPARTITE}')"), "nes_like_match": _flag(f"regexp_matches(seq, '{P.NES}')"), "er_kdel_hdel": _flag("right(seq, 4) IN ('KDEL', 'HDEL')"),
             "er_kkxx": _flag("length(seq) >= 4 AND left(right(seq, 4), 2) = 'KK'"), "gpi_like_ctail": _flag(f"{_run(_R(40))} >= 12"), "c20_hydrophobic_run": _run(_R(20)), "c20_basic_frac": _frac(_R(20), P.BASIC_STRICT), "c20_acidic_frac": _frac(_R(20), P.ACIDIC)}
          | {f"kingdom_{k}": _flag(f"lang = '{v}'") for k, v in (("metazoa", "en"), ("viridiplantae", "fr"), ("fungi", "de"), ("other", "es"))})
_ENDS = {f"c{n}_{k}_frac": _frac(_R(n), v) for n in (3, 4, 12, 40) for k, v in {"basic": P.BASIC_STRICT, "acidic": P.ACIDIC, "hydrophobic": P.HYDROPHOBIC, "ser_thr": P.SER_THR, "small": P.SMALL}.items()} | {f"c{n}_hydropathy_mean": _hyd(_R(n)) for n in (3, 4, 12, 40)} | {
    "pts1_relaxed_match": _flag("regexp_matches(seq, '[A-Z][KRHQ][LIVMFY]$')"), "pts1_hydrophobic_terminal": _flag(f"length(seq) >= 3 AND regexp_matches(seq, '[{P.HYDROPHOBIC}]$')"), "pts2_nterm_match": _flag(f"regexp_matches(left(seq, 40), '{P.PTS2}')")}


def _select(features: dict[str, str]) -> str:
    return f"SELECT input_order, {', '.join(f'round({v}, 6) AS {k}' for k, v in features.items())} FROM ({_AA})"


def _proteins(spark, sf_dir):
    return document_sequences(spark, sf_dir, residues=True).withColumn("seq", P.canonical(F.col("seq")))


def _kingdom() -> Column:
    return F.when(F.col("lang") == "en", "Metazoa").when(F.col("lang") == "fr", "plants").when(F.col("lang") == "de", "Fungi").when(F.col("lang") == "es", "other")


@query(_select(_BASE))
def protein_features(spark, sf_dir):
    return _proteins(spark, sf_dir).select("input_order", *[r6(v).alias(k) for k, v in P.base_features(F.col("seq")).items()])


@query(_select(_BROAD))
def broad_features(spark, sf_dir):
    return _proteins(spark, sf_dir).select("input_order", *[r6(v).alias(k) for k, v in P.broad_features(F.col("seq"), _kingdom()).items()])


@query(_select(_ENDS))
def terminal_features(spark, sf_dir):
    found = P.perox_features(F.col("seq"), _kingdom())
    return _proteins(spark, sf_dir).select("input_order", *[r6(found[k]).alias(k) for k in _ENDS])


@query(f"SELECT CASE WHEN regexp_matches(seq, '{P.PTS1}') THEN 'PTS1' WHEN regexp_matches(left(seq, 40), '{P.PTS2}') THEN 'PTS2' ELSE 'none' END AS signal_type, count(*) AS n FROM ({_AA}) GROUP BY 1")
def perox_signals(spark, sf_dir):
    return _proteins(spark, sf_dir).groupBy(P.signal_type(F.col("seq")).alias("signal_type")).agg(F.count("*").alias("n"))


# --- labels

_PHRASES = ("Secreted.", "Mitochondrion matrix", "Plastid, chloroplast thylakoid lumen", "Chloroplast stroma; Mitochondrion", "Peroxisome", "Nucleus", "", "Chloroplast thylakoid membrane", "Signal peptide; plastid", "thylakoid luminal membrane")
_PHRASE_SQL = "[" + ", ".join(f"'{p}'" for p in _PHRASES) + "][(doc_id % 10 + 1)::INT]"
_TEXTS = f"SELECT doc_id, {_PHRASE_SQL} AS t, CASE WHEN lang = 'fr' THEN 'plant' ELSE 'non_plant' END AS g FROM documents"
_SIG = "SELECT *, (l LIKE '%secreted%' OR l LIKE '%signal peptide%') AS sp, l LIKE '%mitochond%' AS m, (l LIKE '%chloroplast%' OR l LIKE '%plastid%') AS c, l LIKE '%thylakoid%' AS th, (l LIKE '%lumen%' OR l LIKE '%luminal%') AS lu FROM (SELECT *, lower(t) AS l FROM (" + _TEXTS + "))"


def _texts(spark, sf_dir):
    t = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("doc_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), F.when(F.col("lang") == "fr", "plant").otherwise("non_plant").alias("g"))


@query(f"SELECT doc_id, CASE WHEN th AND lu THEN 'lTP' WHEN c THEN 'cTP' WHEN m THEN 'mTP' WHEN sp THEN 'SP' ELSE 'noTP' END AS label, CASE WHEN l LIKE '%peroxisom%' THEN 'yes' ELSE 'no' END AS perox, CASE WHEN th AND lu AND c THEN sp OR m ELSE sp::INT + m::INT + c::INT + (th AND lu)::INT > 1 END AS ambiguous FROM ({_SIG})")
def location_labels(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", labels.from_location_text(F.col("t")).alias("x")).select("doc_id", "x.label", "x.perox", "x.ambiguous")


_STRICT = f"SELECT doc_id, CASE WHEN trim(l) = '' THEN 'missing_location_text' WHEN g <> 'plant' AND (c OR th) THEN 'nonplant_plastid' WHEN sp::INT + m::INT + (g = 'plant' AND c)::INT > 1 OR (lt AND (sp OR m)) THEN 'ambiguous' WHEN lt AND l LIKE '%membrane%' AND l NOT LIKE '%thylakoid lumen%' THEN 'ltp_membrane_noise' WHEN NOT lt AND g = 'plant' AND c AND th THEN 'thylakoid_not_lumen' ELSE '' END AS reason, CASE WHEN lt THEN 'lTP' WHEN g = 'plant' AND c THEN 'cTP' WHEN m THEN 'mTP' WHEN sp THEN 'SP' ELSE 'noTP' END AS label FROM (SELECT *, g = 'plant' AND th AND lu AS lt FROM ({_SIG}))"


@query(f"SELECT doc_id, reason, CASE WHEN reason = '' THEN label END AS label FROM ({_STRICT})")
def strict_labels(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", labels.strict_label(F.col("t"), F.col("g")).alias("x")).select("doc_id", "x.reason", "x.label")


_LINEAGES = ("2759, 33090, 3193", "2759 33208 7742", "2759; 4751", "2759 5794", "2 1224", "", "no taxon")
_LINEAGE_SQL = f"SELECT doc_id, [{', '.join(repr(x) for x in _LINEAGES)}][(doc_id % 7 + 1)::INT] AS x FROM documents"


@query(f"""SELECT doc_id, p.preset FROM (SELECT doc_id, regexp_extract_all(x, '[0-9]+') AS ids FROM ({_LINEAGE_SQL})) l JOIN (SELECT unnest(['viridiplantae', 'metazoa', 'fungi', 'non_viridiplantae_euk', 'protist_core']) AS preset) p ON list_contains(ids, '2759') AND CASE preset WHEN 'viridiplantae' THEN list_contains(ids, '33090') WHEN 'metazoa' THEN list_contains(ids, '33208') WHEN 'fungi' THEN list_contains(ids, '4751')
WHEN 'non_viridiplantae_euk' THEN NOT list_contains(ids, '33090') ELSE NOT (list_contains(ids, '33090') OR list_contains(ids, '33208') OR list_contains(ids, '4751')) END""")
def lineage_presets(spark, sf_dir):
    x = F.element_at(F.array(*[F.lit(p) for p in _LINEAGES]), (F.col("doc_id") % 7 + 1).cast("int"))
    return labels.split_by_preset(table(spark, sf_dir, "documents").select("doc_id", x.alias("lineage_ids"))).select("doc_id", "preset")


@query(f"SELECT CASE WHEN concat(x, ' ') LIKE '%33090 %' THEN 'Viridiplantae' WHEN concat(x, ' ') LIKE '%33208 %' THEN 'Metazoa' WHEN concat(x, ' ') LIKE '%4751 %' THEN 'Fungi' ELSE 'Other' END AS kingdom, count(*) AS n FROM ({_LINEAGE_SQL}) GROUP BY 1")
def kingdoms(spark, sf_dir):
    x = F.element_at(F.array(*[F.lit(p) for p in _LINEAGES]), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").groupBy(labels.kingdom(x).alias("kingdom")).agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n FROM (SELECT unnest(CASE WHEN quality = 1 AND toxic = 1 THEN ['quality', 'toxic'] WHEN quality = 1 THEN ['quality'] WHEN toxic = 1 THEN ['toxic'] ELSE [] END) AS label FROM labels) GROUP BY label")
def label_summary(spark, sf_dir):
    both = F.concat_ws(";", F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))
    return labels.label_summary(table(spark, sf_dir, "labels").select(both.alias("localization_labels")))


def _seeded(*columns: str) -> str:
    text = ", ".join(f"coalesce(({c})::VARCHAR, '')" for c in columns)
    return f"('0x' || substr(md5(concat_ws('/', '1', {text})), 1, 15))::BIGINT"


_LABELS = "SELECT doc_id AS input_order, quality AS label FROM labels"
_DEALT = "SELECT *, row_number() OVER (PARTITION BY label ORDER BY {0}, {1}) - 1 AS place, count(*) OVER (PARTITION BY label) AS held FROM ({2})"


@query(f"SELECT input_order, label, (place % 5)::INT AS fold FROM ({_DEALT.format(_seeded('input_order'), 'input_order', _LABELS)})")
def stratified_folds(spark, sf_dir):
    return labels.stratified_folds(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("input_order"), F.col("quality").alias("label")), 5)


@query(f"SELECT input_order, label FROM ({_DEALT.format(_seeded('input_order'), 'input_order', _LABELS)}) WHERE place < 100")
def capped_sample(spark, sf_dir):
    return labels.capped_sample(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("input_order"), F.col("quality").alias("label")), 100)


# --- evaluation

_PAIRS = "SELECT l.doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'both' WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'bad' ELSE 'plain' END AS truth, CASE WHEN n_chars % 5 = 0 THEN 'bad' WHEN n_chars % 3 = 0 THEN 'plain' ELSE 'good' END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
_CLASSES = ("good", "bad", "plain", "both", "none")


def _pairs(spark, sf_dir):
    n, q, t = F.col("n_chars"), F.col("quality") == 1, F.col("toxic") == 1
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select("doc_id", F.when(q & t, "both").when(q, "good").when(t, "bad").otherwise("plain").alias("truth"), F.when(n % 5 == 0, "bad").when(n % 3 == 0, "plain").otherwise("good").alias("predicted"))


_CLASS_SQL = f"SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM (SELECT label, count(*) FILTER (truth = label) AS support, count(*) FILTER (truth = label AND predicted = label) AS tp, count(*) FILTER (truth <> label AND predicted = label) AS fp, count(*) FILTER (truth = label AND predicted <> label) AS fn FROM ({_PAIRS}), (SELECT unnest({list(_CLASSES)}) AS label) GROUP BY label)"


@query(f"SELECT label, support, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM ({_CLASS_SQL})")
def class_metrics(spark, sf_dir):
    out = metrics.class_metrics(_pairs(spark, sf_dir), _CLASSES)
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(f"SELECT (SELECT count(*) FROM ({_PAIRS})) AS n, round(sum(tp) / (SELECT count(*) FROM ({_PAIRS})), 6) AS accuracy, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 6) AS macro_f1 FROM ({_CLASS_SQL})")
def overall_metrics(spark, sf_dir):
    return metrics.overall(_pairs(spark, sf_dir), _CLASSES).withColumns({c: r6(c) for c in ("accuracy", "macro_f1")})


_MULTI = "SELECT l.doc_id, quality = 1 AS t1, toxic = 1 AS t2, n_chars % 2 = 0 AS p1, n_chars % 7 = 0 AS p2 FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def _multi(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    of = lambda a, b: F.array_compact(F.array(F.when(a, "quality"), F.when(b, "toxic")))
    return metrics.multilabel(both.select(of(F.col("quality") == 1, F.col("toxic") == 1).alias("truth"), of(F.col("n_chars") % 2 == 0, F.col("n_chars") % 7 == 0).alias("predicted")), ("quality", "toxic"))


_BY = f"SELECT label, count(*) FILTER (t) AS support, count(*) FILTER (t AND p) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM (SELECT 'quality' AS label, t1 AS t, p1 AS p FROM ({_MULTI}) UNION ALL SELECT 'toxic', t2, p2 FROM ({_MULTI})) GROUP BY label"
_BYR = f"SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS s, (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) AS d FROM ({_BY})"
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END"


@query(f"SELECT label, support, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(s, 6) AS specificity, round({_F1}, 6) AS f1, round(CASE WHEN d > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt(d) ELSE 0.0 END, 6) AS mcc FROM ({_BYR})")
def multilabel_by_label(spark, sf_dir):
    out = _multi(spark, sf_dir)[0]
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "specificity", "f1", "mcc")})


@query(f"""SELECT n_rows, round(subset_accuracy, 6) AS subset_accuracy, round(jaccard, 6) AS jaccard, round(sample_f1, 6) AS sample_f1, round(hamming_loss, 6) AS hamming_loss, round(p, 6) AS micro_precision, round(r, 6) AS micro_recall, round({_F1}, 6) AS micro_f1, round(macro_f1, 6) AS macro_f1, round(macro_f1, 6) AS macro_f1_observed FROM
(SELECT count(*) AS n_rows, avg((t1 = p1 AND t2 = p2)::INT) AS subset_accuracy, avg(CASE WHEN t1 OR p1 OR t2 OR p2 THEN ((t1 AND p1)::INT + (t2 AND p2)::INT) / ((t1 OR p1)::INT + (t2 OR p2)::INT) ELSE 1.0 END) AS jaccard, avg(CASE WHEN t1 OR p1 OR t2 OR p2 THEN 2.0 * ((t1 AND p1)::INT + (t2 AND p2)::INT) / (t1::INT + t2::INT + p1::INT + p2::INT) ELSE 1.0 END) AS sample_f1, avg(((t1 <> p1)::INT + (t2 <> p2)::INT) / 2) AS hamming_loss FROM ({_MULTI})),
(SELECT sum(tp) / sum(tp + fp) AS p, sum(tp) / sum(tp + fn) AS r FROM ({_BY})), (SELECT avg({_F1}) AS macro_f1 FROM ({_BYR}))""")
def multilabel_overall(spark, sf_dir):
    out = _multi(spark, sf_dir)[1]
    return out.withColumns({c: r6(c) for c in out.columns if c != "n_rows"})


_SCORES = "SELECT quality AS truth, (n_chars % 101) / 100 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
_STEP = f"SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER () AS tpos, sum(neg) OVER () AS tneg FROM (SELECT score, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth <> 1) AS neg FROM ({_SCORES}) GROUP BY score)"
_AT = f"SELECT count(*) AS n_rows, count(*) FILTER (truth = 1 AND score >= 0.5) AS tp, count(*) FILTER (truth <> 1 AND score >= 0.5) AS fp, count(*) FILTER (truth = 1 AND score < 0.5) AS fn, count(*) FILTER (truth <> 1 AND score < 0.5) AS tn FROM ({_SCORES})"


def _scores(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select(F.col("quality").alias("truth"), (F.col("n_chars") % 101 / 100).alias("score"))


@query(f"SELECT n_rows, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round((tp + tn) / n_rows, 6) AS accuracy, round({_F1}, 6) AS f1, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(auprc, 6) AS auprc, round(auroc, 6) AS auroc FROM (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM ({_AT})), (SELECT sum(pos / tpos * (cp / (cp + cn))) AS auprc, sum(neg * (cp - pos / 2.0) / (tpos * tneg)) AS auroc FROM ({_STEP}))")
def binary_metrics(spark, sf_dir):
    out = metrics.binary(_scores(spark, sf_dir))
    return out.withColumns({c: r6(c) for c in out.columns[5:]})


@query(f"SELECT threshold, round(f1, 6) AS f1 FROM (SELECT threshold, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 12) AS f1 FROM (SELECT g / 100 AS threshold, count(*) FILTER (truth = 1 AND score >= g / 100) AS tp, count(*) FILTER (truth <> 1 AND score >= g / 100) AS fp, count(*) FILTER (truth = 1 AND score < g / 100) AS fn FROM ({_SCORES}), (SELECT unnest(range(1, 100)) AS g) GROUP BY g)) ORDER BY f1 DESC, abs(threshold - 0.5), threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(_scores(spark, sf_dir)).withColumn("f1", r6("f1"))


_FEATURES = ("aa_len", "n40_hydrophobic_frac", "n40_hydropathy_mean", "global_basic_frac", "global_acidic_frac", "c10_hydrophobic_frac")
_LANGS = ("en", "fr", "de", "es")
_TRAIN = f"SELECT input_order, lang AS label, {', '.join(f'{_BASE[f]} AS {f}' for f in _FEATURES)} FROM ({_AA})"


def _training(spark, sf_dir):
    found = P.base_features(F.col("seq"))
    return _proteins(spark, sf_dir).select("input_order", F.col("lang").alias("label"), *[found[f].alias(f) for f in _FEATURES])


_MODEL = f"SELECT label AS class, count(*) AS n, {', '.join(f'avg({f}) AS c_{f}' for f in _FEATURES)} FROM t WHERE label IN {_LANGS} GROUP BY label"
_TOTAL = f"SELECT count(*) AS total, {', '.join(f'avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) < 1e-9 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}' for f in _FEATURES)} FROM t WHERE label IN {_LANGS}"


@query(f"WITH t AS ({_TRAIN}), m AS ({_MODEL}), a AS ({_TOTAL}) SELECT class, round(ln((n + 1) / (total + (SELECT count(*) FROM m))), 6) AS log_prior, " + ", ".join(f"round((c_{f} - m_{f}) / s_{f}, 6) AS {f}" for f in _FEATURES) + " FROM m, a")
def centroid_model(spark, sf_dir):
    model = centroid.fit(_training(spark, sf_dir), _FEATURES, classes=_LANGS)
    return model.select("class", r6("log_prior").alias("log_prior"), *[r6(F.get("centroid", k)).alias(f) for k, f in enumerate(_FEATURES)])


@query(f"WITH t AS ({_TRAIN}), m AS ({_MODEL}), a AS ({_TOTAL}), l AS (SELECT input_order, class, -0.5 * (" + " + ".join(f"power((t.{f} - m_{f}) / s_{f} - (c_{f} - m_{f}) / s_{f}, 2)" for f in _FEATURES) + f") + ln((n + 1) / (total + (SELECT count(*) FROM m))) AS v FROM t, m, a), e AS (SELECT *, max(v) OVER (PARTITION BY input_order) AS top FROM l) SELECT input_order, arg_max(class, v) AS predicted, round(max(exp(v - top)) / sum(exp(v - top)), 6) AS probability FROM e GROUP BY input_order")
def centroid_predictions(spark, sf_dir):
    data = _training(spark, sf_dir)
    out = centroid.predict(data, centroid.fit(data, _FEATURES, classes=_LANGS), _FEATURES)
    return out.select("input_order", "predicted", r6(F.array_max(F.map_values("probabilities"))).alias("probability"))


_FOLDED = f"SELECT *, (place % 5)::INT AS fold FROM ({_DEALT.format(_seeded('input_order'), 'input_order', f'SELECT * FROM ({_TRAIN}) WHERE label IN {_LANGS}')})"
_CV = (f"WITH t AS ({_FOLDED}), k AS (SELECT unnest(range(5))::INT AS k), m AS (SELECT k, label AS class, count(*) AS n, {', '.join(f'avg({f}) AS c_{f}' for f in _FEATURES)} FROM t, k WHERE fold <> k GROUP BY k, label), "
       f"a AS (SELECT k, count(*) AS total, {', '.join(f'avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) < 1e-9 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}' for f in _FEATURES)} FROM t, k WHERE fold <> k GROUP BY k), "
       "l AS (SELECT input_order, label, class, -0.5 * (" + " + ".join(f"power((t.{f} - c_{f}) / s_{f}, 2)" for f in _FEATURES) + ") + ln((n + 1) / (total + 4)) AS v FROM t JOIN m ON t.fold = m.k JOIN a ON t.fold = a.k), "
       "o AS (SELECT input_order, label, arg_max(class, v) AS predicted FROM l GROUP BY input_order, label), "
       f"c AS (SELECT class AS label, count(*) FILTER (o.label = class) AS support, count(*) FILTER (o.label = class AND predicted = class) AS tp, count(*) FILTER (o.label <> class AND predicted = class) AS fp, count(*) FILTER (o.label = class AND predicted <> class) AS fn FROM o, (SELECT unnest({list(_LANGS)}) AS class) GROUP BY class), "
       "r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS q FROM c) "
       "SELECT label, support, tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 6) AS f1 FROM r")


@query(_CV)
def cross_validation(spark, sf_dir):
    data = labels.stratified_folds(_training(spark, sf_dir).where(F.col("label").isin(*_LANGS)), 5)
    out = centroid.predict(data, centroid.fit(data, _FEATURES, classes=_LANGS, fold="fold"), _FEATURES, fold="fold")
    return metrics.class_metrics(out, _LANGS, truth="label").withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


_PROBS = "SELECT vec_id, greatest(embedding[1], 0)::DOUBLE AS a, greatest(embedding[2], 0)::DOUBLE AS b, greatest(embedding[3], 0)::DOUBLE AS c, greatest(embedding[4], 0)::DOUBLE AS d, greatest(embedding[5], 0)::DOUBLE AS e, label % 2 = 0 AS plant FROM embeddings"


def _scaled(x: str) -> str:
    return f"CASE WHEN w > 0 THEN {x} / w ELSE {1.0 if x == 'a' else 0.0} END AS {x}"


@query(f"WITH p AS ({_PROBS}), n AS (SELECT *, a + b + c + d + e AS w FROM p), o AS (SELECT vec_id, plant, {', '.join(map(_scaled, 'abcde'))} FROM n), g AS (SELECT vec_id, a, b, c, CASE WHEN plant THEN d ELSE 0.0 END AS d, CASE WHEN plant THEN e ELSE 0.0 END AS e FROM o), h AS (SELECT *, a + b + c + d + e AS w FROM g), f AS (SELECT vec_id, {', '.join(map(_scaled, 'abcde'))} FROM h) SELECT vec_id, " + ", ".join(f"round({x}, 6) AS {y}" for x, y in zip("abcde", labels.CLASSES, strict=True)) + " FROM f")
def organism_gate(spark, sf_dir):
    p = {c: F.greatest(F.get("embedding", k), F.lit(0.0)).cast("double") for k, c in enumerate(labels.CLASSES)}
    group = F.when(F.col("label") % 2 == 0, "plant").otherwise("non_plant")
    return table(spark, sf_dir, "embeddings").select("vec_id", *[r6(v).alias(c) for c, v in centroid.constrain(p, group).items()])


@query(f"SELECT input_order, list_aggregate(list_transform(range(1, 61), lambda k: CASE WHEN k > length(seq) THEN 0 WHEN instr('{P.AA}', substr(seq, k::INT, 1)) > 0 THEN instr('{P.AA}', substr(seq, k::INT, 1)) ELSE 21 END), 'string_agg', ',') AS codes FROM ({_AA})")
def residue_codes(spark, sf_dir):
    return _proteins(spark, sf_dir).select("input_order", F.array_join(P.residue_codes(F.col("seq"), 60), ",").alias("codes"))


_PIECE = "substr(seq, ({0}) + 1, greatest(0, ({1}) - ({0})))"
_CORE, _AROUND = _PIECE.format("greatest(0, k - 18)", "greatest(0, k - 7)"), _PIECE.format("greatest(0, k - 7)", "k + 2")
_HEAD, _BEFORE = _PIECE.format("0", "greatest(1, k - 18)"), _PIECE.format("0", "k")
_CUT_TERMS = {
    "hydrophobic": _frac(_CORE, P.HYDROPHOBIC), "hydrophobic_run": _run(_CORE), "small_3": _flag("substr(seq, k - 2, 1) IN ('A', 'V', 'S', 'G', 'T', 'C')"), "small_1": _flag("substr(seq, k, 1) IN ('A', 'S', 'G', 'T', 'C')"),
    "ala_1": _flag("substr(seq, k, 1) = 'A'"), "proline": _flag("contains(substr(seq, k - 2, 4), 'P')"), "small": _frac(_AROUND, P.SMALL), "charge": f"{_frac(_HEAD, P.BASIC)} - {_frac(_HEAD, P.ACIDIC)}", "ser_thr": _frac(_BEFORE, P.SER_THR)}
_CUT_SCORE = "2.2::DOUBLE * hydrophobic + 0.15::DOUBLE * hydrophobic_run + 0.8::DOUBLE * small_3 + small_1 + 0.4::DOUBLE * ala_1 + 0.5::DOUBLE * small + 0.4::DOUBLE * charge - 0.9::DOUBLE * proline - 0.25::DOUBLE * ser_thr"
_CUT_ROWS = f"SELECT input_order, seq, k, {', '.join(f'({v})::DOUBLE AS {n}' for n, v in _CUT_TERMS.items())} FROM (SELECT input_order, seq, unnest(range(12, least(44, length(seq) - 2) + 1))::INT AS k FROM ({_AA}))"
_CUT_BEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY input_order ORDER BY score DESC, k) AS r FROM (SELECT *, {_CUT_SCORE} AS score FROM ({_CUT_ROWS}))) WHERE r = 1"
_SCAN = ({"score": "coalesce(score, -99.0)", "cut": "coalesce(k, 0)::DOUBLE", "cut_share": "coalesce(k, 0)::DOUBLE / greatest(length(seq), 1)"} | {f"cut_{n}": f"coalesce({n}, 0.0)" for n in _CUT_TERMS}
         | {f"w{a}_{b}_{n}": f.replace("WINDOW", f"substr(seq, {a + 1}, {b - a})") for a, b in ((0, 15), (0, 25), (0, 35), (0, 50), (0, 80), (5, 30), (20, 60), (40, 100))
            for n, f in {"hydropathy": _hyd("WINDOW"), "run": _run("WINDOW"), **{n: _frac("WINDOW", v) for n, v in (_GROUPS | {"small": P.SMALL}).items()}}.items()})


@query(f"SELECT a.input_order, {', '.join(f'round({v}, 6) AS {n}' for n, v in _SCAN.items())} FROM (SELECT input_order, seq FROM ({_AA})) a LEFT JOIN (SELECT * EXCLUDE (seq) FROM ({_CUT_BEST})) b ON a.input_order = b.input_order")
def signal_scan(spark, sf_dir):
    found = windows.with_windows(_proteins(spark, sf_dir), ["input_order"], blocks=("scan",))
    return found.select("input_order", *[r6(F.get("scan", k)).alias(n) for k, n in enumerate(windows.names()["scan"])])


def _windows_sql() -> str:
    """All features of the transit and window blocks, each counted in its own piece of the sequence."""
    out = {}
    for prefix, spans, groups, more in (("t", windows.TRANSIT_WINDOWS, windows.TRANSIT_GROUPS, False), ("f", windows.WINDOWS, windows.WINDOW_GROUPS, True)):
        for a, b in spans:
            piece, name = (f"substr(seq, {a + 1}, {b - a})", f"{prefix}{a}_{b}") if a >= 0 else (f"right(seq, {-a})", f"{prefix}last{-a}")
            parts = {"hydropathy": _hyd(piece), "run": _run(piece), **{n: _frac(piece, g) for n, g in groups.items()}}
            if more:
                parts |= {"length": f"length({piece})::DOUBLE", **{x: _frac(piece, x) for x in P.AA}}
            out |= {f"{name}_{n}": v for n, v in parts.items()}
    return f"SELECT input_order, {', '.join(f'round({v}, 6) AS {n}' for n, v in out.items())} FROM ({_AA})"


@query(_windows_sql())
def window_features(spark, sf_dir):
    """Counts, hydropathy and runs of the windows of transit peptides and of the ensemble, of all texts as residues."""
    found = windows.with_windows(_proteins(spark, sf_dir), ["input_order"], blocks=("transit", "windows"))
    every = windows.names()
    return found.select("input_order", *[r6(F.get(b, k)).alias(n) for b in ("transit", "windows") for k, n in enumerate(every[b])])


def _motif(m: str) -> str:
    at = f"instr(left(seq, 140), '{m}')"
    return f"({at} > 0)::INT::DOUBLE AS {m}_found, (CASE WHEN {at} > 0 THEN {at} - 1 ELSE 999 END)::DOUBLE AS {m}_at"


@query(f"SELECT input_order, {', '.join(map(_motif, P.TRANSIT_MOTIFS))} FROM ({_AA})")
def transit_motifs(spark, sf_dir):
    return _proteins(spark, sf_dir).select("input_order", *[v.alias(n) for n, v in P.motif_places(F.col("seq")).items()])


@query(f"SELECT input_order, CASE WHEN length(seq) > 0 AND length(regexp_replace(seq, '[ACGTRYSWKMBDHVNX?.-]', '', 'g')) = 0 THEN 'dna' ELSE 'protein' END AS mode FROM ({PROTEINS} UNION ALL {SEQS})")
def sequence_mode(spark, sf_dir):
    both = document_sequences(spark, sf_dir, residues=True).union(document_sequences(spark, sf_dir))
    return both.select("input_order", F.when(P.is_dna_like(F.col("seq")), "dna").otherwise("protein").alias("mode"))


@query(f"SELECT (SELECT count(*) FROM (SELECT string_split(accession, '.')[1] FROM ({_ACC}) INTERSECT SELECT string_split(accession, '.')[1] FROM ({_OTHER}))) AS shared_accessions, (SELECT count(*) FROM (SELECT upper(sequence) FROM ({_ACC}) INTERSECT SELECT upper(sequence) FROM ({_OTHER}))) AS shared_sequences")
def leakage(spark, sf_dir):
    return joins.leakage(*_accessions(spark, sf_dir))


@query("SELECT label AS row_idx, round(avg(greatest(embedding[1], 0)), 6) AS p0, round(avg(greatest(embedding[2], 0)), 6) AS p1, round(avg(greatest(embedding[3], 0)), 6) AS p2 FROM embeddings GROUP BY label")
def average_folds(spark, sf_dir):
    part = [F.greatest(F.get("embedding", k), F.lit(0.0)).cast("double") for k in range(3)]
    oof = table(spark, sf_dir, "embeddings").select(F.col("label").alias("row_idx"), F.lit("x").alias("truth"), F.array(*part).alias("probs"))
    return calibration.average_folds(oof).select("row_idx", *[r6(F.get("probs", k)).alias(f"p{k}") for k in range(3)])


_HAS = "coalesce(CASE l WHEN 'germanic' THEN label IN ('en', 'de') ELSE label IN ('fr', 'es') END, FALSE)"
_FAR = {side: " + ".join(f"power((t.{f} - {side}_{f}) / s_{f}, 2)" for f in _FEATURES) for side in "xy"}
_MULTI_SQL = (f"WITH t AS ({_TRAIN}), g AS (SELECT unnest(['germanic', 'romance']) AS l, unnest([0, 1]) AS k), h AS (SELECT t.*, l, k, {_HAS} AS has FROM t, g), "
              f"a AS (SELECT {', '.join(f'CASE WHEN stddev_pop({f}) < 1e-9 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}' for f in _FEATURES)} FROM t), "
              f"y AS (SELECT l, k, count(*) AS n, count(*) FILTER (has) AS m, {', '.join(f'avg({f}) FILTER (has) AS y_{f}, avg({f}) FILTER (NOT has) AS x_{f}' for f in _FEATURES)} FROM h GROUP BY l, k), "
              f"p AS (SELECT t.input_order, l, k, 1 / (1 + exp(-(0.5 * ({_FAR['x']} - ({_FAR['y']})) + ln((m + 1.0) / (n - m + 1.0))))) AS p FROM t, y, a) "
              "SELECT input_order, CASE WHEN max(p) >= 0.5 THEN string_agg(l, ',' ORDER BY k) FILTER (p >= 0.5) ELSE arg_max(l, p) END AS predicted FROM p GROUP BY input_order")


@query(_MULTI_SQL)
def multilabel_predictions(spark, sf_dir):
    data = _training(spark, sf_dir).withColumn("labels", F.array_compact(F.array(F.when(F.col("label").isin("en", "de"), "germanic"), F.when(F.col("label").isin("fr", "es"), "romance"))))
    out = centroid.predict_multilabel(data, centroid.fit_multilabel(data, _FEATURES, ("germanic", "romance")), _FEATURES)
    return out.select("input_order", F.array_join("predicted", ",").alias("predicted"))


_GROUPED = f"SELECT sha256(seq) AS g, max(lang) AS label FROM ({PROTEINS}) GROUP BY g"


@query(f"SELECT d.input_order, place < round(held * 0.2::DOUBLE) AS is_valid FROM ({PROTEINS}) d JOIN ({_DEALT.format(_seeded('g'), 'g', _GROUPED)}) x ON sha256(d.seq) = x.g")
def hash_split(spark, sf_dir):
    rows = document_sequences(spark, sf_dir, residues=True).select("input_order", F.col("seq").alias("sequence"), F.col("lang").alias("label"))
    return calibration.split_by_hash(rows, 0.2).select("input_order", "is_valid")


#: Clusters are dealt one by one, with the folds' loads in arrays.
_CLUSTERS = ("WITH RECURSIVE c AS (SELECT *, row_number() OVER (ORDER BY pos DESC, n DESC, cluster DESC) AS i FROM (SELECT coalesce(source, 'none') AS cluster, count(*) FILTER (lang = 'en') AS pos, count(*) AS n FROM documents GROUP BY 1)), "
             "r AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS p, [0, 0, 0, 0, 0]::BIGINT[] AS m, NULL::VARCHAR AS cluster, NULL::BIGINT AS fold UNION ALL "
             "SELECT i, list_transform(p, lambda x, j: x + CASE WHEN j = f THEN pos ELSE 0 END), list_transform(m, lambda x, j: x + CASE WHEN j = f THEN n ELSE 0 END), cluster, f FROM "
             "(SELECT c.i, c.cluster, c.pos, c.n, r.p, r.m, struct_extract(list_min(list_transform(range(1, 6), lambda k: {'a': CASE WHEN c.pos > 0 THEN r.p[k] ELSE r.m[k] - r.p[k] END, 'b': r.m[k], 'f': k})), 'f') AS f FROM r JOIN c ON c.i = r.i + 1)) "
             "SELECT cluster, (fold - 1)::INT AS fold FROM r WHERE i > 0")


@query(_CLUSTERS)
def cluster_folds(spark, sf_dir):
    return calibration.cluster_folds(table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("cluster"), (F.col("lang") == "en").alias("positive")), 5)


_SCORED = "SELECT doc_id, quality AS truth, (doc_id * 7919 % 1000 // 10) / 100.0::DOUBLE AS score FROM labels"
_STEPS = f"SELECT s, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p FROM (SELECT score AS s, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth <> 1) AS neg FROM ({_SCORED}) GROUP BY score)"
_F1S = f"SELECT s AS threshold, 2 * tp / (tp + fp + p) AS f1, tp::BIGINT AS tp, fp::BIGINT AS fp, (p - tp)::BIGINT AS fn FROM ({_STEPS})"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth"), (F.floor(F.col("doc_id") * 7919 % 1000 / 10) / 100.0).alias("score"))


@query(f"SELECT threshold, round(f1, 6) AS f1, tp, fp, fn FROM (SELECT * FROM ({_F1S}) ORDER BY f1 DESC, threshold DESC LIMIT 1)")
def best_f1_threshold(spark, sf_dir):
    return metrics.best_f1_threshold(_scored(spark, sf_dir)).withColumn("f1", r6("f1"))


@query(f"SELECT threshold, round(f1, 6) AS f1, tp, fp, fn FROM (SELECT * FROM ({_F1S}) ORDER BY f1 DESC, fp, tp DESC, threshold LIMIT 20)")
def f1_thresholds(spark, sf_dir):
    return metrics.f1_thresholds(_scored(spark, sf_dir), most=20).withColumn("f1", r6("f1"))


def _softmax(kind: str, k: int) -> str:
    """(input_order, class, p): nearest centroids of the column ``kind``, which has ``k`` values, over all base features."""
    far = " + ".join(f"power((t.{f} - c_{f}) / s_{f}, 2)" for f in _BASE)
    return (f"SELECT input_order, class, exp(v - max(v) OVER w) / sum(exp(v - top)) OVER w AS p FROM (SELECT *, max(v) OVER (PARTITION BY input_order) AS top FROM (SELECT t.input_order, class, -0.5 * ({far}) + ln((n + 1) / (total + {k})) AS v "
            f"FROM t, a, (SELECT {kind} AS class, count(*) AS n, {', '.join(f'avg({f}) AS c_{f}' for f in _BASE)} FROM r GROUP BY 1))) WINDOW w AS (PARTITION BY input_order)")


def _each(expression: str) -> str:
    return ", ".join(f"({expression.format(c)}) AS {c}" for c in labels.CLASSES)


def _pivoted(c: str) -> str:
    return f"coalesce(max(p) FILTER (class = '{c}'), 0.0) AS {c}"


_SUM = " + ".join(labels.CLASSES)
_LOCALIZE = (
    f"WITH t AS (SELECT input_order, id, lang, seq, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in _BASE.items())} FROM ({PROTEINS})), "
    "r AS (SELECT *, CASE lang WHEN 'en' THEN 'noTP' WHEN 'fr' THEN 'SP' WHEN 'de' THEN 'mTP' ELSE 'cTP' END AS label, CASE WHEN lang = 'es' THEN 'yes' ELSE 'no' END AS perox FROM t WHERE lang IN ('en', 'fr', 'de', 'es')), "
    f"a AS (SELECT count(*) AS total, {', '.join(f'CASE WHEN stddev_pop({f}) < 1e-9 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}' for f in _BASE)} FROM r), "
    f"p AS (SELECT input_order, {', '.join(map(_pivoted, labels.CLASSES))} FROM ({_softmax('label', 4)}) GROUP BY input_order), "
    "g AS (SELECT input_order, noTP, SP, mTP, CASE WHEN input_order % 2 = 0 THEN 0.0 ELSE cTP END AS cTP, CASE WHEN input_order % 2 = 0 THEN 0.0 ELSE lTP END AS lTP FROM p), "
    f"n AS (SELECT input_order, {_each('{0} / (' + _SUM + ')')} FROM g), q AS (SELECT input_order, {_each('power(least(1.0, greatest(1e-12, {0})), 2)')} FROM n), f AS (SELECT input_order, {_each('{0} / (' + _SUM + ')')} FROM q), "
    f"y AS (SELECT input_order, max(p) FILTER (class = 'yes') AS yes FROM ({_softmax('perox', 2)}) GROUP BY input_order) "
    f"SELECT t.input_order, id AS seq_id, CASE greatest(noTP, SP, mTP / 1.5::DOUBLE, cTP, lTP) WHEN noTP THEN 'noTP' WHEN SP THEN 'SP' WHEN mTP / 1.5::DOUBLE THEN 'mTP' WHEN cTP THEN 'cTP' ELSE 'lTP' END AS predicted_class, "
    f"{', '.join(f'round({c}, 6) AS p_{c}' for c in labels.CLASSES)}, round(yes, 6) AS p_peroxisome, CASE WHEN regexp_matches(seq, '{P.PTS1}') THEN 'PTS1' WHEN regexp_matches(left(seq, 40), '{P.PTS2}') THEN 'PTS2' ELSE 'none' END AS perox_signal_type "
    "FROM t JOIN f ON t.input_order = f.input_order JOIN y ON t.input_order = y.input_order")


@query(_LOCALIZE)
def localize(spark, sf_dir):
    """The classes of a fixed table are learned from texts of known language, and all texts are placed by them."""
    data = document_sequences(spark, sf_dir, residues=True)
    named = F.element_at(F.create_map(*[F.lit(x) for pair in zip(("en", "fr", "de", "es"), labels.CLASSES, strict=False) for x in pair]), F.col("lang"))
    names = localize_.feature_names()
    # features of each text once, which the fits and the placing read; texts without a letter count as in SQL
    rows_ = localize_.with_features(data, "protein").withColumn("perox_signal_type", P.signal_type(F.col("protein")))
    rows_ = stored(rows_.select("input_order", "id", named.alias("label"), F.when(F.col("lang") == "es", "yes").otherwise("no").alias("perox"), "perox_signal_type", *names), "features")
    training = rows_.where("label IS NOT NULL")
    fits = (centroid.fit(training, names, kind, classes) for kind, classes in (("label", labels.CLASSES), ("perox", localize_.PEROX)))
    model = localize_.Model(*(stored(m, "model") for m in fits), 0.5, {"mTP": 1.5})
    out = localize_.place(rows_, model, F.when(F.col("input_order") % 2 == 0, "non_plant"))
    return out.select("input_order", "seq_id", "predicted_class", *[r6(c).alias(c) for c in out.columns if c.startswith("p_")], "perox_signal_type")


# --- similarity


@query(None)
def similar_proteins(spark, sf_dir):
    """Every fiftieth text as residues against all texts: each query's best hit besides itself. SQL has no alignments."""
    seqs = document_sequences(spark, sf_dir, residues=True).select(F.col("input_order").alias("id"), "seq")
    hits = similarity.best_similar(seqs, F.col("id") % 50 == 0, min_identity=0.5, least_share=0.01)
    return hits.select("query", "target", r6("identity").alias("identity"), r6("query_coverage").alias("query_coverage"), r6("target_coverage").alias("target_coverage"), "score", r6("bits").alias("bits"))


@query(None)
def protein_clusters(spark, sf_dir):
    """All texts as residues in clusters of half their residues and four fifths of their lengths, dealt into five folds by lang."""
    seqs = document_sequences(spark, sf_dir, residues=True).select(F.col("input_order").alias("id"), "seq", (F.col("lang") == "en").alias("positive"))
    found = similarity.cluster(seqs, min_identity=0.5)
    rows_ = found.join(seqs.select(F.col("id").alias("_i"), "positive"), F.col("id") == F.col("_i"))
    folds = calibration.cluster_folds(rows_, 5)
    return found.join(folds, "cluster").select("id", "cluster", r6("identity").alias("identity"), "fold")


# --- ensembles and searches over left-out predictions

_AS_CLASS = dict(zip(("en", "fr", "de", "es"), labels.CLASSES, strict=False))


def _classed_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_idx, fold, truth, base features): texts as residues, with a class by lang and five folds."""
    data = document_sequences(spark, sf_dir, residues=True)
    truth = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _AS_CLASS.items() for x in pair]), F.col("lang")), F.lit("lTP"))
    return data.select(F.col("input_order").alias("row_idx"), (F.col("input_order") % 5).cast("string").alias("fold"), truth.alias("truth"), *[v.alias(n) for n, v in P.base_features(F.col("seq")).items()])


@query(None)
def tree_ensemble(spark, sf_dir):
    """Left-out class shares of randomised trees on the base features of all texts; SQL has no trees, tests have a recursive twin."""
    rows_ = _classed_proteins(spark, sf_dir)
    out = trees.ensemble_oof(rows_, rows_.columns[3:], labels.CLASSES, "truth", n_trees=10, most_depth=8)
    best = F.get(F.array(*map(F.lit, labels.CLASSES)), calibration.guess(F.col("probs")))
    return out.select("row_idx", "fold", "truth", best.alias("predicted"), *[r6(F.get("probs", k)).alias(f"p_{c}") for k, c in enumerate(labels.CLASSES)])


#: Left-out predictions as numbers of each text: class by lang and id, probabilities that lean to it, specialists' scores, plants.
_LEAN = (37, 41, 43, 47, 53)
_TRUTH = "CASE WHEN doc_id % 7 = 0 THEN 'lTP' WHEN lang = 'en' THEN 'noTP' WHEN lang = 'fr' THEN 'SP' WHEN lang = 'de' THEN 'mTP' ELSE 'cTP' END"
_P = ", ".join(f"(doc_id * {a} % 97 + CASE WHEN truth = '{c}' THEN 60 ELSE 0 END) / 200.0::DOUBLE AS p{k}" for k, (a, c) in enumerate(zip(_LEAN, labels.CLASSES, strict=True)))
_SCORES_OF = (f"SELECT doc_id AS row_idx, truth, {_P}, (doc_id * 7919 % 50 + CASE WHEN truth = 'SP' THEN 25 ELSE 0 END) / 75.0::DOUBLE AS sp, (coalesce(n_chars, 0) * 31 % 40 + CASE WHEN truth = 'lTP' THEN 20 ELSE 0 END) / 60.0::DOUBLE AS ltp, "
              f"doc_id % 3 <> 0 AS plant, (doc_id * 13 % 11) / 10.0::DOUBLE AS s0, (doc_id * 17 % 11) / 10.0::DOUBLE AS s1 FROM (SELECT *, {_TRUTH} AS truth FROM documents)")
_LIMITS = (1.0, 0.9, 1.1, 1.0, 0.8)


def _left_out_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_idx, truth, probs, sp, ltp, plant, share) of all texts."""
    d = table(spark, sf_dir, "documents")
    lang = F.when(F.col("lang") == "en", "noTP").when(F.col("lang") == "fr", "SP").when(F.col("lang") == "de", "mTP").otherwise("cTP")
    d = d.withColumn("truth", F.when(F.col("doc_id") % 7 == 0, "lTP").otherwise(lang))
    own = lambda c, n: F.when(F.col("truth") == c, n).otherwise(0)
    probs = F.array(*[(F.col("doc_id") * a % 97 + own(c, 60)) / 200.0 for a, c in zip(_LEAN, labels.CLASSES, strict=True)])
    return d.select(F.col("doc_id").alias("row_idx"), "truth", probs.alias("probs"), ((F.col("doc_id") * 7919 % 50 + own("SP", 25)) / 75.0).alias("sp"), ((F.coalesce("n_chars", F.lit(0)) * 31 % 40 + own("lTP", 20)) / 60.0).alias("ltp"),
                    (F.col("doc_id") % 3 != 0).alias("plant"), F.array(F.col("doc_id") * 13 % 11 / 10.0, F.col("doc_id") * 17 % 11 / 10.0).alias("share"))


def _best_sql(skip: str = "") -> str:
    """The first class of the highest probability over its limit."""
    scores = {c: f"p{k} / {t}::DOUBLE" for k, (c, t) in enumerate(zip(labels.CLASSES, _LIMITS, strict=True)) if c != skip}
    return f"CASE greatest({', '.join(scores.values())}) " + " ".join(f"WHEN {v} THEN '{c}'" for c, v in scores.items()) + " END"


def _f1_sql(by: str, rows_: str) -> str:
    """(by, f1 of each class, accuracy) of the rows' truth and predicted."""
    f1 = ", ".join(f"coalesce(2.0::DOUBLE * count(*) FILTER (truth = '{c}' AND predicted = '{c}') / nullif(count(*) FILTER (predicted = '{c}') + count(*) FILTER (truth = '{c}'), 0), 0.0) AS f_{c}" for c in labels.CLASSES)
    return f"SELECT {by}, {f1}, count(*) FILTER (truth = predicted) / count(*)::DOUBLE AS accuracy FROM ({rows_}) GROUP BY {by}"


_MACRO = "(" + " + ".join(f"f_{c}" for c in labels.CLASSES) + ") / 5.0::DOUBLE"
_PAIRS = (f"WITH s AS (SELECT *, {_best_sql()} AS base, {_best_sql('SP')} AS non_sp FROM ({_SCORES_OF})), a AS (SELECT DISTINCT sp AS x FROM s), "
          "v AS (SELECT DISTINCT x, ltp AS y FROM a, s WHERE plant AND sp < x AND (truth IN ('cTP', 'lTP') OR p3 + p4 > 0.2::DOUBLE)), b AS (SELECT * FROM v UNION ALL SELECT x, 0.5 FROM a WHERE x NOT IN (SELECT x FROM v)), "
          "r AS (SELECT x, y, truth, CASE WHEN sp >= x THEN 'SP' WHEN plant AND p3 + p4 > 0.2::DOUBLE AND ltp >= y THEN 'lTP' WHEN plant AND p3 + p4 > 0.2::DOUBLE AND (CASE WHEN base = 'SP' THEN non_sp ELSE base END) IN ('cTP', 'lTP') THEN 'cTP' "
          "WHEN base = 'SP' THEN non_sp ELSE base END AS predicted FROM b, s) "
          f"SELECT round(x, 6) AS sp_threshold, round(y, 6) AS ltp_threshold, round({_MACRO}, 6) AS macro_f1, round(least({', '.join(f'f_{c} - {r}::DOUBLE' for c, r in zip(labels.CLASSES, specialists.REFERENCE_F1, strict=True))}), 6) AS margin, round(accuracy, 6) AS accuracy FROM ({_f1_sql('x, y', 'SELECT * FROM r')})")


@query(_PAIRS)
def threshold_pairs(spark, sf_dir):
    """Macro F1, margin and accuracy of every pair of specialists' thresholds over all texts."""
    rows_ = _left_out_scores(spark, sf_dir)
    flagged = rows_.select((F.col("truth") == "SP").cast("int").alias("truth"), F.col("sp").alias("score"))
    candidates = [r.threshold for r in metrics.f1_thresholds(flagged, most=80).collect()]
    out = specialists.pair_scores(rows_, candidates, _LIMITS)
    return out.select(r6("sp_threshold").alias("sp_threshold"), r6("ltp_threshold").alias("ltp_threshold"), r6(specialists.rank("macro_f1")[0]).alias("macro_f1"), r6(specialists.rank("margin")[0]).alias("margin"), r6("accuracy").alias("accuracy"))


_OVERRIDE = (f"WITH s AS (SELECT *, {_best_sql()} AS base, {_best_sql('SP')} AS non_sp FROM ({_SCORES_OF})), a AS (SELECT DISTINCT sp AS x FROM s), "
             "r AS (SELECT x, row_idx, truth, CASE WHEN sp >= x THEN 'SP' WHEN base = 'SP' THEN non_sp ELSE base END AS predicted FROM a, s), "
             f"f AS (SELECT x FROM ({_f1_sql('x', 'SELECT * FROM r')}) ORDER BY round({_MACRO}, 12) DESC, x LIMIT 1) "
             "SELECT row_idx, truth, predicted, round(x, 6) AS threshold FROM r WHERE x = (SELECT x FROM f)")


@query(_OVERRIDE)
def specialist_override(spark, sf_dir):
    """All texts after the signal-peptide specialist at its best threshold of all distinct scores."""
    rows_ = _left_out_scores(spark, sf_dir)
    base = specialists.best_class(F.col("probs"), _LIMITS)
    after = lambda t: specialists.specialist(base, F.col("probs"), F.col("sp"), t, specialists.SP, _LIMITS)
    best = specialists.fit_override(rows_, after(float("-inf")), "sp", before=after(float("inf"))).first().threshold
    return rows_.select("row_idx", "truth", F.get(F.array(*map(F.lit, labels.CLASSES)), after(best)).alias("predicted"), F.round(F.lit(best), 6).alias("threshold"))


_MASS = "(p3 + p4)"
_MIXED = ["(1.0::DOUBLE - b) * (CASE WHEN p3 + p4 > 0 THEN {} / (p3 + p4) ELSE 0.5 END) + b * {}".format(*x) for x in (("p3", "s0"), ("p4", "s1"))]
_SPLIT_BEST = "CASE greatest(p0, p1, p2, q3, q4) WHEN p0 THEN 'noTP' WHEN p1 THEN 'SP' WHEN p2 THEN 'mTP' WHEN q3 THEN 'cTP' ELSE 'lTP' END"
_SPLIT = (f"WITH s AS ({_SCORES_OF}), g AS (SELECT row_number() OVER () AS k, * FROM (VALUES {', '.join(f'({g}::DOUBLE, {b}::DOUBLE, {t}::DOUBLE)' for g in specialists.GATES for b in specialists.BETAS for t in specialists.SPLITS)}) v(gate, b, t)), "
          f"m AS (SELECT *, {_MIXED[0]} AS m3, {_MIXED[1]} AS m4 FROM s, g), n AS (SELECT *, CASE WHEN m3 + m4 > 0 THEN m3 + m4 ELSE 1 END AS z FROM m), "
          "w AS (SELECT *, m3 / z / (1.0::DOUBLE - t) AS w3, m4 / z / t AS w4 FROM n), "
          "x AS (SELECT *, CASE WHEN p3 + p4 > 0 AND p3 + p4 >= gate THEN (p3 + p4) * (w3 / CASE WHEN w3 + w4 > 0 THEN w3 + w4 ELSE 1 END) ELSE p3 END AS q3, CASE WHEN p3 + p4 > 0 AND p3 + p4 >= gate THEN (p3 + p4) * (w4 / CASE WHEN w3 + w4 > 0 THEN w3 + w4 ELSE 1 END) ELSE p4 END AS q4 FROM w), "
          f"r AS (SELECT k, gate, b, t, row_idx, truth, {_SPLIT_BEST} AS predicted FROM x), "
          f"f AS (SELECT k FROM ({_f1_sql('k', 'SELECT * FROM r')}) ORDER BY round({_MACRO}, 12) DESC, round(f_lTP, 12) DESC, accuracy DESC, k LIMIT 1) "
          "SELECT row_idx, truth, predicted, gate, b AS beta, t AS split FROM r WHERE k = (SELECT k FROM f)")


@query(_SPLIT)
def plastid_split(spark, sf_dir):
    """All texts with their plastid classes split anew, by the best setting of the grid."""
    rows_ = _left_out_scores(spark, sf_dir)
    gate, beta, split = specialists.fit_split(rows_)
    best = specialists.best_class(specialists.split_plastid(F.col("probs"), F.col("share"), gate, beta, split))
    return rows_.select("row_idx", "truth", F.get(F.array(*map(F.lit, labels.CLASSES)), best).alias("predicted"), F.lit(gate).alias("gate"), F.lit(beta).alias("beta"), F.lit(split).alias("split"))


_STACK = [*(f"p{k}" for k in range(5)), "greatest(p0, p1, p2, p3, p4)", "p4 / greatest(p3 + p4, 1e-9)", "p3 + p4"]
_GRID = tuple(k / 20 for k in range(1, 20))


def _cross_fitted(positive: str, predicted: str) -> str:
    """SQL of foldwise_override over four folds: a model for each set of folds that is left out, inner scores, thresholds, own scores."""
    n = range(len(_STACK))
    far = lambda c: " + ".join(f"power((x{k} - m{k}) / d{k} - ({c}{k} - m{k}) / d{k}, 2)" for k in n)
    stats = ", ".join(f"avg(x{k}) AS m{k}, CASE WHEN stddev_pop(x{k}) < 1e-9 THEN 1.0 ELSE stddev_pop(x{k}) END AS d{k}, avg(x{k}) FILTER (y) AS y{k}, avg(x{k}) FILTER (NOT y) AS n{k}" for k in n)
    score = f"1.0 / (1.0 + exp((-0.5 * ({far('n')}) + ln((cn + 1.0) / (c + 2.0))) - (-0.5 * ({far('y')}) + ln((cy + 1.0) / (c + 2.0)))))"
    return (f"WITH s AS (SELECT *, {_best_sql()} AS base, {_best_sql(positive)} AS other, row_idx % 4 AS fold, truth = '{positive}' AS y, {', '.join(f'{x} AS x{k}' for k, x in enumerate(_STACK))} FROM ({_SCORES_OF})), "
            "q AS (SELECT a, b FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(4)) AS b) WHERE a <= b), "
            f"m AS (SELECT a, b, count(*) AS c, count(*) FILTER (y) AS cy, count(*) FILTER (NOT y) AS cn, {stats} FROM q, s WHERE fold <> a AND fold <> b GROUP BY a, b), "
            f"z AS (SELECT s.*, o.o AS outer_fold, {score} AS score FROM s, (SELECT unnest(range(4)) AS o) o, m WHERE m.a = least(o.o, fold) AND m.b = greatest(o.o, fold)), "
            f"g AS (SELECT unnest([{', '.join(map(str, _GRID))}]::DOUBLE[]) AS t), r AS (SELECT outer_fold, t, truth, {predicted} AS predicted FROM z, g WHERE outer_fold <> fold), "
            f"f AS (SELECT outer_fold, t, row_number() OVER (PARTITION BY outer_fold ORDER BY round({_MACRO}, 12) DESC, t) AS k FROM ({_f1_sql('outer_fold, t', 'SELECT * FROM r')})) "
            f"SELECT row_idx, fold::VARCHAR AS fold, truth, {predicted} AS predicted, round(score, 6) AS score, t AS threshold FROM z JOIN f ON z.outer_fold = f.outer_fold WHERE k = 1 AND z.outer_fold = fold")


def _override(spark: SparkSession, sf_dir: str, positive: str, **options) -> DataFrame:
    rows_ = _left_out_scores(spark, sf_dir).withColumn("fold", F.col("row_idx") % 4)
    seen = stacking.stack_features([F.col("probs")])
    rows_ = rows_.select("row_idx", "fold", "truth", "probs", *[v.alias(n) for n, v in seen.items()])
    return stacking.foldwise_override(rows_, list(seen), positive, thresholds=_LIMITS, grid=_GRID, **options).withColumn("score", r6("score"))


@query(_cross_fitted("SP", "CASE WHEN score >= t THEN 'SP' WHEN base = 'SP' THEN other ELSE base END"))
def foldwise_specialist(spark, sf_dir):
    """All texts after a cross-fitted signal-peptide specialist over four folds."""
    return _override(spark, sf_dir, "SP")


@query(_cross_fitted("mTP", "CASE WHEN score >= t AND base IN ('noTP', 'cTP') THEN 'mTP' ELSE base END"))
def foldwise_rescue(spark, sf_dir):
    """All texts after a cross-fitted rescue of mitochondrial ones over four folds."""
    return _override(spark, sf_dir, "mTP", sources=("noTP", "cTP"))


def _augmented_sql() -> str:
    """Left-out centroids of three folds of even ids and of all odd ids at a quarter of their weight."""
    n = range(5)
    mean = ", ".join(f"sum(w * p{k}) / sum(w) AS m{k}, sqrt(greatest(0.0, sum(w * p{k} * p{k}) / sum(w) - power(sum(w * p{k}) / sum(w), 2))) AS v{k}" for k in n)
    far = " + ".join(f"power((s.p{k} - m{k}) / d{k} - (c{k} - m{k}) / d{k}, 2)" for k in n)
    return (f"WITH s AS (SELECT *, CASE WHEN row_idx % 2 = 0 THEN row_idx // 2 % 3 END AS fold, CASE WHEN row_idx % 2 = 0 THEN 1.0::DOUBLE ELSE 0.25 END AS w FROM ({_SCORES_OF})), "
            "t AS (SELECT o.o, s.* FROM (SELECT unnest(range(3)) AS o) o, s WHERE fold IS DISTINCT FROM o.o), "
            f"a AS (SELECT o, sum(w) AS total, count(DISTINCT truth) AS classes, {mean} FROM t GROUP BY o), b AS (SELECT *, {', '.join(f'CASE WHEN v{k} < 1e-9 THEN 1.0 ELSE v{k} END AS d{k}' for k in n)} FROM a), "
            f"c AS (SELECT o, truth AS class, sum(w) AS n, {', '.join(f'sum(w * p{k}) / sum(w) AS c{k}' for k in n)} FROM t GROUP BY o, truth), "
            f"l AS (SELECT s.row_idx, s.fold, s.truth, class, -0.5 * ({far}) + ln((n + 1.0) / (total + classes)) AS v FROM s JOIN b ON b.o = s.fold JOIN c ON c.o = s.fold), "
            "e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY row_idx)) AS x FROM l), f AS (SELECT *, x / sum(x) OVER (PARTITION BY row_idx) AS p FROM e) "
            f"SELECT row_idx, fold, truth, {', '.join(f'round(coalesce(sum(p) FILTER (class = {chr(39)}{c}{chr(39)}), 0.0), 6) AS p_{c}' for c in labels.CLASSES)} FROM f GROUP BY row_idx, fold, truth")


@query(_augmented_sql())
def augmented_predictions(spark, sf_dir):
    """Texts of even ids by the other folds' centroids, with the texts of odd ids as external rows of a quarter of their weight."""
    rows_ = _left_out_scores(spark, sf_dir).select("row_idx", "truth", (F.floor(F.col("row_idx") / 2) % 3).alias("fold"), *[F.get("probs", k).alias(f"p{k}") for k in range(5)])
    out = stacking.augmented_oof(rows_.where("row_idx % 2 = 0"), rows_.where("row_idx % 2 <> 0"), [f"p{k}" for k in range(5)])
    return out.select("row_idx", "fold", "truth", *[r6(F.get("probs", k)).alias(f"p_{c}") for k, c in enumerate(labels.CLASSES)])

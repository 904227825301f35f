"""Sequence formats beyond FASTA: FASTQ, EMBL, and the alignments Stockholm, PHYLIP, NEXUS and Clustal; features of GenBank and EMBL records.

Record formats split anywhere. A FASTQ quality line may begin with any character, so lines are numbered within their file first (from the counts
of its blocks) and every four of them are a record: no guess where one begins. EMBL and Stockholm records end with a line //. PHYLIP, NEXUS
and Clustal files are one alignment each, read whole. Line ends may be CRLF; blank lines between records don't count.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonspark.functions import sequences as S
from codonspark.sources.tables import records


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(input_order, id, name, description, seq, quality) of FASTQ files of four lines a record. Raises in the job where a record lacks its @ or +,
    or sequence and quality differ in length."""
    lines = records(spark, path, "line_no", in_file="place").withColumn("line", F.regexp_replace("value", r"\r\z", ""))
    part = lambda k: F.max(F.when(F.col("place") % 4 == k, F.col("line")))
    # a record's four lines stand together, so the first one's number less its place names the file and the record
    rows = lines.groupBy((F.col("line_no") - F.col("place") % 4).alias("input_order")).agg(*[part(k).alias(n) for k, n in enumerate(("head", "seq", "plus", "quality"))])
    rows = rows.where(F.concat(*[F.coalesce(c, F.lit("")) for c in ("head", "seq", "plus", "quality")]) != "")
    good = F.coalesce(F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("quality")), F.lit(False))
    title = F.when(good, F.substr("head", F.lit(2))).otherwise(F.raise_error(F.concat(F.lit("no FASTQ record: "), F.coalesce("head", F.lit("")))).cast("string"))
    name = F.regexp_extract("title", r"\A(\S*)", 1)
    return rows.withColumn("title", title).select("input_order", name.alias("id"), name.alias("name"), F.trim("title").alias("description"), "seq", "quality")


def write_fastq(seqs: DataFrame, path: str) -> None:
    """FASTQ parts in the order of input_order; ``quality`` as letters."""
    title = F.coalesce(F.nullif("description", F.lit("")), "id") if "description" in seqs.columns else F.col("id")
    _write(seqs, F.concat(F.lit("@"), title, F.lit("\n"), "seq", F.lit("\n+\n"), "quality"), path)


def _write(rows: DataFrame, text: Column, path: str, order: str = "input_order") -> None:
    rows.select(order, text.alias("value")).repartitionByRange(order).sortWithinPartitions(order).select("value").write.mode("overwrite").text(path)


# --- features

Part = tuple[int, int, int, str, bool]
PART = "struct<start:int,end:int,strand:int,remote:string,fuzzy:boolean>"
FEATURES = f"array<struct<type:string,location:string,parts:array<{PART}>,qualifiers:map<string,array<string>>>>"


def _split(text: str) -> list[str]:
    """Pieces between commas outside of brackets."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:k])
            start = k + 1
    return [*out, text[start:]]


def location_parts(text: str) -> list[Part]:
    """(start, end, strand, remote, fuzzy) of a location, from 1, ends included, in the order in which its parts are joined.

    join, order, bond and one-of hold lists, complement turns all that it holds about; remote parts name another record; <, >, (a.b) and
    a^b are fuzzy and count by their outer numbers. ValueError for anything else.
    """
    text = re.sub(r"\s", "", text)
    outer = re.fullmatch(r"(complement|join|order|bond|one-of)\((.*)\)", text)
    if outer and outer[1] == "complement":
        return [(a, b, -s, r, f) for a, b, s, r, f in reversed(location_parts(outer[2]))]
    if outer:
        return [p for piece in _split(outer[2]) for p in location_parts(piece)]
    one = re.fullmatch(r"(?:([^:()]+):)?(.+)", text)
    span = one and re.fullmatch(r"([<>]?\d+|\(\d+\.\d+\))(?:(\.\.|\.|\^)([<>]?\d+|\(\d+\.\d+\)))?", one[2])
    if not span:
        raise ValueError(f"no such location: {text}")
    numbers = [int(n) for n in re.findall(r"\d+", one[2])]
    return [(min(numbers), max(numbers), 1, one[1] or "", bool(re.search(r"[<>^(]", one[2])) or span[2] == ".")]


def parse_features(text: str) -> list[dict]:
    """The features of a GenBank or EMBL record: type, location as written, its parts, and qualifiers (lists, as they repeat)."""
    lines = text.replace("\r", "").split("\n")
    if text.lstrip().startswith("ID "):
        lines = ["  " + x[2:] for x in lines if x.startswith("FT")]
    else:
        start = next((k for k, x in enumerate(lines) if x.startswith("FEATURES")), len(lines))
        lines = lines[start + 1:]
        lines = lines[:next((k for k, x in enumerate(lines) if x[:1].strip()), len(lines))]
    out: list[dict] = []
    for line in lines:
        head = re.match(r" {5}(\S+)\s+(.*)", line)
        if head:
            out.append({"type": head[1], "lines": [head[2].strip()]})
        elif out and line.strip():
            out[-1]["lines"].append(line.strip())
    found = []
    for feature in out:
        at = next((k for k, x in enumerate(feature["lines"]) if x.startswith("/")), len(feature["lines"]))
        qualifiers: dict[str, list[str]] = {}
        key = None
        open_ = False  # a quoted value goes on
        for line in feature["lines"][at:]:
            start = None if open_ else re.match(r"/([^=\s]+)(?:=(.*))?\Z", line)
            if start:
                key, value = start[1], start[2] or ""
                qualifiers.setdefault(key, []).append(value)
            elif key is not None:
                qualifiers[key][-1] += ("" if key == "translation" else " ") + line
            own = qualifiers[key][-1] if key is not None else ""
            open_ = own.startswith('"') and own.count('"') % 2 == 1
        clean = {k: [re.sub(r'\A"|"\Z', "", v).replace('""', '"') for v in values] for k, values in qualifiers.items()}
        location = "".join(feature["lines"][:at])
        found.append({"type": feature["type"], "location": location, "parts": location_parts(location), "qualifiers": clean})
    return found


def with_features(rows: DataFrame, text: str = "value") -> DataFrame:
    """``rows`` with ``features`` in the place of the records' text."""
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("location", pa.string()), ("parts", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("strand", pa.int32()), ("remote", pa.string()), ("fuzzy", pa.bool_())]))),
                                   ("qualifiers", pa.map_(pa.string(), pa.list_(pa.string())))]))
        for batch in batches:
            found = [parse_features(t) for t in batch.column(len(kept)).to_pylist()]
            packed = [[f | {"parts": [dict(zip(("start", "end", "strand", "remote", "fuzzy"), p, strict=True)) for p in f["parts"]], "qualifiers": list(f["qualifiers"].items())} for f in fs] for fs in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(packed, kind)], [*kept, "features"])

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept), f"features {FEATURES}"])
    return rows.select(*kept, text).mapInArrow(run, schema)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(input_order, features) of GenBank or EMBL files, in the order of ``fasta.read_genbank`` and ``read_embl``."""
    rows = records(spark, path, "input_order", "\n//").where(F.regexp_like("value", F.lit(r"(?m)^(LOCUS|ID)\b")))
    return with_features(rows.withColumn("value", F.regexp_replace("value", r"\A\s+", "")))


def cut_feature(seq: Column, parts: Column) -> Column:
    """The stretch of a sequence that a feature's parts join; null if one of them lies in another record."""
    piece = lambda p: F.substr(seq, p["start"], p["end"] - p["start"] + 1)
    joined = F.array_join(F.transform(parts, lambda p: F.when(p["strand"] < 0, S.reverse_complement(piece(p))).otherwise(piece(p))), "")
    return F.when(~F.exists(parts, lambda p: p["remote"] != ""), joined)


# --- EMBL


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    """(input_order, id, name, description, seq) of EMBL files; the id has the version where the ID line gives one."""
    rows = records(spark, path, "input_order", "\n//").where(F.regexp_like("value", F.lit(r"(?m)^ID\b")))
    text = F.replace("value", F.lit("\r"), F.lit(""))
    name, version = F.regexp_extract(text, r"(?m)^ID\s+([^;\s]+)", 1), F.regexp_extract(text, r"(?m)^ID\s[^\n]*;\s*SV\s+(\d+)", 1)
    about = F.trim(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^DE\s+(.*)$"), F.lit(1)), lambda x: F.trim(x)), " "))
    seq = F.upper(F.regexp_replace(F.regexp_extract(text, r"(?ms)^SQ[^\n]*\n(.*)", 1), r"[\s\d]", ""))
    return rows.select("input_order", F.when(version != "", F.concat(name, F.lit("."), version)).otherwise(name).alias("id"), name.alias("name"), about.alias("description"), seq.alias("seq"))


def write_embl(seqs: DataFrame, path: str) -> None:
    """EMBL parts in the order of input_order: ID, DE and SQ lines; an id that ends in .digits gives its version."""
    name, version = F.regexp_replace("id", r"\.\d+\z", ""), F.regexp_extract("id", r"\.(\d+)\z", 1)
    about = F.coalesce("description", F.lit("")) if "description" in seqs.columns else F.lit("")
    head = F.concat(F.lit("ID   "), name, F.when(version != "", F.concat(F.lit("; SV "), version)).otherwise(""), F.lit("; "), F.length("seq").cast("string"), F.lit(" BP.\n"))
    rows = F.regexp_extract_all(F.lower("seq"), F.lit(".{1,60}"), F.lit(0))
    body = F.array_join(F.transform(rows, lambda x: F.concat(F.lit("     "), x)), "\n")
    _write(seqs, F.concat(head, F.when(about != "", F.concat(F.lit("DE   "), about, F.lit("\n"))).otherwise(""), F.lit("SQ   Sequence "), F.length("seq").cast("string"), F.lit(" BP;\n"), body, F.lit("\n//")), path)


# --- alignments


def _blocks(lines: list[str], cell: Callable[[str], tuple[str, str] | None]) -> list[tuple[str, str]]:
    """Sequences by name, from lines of (name, piece) in interleaved blocks."""
    out: dict[str, list[str]] = {}
    for line in lines:
        if found := cell(line):
            out.setdefault(found[0], []).append(found[1])
    return [(name, "".join(pieces)) for name, pieces in out.items()]


def _pair(line: str) -> tuple[str, str] | None:
    parts = line.split()
    return (parts[0], "".join(parts[1:])) if len(parts) > 1 else None


def parse_stockholm(text: str) -> list[tuple[str, str]]:
    return _blocks([x for x in text.split("\n") if x.strip() and not x.startswith(("#", "//"))], _pair)


def parse_clustal(text: str) -> list[tuple[str, str]]:
    """Names and pieces of each block; the title and lines of marks, which begin with a blank, don't count, nor do counts at line ends."""
    lines = text.split("\n")[1:]
    return _blocks([re.sub(r"\s+\d+\s*\Z", "", x) for x in lines if x.strip() and not x[0].isspace()], _pair)


def parse_phylip(text: str, strict: bool = False) -> list[tuple[str, str]]:
    """A sequential or interleaved file: names are ten letters where ``strict``, else up to the first blank."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines or not re.fullmatch(r"\s*\d+\s+\d+\s*", lines[0]):
        raise ValueError("a PHYLIP file begins with two numbers")
    n, width = map(int, lines[0].split())
    squeeze = lambda x: re.sub(r"\s", "", x)
    cell = lambda x: (x[:10].strip(), squeeze(x[10:])) if strict else (x.split()[0], squeeze(x.strip()[len(x.split()[0]):]))
    body, names, pieces = lines[1:], [], []
    if len(body) >= n and len(body) % n == 0 and (len(body) == n or any(len(cell(x)[1]) < width for x in body[:n])) and len({len(cell(x)[1]) for x in body[:n]}) == 1:
        for x in body[:n]:
            name, piece = cell(x)
            names.append(name)
            pieces.append(piece)
        for k, x in enumerate(body[n:]):
            pieces[k % n] += squeeze(x)
    else:
        for x in body:
            if not pieces or len(pieces[-1]) >= width:
                name, piece = cell(x)
                names.append(name)
                pieces.append(piece)
            else:
                pieces[-1] += squeeze(x)
    if len(names) != n or any(len(p) != width for p in pieces):
        raise ValueError("a PHYLIP file doesn't hold what its first line says")
    return list(zip(names, pieces, strict=True))


def parse_nexus(text: str) -> list[tuple[str, str]]:
    """The matrix of a NEXUS file's data or characters block; comments in brackets go, names may be in quotes, matchchar stands for the first row."""
    clean = re.sub(r"\[[^\]]*\]", "", text)
    found = re.search(r"(?is)\bmatrix\b(.*?);", clean)
    if not found:
        raise ValueError("a NEXUS file without a matrix")
    def cell(line: str) -> tuple[str, str] | None:
        quoted = re.match(r"\s*'((?:[^']|'')*)'\s*(.*)", line)
        return (quoted[1].replace("''", "'"), re.sub(r"\s", "", quoted[2])) if quoted else _pair(line)
    rows = _blocks([x for x in found[1].split("\n") if x.strip()], cell)
    same = re.search(r"(?i)\bmatchchar\s*=\s*(\S)", clean)
    if same and rows:
        rows = [rows[0], *((name, "".join(a if c == same[1] else c for c, a in zip(seq, rows[0][1], strict=True))) for name, seq in rows[1:])]
    return rows


ALIGNMENTS: dict[str, Callable[[str], list[tuple[str, str]]]] = {"stockholm": parse_stockholm, "clustal": parse_clustal, "phylip": lambda t: parse_phylip(t, True), "phylip-relaxed": parse_phylip, "nexus": parse_nexus}


def read_alignments(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(alignment_id, input_order, id, seq) of alignment files of a form of ALIGNMENTS; alignment_id numbers files in the order of their paths (and
    alignments within them), input_order is the place within. Raises in the job for sequences of different lengths."""
    parse = ALIGNMENTS[form]
    rows = records(spark, path, "alignment_id", "\n//") if form == "stockholm" else records(spark, path, "alignment_id", whole=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = parse(text.replace("\r", "")) if text.strip(" \r\n/") else []
                if len({len(s) for _, s in found}) > 1:
                    raise ValueError(f"sequences of different lengths in alignment {number}")
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.string())], ["alignment_id", "input_order", "id", "seq"])

    return rows.select("alignment_id", "value").mapInArrow(run, "alignment_id long, input_order long, id string, seq string")


def alignment_text(seqs: DataFrame, form: str) -> DataFrame:
    """(alignment_id, value): each alignment as a text; it is put together in one task, as one file of these formats holds it."""
    if form not in ALIGNMENTS:
        raise ValueError(f"no such form: {form}")
    row = {"stockholm": F.concat("id", F.lit(" "), "seq"), "clustal": F.concat("id", F.lit("      "), "seq"), "phylip": F.concat(F.rpad(F.left("id", F.lit(10)), 10, " "), "seq"), "phylip-relaxed": F.concat("id", F.lit("  "), "seq"),
           "nexus": F.concat(F.lit("'"), F.replace("id", F.lit("'"), F.lit("''")), F.lit("' "), "seq")}[form]
    lines = seqs.groupBy("alignment_id").agg(F.array_sort(F.collect_list(F.struct("input_order", row.alias("line")))).alias("l"), F.count("*").cast("string").alias("n"), F.max(F.length("seq")).cast("string").alias("w"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    both = F.concat(F.lit(" "), "n", F.lit(" "), "w", F.lit("\n"))
    nexus = F.concat(F.lit("#NEXUS\nbegin data;\ndimensions ntax="), "n", F.lit(" nchar="), "w", F.lit(";\nformat datatype=dna missing=? gap=-;\nmatrix\n"), body, F.lit("\n;\nend;"))
    whole = {"stockholm": F.concat(F.lit("# STOCKHOLM 1.0\n"), body, F.lit("\n//")), "clustal": F.concat(F.lit("CLUSTAL W multiple sequence alignment\n\n"), body), "phylip": F.concat(both, body), "phylip-relaxed": F.concat(both, body), "nexus": nexus}
    return lines.select("alignment_id", whole[form].alias("value"))


def write_alignments(seqs: DataFrame, path: str, form: str) -> None:
    """A folder alignment_id=... for each alignment of (alignment_id, input_order, id, seq), with one file; Stockholm alignments follow one another."""
    text = alignment_text(seqs, form)
    if form == "stockholm":
        _write(text, F.col("value"), path, "alignment_id")
    else:
        text.repartition("alignment_id").write.mode("overwrite").partitionBy("alignment_id").text(path)

"""FASTA and GenBank files as sequence frames, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codonspark.functions import sequences as S
from codonspark.sources.tables import records

WRAP = 60


def parse_fasta(value: Column) -> Column:
    """struct(id, description, seq) of a record without its leading > (or with it, as a file's first one)."""
    text = F.replace(value, F.lit("\r"), F.lit(""))
    text = F.regexp_replace(text, r"\A\s*>?", "")
    head = F.substring_index(text, "\n", 1)
    body = F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)).otherwise(F.lit(""))
    return F.struct(F.regexp_extract(head, r"\A(\S*)", 1).alias("id"), F.trim(head).alias("description"), F.regexp_replace(body, r"\s", "").alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(input_order, id, name, description, seq) of FASTA files. Wrapped lines, CRLF and empty sequences are fine; files split."""
    rows = records(spark, path, "input_order", "\n>").where(F.regexp_like("value", F.lit(r"\S")))
    rows = rows.select("input_order", parse_fasta(F.col("value")).alias("r"))
    return rows.select("input_order", "r.id", F.col("r.id").alias("name"), "r.description", "r.seq")


def fasta_text(seqs: DataFrame, wrap: int = WRAP) -> Column:
    """The FASTA entry of a row, without the last line feed; ``wrap`` 0: the sequence on one line."""
    title = F.coalesce(F.nullif("description", F.lit("")), "id") if "description" in seqs.columns else F.col("id")
    body = F.array_join(F.regexp_extract_all("seq", F.lit(f".{{1,{wrap}}}"), F.lit(0)), "\n") if wrap else F.col("seq")
    return F.concat(F.lit(">"), title, F.when(F.length("seq") > 0, F.concat(F.lit("\n"), body)).otherwise(F.lit("")))


def write_fasta(seqs: DataFrame, path: str, wrap: int = WRAP) -> None:
    """Writes FASTA parts whose order by name is that of input_order."""
    text = fasta_text(seqs, wrap)
    seqs.select("input_order", text.alias("value")).repartitionByRange("input_order").sortWithinPartitions("input_order").select("value").write.mode("overwrite").text(path)


def parse_genbank(value: Column) -> Column:
    """struct of a GenBank record's id, description, annotations, CDS location text and sequence."""
    text = F.replace(value, F.lit("\r"), F.lit(""))
    one = lambda key: F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?ms)^{key}[ ]+(.*?)(?=^\S|\z)", 1), r"\s+", " "))
    version, accession = F.regexp_extract(text, r"(?m)^VERSION[ ]+(\S+)", 1), F.regexp_extract(text, r"(?m)^ACCESSION[ ]+(.*)$", 1)
    organism = F.trim(F.regexp_extract(text, r"(?m)^[ ]+ORGANISM[ ]+(.*)$", 1))
    cds = F.regexp_replace(F.regexp_extract(text, r"(?ms)^ {5}CDS {2,}(.*?)(?=^ {5,21}\S*/|^ {5}\S|^\S)", 1), r"\s", "")
    seq = F.upper(F.regexp_replace(F.regexp_extract(text, r"(?ms)^ORIGIN[^\n]*\n(.*)", 1), r"[\s\d/]", ""))
    many = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    annotations = F.create_map(F.lit("organism"), F.array(organism), F.lit("accessions"), many(accession), F.lit("definition"), F.array(one("DEFINITION")))
    return F.struct(F.when(version != "", version).otherwise(F.element_at(F.concat(many(accession), F.array(F.lit(""))), 1)).alias("id"), F.regexp_replace(one("DEFINITION"), r"\.\z", "").alias("description"), annotations.alias("annotations"), cds.alias("cds"), seq.alias("seq"))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(input_order, id, description, annotations, cds, seq) of GenBank files; cds is the first CDS feature's location, '' without one."""
    rows = records(spark, path, "input_order", "\n//").where(F.col("value").contains("LOCUS"))
    return rows.select("input_order", parse_genbank(F.col("value")).alias("r")).select("input_order", "r.*")


def record_name(annotations: Column, form: str = "organism_accessions") -> Column:
    """Annotations by their keys in ``form``, joined by _; a list counts by its first element, blanks become _.

    Raises where a record lacks an annotation, or has an empty list of it.
    """
    lacks = lambda k: F.raise_error(F.concat(F.lit(f"no annotation {k}; there are: "), F.array_join(F.map_keys(annotations), ", "))).cast("string")
    parts = [F.coalesce(F.get(F.element_at(annotations, k), 0), lacks(k)) for k in form.split("_")]
    return F.replace(F.regexp_replace(F.concat_ws("_", *parts), "^_", ""), F.lit(" "), F.lit("_"))


def extract_cds(records: DataFrame) -> DataFrame:
    """Records with a CDS, cut to it: its parts in order, reverse-complemented where the location says so."""
    inner = F.regexp_replace("cds", r"[<>]", "")
    minus = inner.startswith("complement(")
    spans = F.transform(F.regexp_extract_all(inner, F.lit(r"(complement\()?\d+(?:\.\.\d+)?"), F.lit(0)), lambda t: F.struct(t.startswith("complement").alias("minus"), F.regexp_extract(t, r"(\d+)", 1).cast("int").alias("a"), F.regexp_extract(t, r"(\d+)\z", 1).cast("int").alias("b")))
    piece = lambda p: F.substr(F.col("seq"), p["a"], p["b"] - p["a"] + 1)
    joined = F.array_join(F.transform(spans, lambda p: F.when(p["minus"] & ~minus, S.reverse_complement(piece(p))).otherwise(piece(p))), "")
    return records.where("cds <> ''").withColumn("seq", F.when(minus, S.reverse_complement(joined)).otherwise(joined))


SEQUENCES = T.StructType([T.StructField("input_order", T.LongType()), T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("seq", T.StringType())])

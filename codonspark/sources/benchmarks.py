"""Tables of published benchmarks: protein database exports, multi-label tables, sequences with labels and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonspark.operators import joins
from codonspark.sources.fasta import read_fasta
from codonspark.sources.tables import UNIPROT, read_tsv, write_tsv


def read_protein_export(spark: SparkSession, path: str, fields: Sequence[str] = UNIPROT) -> DataFrame:
    """A tab-separated export whose columns are ``fields`` by place, whatever its header calls them; missing cells are ''."""
    schema = ", ".join(f"`{f}` string" for f in fields)
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)
    return rows.fillna("").where(" OR ".join(f"`{f}` <> ''" for f in fields))


def write_protein_export(rows: DataFrame, path: str, fields: Sequence[str] = UNIPROT) -> None:
    """The columns ``fields`` as TSV, those that are missing empty."""
    write_tsv(rows.select(*[F.coalesce(F.col(f), F.lit("")).alias(f) if f in rows.columns else F.lit("").alias(f) for f in fields]), path)


def truthy(value: Column) -> Column:
    """Whether a cell says yes: yes, true or a number that isn't 0."""
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.coalesce(text.isin("yes", "y", "true", "t") | (text.try_cast("double") != 0), F.lit(False))


def read_multilabel(spark: SparkSession, path: str, labels: dict[str, Sequence[str]], separator: str = ",") -> DataFrame:
    """A table with a header, plus labels (array): those of which a column says yes; ``labels`` names the columns of each, missing ones say no."""
    rows = read_tsv(spark, path, (), separator)
    says = {name: [truthy(F.col(f"`{c}`")) for c in columns if c in rows.columns] for name, columns in labels.items()}
    own = [F.when(sum((c.cast("int") for c in tests), F.lit(0)) > 0, F.lit(name)) for name, tests in says.items()]
    return rows.withColumn("labels", F.array_compact(F.array(*own)))


def multilabel_rows(rows: DataFrame, labels: Sequence[str], column: str = "labels_text", sequence: str = "sequence") -> DataFrame:
    """Rows with a sequence and a known label, with ``labels``: from the ;-joined ``column``, or where that is empty from the columns of
    the labels' names."""
    text = F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) if column in rows.columns else F.lit("")
    known = F.array(*[F.lit(x) for x in labels])
    listed = F.filter(F.split(text, ";"), lambda x: F.array_contains(known, x))
    flagged = F.array_compact(F.array(*[F.when(truthy(F.col(f"`{x}`")), F.lit(x)) if x in rows.columns else F.lit(None).cast("string") for x in labels]))
    own = rows.withColumn("labels", F.when(text != "", listed).otherwise(flagged))
    return own.where((F.trim(F.coalesce(F.col(sequence), F.lit(""))) != "") & (F.size("labels") > 0))


def multilabel_summary(rows: DataFrame, labels: Sequence[str], column: str = "labels") -> DataFrame:
    """One row: n_rows, n_multi_label_rows, and n_<label> of each label."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.size(column) > 1).alias("n_multi_label_rows"), *[F.count_if(F.array_contains(column, x)).alias(f"n_{x}") for x in labels])


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(accession, label, cleavage_site) of a tab-separated file without a header. Raises for a row of fewer cells."""
    fields = F.split("value", "\t")
    cell = lambda k: F.trim(F.get(fields, k))
    rows = spark.read.text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value")).where("value <> ''")
    first = F.when(F.size(fields) < 3, F.raise_error(F.concat(F.lit("an annotation has three cells: "), "value")).cast("string")).otherwise(cell(0))
    return rows.select(first.alias("accession"), cell(1).alias("label"), cell(2).alias("cleavage_site"))


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """(accession, fold, organism, kind) from TSV with a column for each array of ids, fold, org and y_type."""
    rows = read_tsv(spark, path, ("ids", "fold", "org", "y_type"))
    return rows.select(F.col("ids").alias("accession"), *[F.col(a).cast("int").alias(b) for a, b in (("fold", "fold"), ("org", "organism"), ("y_type", "kind"))])


def read_benchmark(spark: SparkSession, fasta: str, annotations: str, folds: str) -> DataFrame:
    """(accession, sequence, label, fold) of a benchmark of three files, whose ids must agree and not repeat (ValueError)."""
    sequences = read_fasta(spark, fasta).select(F.col("id").alias("accession"), F.col("seq").alias("sequence"))
    return joins.benchmark_table(sequences, read_annotations(spark, annotations).select("accession", "label"), read_folds(spark, folds).select("accession", "fold"))


def union_sources(sources: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """The rows of all sources with ``columns``, those that a source lacks null, and the source's name as ``source_name``."""
    parts = [df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns], F.lit(name).alias("source_name")) for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

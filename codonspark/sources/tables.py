"""GFF, line lists, TSV and CSV tables, reports and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonspark.plans.frames import stored

GFF = "seqid string, source string, type string, start int, `end` int, score string, strand string, phase string, attributes string"
UNIPROT = ("accession", "sequence", "cc_subcellular_location", "organism_id", "lineage_ids")


#: White space at both ends, of all kinds that a line may hold.
BLANKS = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def records(spark: SparkSession, path: str, number: str, separator: str | None = None, whole: bool = False, in_file: str | None = None) -> DataFrame:
    """(number, value) of the records of text files, numbered from 0 without gaps in the order of the files' paths and of their places.

    Spark packs blocks of files into tasks by size. So the rows of each block are counted first (a row for each block), and their sums
    in the order of path and start shift the numbers that the tasks give. ``whole``: a record is a file; ``in_file``: a column with the
    record's number within its file.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    rows = reader.text(path, wholetext=whole).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    blocks = rows.groupBy("__file", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__rows"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shift = lambda w: F.coalesce(F.sum("__rows").over(w), F.lit(0)) - F.col("__first")
    blocks = blocks.select("__file", "__block", shift(before).alias("__shift"), shift(own).alias("__own"))
    inside = [(F.col("__id") + F.col("__own")).cast("long").alias(in_file)] if in_file else []
    return rows.join(blocks, ["__file", "__block"]).select((F.col("__id") + F.col("__shift")).cast("long").alias(number), *inside, "value")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path, "line_no").select("line_no", F.regexp_replace("value", r"\r\z", "").alias("line"))


def read_gff(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(annotations, header): nine columns with line_no, and the lines that begin with #. Blank lines go."""
    lines = _numbered(spark, path)
    fields = F.split("line", "\t")
    names = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")
    cells = [F.get(fields, k).cast("int").alias(n) if n in ("start", "end") else F.get(fields, k).alias(n) for k, n in enumerate(names)]
    body = lines.where(~F.col("line").startswith("#") & (F.regexp_replace("line", BLANKS, "") != "")).select("line_no", *cells)
    return body, lines.where(F.col("line").startswith("#"))


def gff_lines(gff: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """(line_no, value): the header's lines, then annotations, in order."""
    names = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")
    rows = gff.select(F.lit(1).alias("part"), "line_no", F.concat_ws("\t", *[F.coalesce(F.col(n).cast("string"), F.lit(".")) for n in names]).alias("value"))
    if header is not None:
        rows = rows.unionByName(header.select(F.lit(0).alias("part"), "line_no", F.col("line").alias("value")))
    return rows


def write_gff(gff: DataFrame, path: str, header: DataFrame | None = None) -> None:
    gff_lines(gff, header).repartitionByRange("part", "line_no").sortWithinPartitions("part", "line_no").select("value").write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): lines that aren't blank, without white space at their ends."""
    return _numbered(spark, path).select("line_no", F.regexp_replace("line", BLANKS, "").alias("value")).where("value <> ''")


def read_tsv(spark: SparkSession, path: str, required: tuple[str, ...] = (), separator: str = "\t") -> DataFrame:
    """A table with a header, all columns strings, missing cells ''. ValueError if a required column is missing."""
    df = spark.read.option("sep", separator).option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.fillna("")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON where the path says so, else as TSV."""
    write_json(df, path) if path.endswith(".json") else write_tsv(df, path)


def batches(wanted: DataFrame, size: int = 1000) -> DataFrame:
    """(batch, accessions): accessions in the order of line_no, ``size`` to a batch, for a service that takes lists."""
    if size < 1:
        raise ValueError("size must be over 0")
    # ranges of line_no first, then each range's place among them: no task ranks all rows
    part = F.spark_partition_id().alias("part")
    ranged = wanted.select("line_no", "value").repartitionByRange("line_no").select("line_no", "value", part)
    ranged = stored(ranged, "batches")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("line_no", "value")) - 1
    numbered = ranged.withColumn("place", place).join(F.broadcast(offsets), "part").withColumn("batch", F.floor((F.col("first") + F.col("place")) / size).cast("long"))
    return numbered.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]).alias("accessions"))


def write_folds(oof: DataFrame, path: str) -> None:
    """Out-of-fold predictions (source, fold, row_idx, truth, probabilities), a folder for each source and fold."""
    oof.write.mode("overwrite").partitionBy("source", "fold").parquet(path)


def replace_folds(base: DataFrame, partial: DataFrame, key: str = "row_idx", truth: str = "truth") -> DataFrame:
    """``base`` with the rows that ``partial`` covers taken from it. ValueError if it repeats a row or disagrees on a true class."""
    twice = partial.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("partial predictions overlap")
    if not partial.join(base.select(key, F.col(truth).alias("_t")), key).where(~F.col(truth).eqNullSafe(F.col("_t"))).isEmpty():
        raise ValueError("partial predictions disagree on true classes")
    return base.join(partial.select(key), key, "left_anti").unionByName(partial.select(*base.columns))

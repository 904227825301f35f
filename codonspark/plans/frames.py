"""Sequence frames: (input_order, id, description, seq), and what turns codons or columns back into sequences."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonspark.functions import sequences as S

#: Letters of a text stand for bases, so that any table of texts has coding sequences with ambiguous and gap codons.
LETTERS, AS_BASES, AS_RESIDUES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTN-", "ACDEFGHIKLMNPQRSTVWYACDEFG"


def letters(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")


def document_sequences(spark: SparkSession, sf_dir: str, residues: bool = False, keep_case: bool = False) -> DataFrame:
    """(input_order, id, seq) of all documents; ids repeat. ``residues``: proteins; ``keep_case``: lower-case letters stay so."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    to = AS_RESIDUES if residues else AS_BASES
    seq = F.translate(letters(F.col("text")), LETTERS + LETTERS.lower(), to + to.lower()) if keep_case else F.translate(F.upper(letters(F.col("text"))), LETTERS, to)
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("_"), (F.col("doc_id") % 40).cast("string"), F.lit("."), (F.col("doc_id") % 3).cast("string"))
    return docs.select(F.col("doc_id").alias("input_order"), name.alias("id"), "lang", seq.alias("seq"))


def document_alignments(spark: SparkSession, sf_dir: str, step: int = 60) -> DataFrame:
    """(alignment_id, input_order, id, seq): documents whose lengths round up to the same multiple of ``step``, filled with gaps."""
    seqs = document_sequences(spark, sf_dir)
    blocks = F.ceil(F.length("seq") / step)
    return seqs.select(blocks.alias("alignment_id"), "input_order", "id", F.rpad("seq", (blocks * step).cast("int"), "-").alias("seq")).where("alignment_id > 0")


def codon_rows(seqs: DataFrame, keys: tuple[str, ...] = ("input_order",)) -> DataFrame:
    """One row for each complete codon: the keys, site (from 0) and codon in upper case."""
    return seqs.select(*keys, F.posexplode(S.codons(F.upper("seq"))).alias("site", "codon"))


def keep_sites(seqs: DataFrame, kept: DataFrame, key: str = "alignment_id") -> DataFrame:
    """``seqs`` with the codons of the kept sites only; ``kept`` has a row (key, sites) for each alignment, sites an ordered array.

    An alignment without such a row keeps nothing. Sequences aren't taken apart into rows.
    """
    rows = seqs.join(kept.select(key, "sites"), key, "left")
    own = S.codons(F.col("seq"))
    return rows.withColumn("seq", F.coalesce(F.array_join(S.let(own, lambda c: F.transform(F.col("sites"), lambda s: F.get(c, s))), ""), F.lit(""))).select(*seqs.columns)


def seeded(seed: int, *columns: str) -> Column:
    """A number below 2^60 from the MD5 of seed and columns (null as ''), which other engines can repeat."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy("input_order")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group of ``keys`` in ``order``, with all columns."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share, spark.checkpoint.dir, and read again.

    In local mode, where one machine is all there is, a temporary folder is set where that is unset; on a cluster its absence raises.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codonspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key's rows are split where it has more than this many and more than one in SPLIT_SHARE of all rows, so that the table of
#: split keys, which is broadcast, has at most SPLIT_SHARE rows.
SPLIT_ROWS, SPLIT_SHARE = 1_000, 50_000


def spread_join(large: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``large``, a stored table, joined with ``small`` without a task that gets all rows of a frequent key.

    Keys of very many rows in ``large`` are split by a hash of their other columns, and their rows of ``small`` repeated for each part. Null
    keys match nothing.
    """
    limit = max(SPLIT_ROWS, large.count() // SPLIT_SHARE)
    hot = large.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64(*[c for c in large.columns if c != key]), F.col("_parts")).cast("int")
    rows = large.join(F.broadcast(hot), key, "left").withColumn("_part", F.coalesce(part, F.lit(0))).drop("_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part")
    return rows.join(small.join(F.broadcast(hot), key, "left").select(*small.columns, every), [key, "_part"], how).drop("_part")


def running(rows: DataFrame, within: str, order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """``rows`` with the sums of ``columns`` over all rows of the same ``within`` up to theirs in ``order``, in the columns' place.

    Rows are dealt to ranges, which are summed up on their own; only the ranges' sums are put in order. (within, order) must be unique.
    """
    by = F.desc(order) if descending else F.asc(order)
    ranges = stored(rows.repartitionByRange(F.col(within), by).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy(within, "_part").agg(*[F.sum(c).alias(c) for c in columns])
    sums = sums.select(F.col(within).alias("_w"), F.col("_part").alias("_p"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    upto = Window.partitionBy("_part", within).orderBy(by)
    own = ranges.withColumns({c: F.sum(c).over(upto) for c in columns}).join(sums, (F.col("_part") == F.col("_p")) & F.col(within).eqNullSafe(F.col("_w")))
    return own.select(*[(F.col(c) + F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])

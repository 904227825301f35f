"""The corpus pipeline: quality rules, n-gram Jaccard join, secret scans, mixing to target weights, BPE.

Each stage works on all rows that the one before kept, and is written to the shared folder before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonspark.llm import bpe, jaccard, mixing, quality, secrets
from codonspark.llm.common import Workspace
from codonspark.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.cascade(docs).where("rejected_by IS NULL").select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the document with the smallest id; repeated rows once."""
    work = Workspace(spark, "stage-jaccard")
    classes = jaccard.near_duplicates(docs.select("doc_id", "text"), work=work)
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.struct("doc_id").alias("__first"))
    firsts = work.keep(first.groupBy("__first").agg(F.count("*").alias("__n")), "firsts")
    work.only("firsts")
    stay = docs.join(firsts, F.struct("doc_id") == F.col("__first"), "left_semi")
    return stay if firsts.where("__n > 1").isEmpty() else stay.dropDuplicates(["doc_id", "text"])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: one row for each pass of a document, with the words taken in it."""
    return mixing.pieces(mixing.mix(docs), docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every row."""
    rows = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: SQL can't express the Jaccard join's components and the BPE merges; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), f"stage{k}")
        work.only(f"stage{k}")
    return docs

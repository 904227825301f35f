"""The operators' queries over the driver's tables.

Each query applies its operator with production parameters to the whole table and derives the digest columns from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, divergence, fingerprints, jaccard, licenses, mixing, oracles, quality, repair, secrets, sharding, urls, warc
from .common import Workspace

SHARDS = 8


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary())


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), n=3, threshold="0.9")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(pages(spark, sf_dir), Workspace(spark, "warc"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(pages(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    first = F.transform("phrases", lambda m: m["first"])
    label = lambda c: F.transform(c, lambda m: m["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.when(F.size("templates") > 0, F.lit(1.0)).when(F.size("phrases") > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
                        joined(label("phrases")).alias("base_labels"), joined(F.concat(label("phrases"), label("templates"))).alias("labels"), score.alias("score"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.Ledger(Workspace(spark, "secrets"))
    secrets.update(documents(spark, sf_dir), ledger, patterns=secrets.BASE)  # the ledger that an earlier set of rules left
    paths = secrets.scan(documents(spark, sf_dir), ledger)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([p.kind for p in secrets.BASE]))
    return paths.select("doc_id", *[of(p.kind) for p in secrets.BASE], F.sha2(secrets.listing(base).cast("binary"), 256).alias("base_sha256"), secrets.listing(F.col("spans")).alias("spans"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(documents(spark, sf_dir))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return classifier.classify(documents(spark, sf_dir), labels)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_bpe, op3_jaccard_join, op4_warc, op5_url_filter, op6_licenses, op7_mixing, op8_quality, op9_secrets, op10_fingerprints, op11_divergence, op12_classifier, op13_repair, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)

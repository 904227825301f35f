"""Row operators on streams of sequence files.

Each works on one record at a time, so a stream needs no state; column operators need whole alignments and don't stream.
``stream_stats`` keeps running totals by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codonspark.functions import sequences as S
from codonspark.operators import rows
from codonspark.sources.fasta import fasta_text, parse_fasta

KERNELS: dict[str, Callable[..., DataFrame]] = {"mask": rows.mask, "pad": rows.pad, "translate": rows.translate, "remove": rows.remove_sequences}


def stream_fasta(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Records of FASTA files as they arrive in a folder, as (input_order, id, description, seq); a stream has no order, input_order is 0."""
    text = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    parsed = text.where(F.regexp_like("value", F.lit(r"\S"))).select(parse_fasta(F.col("value")).alias("r"))
    return parsed.select(F.lit(0).cast("long").alias("input_order"), "r.id", "r.description", "r.seq")


def run_kernel(stream: DataFrame, kernel: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Writes a kernel's output as FASTA text, exactly once for each file."""
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel: {kernel}")
    done = KERNELS[kernel](stream, **options)
    return done.select(fasta_text(done).alias("value")).writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_stats(stream: DataFrame) -> DataFrame:
    """Running totals by id: sequences, letters, G and C."""
    return stream.groupBy("id").agg(F.count("*").alias("num_sequences"), F.sum(F.length("seq")).alias("total_length"), F.sum(S.count_chars(F.upper("seq"), "GC")).alias("gc"))

"""Helpers shared by the operators: shared-folder tables, column picking and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits at the same six characters.
SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. In local mode, where one machine is all there is, a folder
    of our own is set where that is unset; on a cluster its absence raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codonspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches have ``rows`` rows, for texts of several kilobytes each; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(rows))


def release() -> None:
    """Gives memory that a task has freed back to the system: idle workers would keep it beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems than Linux
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with release() when a task ends."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task


class Workspace:
    """Tables in the shared folder. ``keep`` writes and rereads a frame, which cuts its lineage; ``drop`` deletes tables.

    Shuffle files of a write are deleted when it is done: the table stands for them.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.unset(self.CLEANUP) if before is None else self.spark.conf.set(self.CLEANUP, before)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        for name in self.names & set(names):
            self._delete(self.path(name))
            self.names.remove(name)

    def only(self, *names: str) -> None:
        """Drops all tables but these."""
        self.drop(*self.names - set(names))


#: A key's rows are split where it has more than this many and more than one in SPLIT_SHARE of all rows, so that the table of
#: split keys, which is broadcast, has at most SPLIT_SHARE rows.
SPLIT_ROWS, SPLIT_SHARE = 1_000, 50_000


def split_limit(n_rows: int) -> int:
    return max(SPLIT_ROWS, n_rows // SPLIT_SHARE)


def spread_join(large: DataFrame, small: DataFrame, key: str, limit: int, how: str = "inner") -> DataFrame:
    """``large`` joined with ``small``, which has one row for each ``key``, without a task that gets all rows of a frequent key.

    Keys with more than ``limit`` (see split_limit) rows in ``large`` are split into groups of about that many; their rows of
    ``small`` are repeated for each group. The counts are combined before they are shuffled. Null keys match nothing.
    """
    hot = large.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__parts"))
    others = [c for c in large.columns if c != key]
    rows = large.join(F.broadcast(hot), key, "left").withColumn("__part", F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*others), F.col("__parts")).cast("int"))).drop("__parts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)).alias("__part")
    return rows.join(small.join(F.broadcast(hot), key, "left").select(*small.columns, parts), [key, "__part"], how).drop("__part")


#: Rows of a joined table (a key and a few numbers, some 50 bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000


def join_beside(large: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``large`` joined with a kept table of one row for each ``key``: broadcast if it has at most BROADCAST_ROWS rows, so that
    ``large`` stays where it is, else by spread_join."""
    return large.join(F.broadcast(small), key, how) if small.count() <= BROADCAST_ROWS else spread_join(large, small, key, split_limit(large.count()), how)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text that isn't null, in order."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(inner) > 0, F.split(inner, GAP)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def components(edges: DataFrame, work: Workspace, name: str = "cc", most: int = 60) -> DataFrame:
    """Connected components of (a, b) edges as (node, root), root being the smallest node; isolated nodes aren't listed.

    Every node has a label, at first the smallest of itself and its neighbours. In each step the labels at the two ends of an edge
    are compared; the larger one is hooked to the smallest that it meets, and labels are replaced by the labels of the nodes they
    name, twice. Labels only fall, and when no edge has two of them they are the components' smallest nodes. Minima are combined
    before they are shuffled, and joins split frequent keys, so that no neighbourhood is gathered in one task. Edges with a null
    end are ignored, repeated edges and loops do no harm, an empty table gives an empty result.
    """
    edges = work.keep(edges.where("a <> b").select("a", "b"), f"{name}_edges")
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    now = work.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")), f"{name}0")

    def renamed(column: str, label: str) -> DataFrame:
        return now.select(F.col("node").alias(column), F.col("root").alias(label))

    for step in range(1, most + 1):
        ends = join_beside(join_beside(edges, renamed("a", "x"), "a"), renamed("b", "y"), "b").where("x <> y")
        hooks = work.keep(ends.groupBy(F.greatest("x", "y").alias("root")).agg(F.min(F.least("x", "y")).alias("to")), f"{name}{step}_hooks")
        if hooks.isEmpty():
            return now
        for jump in range(3):
            by_root = hooks if jump == 0 else now.select(F.col("node").alias("root"), F.col("root").alias("to"))
            now = work.keep(join_beside(now, by_root, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}{step}_{jump}")
        work.drop(f"{name}{step}_hooks", f"{name}{step}_0", f"{name}{step}_1", f"{name}{step - 1}_2", f"{name}{step - 1}")
    raise RuntimeError(f"components did not settle in {most} steps")

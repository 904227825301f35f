"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to ``POSITIONS`` places on a ring and each shard owns many of them (its virtual nodes). A key belongs to the
first virtual node at or after its place; if that shard is full, the key goes on clockwise to the next shard with room.
A shard is full when taking the key would lift it over ``(1 + slack)`` times the mean load, so the balance is guaranteed,
and only keys next to full shards leave their home.

All keys of one place move together. The walk therefore needs one row for each place, at most ``POSITIONS`` of them
whatever the size of the corpus; that bounded table is what goes to the driver and back as a broadcast. Rows are read
twice and only (id, checksum, size) is shuffled, by place, to number the rows of a shard without gaps.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

POSITIONS = 1 << 16
VIRTUAL_NODES = 256
SLACK = 0.005


def virtual_nodes(shards: int, each: int = VIRTUAL_NODES, positions: int = POSITIONS) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in ring order. A shard's places depend on its own number only."""
    place = lambda shard, k: int.from_bytes(hashlib.sha256(f"{shard}/{k}".encode()).digest()[:8], "big") % positions
    return sorted((place(shard, k), shard) for shard in range(shards) for k in range(each))


def walk(loads: dict[int, int], shards: int, slack: float = SLACK, each: int = VIRTUAL_NODES, positions: int = POSITIONS) -> dict[int, tuple[int, int, int]]:
    """place -> (shard, home shard, number of full shards passed), heaviest places first, then in ring order.

    A place that no shard can take within the bound (a single text larger than a shard's share) goes to the least
    loaded shard. ``loads`` has at most ``positions`` entries.
    """
    ring = virtual_nodes(shards, each, positions)
    starts = [place for place, _ in ring]
    most = (1 + slack) * sum(loads.values()) / shards
    full, out = [0] * shards, {}
    order: dict[int, list[int]] = {}
    for place, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        at = bisect.bisect_left(starts, place) % len(ring)
        if at not in order:
            order[at] = list(dict.fromkeys(shard for _, shard in ring[at:] + ring[:at]))
        route = order[at]
        steps = next((k for k, shard in enumerate(route) if full[shard] + load <= most), None)
        shard = route[steps] if steps is not None else min(range(shards), key=lambda s: (full[s], s))
        full[shard] += load
        out[place] = (shard, route[0], steps if steps is not None else shards)
    return out


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slack: float = SLACK,
          positions: int = POSITIONS) -> DataFrame:
    """(id, size, text_crc32, place, home_shard, passed, shard, slot) of every row.

    size: UTF-8 bytes plus 1, so that empty and null texts weigh 1 (a null text counts as empty). The key is the id with
    size and checksum: rows with a repeated or null id spread unless they are equal in all three, and equal rows
    stay together. slot numbers a shard's rows from 0 without gaps, by place, then id. An empty table gives no rows.
    Columns other than the two named are not read.
    """
    spark, text = df.sparkSession, text_or_empty(F.col(text_col))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("id", "crc", "size"), F.lit(positions)).cast("int"))
    # bounded by the number of places: (place, bytes, rows)
    found = rows.groupBy("place").agg(F.sum("size").alias("load"), F.count("*").alias("n")).collect()
    to = walk({r.place: r.load for r in found}, shards, slack, positions=positions)
    base, slots = [], [0] * shards
    for r in sorted(found):
        own, home, passed = to[r.place]
        base.append((r.place, own, home, passed, slots[own]))
        slots[own] += r.n
    table = spark.createDataFrame(base, "place int, shard int, home_shard int, passed int, first long")
    number = F.row_number().over(Window.partitionBy("place").orderBy("id", "crc", "size"))
    return rows.withColumn("number", number).join(F.broadcast(table), "place").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "place", "home_shard", "passed", "shard",
        (F.col("first") + F.col("number") - 1).cast("long").alias("slot"))


def moved(df: DataFrame, shards: int, grown: int, **options) -> DataFrame:
    """One row: rows, and how many of them change their shard when ``shards`` become ``grown``."""
    one, two = shard(df, shards, **options), shard(df, grown, **options)
    keys = [one.columns[0], "size", "text_crc32", "place"]
    pairs = one.groupBy(*keys).agg(F.first("shard").alias("a"), F.count("*").alias("n")).join(
        two.groupBy(*keys).agg(F.first("shard").alias("b")).withColumnsRenamed({k: f"_{k}" for k in keys}),
        F.expr(" AND ".join(f"{k} <=> _{k}" for k in keys)))
    return pairs.agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("a") != F.col("b"), F.col("n")).otherwise(0)).alias("n_moved"))

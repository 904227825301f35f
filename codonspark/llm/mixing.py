"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

1. All sources' words are cut into blocks of one length B. The mix has as many seats (blocks that it takes) as all targets have
   blocks. Seats go to the sources by the highest quotients target / (2k - 1), the target being counted in blocks.
2. A source's documents are dealt to SHARDS shards by a seeded hash. Its seats go to its shards in the same way, by the highest
   quotients blocks / (2k - 1): integer quotas of each source in each shard.
3. In a shard, a source's documents stand in a seeded order as one line of n blocks. With a quota of q seats every block is taken
   floor(q / n) times, and the q mod n blocks from a seeded place on, around the line's end, once more. What a document gives
   follows from its place alone; blocks are never listed, and few documents are cut.

Quotients are not listed either: seats that any divisor near the right one gives are counted by rounding, and only the last few
quotients of each party, two for each party in all, are ranked.

A source is never brought into one task: its line is laid out over ``BUCKETS`` hash buckets with running sums inside each,
and only the buckets' sums (a bounded number for each source) are put in order. The sources themselves are ranked in one
window with a row for each source; that table has passed two aggregations and holds a few numbers a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, word_count

BUCKETS, SHARDS = 4096, 8
#: Words of a block at most; fewer where the smallest source would have under LEAST_BLOCKS blocks, as its target would be missed.
BLOCK, LEAST_BLOCKS = 512, 128
SPACES = "[\\x20\\x09-\\x0D]*"


def source_key(column: str) -> Column:
    """A key that null has too, after all others in code-point order: ``a`` and the source, or ``b``."""
    return F.when(F.col(column).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(column).cast("string")))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(key, source_size, target, block) from (key, source_size), block being the same for all.

    Sources in key order weigh ``weights``, repeating. They share ``share`` times all words by weight; a target stops at
    ``most`` times its source's size and the excess is shared again by weight, until none is above: target =
    min(most * size, level * weight), with the level from running sums in the order of size / weight. Sources without
    words get target 0. An empty table gives no rows.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy("key"))  # one row for each source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "key")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    rows = (sizes.withColumn("weight", weight)
            .withColumn("total", F.sum("source_size").over(everything))
            .withColumn("least", F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(everything))
            .withColumn("cap", F.col("source_size") * F.lit(most))
            .withColumn("ratio", F.col("cap") / F.col("weight"))
            # the level if all sources before this one are at their caps, and this and later ones aren't
            .withColumn("level", (F.col("total") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
            .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.coalesce("least", F.lit(1)) / LEAST_BLOCKS)))
    return rows.select("key", "source_size", target.cast("double").alias("target"), block.cast("long").alias("block"))


def apportion(parties: DataFrame, group: Sequence[str], party: str, weight: str, house: Column, most: str, spare: int) -> DataFrame:
    """``parties`` with ``seats``: the ``house`` of each group's seats goes to its parties by the highest quotients weight / (2k - 1),
    equal ones to the earlier party, but at most ``most`` to each.

    With divisor d a party gets floor(weight / d + 1/2) seats, and M parties together get sum / d seats with an error of M / 2 at most. So
    with d = sum / (house - M / 2) none gets too many, and with d = sum / (house + M / 2) they get enough; the seats between
    the two, 2 M at most and ``spare`` more for each party where ``most`` stops others, are ranked by their quotients.
    """
    all_ = Window.partitionBy(*group)
    rows = parties.withColumn("__house", house.cast("long")).withColumn("__sum", F.sum(weight).over(all_)).withColumn("__m", F.count("*").over(all_))
    upto = lambda seats: F.when(F.col("__sum") > 0, F.floor(F.col(weight) * F.greatest(seats, F.lit(0.0)) / F.col("__sum") + 0.5)).otherwise(F.lit(0)).cast("long")
    # one seat either way, against rounding
    rows = rows.withColumn("__sure", F.least(F.greatest(upto(F.col("__house") - F.col("__m") / 2) - 1, F.lit(0)), F.col(most)))
    rows = rows.withColumn("__upto", F.least(upto(F.col("__house") + F.col("__m") / 2) + 1 + spare, F.col(most)))
    rows = rows.withColumn("__left", F.col("__house") - F.sum("__sure").over(all_))
    seats = F.when(F.col("__upto") > F.col("__sure"), F.sequence(F.col("__sure") + 1, F.col("__upto"))).otherwise(F.array().cast("array<bigint>"))
    listed = rows.select(*group, party, "__left", F.col(weight).alias("__weight"), F.explode(seats).alias("__k"))
    quotient = F.col("__weight") / (2 * F.col("__k") - 1)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(quotient.desc(), F.col(party), F.col("__k")))
    more = listed.withColumn("__rank", rank).where("__rank <= __left AND __weight > 0").groupBy(*group, party).agg(F.count("*").alias("__more"))
    rows = rows.join(more, [*group, party], "left").withColumn("seats", (F.col("__sure") + F.coalesce("__more", F.lit(0))).cast("long"))
    return rows.drop("__house", "__sum", "__m", "__sure", "__upto", "__left", "__more")


def quotas(lines: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, shards: int = SHARDS) -> DataFrame:
    """(key, shard, words, n_blocks, source_size, target, block, source_seats, seats): the seats of each source in each shard,
    from (key, shard, words)."""
    table = targets(lines.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, float(most))
    lines = lines.join(table, "key").withColumn("n_blocks", F.ceil(F.col("words") / F.col("block")).cast("long")).withColumn("most", F.col("n_blocks") * most)
    sources = lines.groupBy("key", "source_size", "target").agg(F.sum("n_blocks").alias("blocks"), F.sum("most").alias("most"))
    # a line's last block is short: the target in blocks of the source as they are
    sources = sources.withColumn("due", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0)))
    house = F.floor(F.sum("due").over(Window.partitionBy()) + 0.5)
    sources = apportion(sources, [], "key", "due", house, "most", 1).select("key", F.col("seats").alias("source_seats"))
    return apportion(lines.join(sources, "key"), ["key"], "shard", "n_blocks", F.col("source_seats"), "most", shards).drop("most")


def _overlap(a: Column, b: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(b, high) - F.greatest(a, low), F.lit(0)).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1),
        share: float = 1.5, most: int = 2, seed: int = 17, shards: int = SHARDS, work: Workspace | None = None) -> DataFrame:
    """(id, key, size, source_size, target, taken, shard, whole, from1, n1, from2, n2, mark) of every row.

    size: words of the text, 0 for null. taken: words that the mix takes of it, repeats counted, at most ``most`` times its
    size: ``whole`` times the whole text, and once more n1 words from word from1 on and n2 from from2 on. Shard and order are from an
    MD5 of seed, id and text; rows equal in both are interchangeable. The same rows and seed give the same result in every
    run. A null source is a source of its own, last in order. Empty tables give no rows; other columns aren't read.
    """
    work = work or Workspace(df.sparkSession, "mixing")
    number = lambda x: F.conv(F.substring(x, 1, 15), 16, 10).cast("long")
    mark = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))
    rows = df.select(F.col(id_col).alias("id"), source_key(source_col).alias("key"), word_count(F.col(text_col)).alias("size"), mark.alias("mark"))
    rows = rows.withColumn("bucket", F.pmod(number(F.col("mark")), F.lit(BUCKETS)).cast("int")).withColumn("shard", F.pmod("bucket", F.lit(shards)))
    rows = work.keep(rows, "sizes")  # texts are read once
    buckets = work.keep(rows.groupBy("key", "shard", "bucket").agg(F.sum("size").alias("held")), "buckets")
    table = quotas(buckets.groupBy("key", "shard").agg(F.sum("held").alias("words")), weights, share, most, shards)
    ahead = Window.partitionBy("key", "shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = F.when(F.col("n_blocks") > 0, F.pmod(number(F.md5(F.concat_ws("/", F.lit(str(seed)), "shard", "key"))), F.greatest("n_blocks", F.lit(1)))).otherwise(F.lit(0))
    times = F.when(F.col("n_blocks") > 0, F.floor(F.col("seats") / F.greatest("n_blocks", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    table = table.withColumn("whole", times).withColumn("low", first * F.col("block")).withColumn("extra", F.col("seats") - F.col("whole") * F.col("n_blocks"))
    table = table.withColumn("high", F.least(F.col("low") + F.col("extra") * F.col("block"), F.col("words"))).withColumn(
        "round", F.greatest(first + F.col("extra") - F.col("n_blocks"), F.lit(0)) * F.col("block"))
    offsets = buckets.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0))).join(table.select("key", "shard", "source_size", "target", "whole", "low", "high", "round"), ["key", "shard"])
    offsets = work.keep(offsets.drop("held", "shard"), "offsets")
    within = Window.partitionBy("key", "bucket").orderBy("mark", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["key", "bucket"])
    start, end = F.col("ahead") + F.col("inside"), F.col("ahead") + F.col("inside") + F.col("size")
    rows = rows.withColumns({"n1": _overlap(start, end, F.lit(0), F.col("round")), "n2": _overlap(start, end, F.col("low"), F.col("high")),
                             "from2": F.greatest(F.col("low") - start, F.lit(0)).cast("long")})
    return rows.select(F.col("id").alias(id_col), "key", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                       (F.col("whole") * F.col("size") + F.col("n1") + F.col("n2")).cast("long").alias("taken"), "shard",
                       "whole", F.lit(0).cast("long").alias("from1"), "n1", "from2", "n2", "mark")


def pieces(mixed: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """``texts`` as the mix takes them: each pass of a document that takes any word is one row with the columns of ``texts``.

    Whole passes have the text as it is; in a part, words keep the white space that follows them. ``seed`` is that of the mix. Rows are
    joined by id and text, so an id may repeat or be null; rows equal in both must have been merged. Other columns may have any names.
    """
    spans = mixed.where("taken > 0").select(F.col("mark").alias("__mark"), *[F.col(c).alias(f"__{c}") for c in ("whole", "size", "from1", "n1", "from2", "n2")])
    mark = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))
    rows = texts.select(F.struct(*[F.col(f"`{c}`") for c in texts.columns]).alias("__row"), mark.alias("__mark")).join(spans, "__mark")
    part = F.col("__n1") + F.col("__n2")
    rows = rows.withColumn("__pass", F.explode(F.sequence(F.lit(1), (F.col("__whole") + (part > 0).cast("long")).cast("int"))))
    words = F.regexp_extract_all(F.col("__row")[text_col], F.lit(f"(?:^{SPACES})?{WORD}{SPACES}"), F.lit(0))
    cut = lambda w, a, n: F.slice(w, (F.col(a) + 1).cast("int"), F.col(n).cast("int"))
    some = F.array_join(F.get(F.transform(F.array(words), lambda w: F.concat(cut(w, "__from1", "__n1"), cut(w, "__from2", "__n2"))), 0), "")
    text = F.when((F.col("__pass") <= F.col("__whole")) | (part == F.col("__size")), F.col("__row")[text_col]).otherwise(some)
    return rows.select(*[text.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in texts.columns])

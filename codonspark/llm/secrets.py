"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content (its blob). The ledger is a table in the shared folder of the (blob,
rule version) pairs that were scanned, with their findings. A scan takes one text of each blob that has a pair missing, runs the missing
rules over it, appends to the ledger, and joins the findings that the ledger holds back to all paths with that content. New rule versions
are new rule names in the ledger, so they rescan what they must and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, split_limit, spread_join, text_or_empty

#: Blobs with findings (some 150 bytes each), and keys of unseen blobs (12 bytes each), that may be broadcast.
BROADCAST_ROWS, BROADCAST_KEYS = 50_000, 500_000
SPANS = "array<struct<rule:string,start:int,end:int>>"


@dataclass(frozen=True)
class Pattern:
    """A kind of secret. ``group`` of a match must have ``least`` code points, else the match is dropped; it hides others all
    the same. A changed pattern needs a new ``version``."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0
    version: int = 1

    @property
    def rule(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns. Runs of [0-9a-f] and of AKIA[A-Z0-9] are taken whole, so their least length may stand in the pattern.
BASE = (
    Pattern("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
    Pattern("access", r"AKIA[A-Z0-9]{12,}"),
    Pattern("hex", r"[0-9a-f]{32,}"),
)
#: A key block runs to its END line, before which no other line of dashes stands (a body has few dashes: headers and
#: armour), or, where END is missing, over the header fields and the lines of base64 letters that follow. Line breaks may be
#: written as \\n. Repeats are bounded, as Java's matcher recurses over them: 400 lines hold the longest keys in use.
_BREAK = r"(?:[ \t]*\r?\n[ \t]*|(?:\\r)?\\n)"
_TO_END = r"[^-]*(?:-{1,4}[^-]+){0,64}-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_LINE = "[A-Za-z0-9+/]" * 16 + "[A-Za-z0-9+/]*={0,2}"  # written out: RE2 limits the product of nested repeats
_TO_LAST_LINE = rf"(?:{_BREAK}[A-Za-z-]+: [^\n\\]*){{0,8}}{_BREAK}{{1,2}}{_LINE}(?:{_BREAK}{_LINE}){{0,400}}(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}={{0,2}}(?:{_BREAK}|\z))?"
MORE = (
    Pattern("pem", rf"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:{_TO_END}|{_TO_LAST_LINE})?", version=2),
    Pattern("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Pattern("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
PATTERNS = BASE + MORE


def spans(text: Column, pattern: Pattern) -> Column:
    """The pattern's matches in ``text`` as SPANS: leftmost, not overlapping, in code points, end exclusive.

    The text between matches and the matches themselves give the places: a match starts after all that stands before it.
    """
    regex, empty = F.lit(pattern.regex), F.array().cast(SPANS)
    gaps = F.transform(F.split(text, pattern.regex, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), lambda x: F.length(x))
    held = whole if not pattern.group else F.transform(F.regexp_extract_all(text, regex, F.lit(pattern.group)), lambda x: F.length(x))
    zero = F.struct(F.lit(0).alias("pos"), empty.alias("out"))
    step = lambda s, x: F.struct(
        (s["pos"] + x["gap"] + x["len"]).alias("pos"),
        F.when(x["held"] >= pattern.least, F.concat(s["out"], F.array(F.struct(F.lit(pattern.rule).alias("rule"), (s["pos"] + x["gap"]).alias("start"), (s["pos"] + x["gap"] + x["len"]).alias("end"))))).otherwise(s["out"]).alias("out"))
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("len"), held.alias("held"))
    return F.when(F.regexp_like(text, regex), F.aggregate(rows, zero, step, lambda s: s["out"])).otherwise(empty)


def blob_of(text: Column) -> Column:
    """The lower-case hex SHA-256 of a text in UTF-8; null counts as empty."""
    return F.sha2(text_or_empty(text).cast("binary"), 256)


class Ledger:
    """A table (blob, rules, spans) at ``path``: a row says that these rules were run over the blob, and all that they found."""

    SCHEMA = f"blob string, rules array<string>, spans {SPANS}"

    def __init__(self, work: Workspace, name: str = "ledger"):
        self.work, self.name = work, name
        self.spark, self.path = work.spark, work.path(name)

    def read(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if found else self.spark.createDataFrame([], self.SCHEMA)

    def append(self, entries: DataFrame) -> None:
        entries.write.mode("append").option("compression", "zstd").parquet(self.path)

    def seen(self, patterns: tuple[Pattern, ...]) -> DataFrame:
        """(blob, seen): bit k is set where pattern k was run over the blob."""
        bit = lambda k, p: F.when(F.array_contains("rules", p.rule), F.lit(1 << k)).otherwise(F.lit(0))
        bits = sum((bit(k, p) for k, p in enumerate(patterns)), F.lit(0)).cast("long")
        return self.read().groupBy("blob").agg(F.bit_or(bits).alias("seen"))

    def findings(self, patterns: tuple[Pattern, ...]) -> DataFrame:
        """(blob, spans) of the blobs in which ``patterns`` found something: (kind, start, end), by start, then in the order of ``patterns``."""
        rules = F.array(*[F.lit(p.rule) for p in patterns])
        known = self.read().where(F.size("spans") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
        own = F.filter("spans", lambda s: F.array_contains(rules, s["rule"]))
        order = F.array_sort(F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.array_position(rules, s["rule"]).alias("at"), s["end"].alias("end"))))
        kinds = F.array(*[F.lit(p.kind) for p in patterns])
        out = F.transform(order, lambda s: F.struct(F.get(kinds, s["at"].cast("int") - 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return known.select("blob", out.alias("spans")).where(F.size("spans") > 0)


def update(df: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text", patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """Scans the pairs of the texts' blobs and the patterns that the ledger lacks, appends them, and returns (id, blob) of every row.

    Each unseen blob is read at one of its paths: keys of rows go through an aggregation, then a join by key brings those paths'
    texts, so that a group of copies never meets in one task. Few keys are broadcast, so that no text moves.
    """
    work = ledger.work
    keyed = df.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    paths = work.keep(keyed.select("id", "key", blob_of(F.col("text")).alias("blob")), f"paths{len(work.names)}")
    unique = paths.groupBy("blob").agg(F.min("key").alias("key"))
    all_seen = (1 << len(patterns)) - 1
    unseen = unique.join(ledger.seen(patterns), "blob", "left").select("key", F.coalesce("seen", F.lit(0)).cast("long").alias("seen")).where(F.col("seen") < all_seen)
    unseen = work.keep(unseen, f"unseen{len(work.names)}")
    n = unseen.count()
    if n:
        texts = keyed.select("key", "text").join(F.broadcast(unseen) if n <= BROADCAST_KEYS else unseen, "key")
        missing = lambda k: F.expr(f"(seen & {1 << k}L) = 0")
        rules = F.filter(F.array(*[F.when(missing(k), F.lit(p.rule)) for k, p in enumerate(patterns)]), lambda x: x.isNotNull())
        found = F.concat(*[F.when(missing(k), spans(F.col("text"), p)).otherwise(F.array().cast(SPANS)) for k, p in enumerate(patterns)])
        ledger.append(texts.select(blob_of(F.col("text")).alias("blob"), rules.alias("rules"), found.alias("spans")))
    return paths.select("id", "blob")


def scan(df: DataFrame, ledger: Ledger | None = None, id_col: str = "doc_id", text_col: str = "text", patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """(id, blob, spans) of every row, from the ledger after an update (a new one, if none is given).

    Rows with a null id are paths too, a null text counts as empty. An empty table gives no paths; columns with other names
    don't matter.
    """
    ledger = ledger or Ledger(Workspace(df.sparkSession, "secrets"))
    paths = update(df, ledger, id_col, text_col, patterns)
    found = ledger.work.keep(ledger.findings(patterns), f"found{len(ledger.work.names)}")
    joined = paths.join(F.broadcast(found), "blob", "left") if (n := found.count()) <= BROADCAST_ROWS else spread_join(paths, found, "blob", split_limit(n), "left")
    return joined.select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("spans"))


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by ``mark``. ``found`` is ordered by start.

    A span puts out what stands between the furthest end before it and its start, then the mark, unless it starts within.
    """
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    step = lambda s, x: F.when(x["end"] <= s["pos"], s).otherwise(F.struct(
        x["end"].alias("pos"), F.when(x["start"] >= s["pos"], F.concat(s["out"], F.array(F.substring(text, s["pos"] + 1, x["start"] - s["pos"]), F.lit(mark)))).otherwise(s["out"]).alias("out")))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["pos"] + 1, F.length(text)))))


def redacted(df: DataFrame, text_col: str = "text", patterns: tuple[Pattern, ...] = PATTERNS, ledger: Ledger | None = None) -> DataFrame:
    """``df`` with all secrets of its text replaced. Findings meet the rows by blob, so ids don't matter; a text without
    secrets stays as it is, null included; other columns may have any names. Findings of at most BROADCAST_ROWS blobs are
    broadcast, more are joined by a shuffle in which frequent blobs are split."""
    ledger = ledger or Ledger(Workspace(df.sparkSession, "redact"))
    # the other columns tell copies apart, of which one is read
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    update(df.select(row.alias("id"), F.col(text_col).alias("text")), ledger, "id", "text", patterns)
    found = ledger.work.keep(ledger.findings(patterns), f"found{len(ledger.work.names)}")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), blob_of(F.col(text_col)).alias("blob"))
    rows = rows.join(F.broadcast(found), "blob", "left") if (n := found.count()) <= BROADCAST_ROWS else spread_join(rows, found, "blob", split_limit(n), "left")
    text = F.col("row")[text_col]
    return rows.select(*[F.when(F.col("spans").isNull(), text).otherwise(redact(text, F.col("spans"))).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])


def listing(found: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule names the measures it needs and rejects a text by them. A seeded sample over all partitions is kept as a table. Each
measure's cost is the time that a job takes to compute it over the sample; each rule's selectivity is the share of the sample's texts
that it rejects of those which the rules before it leave. The next rule is always the one with the most rejection per cost, where
measures that rules before it have computed cost nothing. A text that one rule rejects is not put to the next. The order decides how
soon a text is rejected and which rule is named, never the verdict. ``measures`` gives all figures without short cuts.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Workspace, words

SYMBOLS = "#*$%&|<>"
#: Rows of the sample that the order of the rules is taken from, about.
SAMPLE_ROWS = 1000
#: Seconds that a measure is taken to cost at least: a job's time is not known more exactly.
LEAST_SECONDS = 0.005


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def n_chars_in_words(text: Column) -> Column:
    return F.length(F.translate(text, SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(text: Column) -> Column:
    return let(words(text), repeat_words)


def repeat_words(w: Column, window: int = 3) -> Column:
    """Of an array of words, those in windows of ``window`` words that are found twice or more in it, the first included.

    Windows are compared by 64-bit hashes. Only a text with a repeated hash has its windows sorted, as (hash, place)
    structs; neighbours with equal hashes give the repeated places, and the places' gaps give the words they cover.
    """
    def cover(places: Column) -> Column:
        gaps = F.zip_with(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(window)))
        return F.when(F.size(places) > 0, F.aggregate(gaps, F.lit(window), lambda s, x: s + x)).otherwise(F.lit(0))

    def repeated(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = lambda s: F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
        return let(pairs, lambda s: let(F.array_sort(places(s)), cover))

    starts = F.slice(w, 1, F.greatest(F.size(w) - (window - 1), F.lit(0)))
    hashes = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, window)]))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeated(h)).otherwise(F.lit(0))).cast("long")


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of its text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({"n_words": F.size(words(text)).cast("long"), "word_chars": n_chars_in_words(text), "n_symbols": n_symbols(text),
                           "n_dup_lines": n_dup_lines(text), "n_repeat_words": n_repeat_words(text)})


@dataclass(frozen=True)
class Rule:
    """A name, the measures it reads, and when it rejects."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]


#: The first two are the base. The others reject only what no clean text comes near.
RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: m["n_symbols"] * 2 > m["n_words"] * 3),
    Rule("duplicate_lines", ("n_words", "n_dup_lines"), lambda m: m["n_dup_lines"] * 10 > m["n_words"] * 3),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] > m["n_words"] * 20) | (m["word_chars"] < m["n_words"] * 2)),
)
BASE = ("few_words", "repeated_words")


def computed(w: Column, text: Column) -> dict[str, Column]:
    """All measures of a text, given its words."""
    return {"n_words": F.size(w).cast("long"), "word_chars": n_chars_in_words(text), "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text), "n_repeat_words": repeat_words(w)}


def seconds(sample: DataFrame, column: Column, times: int = 2) -> float:
    """The least time of a job that computes ``column`` over the sample and throws it away."""
    best = float("inf")
    for _ in range(times):
        began = time.perf_counter()
        sample.select(column.alias("x")).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    return best


def costs(sample: DataFrame, names: set[str], clock: Callable[[DataFrame, Column], float] = seconds) -> dict[str, float]:
    """Seconds of each measure over the sample (a column ``text``), beyond those of reading it; n_words has the cost of the words
    that others use too."""
    text = F.col("text")
    base = clock(sample, F.length(text))
    split = max(clock(sample, F.size(words(text))) - base, LEAST_SECONDS)
    measured = {k: clock(sample, let(words(text), repeat_words)) - split if k == "n_repeat_words" else clock(sample, computed(F.array(), text)[k]) for k in sorted(names - {"n_words"})}
    return {"n_words": split} | {k: max(v - base, LEAST_SECONDS) for k, v in measured.items()}


def order_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 5, work: Workspace | None = None,
                clock: Callable[[DataFrame, Column], float] = seconds) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share of what is left, seconds) in the order in which the rules run.

    The sample has about ``sample_rows`` rows, or all there are. What comes to the driver is the number of rows for each set of rules
    that reject, and the jobs' times. Rules that reject nothing come last, the cheapest first; without rows the given order stays.
    """
    work = work or Workspace(df.sparkSession, "quality")
    n_rows = df.count()
    if not n_rows:
        return [(r, 0.0, 0.0) for r in rules]
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    sample = work.keep(df.select(text).sample(False, min(1.0, sample_rows / n_rows), seed), "sample")
    cost = costs(sample, {k for r in rules for k in r.needs}, clock)
    flags = sample.select(let(words(F.col("text")), lambda w: F.struct(*[m.alias(k) for k, m in computed(w, F.col("text")).items()])).alias("m"))
    m = {k: F.col("m")[k] for k in flags.schema["m"].dataType.names}
    found = flags.select(*[r.rejects(m).alias(f"r{k}") for k, r in enumerate(rules)]).groupBy(*[f"r{k}" for k in range(len(rules))]).count().collect()
    out, known, rest = [], set(), list(range(len(rules)))
    while rest:
        left = [r for r in found if not any(r[k] for k in range(len(rules)) if k not in rest)]
        total = sum(r["count"] for r in left)
        share = {k: sum(r["count"] for r in left if r[k]) / max(total, 1) for k in rest}
        price = {k: sum(cost[x] for x in rules[k].needs if x not in known) or LEAST_SECONDS for k in rest}
        best = max(rest, key=lambda k: (share[k] / price[k], -price[k], -k))
        out.append((rules[best], share[best], price[best]))
        known |= set(rules[best].needs)
        rest.remove(best)
    work.drop("sample")
    return out


def verdict(order: list[Rule], m: dict[str, Column]) -> Column:
    """The name of the first rule in ``order`` that rejects a text of measures ``m``, null if none does; what only later rules need
    isn't computed then."""
    out = F.when(F.lit(False), F.lit(""))
    for r in order:
        out = out.when(r.rejects({k: m[k] for k in r.needs}), F.lit(r.name))
    return out


def cascade(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``df`` with ``rejected_by`` (null: kept). A null or empty text has no words, so few_words or an earlier rule rejects it.

    Other columns pass unchanged; a column named rejected_by is replaced. An empty table stays empty. A text is split into
    words once for all rules, as each needs their number.
    """
    order = [r for r, _, _ in order_rules(df, text_col, rules, sample_rows)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("rejected_by", let(words(text), lambda w: verdict(order, computed(w, text))))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, all measures, base_failed, kept, rejected_by): the cascade over measures that are reported anyway."""
    order = [r for r, _, _ in order_rules(df, text_col, rules, sample_rows)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = measures(df.select(F.col(id_col).alias("_id"), text.alias("_text")), "_text")
    m = {k: F.col(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    base = [r.rejects(m) for r in rules if r.name in BASE]
    rows = rows.withColumn("base_failed", F.coalesce(base[0] | base[1], F.lit(True))).withColumn("rejected_by", verdict(order, m))
    return rows.select(F.col("_id").alias(id_col), *m, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")

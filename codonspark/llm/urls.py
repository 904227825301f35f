"""URL filters with redirect equivalence.

A rule allows or blocks a host with its subdomains below a path; of the rules that fit a URL the longest decides. URLs that
no rule fits take part in redirect equivalence: redirects and canonical links make aliases of pages, connected components
over these links are the classes, and a class with a blocked URL is blocked, unless a URL of it is allowed by a rule: an
explicit allow comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, join_beside

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def fits(rule: Rule, h: Column, p: Column) -> Column:
    return ((h == rule.host) | h.endswith("." + rule.host)) & p.startswith(rule.path)


def by_rule(h: Column, p: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits. Of rules of one length the first listed decides."""
    name, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for r in sorted(rules, key=lambda r: -len(r.name)):
        name, verdict = name.when(fits(r, h, p), F.lit(r.name)), verdict.when(fits(r, h, p), F.lit(r.verdict))
    return name, verdict


def decoded(text: Column) -> Column:
    """``text`` with &amp; and numeric entities of Unicode characters replaced, each once."""
    entity = "&(?:[aA][mM][pP]|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"
    found = F.regexp_extract_all(text, F.lit(entity), F.lit(0))

    def letter(e: Column) -> Column:
        n = F.when(F.lower(F.substring(e, 3, 1)) == "x", F.conv(F.regexp_extract(e, "[xX]([^;]+)", 1), 16, 10)).otherwise(F.regexp_extract(e, "[0-9]+", 0)).try_cast("int")
        real = ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000))
        return F.when(F.lower(e) == "&amp;", "&").when(real, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(e)
    return F.array_join(F.transform(F.split(text, entity, -1), lambda g, k: F.concat(g, F.coalesce(letter(F.get(found, k)), F.lit("")))), "")


def without_dots(path: Column) -> Column:
    """A path from the root without its segments . and .. (which takes back the one before)."""
    parts = F.split(F.concat(path, F.when(F.regexp_like(path, F.lit(r"/\.\.?$")), "/").otherwise("")), "/", -1)
    step = lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def link_targets(html: Column) -> Column:
    """URLs that a page declares itself an alias of: canonical links and refreshes, as an array without repeats."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))
    href = lambda t: F.regexp_extract(t, r"""(?is)\shref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = lambda t: F.regexp_extract(t, r"""(?is)\scontent\s*=\s*["']?\s*\d+(?:\.\d*)?\s*;\s*url\s*=\s*['"]?([^"'\s>]+)""", 1)
    canonical = F.transform(F.filter(tags, lambda t: F.regexp_like(t, F.lit(r"""(?is)^<link.*\srel\s*=\s*["']?canonical\b"""))), href)
    moved = F.transform(F.filter(tags, lambda t: F.regexp_like(t, F.lit(r"""(?is)^<meta.*\shttp-equiv\s*=\s*["']?refresh\b"""))), refresh)
    return F.array_distinct(F.transform(F.filter(F.concat(canonical, moved), lambda u: u != ""), decoded))


def key(url: Column) -> Column:
    """What makes two URLs one node: scheme, fragment and the host's letter case don't count."""
    query = F.regexp_extract(url, r"\?[^#]*", 0)
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), F.when(path(url) == "", F.lit("/")).otherwise(path(url)), query)).otherwise(url)


def resolve(base: Column, target: Column) -> Column:
    """An absolute URL for a link's target: whole, without a scheme, from the host's root, beside the page, or a query or fragment of it."""
    scheme, root = F.regexp_extract(base, "^[^:/?#]*", 0), F.regexp_extract(base, "^[^:/?#]*://[^/?#]*", 0)
    folder = F.coalesce(F.nullif(F.regexp_extract(path(base), "^.*/", 0), F.lit("")), F.lit("/"))
    own, tail = F.regexp_extract(target, "^[^?#]*", 0), F.regexp_extract(target, "[?#].*", 0)
    rooted = lambda p: F.concat(root, without_dots(p), tail)
    return (F.when(F.regexp_like(target, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), rooted(own))
            .when(target.startswith("?"), F.concat(root, path(base), target)).when(target.startswith("#"), base).otherwise(rooted(F.concat(folder, own))))


def judge(pages: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          rules: tuple[Rule, ...] = RULES, default: str = "allow", work: Workspace | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, class_verdict) of every row.

    Links are those in the pages and those of ``redirects`` (source, target), whose URLs need not be pages. ``default`` is the
    verdict where neither a rule nor the class decides. Null or malformed URLs have empty host and path, fit no rule and
    have no class. Rows with one URL share its fate. Only URLs in a class (a page with links, or a target) are shuffled by
    class; most rows meet the classes in one join by the key of their URL.
    """
    work = work or Workspace(pages.sparkSession, "urls")
    h, p = host(F.col("url")), path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    links = rows.where(F.regexp_like("html", F.lit(r"(?i)canonical|refresh")) & (F.instr("url", "://") > 0))
    links = links.select("url", F.explode(link_targets(F.col("html"))).alias("target")).select(F.col("url"), resolve(F.col("url"), F.col("target")).alias("target"))
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col(redirects.columns[0]).alias("url"), F.col(redirects.columns[1]).alias("target")).where("url IS NOT NULL AND target IS NOT NULL"))
    links = work.keep(links.distinct(), "links")
    name, verdict = by_rule(host(F.col("url")), path(F.col("url")), rules)
    rows = rows.select("id", "url", h.alias("host"), p.alias("path"), key(F.col("url")).alias("node")).withColumn("rule", name).withColumn("own", verdict)
    if links.isEmpty():
        rows = rows.withColumn("class_verdict", F.lit(None).cast("string"))
    else:
        classes = components(links.select(key(F.col("url")).alias("a"), key(F.col("target")).alias("b")), work)
        ends = links.select("url").union(links.select("target")).distinct().withColumn("node", key(F.col("url"))).withColumn("own", by_rule(host(F.col("url")), path(F.col("url")), rules)[1])
        decided = ends.join(classes, "node").groupBy("root").agg(F.max((F.col("own") == "allow").cast("int")).alias("allowed"), F.max((F.col("own") == "block").cast("int")).alias("blocked"))
        decided = decided.select("root", F.when(F.col("allowed") == 1, F.lit("allow")).when(F.col("blocked") == 1, F.lit("block")).alias("class_verdict"))
        verdicts = work.keep(join_beside(classes, work.keep(decided, "decided"), "root").select("node", "class_verdict"), "verdicts")
        rows = join_beside(rows, verdicts, "node", "left")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("own", "class_verdict", F.lit(default)).alias("verdict"), "class_verdict")

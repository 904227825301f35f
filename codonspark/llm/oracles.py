"""DuckDB SQL of the operators' queries that SQL can express.

The URL filter's holds where pages link to no other, as in the driver's tables; the tests cover links by brute force.
"""

from __future__ import annotations

from . import licenses, secrets

_WORD = r"[^\x20\x09-\x0D]+"

QUALITY_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(len(ws) - 2)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) AS tri FROM w WHERE len(ws) > 2),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')))))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 2 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept
FROM m
"""

URL_SQL = """
WITH u AS (SELECT page_id, instr(coalesce(url, ''), '://') AS pos, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, CASE WHEN pos > 0 THEN translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict FROM p, rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id
"""


#: Base32 of a hex digest: five bits at a time from two hex digits.
_NIBBLE = "(instr('0123456789abcdef', substr(h, (5 * i // 4 + {})::INT, 1)) - 1)"
_B32 = f"list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_NIBBLE.format(1)} * 16 + {_NIBBLE.format(2)}) // (CASE 5 * i % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END) % 32 + 1)::INT, 1)), 'string_agg', '')"

WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html
"""

#: The templates as patterns over words with one blank between and around them.
TEMPLATE_PATTERNS = (
    ("apache-2.0", " licensed under the apache license "),
    ("cc-by-nc-4.0", " licensed under (a )?(the )?(creative commons )?cc by nc 4 0 "),
    ("cc-by-4.0", " licensed under (a )?(the )?(creative commons )?cc by 4 0 "),
    ("gpl-3.0", " this [^ ]+ ([^ ]+ )?is licensed under the gnu general public license version 3 "),
    ("mit", " released under the mit license "),
    ("mit", " permission is hereby granted free of charge to any person obtaining a copy of this software "),
    ("copyright", " copyright (c )?[^ ]+ ([^ ]+ )?(by )?[^ ]+ ([^ ]+ ){0,5}all rights reserved "),
)
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _places(phrase: str) -> str:
    tests = " AND ".join(f"ws[k + {i + 1}] = '{w}'" for i, w in enumerate(phrase.split()))
    return f"list_filter(range(len(ws)), lambda k: {tests})"


def _joined(labels: str) -> str:
    return f"coalesce(list_aggregate(list_sort(list_distinct(list_filter({labels}, lambda v: v IS NOT NULL))), 'string_agg', ','), '')"


_HELD = [f"contains(j, ' {phrase} ')" for phrase, _ in licenses.PHRASES]
_BASE_LABELS = "[" + ", ".join(f"CASE WHEN {held} THEN '{label}' END" for held, (_, label) in zip(_HELD, licenses.PHRASES, strict=True)) + "]"
_MORE_LABELS = "[" + ", ".join(f"CASE WHEN regexp_matches(j, '{pattern}') THEN '{label}' END" for label, pattern in TEMPLATE_PATTERNS) + "]"
LICENSE_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, concat(' ', coalesce(list_aggregate(ws, 'string_agg', ' '), ''), ' ') AS j FROM w),
m AS (SELECT doc_id, len(ws) AS n, j, CASE WHEN {' OR '.join(_HELD)} THEN {' || '.join(_places(p) for p, _ in licenses.PHRASES)} ELSE [] END AS places, {_MORE_LABELS} AS more FROM p)
SELECT doc_id, n::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word, {_joined(_BASE_LABELS)} AS base_labels, {_joined(_BASE_LABELS + ' || more')} AS labels,
  CASE WHEN len(list_filter(more, lambda v: v IS NOT NULL)) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END AS score
FROM m
"""


def _any_case(text: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)


#: RE2 folds more letters than ASCII's, so both cases are written out; a quote is doubled within SQL.
_KEYS = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
_ASSIGN = f"({_KEYS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_SECRETS = (("assign", _ASSIGN, 2, 8), *((p.kind, p.regex, 0, 0) for p in secrets.PATTERNS[1:]))


def _spans(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    gaps, whole, held = f"string_split_regex(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}', {group})"
    before = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)"
    matches = f"SELECT doc_id, g, w, unnest(range(1, len(w) + 1)) AS i, unnest(h) AS held FROM (SELECT doc_id, {gaps} AS g, {whole} AS w, {held} AS h FROM d WHERE regexp_matches(t, '{pattern}'))"
    return f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start, start + length(own) AS stop FROM (SELECT doc_id, w[i] AS own, held, ({before})::BIGINT AS start FROM ({matches})) WHERE length(held) >= {least}"


def _listing(test: str) -> str:
    return f"coalesce(string_agg(concat(kind, ':', start::VARCHAR, ':', stop::VARCHAR), ',' ORDER BY start, rank) FILTER ({test}), '')"


SECRET_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(_spans(*x, k) for k, x in enumerate(_SECRETS))})
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256({_listing('rank < 3')}) AS base_sha256, {_listing('kind IS NOT NULL')} AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""

_MIX_NUMBER = "('0x' || substr({}, 1, 15))::BIGINT"
_MIX_OVERLAP = "greatest(least(start + size, {1}) - greatest(start, {0}), 0)"
#: Seats are listed one by one here, and dealt by their quotients.
MIXING_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE concat('a', source) END AS key, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
  md5(concat_ws('/', '17', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))) AS mark FROM documents),
e AS (SELECT *, ({_MIX_NUMBER.format('mark')} % 4096)::INT AS bucket FROM d), g AS (SELECT *, bucket % 8 AS shard FROM e),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT] AS weight, (sum(source_size) OVER ())::BIGINT AS total,
  coalesce(min(CASE WHEN source_size > 0 THEN source_size END) OVER (), 1)::BIGINT AS smallest, source_size * 2.0::DOUBLE AS cap FROM s),
v AS (SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM w),
l AS (SELECT *, max(CASE WHEN own <= cap / weight THEN own END) OVER () AS level FROM v),
t AS (SELECT key, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target, greatest(1, least(512, smallest // 128))::BIGINT AS block FROM l),
n AS (SELECT g.key, shard, sum(size)::BIGINT AS words, any_value(source_size) AS source_size, any_value(target) AS target, any_value(block) AS block, ceil(sum(size) / any_value(block))::BIGINT AS blocks FROM g JOIN t ON g.key = t.key GROUP BY g.key, shard),
a AS (SELECT key, sum(blocks)::BIGINT AS blocks, CASE WHEN any_value(source_size) > 0 THEN any_value(target) * sum(blocks)::BIGINT / any_value(source_size) ELSE 0.0 END AS due FROM n GROUP BY key),
p AS (SELECT key, count(*) AS seats FROM (SELECT key, row_number() OVER (ORDER BY due / (2 * k - 1) DESC, key, k) AS place, floor((SELECT sum(due ORDER BY key) FROM a) + 0.5) AS house FROM (SELECT *, unnest(range(1, 2 * blocks + 1)) AS k FROM a WHERE due > 0)) WHERE place <= house GROUP BY key),
q AS (SELECT key, shard, count(*) AS seats FROM (SELECT x.key, shard, seats, row_number() OVER (PARTITION BY x.key ORDER BY blocks / (2 * k - 1) DESC, shard, k) AS place FROM (SELECT *, unnest(range(1, 2 * blocks + 1)) AS k FROM n) x JOIN p ON x.key = p.key) WHERE place <= seats GROUP BY key, shard),
r AS (SELECT n.*, coalesce(seats, 0)::BIGINT AS seats, CASE WHEN blocks > 0 THEN {_MIX_NUMBER.format("md5(concat_ws('/', '17', n.shard::VARCHAR, n.key))")} % blocks ELSE 0 END AS first FROM n LEFT JOIN q ON n.key = q.key AND n.shard = q.shard),
c AS (SELECT *, CASE WHEN blocks > 0 THEN seats // blocks ELSE 0 END AS whole FROM r), x AS (SELECT *, seats - whole * blocks AS extra FROM c),
o AS (SELECT g.doc_id, g.key, g.shard, g.size, coalesce(sum(size) OVER (PARTITION BY key, shard ORDER BY bucket, mark, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM g)
SELECT doc_id, size, source_size, target, (whole * size + {_MIX_OVERLAP.format('0', 'greatest(first + extra - blocks, 0) * block')} + {_MIX_OVERLAP.format('first * block', 'least((first + extra) * block, words)')})::BIGINT AS taken
FROM o JOIN x ON o.key = x.key AND o.shard = x.shard
"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Every kept term beside every source, and every pair of sources beside every term: the operator's sums without its short cuts.
DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '{_TERM}') AS ws FROM documents),
c AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY r, lang, source, term),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING count(*) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS held FROM k GROUP BY lang),
n AS (SELECT c.lang, c.source, c.term, sum(c.n)::HUGEINT AS n FROM c JOIN k ON c.lang = k.lang AND c.term = k.term GROUP BY c.lang, c.source, c.term),
t AS (SELECT lang, source, sum(n)::HUGEINT AS held FROM n GROUP BY lang, source),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 1) // (coalesce(t.held, 0) + v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (v.held + v.v) AS q
  FROM g JOIN v ON g.lang = v.lang JOIN k ON g.lang = k.lang LEFT JOIN t ON g.lang = t.lang AND g.source = t.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 200
"""

#: States of the form (s?(ua)+)?: where each output letter leads, and the inserts that complete it.
_FORM = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
_TO_END = "('E', 0, ''), ('A', 0, ''), ('U', 3, 'I'), ('S', 6, 'II')"


def _edits() -> str:
    """VALUES of (state, letter, next, cost, edits): up to two inserts, then the row's own edit."""
    out = []
    for state in "ESUA":
        before = [(state, 0, "")]
        for _ in range(2):
            at, cost, edits = before[-1]
            before.append((_FORM.get((at, "u")) or _FORM[at, "a"], cost + 3, edits + "I"))
        for letter in ["d", *"suao", *"SUAO"]:
            more = 3 * letter.isupper()
            for at, cost, edits in before:
                out.append((state, letter, at, cost + 4, edits + "D"))
                if letter != "d" and (at, letter.lower()) in _FORM:
                    out.append((state, letter, _FORM[at, letter.lower()], cost + more, edits + "K"))
                if letter != "d":
                    out += [(state, letter, to, cost + 3 + more, edits + "R") for (x, role), to in _FORM.items() if x == at and role != "s"]
    return ", ".join(map(str, out))


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"
_DAMAGE = _CRC.format("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")
REPAIR_SQL = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_DAMAGE} % 20 AS kind FROM conversations),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, CASE WHEN kind = 3 THEN 2 ELSE 1 END AS copies FROM o WHERE kind <> 0),
n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM (SELECT *, unnest(range(copies)) AS copy FROM m)),
x AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '{_WORD}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM n),
r AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END) WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS letter,
  CASE WHEN i > 1 AND concat(lag(initial) OVER (PARTITION BY conv_id ORDER BY i), initial) NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM x),
c AS (SELECT DISTINCT conv_id FROM conversations),
moves(state, letter, next, cost, edits) AS (VALUES {_edits()}),
dp(conv_id, i, state, cost, audit) AS (SELECT conv_id, 0::BIGINT, 'E', 0, '' FROM c UNION ALL
  SELECT conv_id, i, state, best.c, best.a FROM (SELECT dp.conv_id, r.i, moves.next AS state, min({{'c': dp.cost + moves.cost, 'a': dp.audit || moves.edits}}) AS best
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN moves ON moves.state = dp.state AND moves.letter = r.letter GROUP BY dp.conv_id, r.i, moves.next)),
s AS (SELECT c.conv_id, coalesce(max(r.i), 0) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, coalesce(sum(illegal), 0)::BIGINT AS illegal
  FROM c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
e AS (SELECT s.conv_id, min({{'c': dp.cost + z.cost, 'a': dp.audit || z.edits}}) AS best FROM s JOIN dp ON dp.conv_id IS NOT DISTINCT FROM s.conv_id AND dp.i = s.rows JOIN (VALUES {_TO_END}) z(state, cost, edits) ON z.state = dp.state GROUP BY s.conv_id),
h AS (SELECT conv_id, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS pos FROM e),
w AS (SELECT h.conv_id, pos, audit[pos] AS edit, length(replace(audit[:pos], 'I', '')) AS i FROM h),
y AS (SELECT w.conv_id, pos, edit, r.role, r.text, row_number() OVER (PARTITION BY w.conv_id ORDER BY pos) - CASE WHEN first_value(edit = 'K' AND r.initial = 's') OVER (PARTITION BY w.conv_id ORDER BY pos) THEN 1 ELSE 0 END AS place
  FROM w LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i WHERE edit <> 'D'),
t AS (SELECT conv_id, string_agg(concat(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN edit <> 'I' THEN text END), chr(10) ORDER BY pos) AS whole FROM y GROUP BY conv_id)
SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM s JOIN e ON e.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM s.conv_id
"""

SQL = {"op7_mixing": MIXING_SQL, "op4_warc": WARC_SQL, "op5_url_filter": URL_SQL, "op6_licenses": LICENSE_SQL, "op8_quality": QUALITY_SQL, "op9_secrets": SECRET_SQL, "op11_divergence": DIVERGENCE_SQL,
       "op13_repair": REPAIR_SQL}

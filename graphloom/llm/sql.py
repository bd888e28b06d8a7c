"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from . import lines, mixing

SEP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def _lines(source: str) -> str:
    """Common table expressions: rows d, and what is removed from each host and text."""
    return rf"""
d AS (SELECT row_number() OVER () AS rid, *, coalesce('s' || source, 'n') AS host FROM ({source})),
texts AS (SELECT DISTINCT host, text FROM d),
lines AS (
  SELECT host, text, lower(trim(regexp_replace(l, '{SEP}', ' ', 'g'))) AS line, len(regexp_extract_all(l, '{WORD}')) AS n
  FROM (SELECT host, text, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM texts)),
occ AS (SELECT host, text, line, count(*) AS times, sum(n) AS words FROM lines WHERE line <> '' GROUP BY ALL),
totals AS (SELECT host, count(*) AS total FROM texts GROUP BY host)"""


def _gone(min_documents: int, share: float) -> str:
    return f"""
freq AS (SELECT o.host, o.line FROM occ o JOIN totals t ON o.host = t.host
  GROUP BY o.host, o.line, t.total HAVING count(*) > {min_documents} AND count(*) > {share} * t.total),
gone AS (SELECT o.host, o.text, list(o.line) AS gone, sum(o.times)::BIGINT AS gone_lines, sum(o.words)::BIGINT AS gone_words
  FROM occ o JOIN freq f ON o.host = f.host AND o.line = f.line GROUP BY o.host, o.text)"""


OP2 = rf"""
WITH {_lines("SELECT doc_id, text, source FROM documents")},
{_gone(lines.LIMIT_DOCUMENTS, lines.LIMIT_SHARE)},
w AS (SELECT rid, doc_id, host, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lw FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 5) t(k) GROUP BY rid),
f AS (SELECT w.rid, doc_id, host, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lw) - len(list_distinct(lw)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.rid = cov.rid),
b AS (SELECT f.*, (n_words < {lines.MIN_WORDS} OR 100 * n_repeat_words > {lines.REPEAT_PERCENT} * n_words) AS base_failed,
  coalesce(g.gone_lines, 0) AS n_removed_lines, n_words - coalesce(g.gone_words, 0) AS n_left_words
  FROM f LEFT JOIN gone g ON f.host = g.host AND f.text IS NOT DISTINCT FROM g.text)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND n_left_words >= {lines.MIN_WORDS} AND n_left_words >= {lines.MIN_LEFT} * n_words) AS kept,
  n_removed_lines, n_left_words FROM b
"""

OP6 = rf"""
WITH {_lines("SELECT doc_id, source, text FROM documents")},
{_gone(lines.RATIO_MIN_PAGES, lines.BOILERPLATE_RATIO)}
SELECT d.doc_id, d.source,
  CASE WHEN d.text IS NULL OR g.gone IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)),
    lambda l: NOT list_contains(g.gone, lower(trim(regexp_replace(l, '{SEP}', ' ', 'g'))))), chr(10)) END AS text,
  len(list_filter(string_split(coalesce(d.text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
  coalesce(g.gone_lines, 0) AS n_dropped
FROM d LEFT JOIN gone g ON d.host = g.host AND d.text IS NOT DISTINCT FROM g.text
"""

_W = ", ".join(map(str, mixing.WEIGHTS))
_B = mixing.BLOCK
OP7 = rf"""
WITH sized AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, 'n') AS host, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s0 AS (SELECT host, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, ([{_W}])[(rank - 1) % {len(mixing.WEIGHTS)} + 1] AS weight, source_size * {mixing.CAP} AS cap FROM s1),
s3 AS (SELECT *, (CAST({mixing.SHARE} AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM s2 WINDOW before AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, least(cap::DOUBLE, max(level) OVER () * weight) AS target, ceil(source_size::DOUBLE / {_B})::BIGINT AS blocks FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target * blocks / source_size + 0.5) ELSE 0 END::BIGINT AS draws FROM s4),
per AS (SELECT *, coalesce(sum(draws) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM s5),
n AS (SELECT sum(draws)::BIGINT AS n, greatest(1, floor(sum(draws)::BIGINT * {mixing.GOLDEN}::DOUBLE))::BIGINT AS a FROM per),
step AS (SELECT n, min(a + k) AS a FROM n, range(0, 2000) t(k) WHERE gcd(a + k, n) = 1 GROUP BY n),
slots AS (SELECT k, (k * a) % n AS p FROM step, unnest(range(0, n)) t(k)),
turns AS (SELECT per.host, blocks, row_number() OVER (PARTITION BY per.host ORDER BY k) - 1 AS turn FROM slots JOIN per ON p >= first AND p < first + draws),
uses AS (SELECT host, turn % blocks AS block, count(*) AS uses FROM turns GROUP BY ALL),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY host ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM sized),
parts AS (SELECT rid, host, size, pos, unnest(range(pos // {_B}, (pos + size - 1) // {_B} + 1)) AS block FROM placed WHERE size > 0),
took AS (SELECT rid, sum((least(pos + size, (parts.block + 1) * {_B}) - greatest(pos, parts.block * {_B})) * uses)::BIGINT AS taken
  FROM parts JOIN uses ON parts.host = uses.host AND parts.block = uses.block GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken
FROM placed JOIN per ON placed.host = per.host LEFT JOIN took ON placed.rid = took.rid
"""

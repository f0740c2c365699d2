"""DuckDB SQL for the queries of this subpackage that SQL can express at test size, written apart from the Spark plans."""

from __future__ import annotations

from .chat import PROBE_ID, PROBE_TEXT
from .minhash import PERCENT, SHINGLE
from .quality import MAX_HOST_RATE, MAX_REPEAT_PERCENT, MIN_WORDS
from .suffix_dedup import LENGTH, SHORT

WORD = r"'[^\x20\x09-\x0D]+'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _escaped_length(c: str) -> str:
    return f"2 * length({c}) - length(regexp_replace({c}, '[\\\\<>]', '', 'g'))"


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES ({PROBE_ID}, 0, 'user', {_q(PROBE_TEXT)}), ({PROBE_ID}, 1, 'assistant', {_q(PROBE_TEXT)})))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({_escaped_length('role')} + {_escaped_length('text')} + {len('<turn >') + len('</turn>') + 1})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS a FROM (SELECT r, regexp_extract_all(text, {WORD}) AS ws FROM d)),
g AS (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS t(k) WHERE n > 1 GROUP BY r),
words AS (SELECT r, count(*) AS n FROM w GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {WORD}) GROUP BY r),
m AS (
  SELECT d.r, doc_id, source, coalesce(words.n, 0)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
mo AS (SELECT avg(f / n) AS mean, coalesce(var_pop(f / n), 0) AS v, avg(1 / n) AS inv FROM h),
prior AS (SELECT mean, greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, 1e-6) - 1, 1) AS s FROM mo),
bad AS (SELECT source FROM h, prior WHERE (f + mean * s) / (n + s) > {MAX_HOST_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.source IS NULL AS kept
FROM b LEFT JOIN bad ON b.source = bad.source
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS w FROM documents),
s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) < {SHINGLE} THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '')
    ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS sh FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_in AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.r < y.r GROUP BY x.r, y.r),
l AS (SELECT a, b FROM both_in JOIN n AS na ON na.r = a JOIN n AS nb ON nb.r = b WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
comp AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN comp ON comp.a = d.r LEFT JOIN n ON n.r = d.r
"""

def _covered(name: str, length: int) -> str:
    """name(rid, x, z): maximal runs of bytes that strings of that length cover which start in two places; texts are in hexadecimal, in blocks."""
    return f"""{name}_m AS (SELECT rid, i, md5(substr(y, 2 * (i - o) + 1, {2 * length})) AS m FROM
 (SELECT rid, n, y, o, unnest(range(o, least(o + 2048, n - {length - 1}))) AS i FROM blocks WHERE o < n - {length - 1})),
{name}_r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY m) AS c FROM {name}_m) WHERE c > 1),
{name} AS (SELECT rid, min(i) AS x, max(i) + {length} AS z FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS g
 FROM (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {length} THEN 0 ELSE 1 END AS fresh FROM {name}_r)) GROUP BY rid, g)"""


SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT rid, doc_id, h, length(h) // 2 AS n FROM d),
blocks AS (SELECT rid, n, o, substr(h, 2 * o + 1, {2 * (2048 + LENGTH)}) AS y FROM (SELECT rid, h, n, unnest(range(0, n, 2048)) AS o FROM bytes)),
{_covered('gone', LENGTH)},
{_covered('twice', SHORT)},
edges AS (SELECT rid, x, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY x), 0) AS a FROM gone
 UNION ALL SELECT b.rid, b.n, b.n, coalesce((SELECT max(z) FROM gone g WHERE g.rid = b.rid), 0) FROM bytes b),
kept AS (SELECT rid, string_agg(substr(h, 2 * a + 1, 2 * (x - a)), '' ORDER BY a, x) AS k FROM edges JOIN bytes USING (rid) GROUP BY rid),
g AS (SELECT rid, sum(z - x)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(x || ':' || z, ',' ORDER BY x) AS spans FROM gone GROUP BY rid),
t AS (SELECT rid, sum(z - x)::BIGINT AS n_repeated FROM twice GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256,
 coalesce(spans, '') AS spans, coalesce(n_repeated, 0) AS n_repeated
FROM bytes LEFT JOIN kept USING (rid) LEFT JOIN g USING (rid) LEFT JOIN t USING (rid)"""

SQL: dict[str, str] = {"op1_suffix_dedup": SUBSTRINGS, "op2_chat_format": CHAT, "op6_quality_rules": QUALITY, "op7_minhash_dedup": NEAR}

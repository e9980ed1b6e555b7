"""DuckDB SQL of the operators that SQL can express. doc_id and page_id are taken to be unique."""

from __future__ import annotations

from .line_dedup import MIN_WORDS
from .quality_rules import BASE_BITS, POLICIES, POLICY, RULES
from .url_filters import DEVIATIONS, SUFFIXES, THRESHOLD
from .url_filters import RULES as URL_RULES

_SPACE = r"[\x20\x09-\x0D]"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACE}+'), lambda x: x <> '')"


QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_words("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_TRIM}) <> '') AS ls FROM d),
each AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
grams AS (SELECT doc_id, i, a, lead(a, 1) OVER s AS b, lead(a, 2) OVER s AS c FROM each WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM grams WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
j AS (SELECT *, CAST({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {BASE_BITS} <> 0 AS base_failed, fail_bits & {POLICIES[POLICY] | BASE_BITS} = 0 AS kept, fail_bits, '{POLICY}' AS policy FROM j
"""

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
each AS (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) - 1 AS line FROM split),
l AS (SELECT doc_id, line, trim(x, {_TRIM}) AS x, len({_words("x")}) AS words FROM each),
p AS (SELECT doc_id, line, x, words, sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS e FROM l WHERE words > 0),
g AS (SELECT doc_id, line, list(x) OVER r AS rx, max(line) OVER r AS r_last, sum(words) OVER r AS rw, list(x) OVER f AS fx, min(line) OVER f AS f_first, sum(words) OVER f AS fw FROM p
  WINDOW r AS (PARTITION BY doc_id ORDER BY e - words RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING), f AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
w AS (SELECT doc_id, line AS a, r_last AS z, rx AS content FROM g WHERE rw >= {MIN_WORDS} UNION SELECT doc_id, f_first, line, fx FROM g WHERE fw >= {MIN_WORDS}),
seen AS (SELECT content, min({{'d': doc_id, 'a': a}}) AS first_at FROM w GROUP BY content HAVING count(*) > 1),
met AS (SELECT w.doc_id, unnest(range(a, z + 1)) AS line, {{'d': w.doc_id, 'a': a}} > first_at AS again FROM w JOIN seen USING (content)),
gone AS (SELECT doc_id, line FROM met GROUP BY doc_id, line HAVING bool_and(again)),
kept AS (SELECT each.doc_id, coalesce(string_agg(x, chr(10) ORDER BY each.line) FILTER (gone.line IS NULL), '') AS text, count(gone.line) AS n_deleted FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.line = gone.line GROUP BY each.doc_id)
SELECT d.doc_id, kept.text, coalesce(n_deleted, 0) AS n_deleted FROM documents d LEFT JOIN kept USING (doc_id)
"""

_HOST = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2)"
_LAST = "array_to_string(list_slice(ls, -{0}, -1), '.')"
_TWO = ", ".join(f"'{s}'" for s in SUFFIXES)


def _rule(what: int) -> str:
    by_length = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[what]}'" for v, h, p in by_length) + " END"


def _strength(rows: str) -> str:
    return f"""(SELECT 1 / least(greatest(coalesce(CASE WHEN sum(n) - sum(n * n) / sum(n) <> 0 THEN (sum(n * (bad / n - above) ** 2 / greatest(above * (1 - above), 1e-6)) - count(*)) / (sum(n) - sum(n * n) / sum(n)) END, 0.02), 0.005), 0.9) - 1
      FROM {rows} WHERE n > 0)"""


URL_FILTERS = f"""
WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
label AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
o AS (SELECT host, bad FROM u JOIN label ON label.doc_id = TRY_CAST(nullif(regexp_extract(path, '^/[^/]+/([0-9]{{1,18}})([^0-9]|$)', 1), '') AS BIGINT)),
h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM (SELECT * FROM o UNION ALL SELECT DISTINCT host, NULL::INTEGER FROM u) GROUP BY host),
h1 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM h0), h2 AS (SELECT *, string_split(bare, '.') AS ls FROM h1),
h3 AS (SELECT *, len(ls) < 2 OR regexp_matches(bare, '^[0-9.]*$|^\\[') AS plain, {_LAST.format(2)} IN ({_TWO}) AND len(ls) > 2 AS two FROM h2),
h AS (SELECT host, n, bad, CASE WHEN plain THEN bare WHEN two THEN {_LAST.format(3)} ELSE {_LAST.format(2)} END AS domain, CASE WHEN plain THEN '' WHEN two THEN {_LAST.format(2)} ELSE {_LAST.format(1)} END AS suffix FROM h3),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM h) AS above FROM h GROUP BY suffix), sm AS (SELECT suffix, (bad + above * m) / (n + m) AS above FROM s, (SELECT {_strength("s")} AS m)),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(sm.above) AS above FROM h JOIN sm USING (suffix) GROUP BY suffix, domain), dm AS (SELECT domain, (bad + above * m) / (n + m) AS above FROM d, (SELECT {_strength("d")} AS m)),
k AS (SELECT h.host, h.n, h.bad, dm.above FROM h JOIN dm USING (domain)), q AS (SELECT host, n, bad + above * m AS a, n - bad + (1 - above) * m AS b FROM k, (SELECT {_strength("k")} AS m)),
v AS (SELECT host, CAST(n AS BIGINT) AS labelled, a / (a + b) - {DEVIATIONS} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS lower FROM q)
SELECT page_id, u.host, path, {_rule(0).replace("host", "u.host")} AS rule, coalesce({_rule(1).replace("host", "u.host")}, CASE WHEN lower > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, labelled FROM u JOIN v ON u.host = v.host
"""

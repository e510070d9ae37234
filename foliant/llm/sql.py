"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from foliant.llm import rules, secrets, sharding, topk

_DOCS = "SELECT doc_id, source, coalesce(text, '') AS text FROM documents"


_WORD = r"[^\x20\x09-\x0D]+"

OP9 = rf"""
WITH d AS ({_DOCS}),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) - {rules.WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {rules.WINDOW}),
g AS (SELECT doc_id, i, list_aggregate(ws[i:i + {rules.WINDOW - 1}], 'string_agg', ' ') AS win FROM p),
t AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k.k) AS n FROM t, (SELECT unnest(range({rules.WINDOW})) AS k) AS k GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM w),
s AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
  FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (
  SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed,
    n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words OR 100 * n_symbols > {rules.MOST_SYMBOLS} * n_words OR 100 * n_dup_lines > {rules.MOST_DUP_LINES} * n_lines AS failed
  FROM s),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(failed AS INT)) AS DOUBLE) AS k FROM f GROUP BY source),
m AS (SELECT greatest(least(sum(k) / sum(n), 1 - 1e-6), 1e-6) AS mean, sum(n) AS n, count(*) AS hosts, sum(n) - sum(n * n) / sum(n) AS weight FROM h),
v AS (SELECT mean, CASE WHEN weight > 0 THEN (sum(h.n * pow(h.k / h.n - mean, 2)) - mean * (1 - mean) * hosts * (1 - 1 / greatest(m.n, 1))) / weight ELSE 0 END AS between_ FROM h, m GROUP BY mean, hosts, m.n, weight),
b AS (SELECT mean, least(greatest(CASE WHEN between_ > 0 THEN mean * (1 - mean) / between_ - 1 ELSE {rules.MOST_WEIGHT} END, {rules.LEAST_WEIGHT}), {rules.MOST_WEIGHT}) AS total FROM v)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (h.k + mean * total) / (h.n + total) <= least(mean + greatest({rules.HOST_DEVIATIONS} * sqrt(mean * (1 - mean) / (total + 1)), {rules.HOST_STEP} * (1 - mean)), {rules.HOST_MOST}) AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, b
"""

_ASSIGN = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: int, pattern: str, group: int = 0, least: int = 0) -> str:
    """(doc_id, kind, a, b, s) of a pattern's matches: running lengths of what stands between them and of themselves."""
    return rf"""
  SELECT doc_id, {kind} AS kind, CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS a,
    length(ms[i]) AS n, ms[i] AS s
  FROM (SELECT doc_id, ms, gs, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS ms, regexp_extract_all(text, '{pattern}', {group}) AS gs, string_split_regex(text, '{pattern}') AS gaps FROM d))
  WHERE length(gs[i]) >= {least}"""


def _op7() -> str:
    kinds = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    allowed = " OR ".join(f"contains(lower(s), '{w}')" for w in secrets.ALLOWED)
    w = secrets.WINDOW
    limits = " ".join(f"WHEN {secrets.KINDS.index(k)} THEN {least}" for k, (_, least) in secrets.CLASSES.items())
    shown = f"{kinds}[kind + 1] || ':' || a || ':' || (a + n)"
    return rf"""
WITH d AS ({_DOCS}),
base AS ({_matches(0, _ASSIGN, 2, secrets.ASSIGN_LEAST)} UNION ALL {_matches(1, 'AKIA[A-Z0-9]+', 0, 20)} UNION ALL {_matches(2, '[0-9a-f]+', 0, 24)}),
runs AS ({_matches(0, secrets.CANDIDATE)}),
starts AS (
  SELECT doc_id, a AS ra, a + n AS re, s, a AS p FROM runs
  UNION SELECT r.doc_id, r.a, r.a + r.n, r.s, CAST(b.a + b.n AS INTEGER) FROM runs r JOIN base b ON b.doc_id = r.doc_id AND b.a < r.a + r.n AND r.a < b.a + b.n AND b.a + b.n < r.a + r.n),
free AS (SELECT * FROM starts t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.a <= t.p AND t.p < b.a + b.n)),
ends AS (SELECT f.doc_id, f.ra, f.re, f.s, f.p, min(b.a) AS e FROM free f LEFT JOIN base b ON b.doc_id = f.doc_id AND b.a > f.p AND b.a < f.re GROUP BY ALL),
piece AS (SELECT doc_id, p AS a, substr(s, p - ra + 1, coalesce(e, re) - p) AS s FROM ends),
cand AS (
  SELECT doc_id, a, s, CASE WHEN regexp_full_match(s, '[0-9a-fA-F]+') THEN 3 ELSE 4 END AS kind
  FROM piece WHERE length(s) >= {secrets.CANDIDATE_LEAST} AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]')),
win AS (SELECT doc_id, a, kind, s, unnest(range(0, length(s) - {w - 1})) AS i FROM cand),
hot AS (SELECT doc_id, a, kind, s, min(i) AS lo, max(i) + {w} AS hi FROM win WHERE list_aggregate(string_split(substr(s, i + 1, {w}), ''), 'entropy') >= CASE kind {limits} END GROUP BY doc_id, a, kind, s),
cut AS (SELECT doc_id, kind, CAST(a + lo AS INTEGER) AS a, hi - lo AS n, substr(s, lo + 1, hi - lo) AS s FROM hot),
added AS (
  SELECT cut.* FROM cut
  WHERE NOT ({allowed})),
both_ AS (SELECT doc_id, kind, a, n FROM base UNION ALL SELECT doc_id, kind, a, n FROM added),
bl AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, string_agg({shown}, ',' ORDER BY a, kind) AS l FROM base GROUP BY doc_id),
al AS (SELECT doc_id, string_agg({shown}, ',' ORDER BY a, kind) AS l FROM both_ GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(bl.l, '')) AS base_sha256, coalesce(al.l, '') AS spans
FROM d LEFT JOIN bl ON d.doc_id = bl.doc_id LEFT JOIN al ON d.doc_id = al.doc_id
"""


SQL = {"op2_sharding": sharding.OP2_SQL, "op7_secret_scans": _op7(), "op8_exact_top_k": topk.OP8_SQL, "op9_quality_rules": OP9}

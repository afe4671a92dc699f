"""SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from .url_reputation import LIFT, MOST, RULES, SECOND, STRENGTH, Z

_rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))


def _case(result: int | None) -> str:
    whens = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%' THEN '{(h + p) if result is None else v}'" for h, p, v in _rules)
    return f"CASE {whens} END"


def _strength(mean: str) -> str:
    return f"LEAST(GREATEST({mean} * (1 - {mean}) / GREATEST(q - {mean} * {mean} - k * {mean} * (1 - {mean}) / t, 1e-6) - 1, {STRENGTH[0]}), {STRENGTH[1]})"


def _moments(level: str) -> str:
    return f"""
  SELECT m, {_strength('m')} AS strength FROM (
    SELECT COALESCE((SUM(bad) + 0.5) / (SUM(n) + 1.0), 0.5) AS m, COALESCE(SUM(bad * bad / n) / GREATEST(SUM(n), 1.0), 0.0) AS q, COUNT(*) AS k, COALESCE(GREATEST(SUM(n), 1.0), 1.0) AS t FROM {level})"""


_BARE = "regexp_replace(host, ':[0-9]*$', '')"
_ADDRESS = f"(regexp_matches({_BARE}, '^[0-9]+([.][0-9]+){{3}}$') OR starts_with({_BARE}, '['))"
_DOUBLE = f"regexp_matches({_BARE}, '(^|[.])({'|'.join(SECOND)})[.][a-z]{{2}}$')"


def _last(labels: int) -> str:
    return f"regexp_extract({_BARE}, '((?:[^.]*[.]){{0,{labels - 1}}}[^.]*)$', 1)"


OP3 = f"""
WITH cut AS (
  SELECT page_id, regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^([^?#]*)', 1) AS rest FROM pages),
seen AS (
  SELECT page_id, translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE COALESCE(rest, '') END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut),
keyed AS (
  SELECT *, CASE WHEN {_ADDRESS} THEN {_BARE} WHEN {_DOUBLE} THEN {_last(3)} ELSE {_last(2)} END AS domain, CASE WHEN {_ADDRESS} THEN {_BARE} WHEN {_DOUBLE} THEN {_last(2)} ELSE {_last(1)} END AS suffix,
         TRY_CAST(NULLIF(regexp_extract(path, '/([0-9]{{1,18}})([.]html)?/?$', 1), '') AS BIGINT) AS key FROM seen),
outcome AS (
  SELECT doc_id AS key, MAX(CASE WHEN quality = 0 OR toxic = 1 THEN 1.0 ELSE 0.0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, domain, suffix, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(bad) AS DOUBLE) AS bad FROM keyed JOIN outcome USING (key) WHERE host <> '' GROUP BY host, domain, suffix),
domains AS (SELECT domain, suffix, SUM(n) AS n, SUM(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, SUM(n) AS n, SUM(bad) AS bad FROM hosts GROUP BY suffix),
hm AS ({_moments('hosts')}), dm AS ({_moments('domains')}), sm AS ({_moments('suffixes')}),
s AS (SELECT suffix, (bad + strength * m) / (n + strength) AS s_mean, n + strength AS s_k FROM suffixes, sm),
d AS (SELECT domain, suffix, (bad + strength * s_mean) / (n + strength) AS d_mean, n + strength AS d_k FROM domains JOIN s USING (suffix), dm),
h AS (SELECT host, (bad + strength * d_mean) / (n + strength) AS h_mean, n + strength AS h_k FROM hosts JOIN d USING (domain, suffix), hm),
rated AS (
  SELECT page_id, keyed.host, path, COALESCE(h_mean, d_mean, s_mean, m) AS mean, COALESCE(h_k, d_k, s_k, strength) AS k, m
  FROM keyed LEFT JOIN h ON keyed.host = h.host LEFT JOIN d ON keyed.domain = d.domain LEFT JOIN s ON keyed.suffix = s.suffix, sm)
SELECT page_id, host, path, {_case(None)} AS rule,
       COALESCE({_case(1)}, CASE WHEN mean - {Z} * sqrt(mean * (1 - mean) / (k + 1)) > LEAST({MOST}, {LIFT} * m) THEN 'block' ELSE 'allow' END) AS verdict
FROM rated
"""

def _share(n: str, total: str, terms: str) -> str:
    return f"1 + (1000000000::HUGEINT * ({n} + 2)) // GREATEST({total}::HUGEINT + 2 * {terms}, 1)"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"


OP11 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, COALESCE(text, '') AS text, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, COUNT(*) AS n FROM words GROUP BY lang, term HAVING COUNT(DISTINCT r) >= 10),
grp AS (SELECT DISTINCT lang, source FROM docs),
cnt AS (SELECT lang, source, term, COUNT(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
tot AS (SELECT lang, source, COALESCE(SUM(n), 0) AS total FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY lang, source),
lt AS (SELECT lang, COUNT(*) AS v, SUM(n) AS total FROM kept GROUP BY lang),
p AS (
  SELECT grp.lang, grp.source, kept.term, COALESCE(cnt.n, 0) AS n, {_share('COALESCE(cnt.n, 0)', 'tot.total', 'lt.v')} AS p, {_share('kept.n', 'lt.total', 'lt.v')} AS q
  FROM grp JOIN kept USING (lang) JOIN lt USING (lang) JOIN tot ON tot.lang = grp.lang AND tot.source = grp.source LEFT JOIN cnt ON cnt.lang = grp.lang AND cnt.source = grp.source AND cnt.term = kept.term),
pv AS (SELECT a.lang, a.source, b.source AS item, SUM({_f('a.p', 'b.p')}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(COALESCE(pv.value, 0) AS BIGINT) AS value
  FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pv ON pv.lang = g.lang AND pv.source = g.source AND pv.item = h.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST({_f('p', 'q')} AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM term) WHERE rank <= 10
"""

ORACLES = {"op3_url_reputation": OP3, "op11_divergence": OP11}

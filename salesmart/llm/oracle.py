"""DuckDB SQL of the operators that SQL can state, written against the given tables only.

The others need the tokenizer, 64-bit hashes or fits, which SQL has not.
"""

from __future__ import annotations


def _tagged(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"COALESCE(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text, a byte and then a bit at a time."""
    eight = "list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0])"
    byte = f"list_reduce({eight}, lambda x, _: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda d: ascii(d)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295)"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_tagged, ["doc_id", "source", "lang", n_chars, "text"])) + ")"


MERKLE = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS id, doc_id, COALESCE('=' || lang, '-') AS grp, {_leaf("n_chars")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0
              THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS given
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         COUNT(*) OVER (PARTITION BY grp) AS n FROM docs),
nodes(level, grp, pos, n, node) AS (
  SELECT 0, grp, pos, n, leaf FROM placed
  UNION ALL
  SELECT level + 1, grp, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY level, grp, pos // 2, n),
subroots AS (
  SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, COUNT(*) OVER () AS n FROM nodes WHERE n = 1),
upper(level, pos, n, node) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM upper WHERE n > 1 GROUP BY level, pos // 2, n),
climbs(level, id, grp, pos, n, proof, folded) AS (
  SELECT 0, id, grp, pos, n, '', given FROM placed
  UNION ALL
  SELECT c.level + 1, id, c.grp, c.pos // 2, (c.n + 1) // 2, proof || COALESCE(s.node, ''),
         sha256(CASE WHEN c.pos % 2 = 1 THEN s.node || folded ELSE folded || COALESCE(s.node, '') END)
  FROM climbs c LEFT JOIN nodes s ON s.level = c.level AND s.grp = c.grp AND s.pos = xor(c.pos, 1) WHERE c.n > 1),
tops(level, id, pos, n, proof, folded) AS (
  SELECT 0, id, s.pos, s.n, proof, folded FROM climbs JOIN subroots s USING (grp) WHERE climbs.n = 1
  UNION ALL
  SELECT t.level + 1, id, t.pos // 2, (t.n + 1) // 2, proof || COALESCE(s.node, ''),
         sha256(CASE WHEN t.pos % 2 = 1 THEN s.node || folded ELSE folded || COALESCE(s.node, '') END)
  FROM tops t LEFT JOIN upper s ON s.level = t.level AND s.pos = xor(t.pos, 1) WHERE t.n > 1)
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified
FROM placed JOIN subroots USING (grp) JOIN (SELECT * FROM tops WHERE n = 1) USING (id), (SELECT node FROM upper WHERE n = 1)
"""


def _in_site(site: str) -> str:
    return f"(host = '{site}' OR ends_with(host, '.{site}'))"


def _rule(verdict: str, host: str, path: str) -> str:
    return f"SELECT '{verdict}' AS verdict, '{host}' AS host, '{path}' AS path"


#: Fixed values, stated here so that a wrong one in the query shows.
RULES = " UNION ALL ".join(
    _rule(*r.split()) for r in [
        "allow com /", "block example.com /en/", "allow www.example.com /en/", "block net /es/", "block net /fr/"
    ]
)


def _strength(table: str) -> str:
    """Moments of the beta-binomial: squared deviations beyond those of a binomial."""
    inside = "FILTER (prior > 0 AND prior < 1)"
    over = f"(SUM((bad - n * prior) ** 2 / (prior * (1 - prior))) {inside} - SUM(n) {inside}) / SUM(n * (n - 1)) {inside}"
    return f"""(SELECT CASE WHEN o > 0 THEN least(greatest(1 / o - 1, 0.5), 10000) ELSE 10000 END
                FROM (SELECT CASE WHEN (SUM(n * (n - 1)) {inside}) > 0 THEN {over} END AS o FROM {table} WHERE n > 0))"""


def _posterior(table: str) -> str:
    return f"SELECT *, (bad + strength * prior) / (n + strength) AS rate FROM (SELECT *, {_strength(table)} AS strength FROM {table})"


HOSTS = f"""
WITH rules AS ({RULES}),
urls AS (
  SELECT page_id, translate(regexp_extract(COALESCE(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(COALESCE(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
outcomes AS (
  SELECT doc_id AS page_id, max(toxic = 1 OR quality = 0) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY 1),
hosts AS (
  SELECT *, CASE WHEN host = suffix THEN host
                 ELSE list_last(string_split(left(host, length(host) - length(suffix) - 1), '.')) || '.' || suffix END AS domain
  FROM (SELECT host, COUNT(bad) AS n, COUNT(*) FILTER (bad) AS bad,
               CASE WHEN {_in_site("example.com")} THEN 'example.com' WHEN {_in_site("example.net")} THEN 'example.net'
                    WHEN {_in_site("example.org")} THEN 'example.org' ELSE list_last(string_split(host, '.')) END AS suffix
        FROM urls LEFT JOIN outcomes USING (page_id) GROUP BY host)),
suffixes AS (
  SELECT suffix, SUM(n) AS n, SUM(bad) AS bad,
         (SELECT COALESCE(SUM(bad)::DOUBLE / nullif(SUM(n), 0), 0) FROM hosts) AS prior FROM hosts GROUP BY suffix),
suffix_rates AS ({_posterior("suffixes")}),
domains AS (
  SELECT domain, any_value(s.rate) AS prior, SUM(h.n) AS n, SUM(h.bad) AS bad
  FROM hosts h JOIN suffix_rates s USING (suffix) GROUP BY domain),
domain_rates AS ({_posterior("domains")}),
members AS (SELECT h.host, h.n, h.bad, d.rate AS prior FROM hosts h JOIN domain_rates d USING (domain)),
host_rates AS ({_posterior("members")}),
bounds AS (
  SELECT host, greatest(rate - 1.645 * sqrt(rate * (1 - rate) / (n + strength + 1)), 0) AS bound FROM host_rates),
fitting AS (
  SELECT u.host, u.path, r.host || r.path AS rule, r.verdict
  FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(rule) DESC, r.verdict DESC) = 1)
SELECT page_id, host, path, rule, COALESCE(verdict, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(bound, 6) AS bound
FROM urls LEFT JOIN fitting USING (host, path) JOIN bounds USING (host)
"""


def _p(count: str, size: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({count} + 5)) // ({size} + 5 * v))"


DIVERGENCE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, COALESCE(text, '') AS text
  FROM documents),
words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (
  SELECT lang, term, COUNT(*) AS total FROM words GROUP BY lang, term HAVING COUNT(DISTINCT id) >= 30),
langs AS (SELECT lang, COUNT(*) AS v, SUM(total) AS lang_size FROM kept GROUP BY lang),
held AS (SELECT lang, source, term, COUNT(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, COALESCE((SELECT SUM(n) FROM held h WHERE h.lang = d.lang AND h.source = d.source), 0) AS size
  FROM (SELECT DISTINCT lang, source FROM docs) d),
priced AS (
  SELECT g.lang, g.source, k.term, COALESCE(h.n, 0) AS n, {_p("COALESCE(h.n, 0)", "g.size")} AS p, {_p("k.total", "lang_size")} AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source
   AND h.term = k.term),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         CAST(COALESCE((SELECT SUM(abs(x.p - y.p)) FROM priced x JOIN priced y USING (lang, term)
                        WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM priced WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_merkle_manifest": MERKLE,
        "op12_host_reputation": HOSTS,
        "op13_source_divergence": DIVERGENCE,
    }

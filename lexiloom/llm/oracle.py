"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from .url_filters import RULES

_HOST = "lower(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1))"
_PATH = "regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract({u}, '(?s)^.*?://[^/?#]*[^?#]*(\\??[^#]*)', 1)"
_NODE = f"({_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || {_QUERY})"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

_ATTRIBUTE = "regexp_replace(regexp_extract({t}, '(?is)\\b{n}\\s*=\\s*[\"'']?\\s*([^\"''\\s>]+)', 1), '&(?:amp|#38|#x26);', '&', 'g')"


def _resolved(base: str, link: str) -> str:
    folder = f"regexp_extract(CASE WHEN {_PATH.format(u=base)} = '' THEN '/' ELSE {_PATH.format(u=base)} END, '(?s)^(.*/)', 1)"
    bare, rest = f"regexp_extract({link}, '(?s)^([^?#]*)', 1)", f"regexp_extract({link}, '(?s)^[^?#]*(.*)$', 1)"
    origin = f"regexp_extract({base}, '(?s)^(.*?://[^/?#]*)', 1)"
    parts = f"string_split(substr(CASE WHEN starts_with({bare}, '/') THEN {bare} ELSE {folder} || {bare} END, 2), '/')"
    walked = f"list_reduce(list_prepend('', {parts}), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x = '.' THEN acc ELSE acc || '/' || x END) || CASE WHEN {parts}[-1] IN ('.', '..') THEN '/' ELSE '' END"
    return f"CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link} WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with({link}, '//') THEN 'http:' || {link} WHEN {bare} = '' THEN {origin} || {_PATH.format(u=base)} || {rest} ELSE {origin} || {walked} || {rest} END"


OP2 = f"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {_RULES}),
parts AS (SELECT page_id, url, html, coalesce({_HOST.format(u="url")}, '') AS host, coalesce({_PATH.format(u="url")}, '') AS path FROM pages),
tags AS (SELECT url, {_ATTRIBUTE.format(t="regexp_extract(html, '(?is)<base\\b[^>]*>')", n="href")} AS base, unnest(list_filter(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\brel\\s*=\\s*["'']?\\s*canonical\\b|http-equiv\\s*=\\s*["'']?\\s*refresh\\b'))) AS t FROM parts WHERE contains(url, '://')),
hrefs AS (SELECT url, base, CASE WHEN regexp_matches(t, '(?i)http-equiv') THEN {_ATTRIBUTE.format(t="t", n="url")} ELSE {_ATTRIBUTE.format(t="t", n="href")} END AS r FROM tags),
based AS (SELECT url, r, CASE WHEN base = '' THEN url ELSE coalesce({_resolved("url", "base")}, url) END AS base FROM hrefs WHERE r <> ''),
links AS (SELECT url AS a, {_resolved("base", "r")} AS b FROM based),
nodes AS (SELECT {_NODE.format(u="a")} AS a, {_NODE.format(u="b")} AS b FROM links WHERE contains(b, '://')),
edges AS (SELECT a, b FROM nodes WHERE a <> b UNION SELECT b, a FROM nodes WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
told AS (SELECT n, v FROM (SELECT n, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC, v) AS k FROM (SELECT DISTINCT a AS n FROM edges) JOIN rules ON (split_part(n, '/', 1) = h OR ends_with(split_part(n, '/', 1), '.' || h)) AND starts_with(substr(split_part(n, '?', 1), length(split_part(n, '/', 1)) + 1), p)) WHERE k = 1),
fate AS (SELECT a AS n, bool_or(v = 'allow') AS allowed, bool_or(v = 'block') AS blocked FROM reach LEFT JOIN told ON reach.b = told.n GROUP BY 1),
best AS (SELECT page_id, h || p AS rule, v FROM (SELECT page_id, h, p, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC, v) AS k FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) WHERE k = 1)
SELECT parts.page_id, host, path, rule, CASE WHEN best.v IS NOT NULL THEN best.v WHEN fate.blocked AND NOT coalesce(fate.allowed, false) THEN 'block' ELSE 'allow' END AS verdict
FROM parts LEFT JOIN best ON parts.page_id = best.page_id LEFT JOIN fate ON contains(url, '://') AND fate.n = {_NODE.format(u="url")}
"""

OP9 = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS k FROM documents),
s AS (SELECT doc_id, CASE WHEN len(k) = 0 THEN [] WHEN len(k) < 5 THEN [array_to_string(k, ' ')] ELSE list_distinct(list_transform(range(1, CAST(len(k) AS BIGINT) - 3), lambda i: array_to_string(k[i:i + 4], ' '))) END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
many AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
f AS (SELECT e.* FROM e JOIN many ON e.g = many.g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, a FROM d UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.c, n.doc_id) AS component_id FROM n LEFT JOIN c ON n.doc_id = c.a
"""

#: The cube is not used here: every document walks through every order.
OP13 = """
WITH RECURSIVE o(s) AS (SELECT '' UNION ALL SELECT s || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) f(c) WHERE NOT contains(s, c)),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS k FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
  (CASE WHEN len(k) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(k)) < 50 * len(k) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM d GROUP BY 1, 2),
x AS (SELECT g.*, s, step, s[step] AS f, contains(fails, s[step]) AS failing, step = 1 OR NOT regexp_matches(fails, '[' || s[1:step - 1] || ' ]') AS here FROM g, (SELECT s FROM o WHERE length(s) = 5), range(1, 6) r(step)),
y AS (SELECT part, s, step, f, coalesce(sum(n) FILTER (here AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (here AND failing), 0) AS removed, coalesce(sum(n) FILTER (failing AND NOT here), 0) AS redundant,
  coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails, coalesce(sum(good) FILTER (here AND failing), 0) AS good_lost, coalesce(sum(bad) FILTER (here AND failing), 0) AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
SELECT part, s AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM y
"""

def _kmeans(k: int = 40, rounds: int = 5, size: int = 64, seed: str = "2") -> str:
    """Plain k-means: every vector against every centroid, in every round."""
    steps = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v) ORDER BY c LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, x, min(struct_pack(d := d, c := c)) AS n FROM (SELECT vec_id, v.x AS x, c, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{r}) GROUP BY vec_id, x)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT c, list(m ORDER BY i) AS x FROM (SELECT c, i, CAST(floor(sum(CAST(t AS DOUBLE)) / count(*)) AS BIGINT) AS m FROM (SELECT n.c AS c, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c)")
            steps.append(f"c{r + 1} AS (SELECT c{r}.c AS c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)")
    return (
        "WITH " + ",\n".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps) + f"""
SELECT vec_id, n.c AS cluster, CAST(n.d AS BIGINT) AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(n.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON n.c = c{rounds}.c
"""
    )


OP12 = _kmeans()

ORACLE_SQL = {"op2_url_filters": OP2, "op9_ngram_join": OP9, "op12_ball_kmeans": OP12, "op13_filter_audit": OP13}

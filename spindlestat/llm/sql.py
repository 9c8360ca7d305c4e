"""SQL (DuckDB) for the queries of this subpackage that SQL can express: the URL filter, with its components by recursion, and decontamination, by comparing all windows."""

from __future__ import annotations

from .url_filter import LOWER, RULES, UPPER


def _rest(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"


def _host(rest: str) -> str:
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"


def _path(rest: str) -> str:
    return f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


def _without_dots(path: str) -> str:
    parts = f"list_transform(string_split({path}, '/'), lambda s: [s])"
    kept = f"list_reduce({parts}, lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 1)] ELSE list_concat(acc, x) END)"
    return f"array_to_string({kept}, '/') || CASE WHEN ends_with({path}, '/.') OR ends_with({path}, '/..') THEN '/' ELSE '' END"


def _node(rest: str) -> str:
    return f"CASE WHEN {_host(rest)} <> '' THEN {_host(rest)} || CASE WHEN {_path(rest)} = '' THEN '/' WHEN contains({_path(rest)}, '/.') THEN {_without_dots(_path(rest))} ELSE {_path(rest)} END || regexp_extract({rest}, '^[^?#]*(\\?[^#]*)', 1) END"


def _rule(host: str, path: str, what: int) -> str:
    """CASE over the rules, longest first; what: 0 the rule, 1 its verdict."""
    whens = []
    for verdict, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0])):
        whens.append(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, verdict)[what]}'")
    return f"CASE {' '.join(whens)} END"


def _attribute(tag: str, name: str) -> str:
    found = f"regexp_extract({tag}, '(?is)[\\s\"''/]{name}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>\"'']+)', 1)"
    return f"regexp_replace({found}, '^[\"'']|[\"'']$', '', 'g')"


URL_FILTER = f"""
WITH RECURSIVE p AS (SELECT page_id, url, coalesce(html, '') AS html, {_rest('url')} AS rest FROM pages),
h AS (SELECT page_id, html, {_host('rest')} AS host, {_path('rest')} AS path, {_node('rest')} AS node FROM p),
tags AS (SELECT host, path, node, 'link' AS kind, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*>')) AS tag FROM h UNION ALL SELECT host, path, node, 'meta', unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*>')) FROM h),
hrefs AS (SELECT host, path, node, replace({_attribute('tag', 'href')}, '&amp;', '&') AS href FROM tags WHERE kind = 'link' AND list_contains(regexp_split_to_array(lower({_attribute('tag', 'rel')}), '\\s+'), 'canonical')
UNION ALL SELECT host, path, node, replace(regexp_extract({_attribute('tag', 'content')}, '(?is)url\\s*=\\s*[''"]?([^''"]*)', 1), '&amp;', '&') FROM tags WHERE kind = 'meta' AND lower({_attribute('tag', 'http-equiv')}) = 'refresh'),
targets AS (SELECT node, CASE WHEN regexp_matches(x, '^(?i)https?://') THEN x WHEN starts_with(x, '//') THEN 'http:' || x WHEN x = '' OR regexp_matches(x, '^(?i)[a-z][a-z0-9+.-]*:') THEN NULL WHEN starts_with(x, '/') THEN 'http://' || host || x WHEN starts_with(x, '?') THEN 'http://' || host || path || x
ELSE 'http://' || host || CASE WHEN regexp_extract(path, '^(.*/)[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)[^/]*$', 1) END || x END AS target FROM (SELECT *, trim(href) AS x FROM hrefs)),
links AS (SELECT node AS a, {_node('rest')} AS b FROM (SELECT node, {_rest('target')} AS rest FROM targets)),
both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
others AS (SELECT node, {_rule("split_part(split_part(other, '/', 1), '?', 1)", "regexp_extract(other, '^[^/?#]*([^?#]*)', 1)", 1)} AS own FROM reach),
carried AS (SELECT node, CASE WHEN bool_or(coalesce(own = 'allow', false)) THEN 'allow' WHEN bool_or(coalesce(own = 'block', false)) THEN 'block' ELSE 'allow' END AS verdict FROM others GROUP BY 1)
SELECT page_id, host, path, {_rule('host', 'path', 0)} AS rule, coalesce({_rule('host', 'path', 1)}, carried.verdict, 'allow') AS verdict FROM h LEFT JOIN carried USING (node)
"""


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words("text")} AS w FROM benchmark),
of_items AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS passage
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
of_docs AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS passage
  FROM d, (SELECT DISTINCT n FROM of_items) AS lengths, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
hits AS (SELECT r, i, n, item FROM of_docs JOIN of_items USING (n, passage)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)
"""

"""DuckDB SQL of those queries that SQL can express. Patterns are fixed values of the queries' contracts."""

from __future__ import annotations

from .bloom_cascade import LOWER, UPPER
from .mixing import MOST, WEIGHTS, WORDS
from .sharding import lookup_table
from .warc import KEPT_HEADERS, TRACKING

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _canonical(url: str) -> str:
    bare = rf"regexp_replace(regexp_replace({url}, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = rf"regexp_replace(regexp_replace(regexp_replace(translate(regexp_extract({bare}, '^[^/?]*'), '{UPPER}', '{LOWER}'), '^.*@', ''), ':(80|443)?$', ''), '^(www|m)\.', '')"
    rest = rf"substr({bare}, length(regexp_extract({bare}, '^[^/?]*')) + 1)"
    path = rf"regexp_replace(regexp_replace(regexp_extract({rest}, '^[^?]*'), '(/index)?\.html?$', ''), '/+$', '')"
    query = rf"list_sort(list_filter(string_split(regexp_extract({rest}, '(?s)\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}')))"
    return rf"{host} || {path} || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END"


WARC = f"""
WITH full_ AS (SELECT page_id * 2 AS record_id, {_canonical("url")} AS u, page_id::DOUBLE AS at, md5(html) AS tag, length(html) AS size FROM pages),
again AS (SELECT page_id * 2 + 1 AS record_id, {_canonical("url")} AS u, page_id + 86400.0 * (length(url) % 4 - 1) AS at, md5(html) AS tag, page_id FROM pages),
found AS (
  SELECT a.record_id, a.u, a.tag, a.page_id, (SELECT max(struct_pack(t := f.at, r := f.record_id)) FROM full_ f WHERE f.u = a.u AND (f.at < a.at OR f.at = a.at AND f.record_id < a.record_id)) AS s FROM again a),
joined AS (SELECT f.*, o.tag AS old, o.size FROM found f LEFT JOIN full_ o ON o.record_id = f.s.r)
SELECT record_id, u AS canonical_url, s.r AS source_id,
  CASE WHEN s IS NULL THEN 'no_response' WHEN tag = old THEN 'resolved' ELSE 'etag_mismatch' END AS state,
  CASE WHEN tag = old THEN s.r END AS body_id,
  CASE WHEN tag = old THEN 'cache-control=max-age=' || page_id || ';content-length=' || size || ';content-type=text/html;date=' || page_id || ';etag=W/"' || tag || '"' END AS headers
FROM joined"""
assert {"content-length", "content-type"} <= set(KEPT_HEADERS)

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, unnest(range(1, len(w) - k + 2)) t(i) WHERE len(w) >= k),
hits AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, list_extract([{", ".join(map(str, WEIGHTS))}], CAST((rank - 1) % {len(WEIGHTS)} AS BIGINT) + 1) AS weight, source_size * {MOST} AS cap FROM r),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN cap <= top * weight THEN cap::DOUBLE ELSE top * weight END AS target FROM (SELECT *, max(level) OVER () AS top FROM l)),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.place) AS k,
  CAST('0x' || substr(md5('0:' || coalesce('s' || d.source, 'n')), 1, 4) AS BIGINT) / 65536.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate * k + u) - floor(rate * (k - 1) + u)) * size AS BIGINT) AS taken FROM k"""

CASCADE = rf"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM p),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|\.)(ads?|track(er|ing)?|banner|click)[-.]') OR md5(host) < '2' OR md5(host || path) < '2' THEN 'block' ELSE 'allow' END AS verdict FROM r"""

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _sharding(size: int = 65_537) -> str:
    """Slots by md5, looked up in the filled table, which stands in the query."""
    table = ", ".join(map(str, lookup_table(list(SHARDS), size)))
    slot = f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size}"
    return f"WITH t AS (SELECT [{table}] AS filled) SELECT doc_id, {slot} AS slot, printf('shard-%03d', list_extract(filled, {slot} + 1)) AS shard FROM documents, t"


ORACLE_SQL: dict[str, str] = {
    "op1_warc_revisits": WARC,
    "op2_decontamination": DECONTAMINATION,
    "op3_mixing": MIXING,
    "op9_bloom_cascade": CASCADE,
    "op10_sharding": _sharding(),
}

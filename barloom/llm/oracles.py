"""The queries that SQL can express, for DuckDB."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHARDS = """
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, source, coalesce(text, '') AS t, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT doc_id, source, k, CAST(strlen(d.t) + 16 AS BIGINT) AS size, xor(list_reduce(list_concat([4294967295], list_transform(
    regexp_extract_all(hex(encode(d.t)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id, text_crc32, size) - 1 AS rk, count(*) OVER (PARTITION BY source) AS n FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rk + 1) / (2 * n), k, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 40 // total AS INT) AS shard, pos - ((pos * 40 // total) * total + 39) // 40 AS slot,
  CAST(NULL AS INT) AS grown_shard, source FROM p"""

LINES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
g AS (SELECT rid, w, i, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, w, i, CASE WHEN w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w2, w3) > 1 THEN 1 ELSE 0 END AS m FROM g),
m AS (SELECT rid, w, greatest(m, coalesce(lag(m) OVER o, 0), coalesce(lag(m, 2) OVER o, 0)) AS hit FROM c WINDOW o AS (PARTITION BY rid ORDER BY i)),
ws AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, sum(hit) AS n_repeat_words FROM m GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
dup AS (SELECT rid, count(*) AS n FROM (SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY i) AS k FROM l)
  WHERE k > 1 AND regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
nl AS (SELECT rid, trim(regexp_replace(translate(line, '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS line FROM l),
ln AS (SELECT nl.rid, source, t, line, len(string_split(line, ' ')) AS n FROM nl JOIN d USING (rid) WHERE line <> ''),
host AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
freq AS (SELECT ln.source, line FROM ln JOIN host ON ln.source IS NOT DISTINCT FROM host.source GROUP BY ln.source, line, texts
  HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > 0.01 * texts),
lost AS (SELECT rid, sum(n) AS n FROM ln JOIN freq ON ln.source IS NOT DISTINCT FROM freq.source AND ln.line = freq.line GROUP BY rid),
b AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN ws USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM f"""


def urls(strict, soft, min_soft: int, rules) -> str:
    term = lambda t: f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t.replace('-', '[-]')}([^a-z0-9]|$)') AS BIGINT)"
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ranked)
    verdict = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in ranked)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
  translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS u FROM pages),
p AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT page_id, host, path, CASE {rule} END AS rule, {' + '.join(map(term, strict))} AS n_strict, {' + '.join(map(term, soft))} AS n_soft FROM p)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN n_strict > 0 OR n_soft >= {min_soft} THEN 'block' ELSE 'allow' END END AS verdict,
  n_strict, n_soft FROM c"""


ROLLUPS = """
WITH c AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS a,
  len(regexp_extract_all(coalesce(text, ''), '[\\pL\\pN]+|[^\\pL\\pN\\x20\\x09-\\x0D]')) AS b
  FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL))
SELECT source, lang, CASE WHEN lang <> 'en' THEN 'words-2' ELSE 'words-1' END AS version, count(*) AS docs,
  CAST(sum(CASE WHEN lang <> 'en' THEN b ELSE a END) AS BIGINT) AS tokens FROM c GROUP BY ALL"""


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')" % (_UPPER, _LOWER)

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS nd, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT rid, doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, nd),
x AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY item_id, rid, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""

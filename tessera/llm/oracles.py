"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from tessera.llm.chat import END, EXTRA, TURN
from tessera.llm.quality import RULES as QUALITY
from tessera.llm.quality import SYMBOLS
from tessera.llm.sharding import MASK, MAX_SHARDS, ODD1, ODD2, SHARDS, STEP
from tessera.llm.urls import ALPHABET, BACKING, LOWER, OTHERS, PARTS, RULES, UPPER

SHARD_OF = f"""
scored AS (SELECT doc_id, i, (xor(y, y >> 15)) * {MAX_SHARDS} + {MAX_SHARDS - 1} - i AS z FROM (
  SELECT doc_id, i, (xor(x, x >> 12) * {ODD2}) & {MASK} AS y FROM (
  SELECT doc_id, i, (((xor(b, b >> 15) * {ODD1}) & {MASK}) + h2) & {MASK} AS x FROM (
  SELECT doc_id, i, h2, xor(h1, ((i + 1) * {STEP}) & {MASK}) AS b FROM ids CROSS JOIN (SELECT CAST(unnest(range({SHARDS + 1})) AS BIGINT) AS i) s)))),
best AS (SELECT doc_id, {MAX_SHARDS - 1} - max(z) FILTER (WHERE i < {SHARDS}) % {MAX_SHARDS} AS shard, {MAX_SHARDS - 1} - max(z) % {MAX_SHARDS} AS grown_shard FROM scored GROUP BY doc_id)"""

# for tests: SQL has no CRC-32, so the query itself is held against plain Python
SHARDING = f"""
WITH ids AS (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) & {MASK} AS h1, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 9, 8) AS BIGINT) & {MASK} AS h2 FROM documents),
{SHARD_OF}
SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard FROM documents JOIN best USING (doc_id)"""

LONGEST = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
FITS = [f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{{}}'" for h, p, _ in LONGEST]
RULE = "CASE " + " ".join(f.format(h + p) for f, (h, p, _) in zip(FITS, LONGEST)) + " END"
VERDICT = "CASE " + " ".join(f.format(v) for f, (*_, v) in zip(FITS, LONGEST)) + " END"
P1 = "(sum({n}) OVER (PARTITION BY substr(gram, 3, 1)) + 1.0) / (sum({n}) OVER () + " + f"{ALPHABET})"
P2 = "(sum({n}) OVER (PARTITION BY substr(gram, 2, 2)) + " + f"{BACKING} * (" + P1 + ")) / (sum({n}) OVER (PARTITION BY substr(gram, 2, 1)) + " + f"{BACKING})"
P3 = "({n} + " + f"{BACKING} * (" + P2 + ")) / (sum({n}) OVER (PARTITION BY substr(gram, 1, 2)) + " + f"{BACKING})"
URLS = f"""
WITH parts AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
ruled AS (SELECT *, {RULE} AS rule, {VERDICT} AS by_rule FROM parts),
u AS (SELECT DISTINCT url, by_rule, '^^' || regexp_replace(regexp_replace(translate(url, '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g'), '{OTHERS}', '*', 'g') AS s FROM ruled WHERE url IS NOT NULL),
g AS (SELECT url, by_rule, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS gram FROM u),
c AS (SELECT gram, CAST(count(*) FILTER (WHERE by_rule = 'allow') AS DOUBLE) AS n0, CAST(count(*) FILTER (WHERE by_rule = 'block') AS DOUBLE) AS n1 FROM g GROUP BY gram),
m AS (SELECT gram, ln({P3.format(n='n0')}) - ln({P3.format(n='n1')}) AS score FROM c),
s AS (SELECT url, by_rule, avg(score) AS score FROM g JOIN m USING (gram) GROUP BY url, by_rule),
t AS (SELECT (avg(score) FILTER (WHERE by_rule = 'allow') + avg(score) FILTER (WHERE by_rule = 'block')) / 2 AS bar FROM s)
SELECT page_id, host, path, rule, coalesce(ruled.by_rule, CASE WHEN score < bar THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN s ON s.url = ruled.url CROSS JOIN t"""

CHAT = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA[0]}, 0, 'user', '{EXTRA[1]}' UNION ALL SELECT {EXTRA[0]}, 1, 'assistant', '{EXTRA[1]}'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|[a-z]+\|>|/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS shown FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, shown)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, shown) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(shown) + {len(TURN) + 1 + len(END)}) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

LENGTHS = [3, *sorted(QUALITY.coverage)]
LIMITS = " AND ".join(f"coalesce(chars[{n}], 0) <= {QUALITY.coverage[n]} * word_chars" for n in LENGTHS[1:])
NEXT = ", ".join(f"lead(word, {i}) OVER o AS w{i}" for i in range(max(LENGTHS)))
GRAMS = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, pos, concat_ws(' ', {', '.join(f'w{i}' for i in range(n))}) AS gram FROM x WHERE w{n - 1} IS NOT NULL" for n in LENGTHS)
WITHIN = r"[^\x20\x09-\x0D]"
REPETITION = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WITHIN}+') AS w FROM documents),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS seen FROM l WHERE regexp_matches(line, '{WITHIN}')),
dup AS (SELECT doc_id, count(*) AS n, sum(length(array_to_string(regexp_extract_all(line, '{WITHIN}+'), ''))) AS chars FROM r WHERE seen > 1 GROUP BY doc_id),
q AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
x AS (SELECT doc_id, pos, {NEXT} FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
g AS ({GRAMS}),
t AS (SELECT doc_id, n, pos FROM (SELECT doc_id, n, pos, count(*) OVER (PARTITION BY doc_id, n, gram) AS c FROM g) y WHERE c > 1),
c AS (SELECT DISTINCT doc_id, n, pos + unnest(range(0, n)) AS pos FROM t),
s AS (SELECT c.doc_id, c.n, count(*) AS words, sum(length(word)) AS chars FROM c JOIN q ON q.doc_id = c.doc_id AND q.pos = c.pos GROUP BY c.doc_id, c.n),
m AS (SELECT doc_id, max(words) FILTER (WHERE n = 3) AS repeated, map_from_entries(list((n, chars))) AS chars FROM s GROUP BY doc_id),
f AS (SELECT base.*, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(dup.chars, 0) AS dup_chars, CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeat_words, m.chars FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN m USING (doc_id)),
v AS (SELECT *, n_words < {QUALITY.min_words} OR 100 * n_repeat_words > {QUALITY.repeat_words_percent} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_symbols <= {QUALITY.symbols_per_word} * n_words AND dup_chars <= {QUALITY.line_chars} * word_chars AND {LIMITS} AS kept FROM v"""

SQL = {"op5_urls": URLS, "op6_chat": CHAT, "op10_quality": REPETITION}

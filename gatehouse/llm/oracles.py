"""SQL twins, for DuckDB, of the corpus queries that SQL can express."""

from __future__ import annotations

from gatehouse.llm import url_filters as U
from gatehouse.llm.quality_rules import BASE, CURRENT, RULES
from gatehouse.llm.sharding import PRIME, round_keys

_WORD = r"[^\x20\x09-\x0D]+"

#: Smallest node that links (a, b) reach, for all nodes (node).
_COMPONENTS = """
reach AS (
  SELECT node, node AS seen FROM nodes
  UNION
  SELECT l.b, r.seen FROM reach r JOIN links l ON r.node = l.a
),
parts AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
"""

OP1 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95
),
nodes AS (SELECT vec_id AS node FROM embeddings),
{_COMPONENTS}
SELECT node AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, node = component_id AS kept
FROM parts LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = node
"""

_KEYS = round_keys(20240607)

OP4 = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
sized AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc_table
),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row FROM sized
),
net AS (
  SELECT count(*) AS n, greatest((length(bin(greatest(count(*) - 1, 1))) + 1) // 2, 1)::INT AS bits FROM numbered
),
walk AS (
  SELECT row, row >> bits AS l, row & ((1::BIGINT << bits) - 1) AS r, 0 AS k FROM numbered, net
  UNION ALL
  SELECT row, r, xor(l, (((r + {[s for _, s in _KEYS]}[k % {len(_KEYS)} + 1]) % {PRIME} * {[f for f, _ in _KEYS]}[k % {len(_KEYS)} + 1] % {PRIME}) >> 7) & ((1::BIGINT << bits) - 1)), k + 1
  FROM walk, net WHERE NOT (k > 0 AND k % {len(_KEYS)} = 0 AND ((l << bits) | r) < n)
),
placed AS (
  SELECT row, (l << bits) | r AS place FROM walk, net WHERE k > 0 AND k % {len(_KEYS)} = 0 AND ((l << bits) | r) < n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % 24)::INT AS shard, place // 24 AS slot, NULL::INT AS grown_shard
FROM numbered JOIN placed USING (row)
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP5 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w FROM documents
),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 1) + 1 END)) AS i FROM w)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
nodes AS (SELECT doc_id AS node FROM documents),
{_COMPONENTS}
SELECT node AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM parts LEFT JOIN sizes ON doc_id = node
"""

#: The rows of OP5 with the number of links of each.
OP5_LINKS = OP5.replace(
    "component_id FROM parts LEFT JOIN sizes ON doc_id = node",
    "coalesce(k, 0)::BIGINT AS n_links, component_id FROM parts LEFT JOIN sizes ON doc_id = node"
    " LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) ON a = node",
)

OP6 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (
  SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, 100)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)
),
first AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
covered AS (SELECT doc_id, i FROM w JOIN first USING (s) WHERE m < doc_id),
marked AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM covered
),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k
),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS after FROM spans
),
cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substring(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept || substring(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{_WORD}') AS w FROM d),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY r
),
threes AS (
  SELECT r, i, w[i : i + 2] AS three FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)
),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM threes) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
),
f AS (SELECT *, ({_BITS})::BIGINT AS failed FROM m)
SELECT *, failed & {BASE.mask} <> 0 AS base_failed, failed & {BASE.mask | CURRENT.mask} = 0 AS kept FROM f
"""

OP10 = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, lower(coalesce(role, '')) AS role, coalesce(text, '') AS text, conv_id || ':' || turn AS own,
    conv_id || ':' || (turn - 1) AS before FROM conversations
),
calls AS (
  SELECT conv_id, turn, own, CASE role WHEN 'user' THEN 'answer' ELSE 'configure' END AS name,
    CASE role WHEN 'user' THEN '{"prompt":' || to_json(text) || ',"turn":' || turn || '}' ELSE '{"instructions":' || to_json(text) || '}' END AS arguments
  FROM t WHERE role IN ('user', 'system')
),
levels AS (
  SELECT conv_id, turn, 0 AS level FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls x WHERE x.conv_id = c.conv_id AND x.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, level + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2
),
results AS (SELECT conv_id, turn, before, text FROM t WHERE role NOT IN ('user', 'system'))
SELECT c.conv_id, own AS call_id, 'call' AS kind, (2 * level)::BIGINT AS step, c.turn,
  CASE WHEN before IS NULL THEN 'unanswered' ELSE 'linked' END AS status, '' AS problems,
  '{"arguments":' || arguments || ',"id":"' || own || '","name":"' || name || '","type":"call"}' AS message
FROM calls c JOIN levels USING (conv_id, turn) LEFT JOIN results r ON r.before = own
UNION ALL
SELECT r.conv_id, before, 'result', (2 * level + 1)::BIGINT, r.turn,
  CASE WHEN own IS NULL THEN 'orphan' ELSE 'linked' END, '',
  '{"content":' || to_json(text) || ',"id":"' || before || '","type":"result"}'
FROM results r LEFT JOIN calls c ON r.before = own LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn
"""


def _clustering_round(k: int) -> str:
    """Assignment to the centroids c{k}, and the centroids after it."""
    return f"""
far{k} AS MATERIALIZED (
  SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c{k}.v[i]) * (kept.v[i] - c{k}.v[i])))::BIGINT AS distance
  FROM kept, c{k}
),
a{k} AS MATERIALIZED (SELECT r, c, distance FROM far{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1),
sums{k} AS (
  SELECT c, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM a{k} JOIN kept USING (r)) GROUP BY c, i
),
c{k + 1} AS MATERIALIZED (
  SELECT c{k}.c, coalesce(m.v, c{k}.v) AS v FROM c{k}
  LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM sums{k} GROUP BY c) m USING (c)
),"""


OP11 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding,
    list_transform(embedding, lambda x: greatest(least(floor(64 * x::DOUBLE), 67108864), -67108864)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, embedding) - 1 AS c, v FROM kept QUALIFY c < 16
),{"".join(_clustering_round(k) for k in range(4))}
inertia AS (SELECT c, sum(distance)::BIGINT AS s FROM a3 GROUP BY c)
SELECT vec_id, c::INT AS cluster, distance, s AS cluster_inertia, (SELECT sum(s) FROM inertia)::BIGINT AS inertia,
  sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN kept USING (r) JOIN c3 USING (c) JOIN inertia USING (c)
"""

OP12 = f"""
WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '{_WORD}') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS later FROM d
),
m AS (
  SELECT part, doc_id, concat(
    CASE WHEN len(w) < 50 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
    CASE WHEN later THEN 'E' END) AS fails
  FROM w
),
known AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m LEFT JOIN known USING (doc_id) GROUP BY part, fails
),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
gone AS MATERIALIZED (
  SELECT *, coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda x: instr(filter_order, x))), 6) AS goes FROM masks, orders
),
steps AS (
  SELECT part, filter_order, step, filter_order[step] AS x,
    sum(n) FILTER (goes > step) AS kept, sum(n) FILTER (goes = step) AS removed,
    sum(n) FILTER (goes < step AND contains(fails, filter_order[step])) AS redundant,
    sum(n) FILTER (fails = filter_order[step]) AS unique_fails,
    sum(good) FILTER (goes = step) AS good_lost, sum(toxic) FILTER (goes = step) AS toxic_lost
  FROM gone, (SELECT unnest(range(1, 6))::INT AS step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley
FROM steps
"""

_LINK = U.LINK.replace("'", "''")
_FITS = [
    (f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r)
    for r in sorted(U.RULES, key=lambda r: -len(r.name))
]


def _host_sql(url: str) -> str:
    return f"translate({url}, '{_UPPER}', '{_UPPER.lower()}')"


def _url_round(k: int) -> str:
    return f"""
s{k + 1} AS MATERIALIZED (
  SELECT kind, host, (sum(score) // 100)::BIGINT AS score FROM (
    SELECT kind, host, score * 100 AS score FROM s0
    UNION ALL
    SELECT kind, w."to", {U.HANDED_ON} * (score // edges) FROM walk w JOIN s{k} USING (kind, host)
  ) GROUP BY kind, host
),"""


OP13 = f"""
WITH p AS MATERIALIZED (
  SELECT page_id, html, {_host_sql(f"coalesce(regexp_extract(url, '{U.HOST}', 1), '')")} AS host,
    coalesce(regexp_extract(url, '{U.PATH}', 1), '') AS path FROM pages
),
ruled AS MATERIALIZED (
  SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits} THEN '{r.name}'" for fits, r in _FITS)} END AS rule,
    CASE {" ".join(f"WHEN {fits} THEN '{r.verdict}'" for fits, r in _FITS)} END AS ruled FROM p
),
s0 AS MATERIALIZED (
  SELECT kind, host, ({U.UNIT} * count(*) FILTER (ruled = verdict) // count(*))::BIGINT AS score
  FROM ruled, (VALUES ('trust', 'allow'), ('distrust', 'block')) k(kind, verdict) WHERE host <> '' GROUP BY kind, host
),
hosts AS (SELECT DISTINCT host FROM s0),
sites AS (
  SELECT h.host, max_by(a.host, length(a.host)) AS above FROM hosts h JOIN hosts a ON ends_with(h.host, '.' || a.host)
  WHERE length(h.host) <= {U.LONGEST_HOST} GROUP BY h.host
),
edges AS (
  SELECT host AS src, {_host_sql("link")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS link FROM p)
  UNION SELECT host, above FROM sites UNION SELECT above, host FROM sites
),
ways AS (
  SELECT 'trust' AS kind, src AS host, dst AS "to" FROM edges WHERE src <> '' AND dst <> '' AND src <> dst
  UNION SELECT 'distrust', dst, src FROM edges WHERE src <> '' AND dst <> '' AND src <> dst
),
walk AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY kind, host) AS edges FROM ways),{"".join(_url_round(k) for k in range(U.ROUNDS))}
blocked AS (
  SELECT host FROM s{U.ROUNDS} GROUP BY host
  HAVING coalesce(sum(score) FILTER (kind = 'distrust'), 0) > coalesce(sum(score) FILTER (kind = 'trust'), 0)
    AND coalesce(sum(score) FILTER (kind = 'distrust'), 0) >= {U.THRESHOLD * U.UNIT // 100}
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' END, 'allow') AS verdict FROM ruled
"""

ORACLES = {
    "op1_embedding_near_dedup": OP1,
    "op4_sharding": OP4,
    "op5_ngram_jaccard_join": OP5,
    "ngram_jaccard_links": OP5_LINKS,
    "op6_suffix_array_dedup": OP6,
    "op9_quality_rules": OP9,
    "op10_chat_formatting": OP10,
    "op11_centroid_clustering": OP11,
    "op12_filter_audit": OP12,
    "op13_url_filters": OP13,
}

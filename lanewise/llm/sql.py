"""DuckDB SQL for the queries that SQL can express."""

OP3 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (t)
"""

WHITE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * m >= 85 * (x.n + y.n - m)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

OP9 = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM t),
k AS (SELECT *, translate(trim(line, {WHITE}), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.first AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP10 = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
m AS (SELECT source, (1.0::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE) / ((SELECT count(*) FROM n)::DOUBLE * n) AS mean FROM n),
r AS (SELECT source, mean, greatest(1, ceil(mean / 16.0::DOUBLE))::INTEGER AS draws FROM m),
p AS (SELECT source, draws, mean / draws AS mu, 0 AS k, exp(-(mean / draws)) AS p, exp(-(mean / draws)) AS c FROM r
  UNION ALL SELECT source, draws, mu, k + 1, p * mu / (k + 1), c + p * mu / (k + 1) FROM p WHERE k < 95),
u AS (SELECT d.doc_id, d.source, j, ('0x' || substr(md5('1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source, LATERAL (SELECT unnest(range(1, r.draws + 1)) AS j)),
t AS (SELECT u.doc_id, sum((SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.c <= u.u))::BIGINT AS times FROM u GROUP BY u.doc_id),
e AS (SELECT doc_id, unnest(range(1, times + 1))::INTEGER AS copy FROM t)
SELECT d.*, e.copy, md5('1/order:' || d.doc_id || ':' || e.copy) AS order_key FROM documents d JOIN e USING (doc_id)
"""

OP8 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest),
h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]*)', 1)), '^www[.]', '') AS host,
  regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#:]*(?::[0-9]*)?([^#]*)', 1) AS rest FROM d)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to,
  array_to_string(list_reverse(string_split(h.host, '.')), ',') || ')' || CASE WHEN h.rest LIKE '/%' THEN h.rest ELSE '/' || h.rest END AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(((d.page_id % 1000000000) + 1000000000) % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM d LEFT JOIN f USING (payload_digest) JOIN h USING (page_id)
"""

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda e: e <> 0)) > 0
  AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93::DOUBLE),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_QUOTE = "[\"'']?"
_KEYS = "|".join(_any_case(w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))
_ASSIGN = rf"({_KEYS}){_QUOTE}\x20*[:=]\x20*{_QUOTE}([A-Za-z0-9+/_.=-]+)"
_WORDS = "(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})?"
_ALLOWED = f"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|{_WORDS}(?:[-_/=+]{_WORDS})*|[a-z]+(?:[A-Z][a-z]+)+[0-9]{{0,4}}|[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}"
_PLACEHOLDER = "[A-Za-z0-9]*(?i:example|placeholder|changeme|x{6}|0{8}|abcdefgh|01234567)[A-Za-z0-9]*"


def _found(text: str, pattern: str) -> str:
    """List of (start, text) of a pattern's matches; the texts between them give the places."""
    gaps, got = f"regexp_split_to_array({text}, '{pattern}')", f"regexp_extract_all({text}, '{pattern}')"
    return f"list_transform({got}, lambda m, i: {{'pos': list_sum(list_transform({gaps}[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform({got}[1:i - 1], lambda g: length(g))), 0), 'text': m}})"


_CLASSES = (("[0-9a-f]{20,}", 3.0), ("[0-9A-F]{20,}", 3.0), ("[A-Z0-9]{20,}", 3.5), ("[A-Za-z0-9]{20,}", 3.7), ("[A-Za-z0-9+/_=-]{20,}", 3.9))

OP7 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (
  SELECT doc_id, 0 AS kind, m.pos AS a, m.pos + length(m.text) AS b FROM (
    SELECT doc_id, unnest(list_zip({_found('text', _ASSIGN)}, regexp_extract_all(text, '{_ASSIGN}', 2))) AS z, z[1] AS m, z[2] AS v FROM t) WHERE length(v) >= 12
  UNION ALL SELECT doc_id, 1, m.pos, m.pos + length(m.text) FROM (SELECT doc_id, unnest({_found('text', 'AKIA[A-Z0-9]+')}) AS m FROM t) WHERE length(m.text) >= 18
  UNION ALL SELECT doc_id, 2, m.pos, m.pos + length(m.text) FROM (SELECT doc_id, unnest({_found('text', '[0-9a-f]+')}) AS m FROM (SELECT * FROM t WHERE regexp_matches(text, '[0-9a-f]{{16,}}'))) WHERE length(m.text) >= 16),
runs AS (SELECT doc_id, unnest({_found('text', '[A-Za-z0-9+/_=-]{20,}')}) AS m FROM t),
cut AS (SELECT doc_id, m.pos AS run_pos, regexp_split_to_array(m.text, '{_PLACEHOLDER}') AS parts, regexp_extract_all(m.text, '{_PLACEHOLDER}') AS holes FROM runs),
parts AS (
  SELECT doc_id, unnest(list_transform(parts, lambda p, i: {{'pos': run_pos + coalesce(list_sum(list_transform(parts[1:i - 1], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(holes[1:i - 1], lambda g: length(g))), 0), 'text': p}})) AS p FROM cut),
likely AS (SELECT doc_id, p.pos AS pos, p.text AS part FROM parts WHERE length(p.text) >= 20 AND NOT regexp_full_match(p.text, '{_ALLOWED}')),
strings AS ({" UNION ALL ".join(f"SELECT doc_id, pos, {i} AS class, {bits} AS bits, unnest({_found('part', pattern)}) AS c FROM likely" for i, (pattern, bits) in enumerate(_CLASSES))}),
windows AS (
  SELECT doc_id, class, pos + c.pos AS start, bits, c.text AS text, unnest(range(length(c.text) - 19)) AS i FROM strings WHERE NOT regexp_full_match(c.text, '{_ALLOWED}')),
hot AS (SELECT doc_id, class, start, i FROM windows WHERE list_entropy(string_split(substr(text, i + 1, 20), '')) >= bits - 1e-9),
steps AS (SELECT *, CASE WHEN i <= lag(i) OVER w + 20 THEN 0 ELSE 1 END AS new FROM hot WINDOW w AS (PARTITION BY doc_id, class, start ORDER BY i)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, class, start ORDER BY i) AS n FROM steps),
spans AS (SELECT DISTINCT doc_id, a, b FROM (SELECT doc_id, start + min(i) AS a, start + max(i) + 20 AS b FROM numbered GROUP BY doc_id, class, start, n)),
outside AS (SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id IS NOT DISTINCT FROM s.doc_id AND b.a <= s.a AND s.b <= b.b)),
breaks AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM outside),
joined AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a, b) AS n FROM breaks),
every AS (SELECT doc_id, kind, a, b FROM b UNION ALL SELECT doc_id, 3, min(a), max(b) FROM joined GROUP BY doc_id, n),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || a::BIGINT || ':' || b::BIGINT AS shown FROM every)
SELECT t.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(shown, ',' ORDER BY a, kind, b) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(shown, ',' ORDER BY a, kind, b), '') AS spans
FROM t LEFT JOIN named n ON n.doc_id IS NOT DISTINCT FROM t.doc_id GROUP BY t.doc_id
"""

ORACLES = {"op4_embedding_dedup": OP4, "op8_warc": OP8, "op10_mix_sources": OP10, "op3_exact_dedup": OP3, "op6_minhash_dedup": OP6, "op7_secrets": OP7, "op9_line_dedup": OP9}

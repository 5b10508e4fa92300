"""The operators that SQL can express, stated again for DuckDB."""

OP3 = r"""
WITH hexed AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, coalesce(octet_length(encode(text)), 0) AS n_bytes
  FROM documents
),
windows AS (
  SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS w
  FROM hexed, unnest(generate_series(0, n_bytes - 50)) AS t(p) WHERE n_bytes >= 50
),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
gone AS (SELECT doc_id, p FROM windows JOIN firsts USING (w) WHERE first < doc_id),
bytes AS (
  SELECT doc_id, p, substring(h, 2 * p + 1, 2) AS b
  FROM hexed, unnest(generate_series(0, n_bytes - 1)) AS t(p) WHERE n_bytes >= 1
),
marked AS (
  SELECT b.doc_id, b.p, b.b,
    coalesce(b.p - max(g.p) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS UNBOUNDED PRECEDING) < 50, false) AS removed
  FROM bytes b LEFT JOIN gone g ON g.doc_id = b.doc_id AND g.p = b.p
),
edges AS (
  SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM marked
),
totals AS (
  SELECT doc_id, count(*) FILTER (removed) AS n_removed, count(*) FILTER (begins) AS n_spans,
    coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT removed), '') AS kept
  FROM edges GROUP BY doc_id
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM hexed LEFT JOIN totals USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counts USING (vec_id)
"""

OP10 = r"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
windows AS (
  SELECT doc_id, p, array_to_string(words[p : p + 7], ' ') AS w
  FROM split, unnest(generate_series(1, len(words) - 7)) AS t(p) WHERE len(words) >= 8
),
twice AS (
  SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS next
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
),
repeated AS (SELECT doc_id, sum(least(8, coalesce(next - p, 8))) AS n FROM twice GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeated USING (doc_id)
),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM judged GROUP BY source),
prior AS (
  SELECT sum(f) / sum(n) AS mean, coalesce(var_samp(f / n), 0) - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * avg(1.0 / n) AS between
  FROM hosts
),
rates AS (
  SELECT source, CASE WHEN between > 0
    THEN (f + mean * greatest(mean * (1 - mean) / between - 1, 1e-6)) / (n + greatest(mean * (1 - mean) / between - 1, 1e-6))
    ELSE mean END AS rate
  FROM hosts, prior
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND rate <= 0.5 AS kept
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""

OP11 = r"""
WITH own AS (
  SELECT conv_id AS c, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS digest, octet_length(encode(coalesce(text, ''))) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || md5(coalesce(text, '')))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
lengths AS (SELECT c, max(i) AS n FROM own GROUP BY c),
steps AS (  -- each byte of the decimal id, and eight steps of one bit after it
  SELECT c, n, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS s
  FROM lengths
),
convs AS (
  SELECT c, n, c - c % 5 AS base,
    xor(list_reduce(s, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h
  FROM steps
),
taken AS (SELECT v.*, least(h, coalesce(b.n, 0)) AS t FROM convs v LEFT JOIN lengths b ON b.c = v.base),
rebuilt AS (
  SELECT v.c, o.i AS d, o.digest, o.bytes FROM taken v JOIN own o ON o.c = v.base AND o.i <= v.t
  UNION ALL
  SELECT v.c, v.t + o.i - v.h, o.digest, o.bytes FROM taken v JOIN own o ON o.c = v.c AND o.i > v.h
),
chains AS (
  SELECT c, d, bytes, string_agg(digest, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM rebuilt
  UNION ALL
  SELECT c, 0, 0, '' FROM lengths
),
nodes AS (SELECT path, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM chains GROUP BY path),
kin AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND left(k.path, 32 * n.depth::INT) = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth - 1)::INT)
),
sums AS (  -- what hangs below a node: nodes whose smallest member goes through it
  SELECT a.path, sum((k.n_children = 0)::INT) AS n_leaves, sum((k.n_convs - 1) * k.bytes) AS saved
  FROM kin k JOIN chains a ON a.c = k.conv_id AND a.d <= k.depth GROUP BY a.path
),
ends AS (
  SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
  FROM (SELECT *, max(d) OVER (PARTITION BY c) AS size FROM chains) WHERE d = size GROUP BY path
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM kin JOIN sums USING (path) LEFT JOIN ends USING (path)
"""

OP13 = r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents
),
tokens AS (
  SELECT doc, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM words, unnest(found) AS u(t)
),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM words),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, coalesce(t.total, 0) AS total, k.n AS lang_n, l.total AS lang_total, l.v
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
),
shares AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5))::HUGEINT // (total + 5 * v)::HUGEINT AS p,
    1 + (1000000000 * (lang_n + 5))::HUGEINT // (lang_total + 5 * v)::HUGEINT AS q
  FROM every
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
each AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM each)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES = {"op11_prefix_trie": OP11, "op13_source_divergence": OP13, "op3_substring_dedup": OP3, "op6_embedding_dedup": OP6, "op10_quality_rules": OP10}

"""SQL counterparts of the training-data queries, where SQL can express them on whole tables."""

ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
WITH tagless AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', chr(10), 'g'),
      '(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|hr|title|head|body|html|nav|header|footer|article|section|aside|main|table|tr|td|th|blockquote|pre|form)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS t
  FROM pages),
plain AS (
  SELECT page_id, host, replace(replace(replace(replace(replace(replace(replace(replace(t,
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t
  FROM tagless),
cut AS (
  SELECT page_id, host, list_filter(list_transform(string_split(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM plain),
placed AS (SELECT page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM cut),
-- Every line of a host with its number of pages; a page has a line if the line has a place in it.
spread AS (SELECT host, line, count(DISTINCT page_id) AS n_with FROM placed WHERE host <> '' GROUP BY ALL),
gone AS (
  SELECT s.host, s.line FROM spread s
  WHERE n_with > 1 AND n_with * 20 > (SELECT count(*) FROM cut c WHERE c.host = s.host)),
kept AS (
  SELECT p.page_id, count(*) AS n_left, string_agg(p.line, chr(10) ORDER BY place) AS text
  FROM placed p ANTI JOIN gone g ON g.host = p.host AND g.line = p.line GROUP BY p.page_id)
SELECT c.page_id, host, len(lines) AS n_lines, len(lines) - coalesce(n_left, 0) AS n_dropped, coalesce(k.text, '') AS text
FROM cut c LEFT JOIN kept k USING (page_id)""",
    "op2_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op11_exact_dedup": """
WITH plain AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
owners AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM plain JOIN owners USING (t)""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.id <> c.id AND a.id % 50 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place
  FROM scored WHERE same),
ranked AS (
  SELECT p.anchor_id, p.positive_id, n.id AS negative_id, p.positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3""",
    "op13_merkle_manifest": """
WITH RECURSIVE given AS (
  SELECT doc_id, lang, n_chars, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    -- CRC-32, bit by bit
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda k: 0::BIGINT)),
        lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS moved, crc % 7 = 0 AS tampered
  FROM given),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, level, i // 2, n),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2, n),
steps AS (
  SELECT p.doc_id, t.level, t.i, (p.i >> t.level) & 1 AS bit, (SELECT h FROM tree s WHERE s.lang IS NOT DISTINCT FROM t.lang AND s.level = t.level AND s.i = xor(t.i, 1)) AS sibling
  FROM placed p JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.i = p.i >> t.level AND t.n > 1
  UNION ALL
  SELECT p.doc_id, 1000 + t.level, t.i, (r.i >> t.level) & 1, (SELECT h FROM top s WHERE s.level = t.level AND s.i = xor(t.i, 1))
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN top t ON t.i = r.i >> t.level AND t.n > 1),
paths AS (
  SELECT doc_id, string_agg(coalesce(sibling, ''), '' ORDER BY level) AS proof, list({'h': coalesce(sibling, ''), 'bit': bit} ORDER BY level) AS path
  FROM steps GROUP BY doc_id),
folded AS (
  SELECT p.doc_id, p.leaf, r.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend({'h': CASE WHEN tampered THEN moved ELSE leaf END, 'bit': 0::BIGINT}, coalesce(path, [])),
      lambda node, x: {'h': sha256(CASE WHEN x.bit = 1 THEN x.h || node.h ELSE node.h || x.h END), 'bit': 0::BIGINT}).h AS folded_root
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang LEFT JOIN paths USING (doc_id))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded""",
}

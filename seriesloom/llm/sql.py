"""DuckDB statements for the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "op3_minhash_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r(node, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen
), m AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id
""",
    "op5_top_products": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
)
SELECT * FROM r WHERE rank <= 5
""",
    "op9_quality_cascade": f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), c AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM g WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, t, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(ls, lambda x: trim(x, {_WHITE}) <> '')) - len(list_distinct(list_filter(ls, lambda x: trim(x, {_WHITE}) <> ''))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_symbols > 10 * n_words
    OR 2 * n_dup_lines > len(ls) OR 10 * len(regexp_extract_all(t, '[0-9]')) > 3 * word_chars
    OR 10 * len(regexp_extract_all(t, '\\.\\.\\.')) > 3 * n_words) AS kept
FROM b
""",
    "op10_site_lines": f"""
WITH l AS (
  SELECT doc_id, source, k, line, trim(line, {_WHITE}) AS t
  FROM (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS k
        FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), s AS (
  SELECT source, count(*) AS total FROM documents GROUP BY source
), f AS (
  SELECT source, t FROM (SELECT DISTINCT doc_id, source, t FROM l WHERE t <> '') JOIN s USING (source)
  GROUP BY source, t, total HAVING count(*) >= 3 AND 100 * count(*) > 10 * total
), j AS (
  SELECT l.*, f.t IS NOT NULL AS hit FROM l LEFT JOIN f ON f.source = l.source AND f.t = l.t
), d AS (
  SELECT doc_id, count(*) FILTER (t <> '') AS n_lines,
    coalesce(bool_and(hit) FILTER (t <> ''), true) AS all_hit, count(*) FILTER (hit) AS n_hit,
    array_to_string(list(line ORDER BY k), chr(10)) AS full_text,
    array_to_string(list(line ORDER BY k) FILTER (NOT hit), chr(10)) AS rest
  FROM j GROUP BY doc_id
)
SELECT doc_id, n_lines::BIGINT AS n_lines, (CASE WHEN all_hit THEN 0 ELSE n_hit END)::BIGINT AS n_dropped,
  sha256(CASE WHEN all_hit THEN full_text ELSE rest END) AS kept_sha256
FROM d
""",
}

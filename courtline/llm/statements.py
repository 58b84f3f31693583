"""DuckDB statements for those operators of this subpackage that SQL can express, each by plain means."""

EXACT_DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM t
"""

PHRASES_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, row_number() OVER () AS piece_id
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
words AS (SELECT lang, piece_id, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM pieces),
runs AS (
  SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3
  FROM words WINDOW o AS (PARTITION BY piece_id ORDER BY pos)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, 1 AS size, w1 AS phrase, NULL AS h1, NULL AS t1, NULL AS h2, NULL AS t2, count(*) AS a
  FROM runs GROUP BY ALL HAVING count(*) >= 10
  UNION ALL
  SELECT lang, 2, w1 || ' ' || w2, w1, w2, NULL, NULL, count(*)
  FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
  UNION ALL
  SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2 || ' ' || w3, w1 || ' ' || w2, w3, count(*)
  FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
parts AS (
  SELECT lang, size, phrase, a, 1 AS k, h1 AS head, t1 AS tail FROM f WHERE size >= 2
  UNION ALL
  SELECT lang, size, phrase, a, 2, h2, t2 FROM f WHERE size = 3),
cuts AS (
  SELECT c.*, h.a AS l, t.a AS r, CAST((1000000::HUGEINT * c.a * c.a) // (h.a::HUGEINT * t.a) AS BIGINT) AS score
  FROM parts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
worst AS (
  SELECT * FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, h2 AS phrase, a FROM f WHERE size = 3 UNION ALL SELECT lang, t1, a FROM f WHERE size = 3)
  GROUP BY ALL),
kept AS (
  SELECT w.* FROM worst w LEFT JOIN longer b ON w.size = 2 AND b.lang = w.lang AND b.phrase = w.phrase
  WHERE b.longer IS NULL OR 100 * b.longer < 50 * w.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

FILL_IN_MIDDLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents),
d AS (
  SELECT doc_id, text, u, len(u) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(c1, c2)], '') AS prefix,
         array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS suffix
  FROM d)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

EMBEDDINGS_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.rid AS u, b.rid AS w
  FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach(rid, vec_id) AS (
  SELECT rid, vec_id FROM v
  UNION
  SELECT l.w, r.vec_id FROM reach r JOIN links l ON l.u = r.rid),
component AS (SELECT rid, min(vec_id) AS component_id FROM reach GROUP BY rid),
degree AS (SELECT u AS rid, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN component USING (rid) LEFT JOIN degree USING (rid)
"""

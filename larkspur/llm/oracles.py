"""DuckDB SQL of the queries of this subpackage that SQL can express."""

OP1 = r'''
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS src, source IS NULL AS nul,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), per0 AS (
  SELECT src, nul, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY nul, src) - 1) % 3) + 1] AS w
  FROM sized GROUP BY src, nul
), per1 AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap FROM per0
), per2 AS (
  SELECT *, row_number() OVER o AS rn,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM per1 WINDOW o AS (ORDER BY cap / w, nul, src)
), chosen AS (SELECT arg_min(lvl, rn) AS lvl FROM per2 WHERE lvl <= cap / w
), targets AS (
  SELECT src, source_size, coalesce(least(cap, (SELECT lvl FROM chosen) * w), cap) AS target FROM per2
), e AS (
  SELECT doc_id, s.src, size, source_size, target,
         CASE WHEN size > 0 AND source_size > 0 THEN least(2.0::DOUBLE, target * 1.0::DOUBLE / source_size) ELSE 0.0::DOUBLE END AS e,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':17'), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sized s JOIN targets USING (src)
), q AS (
  SELECT *, floor(e) AS whole, (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) AS q
  FROM e
), n AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY src) AS need,
         coalesce(sum(CASE WHEN e > whole THEN size END) OVER (PARTITION BY src ORDER BY (CASE WHEN e > whole THEN q END) NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM q
), c AS (
  SELECT *, (whole + CASE WHEN e > whole AND before + size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END)::BIGINT AS copies FROM n
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
'''

OP3 = r'''
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9::DOUBLE
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       least(e.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS kept
FROM embeddings e
'''

OP8 = r'''
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_of ON least_of.a = d.doc_id
'''

"""Oracle SQL (DuckDB) of the queries that SQL can express."""

OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || (doc_id IS NULL) || '|' || coalesce(source, 'null') || '|' || (source IS NULL) || '|' || coalesce(md5(text), 'null'))
             || '|' || row_number() OVER (PARTITION BY doc_id, source, text) || '|mix-1') AS k
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w,
         CAST(2 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total
  FROM sources),
ordered AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / w, w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS remaining,
         sum(w) OVER (ORDER BY cap / w, w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighted),
flagged AS (SELECT *, cap * rest <= remaining * w AS capped FROM ordered),
budget AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap ELSE (total - sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER ()) * w
              / sum(CASE WHEN capped THEN 0.0 ELSE w END) OVER () END AS target
  FROM flagged),
placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead,
         CASE WHEN b.source_size > 0 THEN CAST(floor(b.target) AS BIGINT) // b.source_size ELSE 0 END AS whole
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(CAST(floor(target) AS BIGINT) - whole * source_size - ahead, size)) AS BIGINT) AS taken
FROM placed
"""

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, CAST(least(e.vec_id, coalesce(l.m, e.vec_id)) AS BIGINT) AS component_id,
       e.vec_id <= coalesce(l.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""

OP12 = """
WITH paid AS (SELECT page_id, url, coalesce(html, '') AS p FROM pages),
least AS (SELECT p, min(page_id) AS first FROM paid WHERE strlen(p) >= 100 GROUP BY p)
SELECT page_id, CAST(strlen(paid.p) AS BIGINT) AS payload_bytes, sha256(paid.p) AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to,
       replace(replace(replace(replace(url, ' ', '%20'), chr(9), '%09'), chr(13), '%0D'), chr(10), '%0A') AS target_uri
FROM paid LEFT JOIN least ON least.p = paid.p
"""

OP13 = """
WITH tables AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda crc, k: xor(crc >> 1, 3988292384 * (crc & 1)), i)) AS t),
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 5 AS first,
         xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                         lambda crc, x: xor(crc >> 8, t[(xor(crc, x) & 255) + 1]), 4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns), tables),
made AS (
  SELECT v.c, 0 AS own, t.pos, role, text FROM convs v JOIN turns t ON t.c = v.first AND t.pos <= v.h
  UNION ALL SELECT v.c, 1, t.pos, role, text FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h),
steps AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, md5(md5(role) || md5(text)) AS k, strlen(text) AS n FROM made),
lengths AS (SELECT v.c, count(s.d) AS len FROM convs v LEFT JOIN steps s ON s.c = v.c GROUP BY v.c),
paths AS (
  SELECT c, d, n, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM steps
  UNION ALL SELECT c, 0, 0, 'root' FROM convs),
steps_up AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent FROM paths),
nodes AS (
  SELECT p.node, p.d, min(p.c) AS owner, count(*) AS m, min(p.n) AS n, min(p.parent) AS parent,
         string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (l.len = p.d) AS ends
  FROM steps_up p JOIN lengths l ON l.c = p.c GROUP BY p.node, p.d),
children AS (SELECT parent, count(*) AS k FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
under AS (
  SELECT up.node, CAST(sum((u.m - 1) * u.n) AS BIGINT) AS saved, count(*) FILTER (k.k IS NULL) AS leaves
  FROM nodes u JOIN paths up ON up.c = u.owner AND up.d <= u.d LEFT JOIN children k ON k.parent = u.node GROUP BY up.node)
SELECT v.owner AS conv_id, CAST(v.d AS BIGINT) AS depth, p.owner AS parent_conv_id, CAST(v.m AS BIGINT) AS n_convs,
       CAST(coalesce(k.k, 0) AS BIGINT) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, u.saved AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM nodes v JOIN under u ON u.node = v.node LEFT JOIN nodes p ON p.node = v.parent LEFT JOIN children k ON k.parent = v.node
"""

ORACLES = {"op1_near_vectors": OP1, "op3_mix_sources": OP3, "op5_top_k": OP5, "op12_warc": OP12, "op13_prefix_trie": OP13}

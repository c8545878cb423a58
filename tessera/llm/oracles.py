"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op7_decontamination"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS pat
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
spot AS (SELECT uid, w, unnest(range(1, len(w) + 1)) AS k FROM doc WHERE len(w) > 0),
hit AS (
  SELECT s.uid, s.k, z.n, win.item_id
  FROM spot s JOIN size z ON s.k + z.n - 1 <= len(s.w)
  JOIN win ON win.n = z.n AND win.pat = array_to_string(s.w[s.k : s.k + z.n - 1], ' ')),
cover AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(k, k + n)) AS p FROM hit) GROUP BY uid),
who AS (
  SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT uid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(h.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(h.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN cover c USING (uid) LEFT JOIN who h USING (uid)
"""

ORACLES["op5_neighbours"] = r"""
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(range(1, len(q.v) + 1), lambda k: q.v[k] * c.v[k]), lambda a, b: a + b) AS score
  FROM good q JOIN good c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

ORACLES["op2_perspectives"] = r"""
WITH clean AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, section ORDER BY turn, role, text) - 1) // 256 AS part
  FROM (SELECT conv_id, CAST(floor(turn / 64) AS BIGINT) AS section, coalesce(turn, 0) AS turn,
               coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
        FROM conversations)),
who AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM clean WHERE role <> 'system'),
line AS (
  SELECT conv_id, perspective, section, part, turn, role, text,
         CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
              ELSE '<|user name=' || role || '|>' END || chr(10) AS head,
         text || '<|end|>' || chr(10) AS body, CASE WHEN role = perspective THEN 1 ELSE 0 END AS mask
  FROM clean JOIN who ON conv_id IS NOT DISTINCT FROM c),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER w, 0) AS before
  FROM line
  WINDOW w AS (PARTITION BY conv_id, perspective, section, part ORDER BY turn, role, text
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, perspective, section, part, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY turn, role, text) AS rendered,
       string_agg(CAST(mask AS VARCHAR), ',' ORDER BY turn, role, text) AS masks,
       coalesce(string_agg(CASE WHEN mask = 1 THEN CAST(CAST(before + length(head) AS BIGINT) AS VARCHAR) || ':' ||
                CAST(CAST(before + length(head) + length(body) - 1 AS BIGINT) AS VARCHAR) END, ','
                ORDER BY turn, role, text), '') AS mask_spans
FROM placed GROUP BY conv_id, perspective, section, part
"""

ORACLES["op8_warc"] = r"""
WITH page AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         list_reduce(list_transform(range(8), lambda g: list_reduce(list_transform(range(4), lambda k:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + CAST((CAST('0x' || substr(sha1(encode(coalesce(html, ''))), 1 + g * 5, 5) AS BIGINT) >> (15 - 5 * k)) & 31 AS INTEGER), 1)),
           lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest
  FROM pages),
best AS (SELECT payload_digest, max(page_id) AS original FROM page GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN p.page_id IS NOT DISTINCT FROM b.original OR b.original IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM b.original THEN b.original END AS refers_to
FROM page p JOIN best b USING (payload_digest)
"""

ORACLES["op9_jaccard"] = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
gram AS (
  SELECT DISTINCT uid, array_to_string(w[k : k + 3], ' ') AS g
  FROM (SELECT uid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM doc WHERE len(w) > 0)),
size AS (SELECT uid, count(*) AS n FROM gram GROUP BY uid),
few AS (SELECT g FROM gram GROUP BY g HAVING count(*) > 1),
pairs AS (SELECT a.uid AS x, b.uid AS y, count(*) AS i FROM gram a JOIN few USING (g) JOIN gram b USING (g) WHERE a.uid <> b.uid GROUP BY ALL),
link AS (SELECT x, y FROM pairs JOIN size s ON s.uid = x JOIN size t ON t.uid = y WHERE 100 * i >= 85 * (s.n + t.n - i)),
reach AS (SELECT uid AS x, uid AS y FROM size UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
low AS (SELECT x AS uid, min(d.doc_id) AS component_id FROM reach JOIN doc d ON d.uid = y GROUP BY x)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
       CASE WHEN s.n IS NULL THEN d.doc_id ELSE l.component_id END AS component_id
FROM doc d LEFT JOIN size s USING (uid) LEFT JOIN low l USING (uid)
"""

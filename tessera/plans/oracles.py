"""DuckDB SQL for the engine's own queries."""

from __future__ import annotations

CAPACITY = 256
ORACLES: dict[str, str] = {}

_TOP = """
SELECT v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score
FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where}
ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id LIMIT {k}"""
ORACLES["vector_topk"] = _TOP.format(where="true", k=6)
ORACLES["vector_topk_most"] = _TOP.format(where="true", k=20)
ORACLES["vector_topk_eq"] = _TOP.format(where="label = 3", k=6)
ORACLES["vector_topk_in"] = _TOP.format(where="label IN (1, 4, 7)", k=6)
ORACLES["vector_topk_lines"] = _TOP.format(where="vec_id >= 100 AND vec_id + 9 <= 300", k=6)
ORACLES["must_contain"] = "SELECT doc_id, source AS file_path FROM documents WHERE contains(text, 'tion') AND contains(source, 'src1')"
ORACLES["unknown_sources"] = "SELECT s AS file_path FROM (VALUES ('src0'), ('src1'), ('nowhere'), ('elsewhere')) t(s) WHERE s NOT IN (SELECT source FROM documents)"

_LINES = "item AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_PACK = (
    "WITH RECURSIVE " + _LINES + """, step AS (
  SELECT doc_id, k, x, 1 AS g, length(x) + {extra} AS size FROM item WHERE k = 1
  UNION ALL
  SELECT i.doc_id, i.k, i.x, CASE WHEN s.size + length(i.x) + {extra} > 256 THEN s.g + 1 ELSE s.g END,
         CASE WHEN s.size + length(i.x) + {extra} > 256 THEN length(i.x) ELSE s.size + length(i.x) + {extra} END
  FROM step s JOIN item i ON i.doc_id = s.doc_id AND i.k = s.k + 1)
SELECT doc_id, CAST(g - 1 AS INTEGER) AS ordinal, string_agg(x, chr(10) ORDER BY k) AS chunk FROM step GROUP BY doc_id, g"""
)
ORACLES["line_pack_chunks"] = _PACK.format(extra=0)
ORACLES["force_line_split"] = _PACK.format(extra=1)
ORACLES["greedy_pack"] = (
    "WITH RECURSIVE " + _LINES + """, step AS (
  SELECT doc_id, k, 1 AS g, length(x) AS size, length(x) > 384 AS big FROM item WHERE k = 1
  UNION ALL
  SELECT i.doc_id, i.k, CASE WHEN length(i.x) > 384 OR s.big OR s.size + length(i.x) > 256 THEN s.g + 1 ELSE s.g END,
         CASE WHEN length(i.x) > 384 OR s.big OR s.size + length(i.x) > 256 THEN length(i.x) ELSE s.size + length(i.x) END,
         length(i.x) > 384
  FROM step s JOIN item i ON i.doc_id = s.doc_id AND i.k = s.k + 1)
SELECT doc_id, CAST(g - 1 AS INTEGER) AS ordinal, CAST(min(k) AS INTEGER) AS first_item, CAST(max(k) AS INTEGER) AS last_item, bool_or(big) AS oversized
FROM step GROUP BY doc_id, g"""
)
ORACLES["paragraph_overlap"] = (
    "WITH RECURSIVE " + _LINES + """, step AS (
  SELECT doc_id, k, CASE WHEN length(x) > 256 THEN [] ELSE [x] END AS cur, CASE WHEN length(x) > 256 THEN 0 ELSE length(x) END AS size,
         CASE WHEN length(x) > 256 THEN [x] ELSE []::VARCHAR[] END AS done
  FROM item WHERE k = 1
  UNION ALL
  SELECT i.doc_id, i.k,
    CASE WHEN length(i.x) > 256 THEN []
         WHEN s.size + length(i.x) > 256 AND len(s.cur) > 0 THEN CASE WHEN length(s.cur[-1]) + length(i.x) <= 256 THEN [s.cur[-1], i.x] ELSE [i.x] END
         ELSE list_append(s.cur, i.x) END,
    CASE WHEN length(i.x) > 256 THEN 0
         WHEN s.size + length(i.x) > 256 AND len(s.cur) > 0 THEN length(i.x) + CASE WHEN length(s.cur[-1]) + length(i.x) <= 256 THEN length(s.cur[-1]) ELSE 0 END
         ELSE s.size + length(i.x) END,
    CASE WHEN length(i.x) > 256 THEN list_append(CASE WHEN len(s.cur) > 0 THEN [array_to_string(s.cur, chr(10) || chr(10))] ELSE []::VARCHAR[] END, i.x)
         WHEN s.size + length(i.x) > 256 AND len(s.cur) > 0 THEN [array_to_string(s.cur, chr(10) || chr(10))]
         ELSE []::VARCHAR[] END
  FROM step s JOIN item i ON i.doc_id = s.doc_id AND i.k = s.k + 1),
made AS (
  SELECT doc_id, k, unnest(done) AS chunk, generate_subscripts(done, 1) AS j FROM step
  UNION ALL
  SELECT doc_id, k + 1, array_to_string(cur, chr(10) || chr(10)), 1
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS r FROM step) WHERE r = 1 AND len(cur) > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS INTEGER) AS ordinal, chunk FROM made"""
)
ORACLES["fixed_groups"] = (
    "WITH " + _LINES + """
SELECT doc_id, CAST((k - 1) // 20 AS INTEGER) AS ordinal, CAST(count(*) AS INTEGER) AS n_items, string_agg(x, '|' ORDER BY k) AS items
FROM item GROUP BY doc_id, (k - 1) // 20"""
)
_SECTIONS = """headed AS (SELECT doc_id, string_split('before' || chr(10) || '# ' || source || chr(10) || replace(text, chr(10), chr(10) || '## part' || chr(10)), chr(10)) AS l FROM documents),
line AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM headed),
flag AS (SELECT *, CAST(regexp_matches(x, '^#{1,6}\\s+.+$') AS INTEGER) AS h FROM line),
part AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM flag),
section AS (
  SELECT doc_id, g, CASE WHEN max(h) = 0 THEN 'Introduction' ELSE trim(regexp_extract(min_by(x, k), '^#{1,6}\\s+(.+)$', 1)) END AS title,
         CAST(CASE WHEN max(h) = 0 THEN 0 ELSE length(regexp_extract(min_by(x, k), '^(#{1,6})', 1)) END AS INTEGER) AS level,
         CAST(min(k) AS INTEGER) AS start_line, CAST(max(k) AS INTEGER) AS end_line, string_agg(x, chr(10) ORDER BY k) AS content
  FROM part GROUP BY doc_id, g)"""
ORACLES["md_sections"] = "WITH " + _SECTIONS + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS ordinal, title, level, start_line, end_line, content FROM section"
ORACLES["md_chunks"] = (
    "WITH RECURSIVE " + _SECTIONS + r""", item AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS k FROM section),
step AS (
  SELECT doc_id, k, 1 AS p, length(content) AS size, length(content) > 384 AS big FROM item WHERE k = 1
  UNION ALL
  SELECT i.doc_id, i.k, CASE WHEN length(i.content) > 384 OR s.big OR s.size + length(i.content) > 256 THEN s.p + 1 ELSE s.p END,
         CASE WHEN length(i.content) > 384 OR s.big OR s.size + length(i.content) > 256 THEN length(i.content) ELSE s.size + length(i.content) END,
         length(i.content) > 384
  FROM step s JOIN item i ON i.doc_id = s.doc_id AND i.k = s.k + 1),
made AS (
  SELECT doc_id, p, string_agg(content, chr(10) || chr(10) ORDER BY k) AS whole, min_by(title, k) AS section_title, min_by(level, k) AS section_level,
         string_agg(title, ' > ' ORDER BY k) AS section_hierarchy, string_agg(CAST(level AS VARCHAR), ',' ORDER BY k) AS header_levels,
         min(start_line) AS start_line, max(end_line) AS end_line, CASE WHEN bool_or(big) THEN true END AS is_partial
  FROM step JOIN item USING (doc_id, k) GROUP BY doc_id, p),
-- a section that is too large has two lines here, of which each is a piece
cut AS (SELECT *, unnest(CASE WHEN is_partial THEN string_split(whole, chr(10)) ELSE [whole] END) AS text,
               generate_subscripts(CASE WHEN is_partial THEN string_split(whole, chr(10)) ELSE [whole] END, 1) AS j FROM made)
SELECT * EXCLUDE (p, j, whole), CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, j) - 1 AS INTEGER) AS ordinal,
       CAST(len(regexp_extract_all(text, '[^\s\x{00a0}\x{2000}-\x{200a}\x{3000}]+')) AS INTEGER) AS word_count FROM cut"""
)
ORACLES["md_rich_metadata"] = r"""
WITH rich AS (SELECT doc_id, text || chr(10) || '- [ ] open' || chr(10) || '- [x] done' || chr(10) || '  - [X] nested' || chr(10) || '![pic](a.png) and [link](b)' || chr(10) ||
  '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || chr(10) || repeat('[more](x) ', doc_id % 5) AS t FROM documents),
c AS (SELECT doc_id, len(regexp_extract_all(t, '[^\s\x{00a0}\x{2000}-\x{200a}\x{3000}]+')) AS w, len(regexp_extract_all(t, '```[\s\S]*?```')) AS code, len(regexp_extract_all(t, '(?m)^[ \t]*- \[[ xX]\] ')) AS box,
  len(regexp_extract_all(t, '(?m)^[ \t]*- \[[xX]\] ')) AS yes, len(regexp_extract_all(t, '\[[^\]]+\]\([^)]+\)')) - len(regexp_extract_all(t, '!\[[^\]]+\]\([^)]+\)')) AS link,
  len(regexp_extract_all(t, '!\[[^\]]*\]\([^)]+\)')) AS image, len(regexp_extract_all(t, '(?m)^[ \t]*\|?(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*:?-*:?[ \t]*$')) AS tab FROM rich)
SELECT doc_id, CAST(w AS INTEGER) AS word_count, CAST(code AS INTEGER) AS code_block_count, CAST(box AS INTEGER) AS checkbox_count, CAST(link AS INTEGER) AS link_count,
  CAST(image AS INTEGER) AS image_count, CAST(tab AS INTEGER) AS table_count, CAST(yes AS INTEGER) AS checked_count, CAST(box - yes AS INTEGER) AS unchecked_count,
  code > 0 AS has_code_blocks, box > 0 AS has_checkboxes, link > 0 AS has_links, image > 0 AS has_images, tab > 0 AS has_tables FROM c"""
ORACLES["line_numbers"] = (
    _PACK.format(extra=0).replace("SELECT doc_id, CAST(g - 1", ", packed AS (SELECT doc_id, CAST(g - 1") + """),
asked AS (SELECT doc_id, ordinal, chunk FROM packed UNION ALL SELECT doc_id, CAST(max(ordinal) + 1 AS INTEGER), chr(2) || 'none' FROM packed GROUP BY doc_id),
c AS (SELECT doc_id, ordinal, text, chunk, strpos(text, chunk) AS p FROM asked JOIN documents USING (doc_id)),
n AS (SELECT *, length(substr(text, 1, p - 1)) - length(replace(substr(text, 1, p - 1), chr(10), '')) + 1 AS s, length(chunk) - length(replace(chunk, chr(10), '')) AS h FROM c)
SELECT doc_id, ordinal, CAST(CASE WHEN p > 0 THEN s ELSE 1 END AS INTEGER) AS start_line, CAST(CASE WHEN p > 0 THEN s + h ELSE 1 END AS INTEGER) AS end_line FROM n"""
)
ORACLES["json_array_groups"] = """
SELECT user_id, CAST((k - 1) // 50 AS INTEGER) AS ordinal, CAST(count(*) AS INTEGER) AS n_items, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS items
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) GROUP BY user_id, (k - 1) // 50"""
ORACLES["json_units"] = """
SELECT event_id AS doc_id, CAST(0 AS INTEGER) AS ordinal, '{' || chr(10) || '  "k": ' || (props ->> 'k') || chr(10) || '}' AS text,
       '$.k' AS json_path, 'k' AS json_key, 'int' AS json_type, CAST(3 AS INTEGER) AS end_line FROM events"""
ORACLES["header_code"] = """
SELECT p_partkey AS id, concat_ws(chr(10), '// File     : ' || p_name, '// Language : python', '// Symbol   : ' || p_brand, CASE WHEN p_size > 20 THEN '// Kind     : class' END,
  '// In       : ' || replace(p_brand, '#', ''), '// Summary  : ' || trim(p_type), '// Calls    : ' || replace(p_type, ' ', '') || ', x, yz, d, e') || chr(10) || chr(10) || 'body' || chr(10) || chr(10) || 'end' AS document FROM part"""
ORACLES["header_document"] = """
SELECT doc_id, concat_ws(' ', '[Document: doc' || doc_id || ']', CASE WHEN doc_id % 2 = 0 THEN '[Type: md]' END,
  CASE WHEN doc_id % 3 > 0 THEN '[Section: ' || repeat('#', doc_id % 7) || ' ' || source || ']' END) AS header FROM documents"""
ORACLES["header_structured"] = """
SELECT page_id, concat_ws(chr(10), '// File: ' || url, CASE WHEN page_id % 2 = 0 THEN '// JSON Path: $.a' END, CASE WHEN page_id % 3 = 0 THEN '// XML Path: /r/b' END) AS header FROM pages"""
ORACLES["symbol_names"] = """
WITH s AS (SELECT p_partkey, p_partkey % 6 AS m, p_size, replace(p_name, ' ', '_') AS n FROM part)
SELECT p_partkey, CASE m WHEN 0 THEN 'Cls' WHEN 1 THEN 'Name' WHEN 2 THEN 'name' WHEN 5 THEN 'Cls' ELSE 'run' END AS display_name,
  CASE m WHEN 0 THEN 'class' WHEN 1 THEN 'property' WHEN 2 THEN 'field' WHEN 5 THEN 'unknown' ELSE 'method' END AS inferred,
  CASE p_size WHEN 7 THEN 'class' WHEN 9 THEN 'constructor' WHEN 11 THEN 'enum' WHEN 12 THEN 'enum_member' WHEN 15 THEN 'field' WHEN 17 THEN 'function' WHEN 21 THEN 'interface' WHEN 26 THEN 'method'
    WHEN 29 THEN 'module' WHEN 30 THEN 'namespace' WHEN 41 THEN 'property' WHEN 49 THEN 'struct' WHEN 54 THEN 'type' WHEN 61 THEN 'variable' ELSE 'unknown' END AS label,
  CASE m WHEN 0 THEN 'Cls' WHEN 1 THEN 'Name' WHEN 2 THEN 'name' WHEN 3 THEN 'run()' WHEN 4 THEN 'run(+1)' ELSE '' END AS enclosing FROM s"""
ORACLES["classify_files"] = r"""
WITH p AS (SELECT page_id, '/src/' || regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') || ['.py', '.CS', '.json', '.csproj', '.md', '', '.zzz'][page_id % 7 + 1] AS p FROM pages),
n AS (SELECT page_id, string_split(p, '/')[-1] AS file_name FROM p),
s AS (SELECT page_id, file_name, lower(regexp_extract(file_name, '[^.](\.[^./]+)$', 1)) AS suffix FROM n)
SELECT page_id, suffix, file_name,
  CASE WHEN suffix IN ('.py', '.cs', '.html', '.htm') THEN 'code' WHEN suffix IN ('.json', '.csproj') THEN 'structured' WHEN suffix = '.md' THEN 'document' ELSE 'unknown' END AS file_type,
  CASE suffix WHEN '.py' THEN 'python' WHEN '.cs' THEN 'csharp' WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' END AS language,
  CASE WHEN suffix IN ('.py', '.cs', '.html', '.htm') THEN 'code' WHEN suffix = '.json' THEN 'json' WHEN suffix = '.csproj' THEN 'xml' WHEN suffix = '.md' THEN 'document' ELSE 'fallback' END AS parser FROM s"""
_OCC = """occ AS (SELECT user_id AS doc_ord, CAST(epoch(ts) AS BIGINT) AS start, event_id AS idx, event_type || '-' || (event_id % 97) AS symbol, event_type = 'signup' AS is_def FROM (SELECT *, date_trunc('second', ts) AS t FROM events))"""
_OCC = _OCC.replace("epoch(ts)", "epoch(t)")
_CALL = _OCC + """, def AS (SELECT doc_ord, start, arg_max(symbol, idx) AS caller FROM occ WHERE is_def GROUP BY doc_ord, start),
ref AS (SELECT o.doc_ord, o.idx, o.symbol, d.caller FROM (SELECT * FROM occ WHERE NOT is_def) o ASOF JOIN def d ON o.doc_ord = d.doc_ord AND o.start >= d.start)"""
ORACLES["enclosing_definition"] = "WITH " + _CALL + " SELECT doc_ord AS user_id, idx AS event_id, symbol, caller FROM ref"
_EDGE = _CALL + """, known AS (SELECT DISTINCT symbol FROM occ WHERE idx % 97 < 60),
edge AS (SELECT caller, symbol AS callee, min({'d': doc_ord, 'i': idx}) AS pos FROM ref WHERE symbol <> caller AND caller IN (FROM known) AND symbol IN (FROM known) GROUP BY 1, 2)"""
ORACLES["call_graph_edges"] = "WITH " + _EDGE + " SELECT caller, callee, pos.d AS first_doc, pos.i AS first_idx FROM edge"
ORACLES["callers_top10"] = "WITH " + _EDGE + """, k AS (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY pos.d, pos.i, caller) AS r FROM edge)
SELECT callee AS symbol, string_agg(caller, ', ' ORDER BY r) AS callers FROM k WHERE r <= 10 GROUP BY callee"""
ORACLES["symbol_range_lookup"] = """
WITH c AS (SELECT o_orderkey, o_custkey % 50 AS f, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 30 END AS e FROM orders),
y AS (SELECT c_custkey AS ord, c_name AS symbol, (c_custkey * 7919) % 3000 AS pos, c_custkey % 50 AS f FROM customer),
p AS (SELECT o_orderkey, symbol, row_number() OVER (PARTITION BY o_orderkey ORDER BY
   CASE WHEN e > 0 AND pos BETWEEN s AND e - 1 THEN 1 WHEN pos <= s THEN 2 ELSE 3 END,
   CASE WHEN e > 0 AND pos BETWEEN s AND e - 1 THEN pos WHEN pos <= s THEN -pos ELSE pos END, ord) AS r FROM c JOIN y USING (f))
SELECT c.o_orderkey, p.symbol FROM c LEFT JOIN p ON p.o_orderkey = c.o_orderkey AND r = 1"""
ORACLES["symbol_definitions"] = "WITH " + _OCC + """, sym AS (SELECT doc_ord, idx AS ord, symbol FROM occ WHERE idx % 3 = 0),
last AS (SELECT symbol, max({'d': doc_ord, 'o': ord}) AS m, min(doc_ord) AS first FROM sym GROUP BY symbol),
def AS (SELECT l.symbol, max({'d': o.doc_ord, 'i': o.idx, 's': o.start}) AS x FROM last l JOIN occ o ON o.symbol = l.symbol AND o.is_def AND o.doc_ord >= l.first GROUP BY l.symbol)
SELECT l.symbol, l.m.d AS doc_ord, l.m.o AS ord, x.s AS start, x.s + 1 AS "end" FROM last l LEFT JOIN def USING (symbol)"""
_CHUNK = "c AS (SELECT source AS file_path, CASE WHEN doc_id % 4 > 0 THEN lang END AS language, CASE WHEN doc_id % 5 = 0 THEN 'class' ELSE '' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'code' END AS chunk_type FROM documents)"
ORACLES["list_sources"] = "WITH " + _CHUNK + """
SELECT DISTINCT facet, value FROM (SELECT 'sources' AS facet, file_path AS value FROM c UNION ALL SELECT 'languages', language FROM c UNION ALL SELECT 'kinds', kind FROM c UNION ALL SELECT 'chunk_types', chunk_type FROM c) WHERE value <> ''"""
ORACLES["stats_counts"] = "WITH " + _CHUNK + """
SELECT facet, value, count(*) AS n FROM (SELECT 'chunk_type' AS facet, coalesce(chunk_type, 'unknown') AS value FROM c UNION ALL SELECT 'language', language FROM c UNION ALL SELECT 'kind', kind FROM c) WHERE value <> '' GROUP BY 1, 2"""
ORACLES["chunks_per_file"] = "SELECT source AS file_path, count(*) AS chunk_count FROM documents GROUP BY source"
ORACLES["list_documents"] = "SELECT count(DISTINCT source) AS total_documents, count(*) AS total_chunks FROM documents"
ORACLES["lower_path_batches"] = """
SELECT (k - 1) // 100 AS batch_index, count(*) AS files_processed, min(page_id) AS first_page
FROM (SELECT page_id, row_number() OVER (ORDER BY lower(url), page_id) AS k FROM pages) GROUP BY 1"""
ORACLES["registry_ids"] = "SELECT page_id, sha256(url) AS doc_id, substr(sha256(html), 1, 16) AS file_hash, CAST(octet_length(encode(html)) AS INTEGER) AS file_size FROM pages"
ORACLES["xml_chunks"] = r"""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
item AS (SELECT doc_id, 1 AS k, 'lang' AS tag, '<lang>x</lang>' AS c FROM documents
  UNION ALL SELECT doc_id, k + 1, 'p', CASE WHEN x = '' THEN '<p />' ELSE '<p>' || replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' END FROM raw),
step AS (
  SELECT doc_id, k, 1 AS p, length(c) AS size, length(c) > 384 AS big FROM item WHERE k = 1
  UNION ALL
  SELECT i.doc_id, i.k, CASE WHEN length(i.c) > 384 OR s.big OR s.size + length(i.c) > 256 THEN s.p + 1 ELSE s.p END,
         CASE WHEN length(i.c) > 384 OR s.big OR s.size + length(i.c) > 256 THEN length(i.c) ELSE s.size + length(i.c) END, length(i.c) > 384
  FROM step s JOIN item i ON i.doc_id = s.doc_id AND i.k = s.k + 1)
SELECT doc_id, CAST(p - 1 AS INTEGER) AS ordinal, string_agg(c, chr(10) ORDER BY k) AS text,
       CASE WHEN count(DISTINCT tag) = 1 THEN '/doc/' || min(tag) ELSE '/doc/{' || string_agg(tag, ',' ORDER BY k) || '}' END AS xml_path,
       CASE WHEN count(DISTINCT tag) = 1 THEN min(tag) ELSE string_agg(tag, ',' ORDER BY k) END AS xml_tag,
       CASE WHEN bool_or(big) THEN 'xml_split' ELSE 'structured' END AS chunk_type, CAST(CASE WHEN NOT bool_or(big) THEN count(*) END AS INTEGER) AS tag_count,
       CASE WHEN bool_or(big) THEN true END AS is_partial
FROM step JOIN item USING (doc_id, k) GROUP BY doc_id, p"""
ORACLES["json_chunks"] = r"""
WITH part AS (SELECT doc_id, '  "doc_id": ' || doc_id AS a, '  "lang": ' || to_json(lang) AS b,
  '  "lines": [' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: '    ' || to_json(x)), ',' || chr(10)) || chr(10) || '  ]' AS c FROM documents),
size AS (SELECT *, length(a) + length(b) + 8 AS head, length(c) + 4 AS body FROM part),
made AS (
  SELECT doc_id, 0 AS ordinal, '{' || chr(10) || a || ',' || chr(10) || b || ',' || chr(10) || c || chr(10) || '}' AS text, '$.{doc_id,lang,lines}' AS json_path, 'structured' AS chunk_type, NULL AS is_partial
  FROM size WHERE body <= 384 AND head + body <= 256
  UNION ALL SELECT doc_id, 0, '{' || chr(10) || a || ',' || chr(10) || b || chr(10) || '}', '$.{doc_id,lang}', 'structured', NULL FROM size WHERE body > 384 OR head + body > 256
  UNION ALL SELECT doc_id, 1, '{' || chr(10) || c || chr(10) || '}', '$.lines', CASE WHEN body > 384 THEN 'json_split' ELSE 'structured' END, CASE WHEN body > 384 THEN true END
  FROM size WHERE body > 384 OR head + body > 256)
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, text, json_path, chunk_type, is_partial, CAST(NULL AS VARCHAR) AS array_range FROM made"""

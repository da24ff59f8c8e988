"""DuckDB SQL for the queries of catalogue_more.py, written against the tables and not against the operators."""

from __future__ import annotations

from .oracles import _CHANGE, _NEW, _STOP

SQL: dict[str, str] = {}

_MD = "'## Doc ' || doc_id || chr(10) || chr(10) || replace(text, 'the', CASE doc_id % 3 WHEN 0 THEN '**the**' WHEN 1 THEN '`the`' ELSE '[the](u/v)' END)"
_BARE = "regexp_replace(trim(x), '^#{1,6}\\s+', '')"
_BARE = f"regexp_replace({_BARE}, '`([^`]*)`', '\\1', 'g')"
_BARE = f"regexp_replace({_BARE}, '\\[(.*?)\\]\\((.*?)\\)', '[\\1]', 'g')"
_BARE = f"regexp_replace({_BARE}, '\\*\\*|__|\\*', '', 'g')"
SQL["markdown_to_plain"] = f"SELECT doc_id, sha256(regexp_replace(array_to_string(list_transform(string_split({_MD}, chr(10)), lambda x: {_BARE}), chr(10)), '^\\s+|\\s+$', '', 'g') || chr(10)) AS plain_sha256 FROM documents"
SQL["frontmatter_fields"] = "SELECT p_partkey, p_name AS title, 'part' AS kind, 'About ' || p_name AS body FROM part"
SQL["title_forms"] = "SELECT p_partkey, p_name AS core, '第' || p_size || '条' AS reference, 'c' || p_partkey || ' ' || p_name AS chunk_title FROM part"
SQL["value_forms"] = """
SELECT p_partkey, p_brand || '|' || p_type AS aliases, p_size % 4 IN (0, 2, 3) AS flag, regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS number,
       lower(p_name) || ' x' AS cache_key, '\\*' || p_name || '\\_\\[1\\]' AS escaped FROM part
"""
SQL["normalized_queries"] = """
SELECT * FROM (VALUES ('a', '第十二条 是什么', '第12条', '第十二条 是什么', '第十二条 是什么'), ('b', 'abc (x),的 钢筋', '', 'abc|(x),|钢筋', 'abc (x),的 钢筋|abc|(x),|钢筋'),
  ('c', '什么', '', '什么', '什么'), ('d', '第二百零五條与第3条', '第3条', '第二百零五條', '第二百零五條与第3条|第二百零五條'), ('e', '', '', '', '')) AS v(query_id, normalized, article_terms, title_terms, alias_terms)
"""
SQL["shard_names"] = "SELECT * FROM (VALUES ('con', 'U0063-006F-006E'), ('ab', 'ab'), ('a b', 'U0061-0020-0062'), ('', '_EMPTY'), ('x/y', 'U0078-002F-0079'), ('LPT1', 'U004C-0050-0054-0031'), ('é.', 'U00E9-002E')) AS v(shard, file)"
SQL["heading_positions"] = """
WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents),
h AS (SELECT doc_id, unnest(range(0, (n - 1) // 5 + 1)) AS k FROM d),
l AS (SELECT doc_id, k, k % 3 AS level, k - k % 3 AS root FROM h)
SELECT doc_id, 'h' || 5 * k AS at, array_to_string([('h' || 5 * (root + j)) FOR j IN range(0, level + 1)], '>') AS stack FROM l
"""
SQL["chapter_toc"] = """
WITH c AS (SELECT conv_id, role, 'c' || lpad(turn::VARCHAR, 4, '0') AS chunk_id, turn FROM conversations)
SELECT conv_id AS doc_id, role AS chapter, arg_min(chunk_id, turn) AS first, arg_max(chunk_id, turn) AS last, count(*) AS chunks FROM c GROUP BY ALL
"""
SQL["aligned_texts"] = """
WITH a AS (SELECT doc_id, text, instr(text, 'the') AS i FROM documents),
b AS (SELECT *, CASE WHEN i > 0 THEN i + 2 ELSE 0 END AS done FROM a),
c AS (SELECT *, instr(substr(text, done + 1), 'tion') AS j FROM b),
e AS (SELECT *, CASE WHEN j > 0 THEN done + j + 3 ELSE done END AS done2 FROM c),
f AS (SELECT *, instr(substr(text, done2 + 1), 'the') AS k FROM e)
SELECT doc_id, i - 1 AS at0, CASE WHEN j > 0 THEN done + j - 1 ELSE -1 END AS at1, CASE WHEN k > 0 THEN done2 + k - 1 ELSE -1 END AS at2 FROM f
"""
SQL["chunk_lengths"] = """
WITH n AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0), o AS (SELECT doc_id, n, unnest(range(0, (n - 1) // 100 + 1)) AS k FROM n)
SELECT doc_id, k + 1 AS ordinal, 100 * k AS char_start, least(100 * k + 100, n) AS char_end FROM o
"""
SQL["reference_edges"] = "SELECT DISTINCT a.p_brand AS doc_id, 'a' || a.p_partkey AS from_node_id, 'a' || b.p_partkey AS to_node_id FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_size = a.p_size + 1"
SQL["title_mention_edges"] = """
SELECT 'ca' || a.p_partkey AS from_node_id, 'a' || b.p_partkey AS to_node_id FROM part a JOIN part b ON a.p_brand = b.p_brand
WHERE list_contains(list_concat(['about'], string_split(a.p_name, ' ')), string_split(b.p_name, ' ')[1])
"""
SQL["alias_expansion"] = """
WITH w AS (SELECT * FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS t FROM part) WHERE NOT list_contains(STOP, t)),
h AS (SELECT DISTINCT t, replace(p_name, ' ', '') AS alias FROM part JOIN w ON contains(p_name, t))
SELECT t AS query_id, alias, n FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY alias) AS n FROM h) WHERE n <= 3
""".replace("STOP", _STOP)
SQL["edge_upsert"] = "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.5 END AS confidence, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders GROUP BY 1"
SQL["structural_routes"] = """
WITH p AS (SELECT * FROM part), q AS (SELECT DISTINCT p_size FROM p)
SELECT '第' || q.p_size || '条' AS query_id, 'a' || p_partkey AS item, row_number() OVER (PARTITION BY q.p_size ORDER BY p_brand, p_partkey) AS rank FROM q JOIN p USING (p_size)
"""
SQL["double_hits"] = "SELECT lang AS query_id, doc_id AS ref_path, row_number() OVER (PARTITION BY lang ORDER BY contains(text, 'license') DESC, doc_id) AS pos FROM documents"
SQL["candidate_files"] = """
SELECT DISTINCT lang AS query_id, source || '.md' AS ref_path FROM documents d WHERE n_chars > 2000
AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = d.lang AND e.source = d.source AND contains(e.text, 'license'))
"""
SQL["point_lookup"] = """
WITH a AS (SELECT * FROM (VALUES (7, 0::BIGINT), (4, 1), (1, 2)) AS v(k, asked))
SELECT k::VARCHAR AS node_id, lpad(max(o_orderkey)::VARCHAR, 12, '0') AS source_version, asked FROM orders JOIN a ON o_custkey = k WHERE o_orderstatus <> 'F' GROUP BY k, asked
"""
SQL["pruned_weights"] = "SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE NOT ((value - 10) / 1000 < 0.01 AND ts < TIMESTAMP '2024-01-22 00:00:00')"

_NODES = "SELECT s_nationkey AS doc_id, 'v' || n_regionkey AS v, n_regionkey, n_name, s_suppkey, 's' || s_suppkey AS node_id, s_suppkey % 4 AS ordinal, s_name, s_acctbal > 0 AS active FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_PATH = "'canonical_text/' || n_nationkey || '--v' || n_regionkey || '.txt'"
SQL["canonical_manifest"] = f"""
WITH t AS (SELECT doc_id, string_agg(s_name, chr(10) || chr(10) ORDER BY ordinal, s_name || '.md') || chr(10) AS text FROM ({_NODES}) WHERE active GROUP BY doc_id)
SELECT n_nationkey AS doc_id, n_name AS title, '(unknown)' AS source_file, n_regionkey <> 2 AS active_version, {_PATH} AS canonical_text_path, sha256(coalesce(text, chr(10))) AS canonical_text_sha256
FROM nation LEFT JOIN t ON doc_id = n_nationkey
"""
SQL["export_locators"] = f"SELECT 's' || s_suppkey AS node_id, s_nationkey AS doc_id, s_name || '.md' AS ref_path, {_PATH} AS canonical_text_path, n_name AS doc_title FROM supplier JOIN nation ON s_nationkey = n_nationkey"
SQL["export_children"] = f"SELECT 'p' || s_suppkey % 10 AS parent_id, row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY ordinal, node_id) AS pos, node_id FROM ({_NODES}) WHERE active AND n_regionkey <> 2"
SQL["active_parsers"] = f"""
SELECT doc_id, v AS source_version, CASE WHEN bool_or(s_suppkey % 7 = 0) THEN 'outline' WHEN bool_or(s_suppkey % 5 = 0) THEN 'markdown_headings' ELSE 'block_fallback' END AS active_parser
FROM ({_NODES}) WHERE active GROUP BY ALL
"""
SQL["corpus_view"] = f"SELECT node_id, n_name AS doc_title, s_name || chr(10) AS plain FROM ({_NODES})"
SQL["edge_fingerprints"] = """
SELECT 'next|' || n_name || '|' || n_regionkey AS id, sha256('{"confidence":1,"edge_type":"next","from_node_id":"' || n_name || '","to_node_id":"' || n_regionkey || '"}') AS fingerprint FROM nation
"""
SQL["documents_as_markdown"] = """
WITH d AS (SELECT * FROM nation WHERE contains(lower(n_name), 'n_1'))
SELECT '# Docs' || chr(10) || chr(10) || '- query: `N_1`' || chr(10) || '- hits: ' || count(*) || chr(10) || chr(10) || '| doc_id | 标题 | 源文件 | 目录 |' || chr(10) || '|---|---|---|---|' || chr(10) ||
       string_agg('| `' || n_nationkey || '` | ' || n_name || ' | `' || lower(n_name) || '.md` | `references/' || n_nationkey || '/toc.md` |' || chr(10), '' ORDER BY n_name, n_nationkey::VARCHAR) AS markdown FROM d
"""
SQL["files_as_markdown"] = """
SELECT '# Files' || chr(10) || chr(10) || '- pattern: `^nation_2`' || chr(10) || '- hits: ' || count(*) || chr(10) || chr(10) || string_agg('- `n/' || lower(n_name) || '`' || chr(10), '' ORDER BY 'n/' || lower(n_name)) AS markdown
FROM (SELECT DISTINCT n_name FROM nation WHERE lower(n_name) LIKE 'nation\\_2%' ESCAPE '\\')
"""
SQL["bodies_from_files"] = "SELECT 's' || s_suppkey AS node_id, 'Body of ' || s_name || chr(10) AS body_md FROM supplier"

# Chunks by recursion: the first separator that occurs in reach, at its last occurrence. No document here has a table or fenced code.
_SEPARATORS = ("'。'", "'！'", "'？'", "'. '", "'! '", "'? '", "chr(10) || chr(10)", "chr(10)", "' '")
_REACH = "substr(text, hi + 1, 1800 + length({s}))"
_LAST = ", ".join("CASE WHEN strpos(reverse({r}), reverse({s})) > 0 THEN hi + length({r}) - strpos(reverse({r}), reverse({s})) + 1 END".format(r=_REACH.format(s=s), s=s) for s in _SEPARATORS)
_CHUNKS = f"""
WITH RECURSIVE c(doc_id, text, n, lo, hi) AS (
  SELECT doc_id, text, length(text), 0::BIGINT, 0::BIGINT FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, text, n, hi, CASE WHEN hi + 1800 >= n THEN n ELSE coalesce({_LAST}, hi + 1800) END FROM c WHERE hi < n),
p AS (SELECT doc_id, lo, substr(text, lo + 1, hi - lo) AS piece FROM c WHERE hi > 0),
t AS (SELECT doc_id, lo + length(piece) - length(regexp_replace(piece, '^\\s+', '')) AS a, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS bare FROM p)
"""
_CHUNK = f"{_CHUNKS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a))::INT AS ordinal, a::INT AS char_start, (a + length(bare))::INT AS char_end, bare AS text FROM t WHERE bare <> ''"
SQL["chunk_document"] = _CHUNK
SQL["chunk_statistics"] = f"SELECT doc_id, count(*) AS chunks, avg(length(text)) AS avg_chars, min(length(text))::INT AS min_chars, max(length(text))::INT AS max_chars FROM ({_CHUNK}) GROUP BY doc_id"

_COUNTED = """
SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]{2,}'), lambda x: lower(x))) AS word FROM documents)
WHERE NOT list_contains(STOP, word) GROUP BY ALL HAVING count(*) >= 2
""".replace("STOP", _STOP)
# The greedy choice by recursion over each document's words in order.
SQL["keywords_greedy"] = f"""
WITH RECURSIVE o AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(word) DESC, word) AS k FROM ({_COUNTED})),
g(doc_id, k, chosen) AS (
  SELECT doc_id, 0::BIGINT, []::VARCHAR[] FROM documents
  UNION ALL
  SELECT g.doc_id, o.k, CASE WHEN len(list_filter(chosen, lambda c: length(c) > length(word) AND contains(c, word))) > 0 THEN chosen ELSE list_append(chosen, word) END
  FROM g JOIN o ON o.doc_id = g.doc_id AND o.k = g.k + 1 WHERE len(chosen) < 8)
SELECT doc_id, arg_max(chosen, k) AS keywords FROM g GROUP BY doc_id
"""

# Every line stands alone there, since line feeds are doubled; no line is an underline.
SQL["heading_inference"] = r"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
b AS (SELECT *, trim(line) AS bare, regexp_extract(trim(line), '^([0-9]+(?:\.[0-9]+)+)\s+\S', 1) AS number FROM l),
h AS (SELECT doc_id, i, CASE WHEN bare = '' THEN '' WHEN starts_with(bare, '#') THEN rtrim(line)
        WHEN regexp_matches(bare, '(?i)^Chapter\s+') OR regexp_matches(bare, '^第[一二三四五六七八九十百千万0-9]+[章节篇部]') THEN '# ' || bare
        WHEN number <> '' THEN repeat('#', least(6, len(string_split(number, '.')))::INT) || ' ' || bare
        WHEN length(bare) < 60 AND NOT regexp_matches(bare, '^[-*•·]\s|^[0-9]+\.\s') THEN '### ' || bare ELSE rtrim(line) END AS t FROM b),
p AS (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start, regexp_extract(t, '^(#{1,6})\s+\S', 1) AS mark FROM h)
SELECT doc_id, length(mark) AS level, trim(regexp_replace(t, '^#{1,6}\s+', '')) AS title, char_start FROM p WHERE mark <> ''
"""
SQL["normalized_questions"] = """
WITH q AS (SELECT p_partkey AS k, lower(p_name) AS name, p_partkey % 3 > 0 AS cited, p_size::VARCHAR AS size FROM part),
n AS (SELECT *, CASE WHEN cited THEN '第' || translate(size, '123456789', '一二三四五六七八九') || '條' ELSE '' END || '的 ' || name || ', (' || k || ') 是什么' AS normalized,
             replace(name, ' ', '|') || ',|(' || k || ')' AS title FROM q)
SELECT k AS query_id, normalized, CASE WHEN cited THEN '第' || right(rtrim(size, '0'), 1) || '条' ELSE '' END AS article_terms, title AS title_terms, normalized || '|' || title AS alias_terms FROM n
"""
SQL["cjk_tokens_of_names"] = """
WITH t AS (SELECT p_partkey, string_split(translate(p_name, 'abcdefghijklmnopqrstuvwxyz', '天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余'), ' ') AS runs FROM part)
SELECT p_partkey, array_to_string(flatten(list_transform(runs, lambda r: list_concat(CASE WHEN length(r) BETWEEN 2 AND 6 THEN [r] ELSE [] END,
       CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i::INT, 2)) END))), ' ') AS tokens FROM t
"""
SQL["shard_files"] = """
WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name[1:5] WHEN 1 THEN p_brand[1:6] WHEN 2 THEN 'com' || p_partkey % 12 ELSE '' END AS s FROM part)
SELECT p_partkey, CASE WHEN s = '' THEN '_EMPTY' WHEN contains(s, ' ') OR regexp_full_match(s, 'com[1-9]') THEN 'U' || array_to_string(list_transform(string_split(s, ''), lambda c: printf('%04X', ascii(c))), '-') ELSE s END AS file FROM s
"""

_OF_NEW = _CHUNK.replace("FROM documents WHERE text <> ''", f"FROM ({_NEW}) WHERE text <> ''")
SQL["incremental_rebuild"] = f"""
WITH ch AS ({_CHANGE}), k AS ({_OF_NEW})
SELECT ch.doc_id, change, source, count(k.ordinal) AS chunks, coalesce(sum(k.char_end - k.char_start), 0)::BIGINT AS chars, max(sha256(k.text)) FILTER (k.ordinal = m.last) AS last_sha256
FROM ch LEFT JOIN ({_NEW}) n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, max(ordinal) AS last FROM k GROUP BY doc_id) m USING (doc_id) GROUP BY ALL
"""
SQL["extracted_files"] = """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN repeat('#', (p_size % 3 + 1)::INT) || ' ' || p_name || chr(10) || chr(10) || p_type || chr(10) WHEN 1 THEN p_name || chr(10) || p_type END AS text,
       CASE p_partkey % 4 WHEN 2 THEN 'not a DOCX document' WHEN 3 THEN 'f' || p_partkey || '.bin' END AS error FROM part
"""

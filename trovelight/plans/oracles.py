"""DuckDB SQL for the queries of catalogue.py, written against the tables and not against the operators."""

from __future__ import annotations

from ..functions.constants import ENGLISH_STOP_WORDS

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(ENGLISH_STOP_WORDS)) + "]"


def _tokens(column: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({column}, '[A-Za-z0-9_]{{2,}}'), lambda x: lower(x)), lambda x: NOT list_contains({_STOP}, x))"


def _terms(column: str) -> str:
    return f"list_filter(flatten(list_transform({_tokens(column)}, lambda x: string_split(x, '_'))), lambda x: x <> '')"


ORACLES: dict[str, str] = {}

ORACLES["fts_tokens"] = f"SELECT doc_id, len(t)::BIGINT AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)"
_POST = f"SELECT doc_id, unnest({_terms('text')}) AS term FROM documents"
ORACLES["fts_token_df"] = f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM ({_POST}) GROUP BY term"
ORACLES["doc_lengths"] = f"SELECT 'd' || lpad(doc_id::VARCHAR, 8, '0') AS node_key, len({_terms('text')})::BIGINT AS dl FROM documents"
ORACLES["cjk_bigrams_literals"] = """
WITH v(id, runs) AS (VALUES (1::BIGINT, ['预应力混凝土']), (2, ['梁']), (3, ['钢筋']), (4, ['预应力混凝土结构设计规范']), (5, ['钢筋', '混凝土']), (6, []::VARCHAR[]))
SELECT id, coalesce(array_to_string(flatten(list_transform(runs, lambda r: list_concat(CASE WHEN length(r) BETWEEN 2 AND 6 THEN [r] ELSE [] END,
       CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i::INT, 2)) END))), ' '), '') AS tokens FROM v
"""
ORACLES["occurrences"] = "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n_the, ((length(text) - length(replace(text, 'onon', ''))) // 4)::BIGINT AS n_onon FROM documents"
ORACLES["keyword_frequency"] = f"SELECT lang, word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT lang, doc_id, unnest({_tokens('text')}) AS word FROM documents) GROUP BY ALL"


def _bm25(optional: str, required: str, tail: str) -> str:
    """optional, required: lists of tokens of a benchmark text. Tokens with an underscore don't occur there."""
    return f"""
WITH post AS ({_POST}),
tf AS (SELECT doc_id, term, count(*) AS f FROM post GROUP BY ALL),
dl AS (SELECT doc_id, len({_terms('text')}) AS dl, lang, source FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, {optional} AS o, {required} AS r, coalesce({_tokens('text')}[1], '') AS first FROM benchmark),
ph AS (SELECT item_id, unnest(o) AS term, false AS req FROM q UNION ALL SELECT item_id, unnest(r), true FROM q),
need AS (SELECT item_id, count(*) FILTER (req) AS nr, count(*) FILTER (NOT req) AS no FROM ph GROUP BY item_id),
sc AS (SELECT ph.item_id, tf.doc_id, count(*) FILTER (req) AS hr, count(*) FILTER (NOT req) AS ho,
              -sum(round(greatest(ln((n - df + 0.5) / (df + 0.5)), CASE WHEN (n - df + 0.5) / (df + 0.5) > 1 THEN 0 ELSE 1e-6 END) * (0.4 * f * 2.2) / (0.4 * f + 1.2 * (0.25 + 0.75 * dl / avgdl)) * 1125899906842624)::BIGINT) / 1125899906842624.0 AS score
       FROM ph JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
good AS (SELECT sc.* FROM sc JOIN need USING (item_id) WHERE hr = nr AND (no = 0 OR ho > 0)),
rk AS (SELECT good.item_id AS query_id, good.doc_id, score, row_number() OVER (PARTITION BY good.item_id ORDER BY score,
         CASE WHEN first <> '' AND contains(lower(lang), first) THEN 0 ELSE 1 END, CASE WHEN first <> '' AND contains(lower(source), first) THEN 0 ELSE 1 END, good.doc_id) AS rank
       FROM good JOIN dl USING (doc_id) JOIN q ON q.item_id = good.item_id)
{tail}"""


_DISTINCT = f"list_transform(list_sort(list_transform(list_distinct({_tokens('text')}), lambda x: struct_pack(p := list_position({_tokens('text')}, x), t := x))), lambda s: s.t)"
_SOME = f"list_slice({_DISTINCT}, 1, 64)"
_MUST = f"list_distinct({_tokens('string_split(text, chr(32))[1]')})"
_EVERY = f"flatten(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: list_distinct({_tokens('w')})))"
_TOP = "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM rk WHERE rank <= 20"
ORACLES["bm25_topk_or"] = _bm25(_SOME, "[]::VARCHAR[]", _TOP)
ORACLES["bm25_topk_and"] = _bm25("[]::VARCHAR[]", _EVERY, _TOP)
ORACLES["bm25_must_terms"] = _bm25(_SOME, _MUST, _TOP)
ORACLES["search_cascade_level"] = f"""
WITH post AS (SELECT DISTINCT doc_id, term FROM ({_POST})),
q AS (SELECT item_id, {_SOME} AS o, {_EVERY} AS e, {_MUST} AS m FROM benchmark),
l AS (SELECT item_id, 1 AS level, list_distinct(list_concat(e, m)) AS req, []::VARCHAR[] AS opt FROM q UNION ALL SELECT item_id, 2, m, o FROM q UNION ALL SELECT item_id, 3, []::VARCHAR[], o FROM q),
ph AS (SELECT item_id, level, unnest(req) AS term, true AS r FROM l UNION ALL SELECT item_id, level, unnest(opt), false FROM l),
hit AS (SELECT item_id, level, doc_id, count(*) FILTER (r) AS hr, count(*) FILTER (NOT r) AS ho FROM ph JOIN post USING (term) GROUP BY ALL),
good AS (SELECT hit.* FROM hit JOIN l USING (item_id, level) WHERE hr = len(req) AND (len(opt) = 0 OR ho > 0)),
best AS (SELECT item_id, min(level) AS level FROM good GROUP BY item_id)
SELECT item_id AS query_id, level::BIGINT AS level, count(*) AS n_hits FROM good JOIN best USING (item_id, level) GROUP BY ALL
"""
ORACLES["exclude_terms"] = "SELECT doc_id FROM documents WHERE NOT (contains(lower(source || chr(10) || text), 'the ') OR contains(lower(source || chr(10) || text), 'que') OR contains(lower(source || chr(10) || text), 'src1'))"
ORACLES["like_fallback"] = f"""
WITH w AS (SELECT item_id, unnest(list_slice({_DISTINCT}, 1, 5)) AS t FROM benchmark),
h AS (SELECT DISTINCT item_id, doc_id FROM documents JOIN w ON contains(lower(text), t))
SELECT item_id AS query_id, rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM h) WHERE rank <= 20
"""
ORACLES["snippet_window"] = """
WITH p AS (SELECT doc_id, text, length(text) AS n, list_min(list_filter([instr(text, 'tion'), instr(text, 'ung'), instr(text, 'eaux'), instr(text, 'ción')], lambda x: x > 0)) AS f FROM documents),
s AS (SELECT *, greatest(0, f - 1 - 40) AS a FROM p),
e AS (SELECT *, least(n, a + 120) AS b FROM s),
g AS (SELECT *, CASE WHEN b - a < 120 THEN greatest(0, b - 120) ELSE a END AS c FROM e)
SELECT doc_id, CASE WHEN f IS NULL THEN substr(text, 1, 120) ELSE CASE WHEN c > 0 THEN '… ' ELSE '' END || substr(text, c::BIGINT + 1, (b - c)::BIGINT) || CASE WHEN b < n THEN ' …' ELSE '' END END AS snippet FROM g
"""
_LINES = "SELECT doc_id AS file, unnest(range(1, len(l) + 1)) AS line_number, unnest(l) AS line_text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
ORACLES["grep_lines_regex"] = f"SELECT * FROM ({_LINES}) WHERE regexp_matches(line_text, '[Tt]ion [a-z]{{2}}\\.')"
ORACLES["grep_lines_fixed"] = f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_number) AS n FROM ({_LINES}) WHERE contains(line_text, 'and the')) WHERE n <= 3"
ORACLES["grep_terms_or"] = f"SELECT * FROM ({_LINES}) WHERE contains(line_text, 'password') OR contains(line_text, 'token') OR contains(line_text, 'license') OR contains(line_text, 'the onon')"
ORACLES["grep_queries"] = f"""
WITH q AS (SELECT item_id, list_slice(list_filter(regexp_split_to_array(translate(text, '/-', '  '), '\\s+'), lambda x: length(x) >= 2), 1, 6) AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, unnest(w) AS token FROM q),
h AS (SELECT item_id, file, line_number, count(*) AS n_tokens FROM ({_LINES}) JOIN t ON contains(line_text, token) GROUP BY ALL)
SELECT item_id AS query_id, file, line_number, n_tokens, pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_tokens DESC, file, line_number) AS pos FROM h) WHERE pos <= 10
"""
ORACLES["grep_punct_tolerant"] = f"SELECT * FROM ({_LINES}) WHERE contains(line_text, 'the,') OR contains(line_text, 'the，')"
ORACLES["files_by_pattern"] = "SELECT DISTINCT url AS path FROM pages WHERE regexp_matches(regexp_extract(url, '([^/]*)/*$', 1), '^[0-9]{2,3}(\\?|$)')"
ORACLES["catalog_filter"] = "SELECT doc_id, source AS title FROM documents WHERE contains(lower(source || chr(10) || 'Docs/' || lang || '.md'), 'src1')"
ORACLES["block_spans"] = """
WITH d AS (SELECT doc_id, regexp_replace(text, '\\. ?\\n', '.' || chr(10) || chr(10), 'g') AS t FROM documents),
l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line, len(x) AS n FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM d)),
s AS (SELECT *, length(line) + CASE WHEN i = n - 1 THEN 0 ELSE 1 END AS size FROM l),
p AS (SELECT *, sum(size) OVER w AS stop, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER w AS island FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, island, min(stop - size) AS a, max(stop) AS b FROM p WHERE trim(line) <> '' GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS reading_order, a::BIGINT AS char_start, b::BIGINT AS char_end FROM g
"""
_NODE = "'c:' || conv_id || ':' || turn"
ORACLES["sibling_links"] = f"SELECT {_NODE} AS node_id, lag({_NODE}) OVER w AS prev_id, lead({_NODE}) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
_LINKS = f"SELECT 'prev' AS edge_type, {_NODE} AS from_node_id, lag({_NODE}) OVER (PARTITION BY conv_id ORDER BY turn) AS to_node_id, conv_id FROM conversations UNION ALL SELECT 'next', {_NODE}, lead({_NODE}) OVER (PARTITION BY conv_id ORDER BY turn), conv_id FROM conversations"
ORACLES["structure_edges"] = f"SELECT edge_type, from_node_id, to_node_id FROM ({_LINKS}) WHERE to_node_id IS NOT NULL"
ORACLES["neighbor_range_join"] = f"""
WITH t AS (SELECT conv_id, {_NODE} AS node_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at FROM conversations)
SELECT h.conv_id AS query_id, n.node_id, min(abs(n.at - h.at))::BIGINT AS distance FROM t h JOIN t n ON n.conv_id = h.conv_id AND abs(n.at - h.at) = 1 WHERE h.role = 'assistant' GROUP BY ALL
"""
ORACLES["graph_walk_depth2"] = f"""
WITH RECURSIVE e AS (SELECT from_node_id AS u, to_node_id AS v FROM ({_LINKS}) WHERE to_node_id IS NOT NULL),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(query_id, node_id, depth) AS (SELECT conv_id, {_NODE}, 0 FROM conversations WHERE turn = 0 UNION SELECT r.query_id, b.v, depth + 1 FROM r JOIN b ON b.u = r.node_id WHERE depth < 2)
SELECT query_id, node_id, min(depth)::BIGINT AS depth FROM r GROUP BY ALL
"""
ORACLES["passage_mention_edges"] = f"""
WITH t AS (SELECT conv_id, {_NODE} AS node_id, text, lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS form, regexp_extract(text, '[A-Za-z]{{4,}}') AS w FROM conversations)
SELECT a.node_id AS from_node_id, b.node_id AS to_node_id FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.node_id <> b.node_id
WHERE b.w <> '' AND contains(a.form, lower(b.w)) AND regexp_matches(a.text, '(?i)(^|[^A-Za-z0-9_])' || b.w || '($|[^A-Za-z0-9_])')
"""
ORACLES["cooccurrence_edges"] = f"""
WITH d AS (SELECT * FROM (SELECT conv_id, {_NODE} AS node, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 200),
t AS (SELECT conv_id, node, unnest(range(len(x))) AS pos, unnest(x) AS token FROM (SELECT conv_id, node, {_tokens('text')} AS x FROM d)),
c AS (SELECT conv_id, node, token, count(*) AS n, min(pos) AS f FROM t WHERE length(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+') GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, f) AS r FROM c) WHERE r <= 12),
z AS (SELECT node, count(*) AS size FROM k GROUP BY node HAVING count(*) >= 2),
m AS (SELECT k.conv_id, k.node, token, size FROM k JOIN z USING (node)),
p AS (SELECT a.conv_id, a.node AS a, b.node AS b, round(count(*) / greatest(any_value(a.size), any_value(b.size)), 4) AS conf FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.token = b.token AND a.node < b.node GROUP BY ALL HAVING count(*) >= 2),
w AS (SELECT conv_id, a AS f, b AS t, conf FROM p UNION ALL SELECT conv_id, b, a, conf FROM p)
SELECT conv_id AS doc_id, f AS from_node_id, t AS to_node_id, conf AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY conf DESC, f, t) AS r FROM w) WHERE r <= 5000
"""
ORACLES["alias_extraction"] = """
WITH a AS (SELECT DISTINCT p_type, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS alias FROM part),
n AS (SELECT *, regexp_replace(lower(alias), '[^0-9a-z]', '', 'g') AS f FROM a)
SELECT f AS normalized_alias, p_type AS target_node_id, 'exact' AS alias_level, alias, 'title' AS source, 1.0::DOUBLE AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY f, p_type ORDER BY length(alias), alias) AS r FROM n) WHERE r = 1
"""
ORACLES["dedupe_edges"] = f"SELECT edge_type, CASE WHEN edge_type = 'prev' THEN 1.0 ELSE 0.4 END::DOUBLE AS confidence, count(*) AS n FROM ({_LINKS}) WHERE to_node_id IS NOT NULL GROUP BY ALL"
ORACLES["expand_hits"] = f"""
WITH t AS (SELECT conv_id, turn, {_NODE} AS node_id FROM conversations),
x AS (SELECT conv_id, turn, node_id, CASE WHEN turn = 1 THEN 0 ELSE 1 END AS far FROM t WHERE turn BETWEEN 0 AND 2 AND conv_id IN (SELECT conv_id FROM t WHERE turn = 1))
SELECT conv_id AS query_id, node_id, row_number() OVER (PARTITION BY conv_id ORDER BY far, turn) AS pos FROM x
"""
_LISTS = """
d AS (SELECT doc_id, lang, n_chars, len(string_split(text, chr(10))) AS n_lines FROM documents),
l AS (SELECT lang AS query_id, 0 AS list_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS pos, doc_id AS item FROM d
      UNION ALL SELECT lang, 1, row_number() OVER (PARTITION BY lang ORDER BY n_lines DESC, doc_id) - 1, doc_id FROM d
      UNION ALL SELECT lang, 2, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) - 1, doc_id FROM d)
"""
ORACLES["rrf_fusion"] = f"""
WITH {_LISTS}, s AS (SELECT query_id, item, sum(1.0::DOUBLE / (61 + pos)) AS score, min(struct_pack(a := list_id, b := pos)) AS f FROM l GROUP BY ALL)
SELECT query_id, item, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, f.a, f.b) AS rank FROM s) WHERE rank <= 30
"""
ORACLES["route_merge"] = f"""
WITH {_LISTS}, s AS (SELECT query_id, item, min(CASE list_id WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END * 1000000000 + pos) AS place FROM l GROUP BY ALL)
SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY place, item) AS rank FROM s
"""
ORACLES["merge_dedupe"] = f"""
WITH l AS ({_LINES}),
a AS (SELECT file, line_number, 0 AS prio, row_number() OVER (PARTITION BY file ORDER BY line_number) - 1 AS pos FROM l WHERE contains(line_text, 'password')),
b AS (SELECT file, line_number, 1 AS prio, row_number() OVER (PARTITION BY file ORDER BY line_number) - 1 AS pos FROM l WHERE contains(line_text, 'password') OR contains(line_text, 'token'))
SELECT file, line_number, prio::BIGINT AS prio, pos FROM (SELECT *, row_number() OVER (PARTITION BY file, line_number ORDER BY prio, pos) AS r FROM (FROM a UNION ALL FROM b)) WHERE r = 1
"""
ORACLES["proximity_bucket"] = """
WITH s AS (SELECT doc_id, string_split(lower(text), 'tion') AS a, string_split(lower(text), 'ment') AS b FROM documents),
p AS (SELECT doc_id, [list_sum(list_transform(a[1:k], lambda x: length(x))) + 4 * (k - 1) FOR k IN range(1, least(len(a), 11))] AS x,
                     [list_sum(list_transform(b[1:k], lambda x: length(x))) + 4 * (k - 1) FOR k IN range(1, least(len(b), 11))] AS y FROM s),
w AS (SELECT doc_id, list_min([list_min([abs(i - j) FOR j IN y]) FOR i IN x]) AS w FROM p)
SELECT doc_id, CASE WHEN w <= 50 THEN 2.0 WHEN w <= 200 THEN 1.0 WHEN w <= 500 THEN 0.5 ELSE 0.0 END::DOUBLE AS bonus FROM w
"""
_DELTA = "SELECT user_id::VARCHAR AS q, 'n' || json_extract_string(props, '$.k') AS node, ts, event_id, CASE event_type WHEN 'purchase' THEN 2.0 WHEN 'error' THEN -3.0 WHEN 'view' THEN 1.0 END::DOUBLE AS d FROM events WHERE event_type IN ('purchase', 'error', 'view')"


def _fold(keys: str) -> str:
    step = "lambda w, d: CASE WHEN d >= 0 THEN least(w + d, 20.0::DOUBLE) ELSE greatest(w + d, -10.0::DOUBLE) END"
    return f"SELECT {keys}, list_reduce(list_prepend(0.0::DOUBLE, list(d ORDER BY ts, event_id)), {step}) AS weight, count(*) FILTER (d > 0) AS pos_count, count(*) FILTER (d < 0) AS neg_count, max(ts) AS last FROM ({_DELTA}) GROUP BY ALL"


_DECAY = f"SELECT q, node, weight * exp(-0.6931471805599453 * (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last)) / 86400000000.0 / 30) AS weight FROM ({_fold('q, node')})"
ORACLES["weights_fold"] = f"SELECT q AS query_norm, weight, pos_count, neg_count FROM ({_fold('q')})"
ORACLES["decayed_weights"] = f"SELECT q AS query_norm, node AS node_id, round(weight, 6) AS weight FROM ({_DECAY}) WHERE weight > 0.01"
_PASSED = f"date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ({_DELTA})) - INTERVAL 1 HOUR"
ORACLES["streamed_weights"] = f"SELECT q AS query_norm, node AS node_id, weight, pos_count, neg_count FROM ({_fold('q, node').replace('GROUP BY', f'WHERE {_PASSED} GROUP BY')})"
_HITS = "SELECT user_id::VARCHAR AS q, 'n' || json_extract_string(props, '$.k') AS node, max(ts) AS t FROM events GROUP BY ALL"
ORACLES["learned_boost_order"] = f"""
WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY t DESC, node) AS rank FROM ({_HITS}))),
w AS (SELECT * FROM ({_DECAY}) WHERE weight > 0.01),
j AS (SELECT h.*, CASE WHEN w.weight IS NOT NULL THEN row_number() OVER (PARTITION BY h.q ORDER BY w.weight DESC NULLS LAST, rank) END AS n FROM h LEFT JOIN w ON w.q = h.q AND w.node = h.node)
SELECT q AS query_id, node AS node_id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN n <= 5 THEN n END NULLS LAST, rank) AS boosted FROM j
"""
_OLD = "SELECT doc_id, CASE WHEN source = 'src5' THEN 'old5' ELSE source END AS source, CASE WHEN source = 'src7' THEN text || '!' ELSE text END AS text FROM documents WHERE source <> 'src3'"
_NEW = "SELECT doc_id, source, text FROM documents WHERE source <> 'src9'"
_NEWPOST = f"SELECT doc_id, unnest({_terms('text')}) AS term FROM ({_NEW})"
ORACLES["index_update_df"] = f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM ({_NEWPOST}) GROUP BY term"
ORACLES["index_update_topk"] = _bm25(_SOME, "[]::VARCHAR[]", "SELECT state, query_id, doc_id, round(score, 6) AS score FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score) AS place FROM rk), (VALUES ('updated'), ('compacted')) AS v(state) WHERE place <= 5").replace(f"WITH post AS ({_POST})", f"WITH post AS ({_NEWPOST})").replace("AS dl, lang, source FROM documents)", "AS dl, '' AS lang, source FROM (" + _NEW + "))")
ORACLES["merge_history"] = f"SELECT doc_id, source, true AS is_active FROM ({_NEW}) UNION ALL SELECT doc_id, source, false FROM ({_OLD}) WHERE doc_id NOT IN (SELECT doc_id FROM ({_NEW}))"
_CHANGE = f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'removed' WHEN o.doc_id IS NULL THEN 'added' WHEN o.source = n.source AND o.text = n.text THEN 'unchanged' WHEN o.text = n.text THEN 'metadata_only' ELSE 'rebuild' END AS change FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (doc_id)"
ORACLES["change_set"] = _CHANGE
ORACLES["fingerprint_diff"] = f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (doc_id) WHERE o.text IS DISTINCT FROM n.text"
ORACLES["apply_changes"] = f"""
WITH c AS ({_CHANGE}), dirty AS (SELECT doc_id FROM c WHERE change IN ('rebuild', 'added', 'removed'))
SELECT source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, source FROM ({_OLD}) WHERE doc_id NOT IN (FROM dirty) UNION ALL SELECT doc_id, source FROM ({_NEW}) WHERE doc_id IN (FROM dirty)) GROUP BY source
"""
ORACLES["latest_version"] = "SELECT user_id, event_type, a AS is_active, v AS source_version FROM (SELECT user_id, event_type, value >= 5 AS a, lpad(event_id::VARCHAR, 9, '0') AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value >= 5) DESC, event_id DESC) AS r FROM events) WHERE r = 1"
ORACLES["single_active_invariant"] = "SELECT 'single_active' AS \"check\", user_id || ':' || event_type AS id FROM events GROUP BY user_id, event_type HAVING count(*) FILTER (value >= 40) > 1"
ORACLES["vacuum_purge"] = "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars >= 500)"
ORACLES["export_digest"] = """SELECT n_regionkey, sha256(string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', chr(10) ORDER BY '{"key":' || n_nationkey || ',"name":"' || n_name || '"}')) AS sha256 FROM nation GROUP BY n_regionkey"""
ORACLES["footprint"] = f"""
WITH c AS ({_CHANGE}), w AS (SELECT doc_id, 1 + len(list_distinct(string_split(text, chr(10)))) AS n FROM ({_NEW}))
SELECT sum(CASE WHEN change = 'unchanged' THEN 0 ELSE n END)::BIGINT AS rewritten, sum(n)::BIGINT AS "full" FROM w JOIN c USING (doc_id)
"""
ORACLES["prefix_shards"] = """
WITH c AS (SELECT *, count(*) OVER (PARTITION BY substr(p_name, 1, 1)) AS c1, count(*) OVER (PARTITION BY substr(p_name, 1, 2)) AS c2, count(*) OVER (PARTITION BY substr(p_name, 1, 3)) AS c3 FROM part)
SELECT substr(p_name, 1, CASE WHEN c1 <= 60 THEN 1 WHEN c2 <= 60 THEN 2 WHEN c3 <= 60 THEN 3 ELSE 4 END) AS shard, count(*) AS n FROM c GROUP BY 1
"""
ORACLES["identifiers"] = """
WITH t AS (SELECT p_partkey, p_size, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || CASE WHEN p_size % 3 = 0 THEN ' V' || p_size ELSE '' END AS title FROM part),
v AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN 'v' || p_size ELSE 'current' END AS version FROM t)
SELECT p_partkey, regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') AS slug, version, p_partkey || '@' || version AS node_key,
       array_to_string(list_filter(string_split(title, ' '), lambda x: length(x) >= 2), '|') AS words, array_to_string(list_sort(list_distinct(string_split(lower(title), ' '))), ' ') AS query_key FROM v
"""
ORACLES["json_props"] = "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, count(DISTINCT props->>'$.k') AS k_distinct FROM events GROUP BY event_type"
ORACLES["budget_cut"] = "SELECT doc_id, used::BIGINT AS used FROM (SELECT doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 40000"
ORACLES["neighbor_recommendation"] = """
WITH f AS (SELECT user_id::VARCHAR AS q, (props->>'$.k')::INT % 3 AS n, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR DESC) AS r FROM events WHERE event_type IN ('purchase', 'error')),
s AS (SELECT q, n, sum(CASE event_type WHEN 'purchase' THEN 1 ELSE -2 END) AS score FROM f WHERE r <= 20 GROUP BY ALL),
u AS (SELECT DISTINCT user_id::VARCHAR AS q FROM events),
b AS (SELECT u.q, n, score, row_number() OVER (PARTITION BY u.q ORDER BY score DESC NULLS LAST, abs(n - 1), n) AS r FROM u LEFT JOIN s USING (q))
SELECT q AS query_id, CASE WHEN score > 0 THEN n ELSE 1 END::BIGINT AS neighbors FROM b WHERE r = 1
"""
ORACLES["query_stats_top5"] = "SELECT user_id::VARCHAR AS query_norm, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, query_norm LIMIT 5"
ORACLES["queries_last_7d"] = "SELECT count(*) AS queries, count(*) FILTER (ts >= TIMESTAMP '2024-02-01' - INTERVAL 7 DAY) AS queries_7d, count(*) FILTER (event_type IN ('purchase', 'error', 'view')) AS weights, count(*) AS feedback FROM events"
ORACLES["rewrite_suggestions"] = f"""
WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY t DESC, node) AS rank FROM ({_HITS}))),
w AS (SELECT q, node, weight FROM ({_fold('q, node')}) WHERE weight > 0),
b AS (SELECT h.q, w.q AS other, max(weight) AS weight FROM h JOIN w USING (node) WHERE h.q <> w.q GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY weight DESC, other) AS rank FROM b),
t AS (SELECT user_id::VARCHAR AS other, arg_max('User ' || user_id || ' ' || event_type, ts) AS txt FROM events GROUP BY user_id)
SELECT q AS query_id, txt AS suggestion, rank FROM r JOIN t USING (other) WHERE rank <= 3
"""
ORACLES["similar_queries"] = """
SELECT q AS query_id, log_id, rank FROM (SELECT user_id::VARCHAR AS q, event_id::VARCHAR AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR DESC) AS rank FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY) WHERE rank <= 5
"""
ORACLES["history_newest"] = "SELECT event_id::VARCHAR AS query_id, 'User ' || user_id || ' ' || event_type AS query_text FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id::VARCHAR DESC LIMIT 50"
ORACLES["cache_ttl_lru"] = "SELECT user_id::VARCHAR AS query_norm, arg_max(event_id, ts)::VARCHAR AS query_id FROM events WHERE ts > TIMESTAMP '2024-02-01' - INTERVAL 2 DAY GROUP BY user_id ORDER BY max(ts) DESC LIMIT 50"
ORACLES["label_feedback_join"] = "SELECT lang, count(*) AS n, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang"
ORACLES["html_to_text"] = """
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, sha256(t) AS text_sha256, length(t)::BIGINT AS n_chars FROM c
"""

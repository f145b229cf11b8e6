"""DuckDB counterparts of the registered queries, written independently of them."""

from __future__ import annotations

from quillgraph.plans.queries import CENTER, FILTERED_TYPES, NO_WORDS, TOP, WORDS
from quillgraph.plans.views import SQL

_TYPES = "'" + "', '".join(FILTERED_TYPES) + "'"


def _walks(name: str, forward: bool, depth: int, types: str | None = None, seeds: str = "SELECT id AS seed FROM docs_v") -> str:
    """Recursive enumeration of all walks, then the shortest to each node."""
    a, b = ("source_doc_id", "target_doc_id") if forward else ("target_doc_id", "source_doc_id")
    only = f" AND type IN ({types})" if types else ""
    return f"""
{name}_w AS (
  SELECT seed, l.{b} AS node, 1 AS depth, type FROM ({seeds}) JOIN links_v l ON l.{a} = seed WHERE target_doc_id IS NOT NULL{only}
  UNION ALL
  SELECT w.seed, l.{b}, w.depth + 1, l.type FROM {name}_w w JOIN links_v l ON l.{a} = w.node WHERE w.depth < {depth} AND l.target_doc_id IS NOT NULL{only.replace("type", "l.type")}),
{name} AS (
  SELECT seed, node, CAST(min(depth) AS INT) AS depth, substr(min(depth || type), 2) AS link_type, '{"outgoing" if forward else "incoming"}' AS direction
  FROM {name}_w WHERE node <> seed GROUP BY seed, node)"""


def _both(depth: int, seeds: str = "SELECT id AS seed FROM docs_v") -> str:
    return f"""{_walks("fwd", True, depth, seeds=seeds)}, {_walks("bwd", False, depth, seeds=seeds)},
both_v AS (
  SELECT seed, node, depth, link_type, direction FROM (
    SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY depth, direction DESC) AS r FROM (SELECT * FROM fwd UNION ALL SELECT * FROM bwd)) WHERE r = 1)"""


def _named(table: str) -> str:
    return f"SELECT t.seed, t.node, t.depth, t.link_type, t.direction, d.title, d.doc_type FROM {table} t JOIN docs_v d ON d.id = t.node"


_NODES = f"""nodes AS (SELECT d.id AS node, d.title, d.doc_type, 0 AS depth FROM docs_v d WHERE id = {CENTER}
  UNION ALL SELECT d.id, d.title, d.doc_type, b.depth FROM both_v b JOIN docs_v d ON d.id = b.node),
edges AS (SELECT source_doc_id, target_doc_id, type FROM links_v WHERE source_doc_id IN (SELECT node FROM nodes) AND target_doc_id IN (SELECT node FROM nodes))"""
_CENTERED = f"WITH RECURSIVE {SQL}, {_both(2, f'SELECT {CENTER} AS seed')}, {_NODES}"
_DEGREES = """SELECT n.node, n.title, n.doc_type, n.depth,
  (SELECT count(*) FROM edges WHERE source_doc_id = n.node) AS out_degree, (SELECT count(*) FROM edges WHERE target_doc_id = n.node) AS in_degree FROM nodes n"""


def _bm25(words: str) -> str:
    tokens = [t.lower() for t in words.split() if len(t) >= 3]
    count = lambda x, t: f"(length(lower({x})) - length(replace(lower({x}), '{t}', ''))) // {len(t)}"
    f = ", ".join(f"{count("coalesce(heading, '')", t)} + {count('content', t)} AS f{i}" for i, t in enumerate(tokens))
    stats = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(tokens)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END"
    rank = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(tokens)))
    return f"""
counted AS (SELECT section_id, doc_id, heading, content, greatest(length(coalesce(heading, '')) - 2, 0) + greatest(length(content) - 2, 0) AS size, {f} FROM sections_v),
stats AS (SELECT count(*) AS n, avg(size) AS mean, {stats} FROM counted),
ranked AS (SELECT section_id, doc_id, heading, content, -({rank}) AS rank FROM counted, stats WHERE {" AND ".join(f"f{i} > 0" for i in range(len(tokens)))})"""


_SIM = "list_inner_product(embedding, q)"


def _scores(words: str, limit: int, depth: int, types: str | None = None) -> str:
    only = f"WHERE link_type IN ({types})" if types else ""
    return f"""WITH RECURSIVE {SQL}, {_bm25(words)},
hits AS (SELECT section_id, doc_id, {_SIM} AS s FROM vectors_v, query_v ORDER BY s DESC, section_id LIMIT {10 * limit}),
seeds AS (SELECT DISTINCT doc_id AS seed FROM (SELECT doc_id FROM hits ORDER BY s DESC, section_id LIMIT {2 * limit})),
{_both(depth, "SELECT seed FROM seeds")},
prox AS (SELECT doc_id, max(p) AS prox FROM (SELECT node AS doc_id, 1.0 / depth AS p FROM both_v JOIN docs_v ON id = node {only} UNION ALL SELECT seed, 1.0 FROM seeds) GROUP BY doc_id),
top AS (SELECT ranked.* FROM ranked JOIN docs_v ON id = doc_id ORDER BY rank, section_id LIMIT {10 * limit}),
fts AS (SELECT doc_id, max(abs(rank) / (SELECT max(abs(rank)) FROM top)) AS fts FROM top GROUP BY doc_id),
placed AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS r FROM hits),
vec AS (SELECT doc_id, CASE WHEN count(*) > 1 THEN 0.8 * greatest(max(s), 0) + 0.2 * avg(s) FILTER (r <= 3) ELSE greatest(max(s), 0) END AS vec FROM placed GROUP BY doc_id),
weights AS (SELECT CASE WHEN count(*) > 0 THEN 0.3 * 0.3 ELSE 0 END AS gamma FROM top),
scored AS (
  SELECT doc_id, 0.7 * coalesce(vec, 0) + (0.3 - gamma) * coalesce(prox, 0) + gamma * coalesce(fts, 0) AS score,
    coalesce(vec, 0) AS vec, coalesce(prox, 0) AS prox, coalesce(fts, 0) AS fts
  FROM (vec FULL JOIN prox USING (doc_id)) LEFT JOIN fts USING (doc_id), weights)"""


_SCORES = "SELECT doc_id, round(score, 6) AS score, round(vec, 6) AS vec, round(prox, 6) AS prox, round(fts, 6) AS fts FROM scored"
_SEARCHED = f"WITH {SQL}, {_bm25(WORDS)}, top AS (SELECT r.*, d.title, d.doc_type FROM ranked r JOIN docs_v d ON d.id = r.doc_id ORDER BY rank, section_id LIMIT {2 * TOP})"

_TARGETS = """asked AS (
  SELECT doc_id AS link_id, 'n' || ((doc_id * 3) % 101) AS name, coalesce(lang, '') || '/n' || ((doc_id * 3) % 101) AS path,
    regexp_replace(n.filepath, '/[^/]*$', '') AS folder FROM documents JOIN nested_v n ON n.id = doc_id),
files AS (SELECT id, filepath, lower(regexp_replace(filepath, '\\.md$', '')) AS key, regexp_replace(filepath, '/[^/]*$', '') AS folder, len(string_split(filepath, '/')) AS depth FROM nested_v)"""


def _resolved(condition: str, order: str, ambiguous: str) -> str:
    return f"""WITH {SQL}, {_TARGETS},
found AS (SELECT link_id, id, filepath, row_number() OVER (PARTITION BY link_id ORDER BY {order}) AS r, count(*) OVER (PARTITION BY link_id) AS n
  FROM asked a JOIN files f ON {condition})
SELECT a.link_id, CASE WHEN id IS NULL THEN 'dangling' ELSE 'resolved' END AS status, id AS target_doc_id, filepath, {ambiguous} AS ambiguous
FROM asked a LEFT JOIN (SELECT * FROM found WHERE r = 1) USING (link_id)"""


_WORDS_OF = "len(list_filter(regexp_split_to_array(regexp_replace(text, '[\\x{3000}-\\x{9fff}\\x{f900}-\\x{faff}]', ' ', 'g'), '[\\s\\p{Z}\\x{0b}\\x{85}]+'), lambda w: w <> ''))"

ORACLES: dict[str, str] = {
    "vector_topk": f"WITH {SQL} SELECT section_id, doc_id, round({_SIM}, 6) AS similarity FROM vectors_v, query_v ORDER BY {_SIM} DESC, section_id LIMIT {TOP}",
    "vector_neighbours": f"""WITH {SQL}
SELECT query_id, section_id, round(s, 6) AS similarity, CAST(rank AS INT) AS rank FROM (
  SELECT a.section_id AS query_id, b.section_id, list_inner_product(a.embedding, b.embedding) AS s,
    row_number() OVER (PARTITION BY a.section_id ORDER BY round(list_inner_product(a.embedding, b.embedding), 12) DESC, b.section_id) AS rank FROM vectors_v a, vectors_v b) WHERE rank <= 3""",
    "fulltext_bm25": f"WITH {SQL}, {_bm25(WORDS)} SELECT section_id, doc_id, round(rank, 6) AS rank FROM ranked",
    "fulltext_doc_type_postfilter": f"{_SEARCHED} SELECT section_id, doc_id, title, doc_type, heading, round(rank, 6) AS rank FROM top WHERE doc_type = 'guide' ORDER BY rank, section_id LIMIT {TOP}",
    "graph_forward": f"WITH RECURSIVE {SQL}, {_walks('fwd', True, 2)} {_named('fwd')}",
    "graph_backward": f"WITH RECURSIVE {SQL}, {_walks('bwd', False, 2)} {_named('bwd')}",
    "graph_bidirectional": f"WITH RECURSIVE {SQL}, {_both(2)} {_named('both_v')}",
    "graph_link_types": f"WITH RECURSIVE {SQL}, {_walks('fwd', True, 3, _TYPES)} {_named('fwd')}",
    "graph_full_degrees": f"WITH {SQL}, nodes AS (SELECT id AS node, title, doc_type, 0 AS depth FROM docs_v), edges AS (SELECT * FROM links_v WHERE target_doc_id IS NOT NULL) {_DEGREES}",
    "graph_full_edges": f"WITH {SQL} SELECT source_doc_id, target_doc_id, type FROM links_v WHERE target_doc_id IS NOT NULL",
    "graph_centered_nodes": f"{_CENTERED} {_DEGREES}",
    "graph_centered_edges": f"{_CENTERED} SELECT * FROM edges",
    "graph_proximity": f"WITH RECURSIVE {SQL}, {_both(2)} SELECT node, max(1.0 / depth) AS proximity, min(depth) AS depth FROM both_v GROUP BY node",
    "hybrid_scores": f"{_scores(WORDS, TOP, 2)} {_SCORES}",
    "hybrid_no_fts": f"{_scores(NO_WORDS, TOP, 1)} {_SCORES}",
    "hybrid_search": f"""{_scores(WORDS, 5, 2)} SELECT doc_id, title, doc_type, round(score, 6) AS score,
  coalesce(nullif(concat_ws(', ', CASE WHEN vec > 0 THEN printf('vector similarity: %.3f', vec) END, CASE WHEN prox > 0 THEN printf('graph proximity: %.3f', prox) END,
    CASE WHEN fts > 0 THEN printf('fulltext: %.3f', fts) END), ''), 'graph-connected') AS relevance_reason
FROM scored JOIN docs_v ON id = doc_id ORDER BY round(scored.score, 12) DESC, doc_id LIMIT 5""",
    "fts_fallback": f"""{_SEARCHED}, few AS (SELECT * FROM top ORDER BY rank, section_id LIMIT {TOP})
SELECT doc_id, title, (SELECT filepath FROM docs_v WHERE id = doc_id) AS filepath, doc_type, section_id, (SELECT count(*) FROM top) AS total_found, round(abs(rank), 6) AS score,
  'fulltext_fallback' AS search_type
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, section_id) AS r FROM few) WHERE r = 1""",
    "page_sections": f"""WITH {SQL}, pages AS (
  SELECT doc_id, string_agg(CASE WHEN coalesce(heading, '') = '' THEN content ELSE '## ' || heading || chr(10) || chr(10) || content END, chr(10) || chr(10) ORDER BY section_order) AS content FROM sections_v GROUP BY doc_id)
SELECT doc_id, CAST(length(content) AS INT) AS n_chars, sha256(content) AS content_hash FROM pages""",
    "page_links": f"""WITH {SQL},
o AS (SELECT source_doc_id AS doc_id, string_agg(title || ':' || type, ',' ORDER BY title, filepath, type) AS outgoing FROM links_v JOIN docs_v ON id = target_doc_id GROUP BY 1),
b AS (SELECT target_doc_id AS doc_id, string_agg(title || ':' || type, ',' ORDER BY title, filepath, type) AS incoming FROM links_v JOIN docs_v ON id = source_doc_id GROUP BY 1)
SELECT id AS doc_id, coalesce(outgoing, '') AS outgoing, coalesce(incoming, '') AS incoming FROM docs_v LEFT JOIN o ON o.doc_id = id LEFT JOIN b ON b.doc_id = id""",
    "list_pages": f"WITH {SQL} SELECT id, filepath, title, doc_type, (SELECT count(*) FROM links_v WHERE source_doc_id = id) AS link_count FROM docs_v ORDER BY title, id",
    "status_counts": f"""WITH {SQL} SELECT (SELECT count(*) FROM docs_v) AS documents, (SELECT count(*) FROM sections_v) AS sections, (SELECT count(*) FROM links_v) AS links,
  (SELECT count(target_doc_id) FROM links_v) AS resolved_links, (SELECT count(*) FROM links_v WHERE target_doc_id IS NULL) AS dangling_links,
  (SELECT count(*) FROM vectors_v) AS embedded_sections, (SELECT count(*) FROM checked_v) AS refs, (SELECT count(*) FROM checked_v WHERE is_stale) AS stale_refs""",
    "context_budget": f"""WITH RECURSIVE {SQL}, {_both(1)},
sizes AS (SELECT doc_id, CAST(sum(length(content)) + 2 * (count(*) - 1) AS BIGINT) AS size FROM sections_v GROUP BY doc_id),
items AS (
  -- A related document counts with its summary of 500 characters.
  SELECT seed, node, least(coalesce(size, 0), 500) AS size, row_number() OVER (PARTITION BY seed ORDER BY depth, title, node) AS place
  FROM both_v JOIN docs_v ON id = node LEFT JOIN sizes ON sizes.doc_id = node),
fold AS (
  SELECT id AS seed, 0 AS place, coalesce(size, 0) AS total, 0 AS truncated, '' AS taken FROM docs_v LEFT JOIN sizes ON sizes.doc_id = id
  UNION ALL
  SELECT f.seed, f.place + 1, CASE WHEN total + i.size <= 8000 THEN total + i.size ELSE total END, CASE WHEN total + i.size <= 8000 THEN truncated ELSE truncated + 1 END,
    CASE WHEN total + i.size <= 8000 THEN taken || CASE WHEN taken = '' THEN '' ELSE ',' END || i.node ELSE taken END
  FROM fold f JOIN items i ON i.seed = f.seed AND i.place = f.place + 1)
SELECT f.seed, coalesce(s.size, 0) AS center_size, f.total AS total_size, f.truncated, f.taken
FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY place DESC) AS r FROM fold) f LEFT JOIN sizes s ON s.doc_id = f.seed WHERE r = 1""",
    "stale_documents": f"""WITH {SQL}
SELECT doc_id, title, CASE WHEN bool_or(last_synced_hash <> '') THEN 'stale' ELSE 'untracked' END AS staleness,
  string_agg(file_path || ':' || CASE WHEN last_synced_hash = '' THEN 'not_found' WHEN current_hash = '__NOT_FOUND__' THEN 'deleted' ELSE 'modified' END, ',' ORDER BY file_path) AS stale_refs
FROM checked_v JOIN docs_v ON id = doc_id WHERE is_stale GROUP BY doc_id, title""",
    "stale_summary": f"WITH {SQL} SELECT count(*) FILTER (NOT is_stale) AS fresh, count(*) FILTER (is_stale) AS stale, count(*) AS total FROM checked_v",
    "suggest_links": f"""WITH {SQL},
near AS (
  SELECT a.section_id AS qs, a.doc_id AS qd, b.section_id AS ts, b.doc_id AS td, list_inner_product(a.embedding, b.embedding) AS s,
    row_number() OVER (PARTITION BY a.section_id ORDER BY round(list_inner_product(a.embedding, b.embedding), 12) DESC, b.section_id) AS rank FROM vectors_v a, vectors_v b),
known AS (SELECT source_doc_id AS a, target_doc_id AS b FROM links_v WHERE target_doc_id IS NOT NULL UNION SELECT target_doc_id, source_doc_id FROM links_v WHERE target_doc_id IS NOT NULL),
labels_v AS (SELECT section_id, section_order, coalesce(heading, substr(content, 1, 100)) AS label FROM sections_v),
pairs AS (
  SELECT qd, td, s, x.title AS st, y.title AS tt, p.label AS sl, q.label AS tl,
    row_number() OVER (PARTITION BY least(qd, td), greatest(qd, td) ORDER BY x.title, p.section_order, rank, qs) AS r
  FROM near JOIN labels_v p ON p.section_id = qs JOIN labels_v q ON q.section_id = ts JOIN docs_v x ON x.id = qd JOIN docs_v y ON y.id = td
  WHERE rank <= 10 AND qd <> td AND round(s, 12) >= 0.3 AND NOT EXISTS (SELECT 1 FROM known WHERE a = qd AND b = td))
SELECT qd AS source_doc_id, td AS target_doc_id, st AS source_title, tt AS target_title, sl AS source_label, tl AS target_label, round(s, 6) AS similarity
FROM pairs WHERE r = 1 ORDER BY round(s, 12) DESC, qd, td LIMIT 50""",
    "link_resolution_name": _resolved("regexp_replace(f.key, '.*/', '') = a.name", "CASE WHEN f.folder = a.folder THEN 0 ELSE 1 END, CASE WHEN f.folder = a.folder THEN 0 ELSE f.depth END, filepath, id", "coalesce(n > 1, false)"),
    "link_resolution_path": _resolved("f.key = a.path OR ends_with(f.key, '/' || a.path)", "filepath, id", "false"),
    "ambiguous_names": f"WITH {SQL}, {_TARGETS} SELECT regexp_replace(key, '.*/', '') AS name, count(*) AS files FROM files GROUP BY 1 HAVING count(*) > 1",
    "link_dedupe": f"WITH {SQL} SELECT source_doc_id, target_doc_id, type, position, target_title FROM (SELECT *, row_number() OVER (PARTITION BY source_doc_id, coalesce(CAST(target_doc_id AS VARCHAR), ''), type ORDER BY position) AS r FROM links_v) WHERE r = 1",
    "link_counts": f"WITH {SQL} SELECT count(*) AS total, count(target_doc_id) AS resolved, count(*) FILTER (target_doc_id IS NULL) AS dangling FROM links_v",
    "dangling_reresolve": f"WITH {SQL} SELECT source_doc_id, coalesce(target_doc_id, (SELECT min(id) FROM docs_v WHERE title = target_title)) AS target_doc_id, type, position, target_title FROM links_v",
    "section_diff": f"""WITH {SQL},
n AS (SELECT doc_id, section_order, CASE WHEN section_id % 7 = 0 THEN content || '!' ELSE content END AS c FROM sections_v WHERE section_id % 11 <> 0
  UNION ALL SELECT doc_id, section_order + 50000, content FROM sections_v WHERE section_id % 13 = 0)
SELECT doc_id, section_order, CASE WHEN n.c IS NULL THEN 'delete' WHEN o.content IS NULL THEN 'insert' WHEN n.c <> o.content THEN 'update' ELSE 'keep' END AS action
FROM (SELECT doc_id, section_order, content FROM sections_v) o FULL JOIN n USING (doc_id, section_order)""",
    "doc_upsert": f"""WITH {SQL}
SELECT id, CASE WHEN id % 5 = 0 THEN 'changed' ELSE body_hash END AS body_hash, CASE WHEN id % 9 <> 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS created_at,
  CASE WHEN id % 9 <> 0 AND id % 5 <> 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS updated_at, id % 9 = 0 OR id % 5 = 0 AS changed FROM docs_v""",
    "delete_missing_cascade": f"""WITH {SQL}
SELECT 'documents' AS name, count(*) AS rows FROM docs_v WHERE id % 10 <> 0 UNION ALL SELECT 'sections', count(*) FROM sections_v WHERE doc_id % 10 <> 0
UNION ALL SELECT 'links', count(*) FROM links_v WHERE source_doc_id % 10 <> 0 AND coalesce(target_doc_id % 10, 1) <> 0 UNION ALL SELECT 'refs', count(*) FROM refs_v WHERE doc_id % 10 <> 0""",
    "token_estimate": f"SELECT doc_id, CAST(ceil(1.5 * len(regexp_extract_all(text, '[\\x{{3000}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]')) + 1.3 * {_WORDS_OF}) AS INT) AS tokens FROM documents",
    "path_functions": f"""WITH {SQL}, p AS (SELECT id, filepath, string_split(filepath, '/') AS parts FROM nested_v)
SELECT id, parts[-1] AS name, array_to_string(parts[:-2], '/') AS folder, regexp_replace(filepath, '\\.md$', '') AS title, lower(regexp_replace(filepath, '\\.md$', '')) AS normal,
  CASE WHEN len(parts) > 2 THEN array_to_string(parts[:-3], '/') || '/' ELSE '' END || 'x/y.md' AS linked, CAST(len(parts) AS BIGINT) AS depth FROM p""",
    "glob_filter": f"WITH {SQL} SELECT filepath FROM docs_v WHERE regexp_matches(filepath, '^src1[^/]*/(.*/)?[^/]*\\.md$') AND NOT contains('/' || filepath, '/de/')",
    "markdown_links": """
SELECT 'a/' || doc_id || '.md' AS filepath, u.target AS target, u.type AS type, CAST(u.position AS INT) AS position FROM (
  SELECT doc_id, unnest([{'target': 'page ' || doc_id, 'type': 'implements', 'position': 0}, {'target': 'other', 'type': 'references', 'position': 1},
    {'target': 'b/p ' || doc_id, 'type': 'references', 'position': 2}]) AS u FROM documents)""",
    "page_titles": """
SELECT CAST(doc_id AS VARCHAR) AS filepath, 'Page ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'api' ELSE 'spec' END AS doc_type, 'src/a.ts' AS source_refs,
  CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS warnings FROM documents""",
    "debounce_events": """
WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
SELECT user_id, max(ts) AS ts, count(*) AS events FROM s GROUP BY user_id, burst""",
    "snapshot_changes": f"""WITH {SQL}
SELECT CASE WHEN id % 4 = 0 THEN 'add' WHEN id % 5 = 0 THEN 'unlink' ELSE 'change' END AS type, filepath FROM docs_v
WHERE (id % 4 = 0) <> (id % 5 = 0) OR (id % 4 <> 0 AND id % 5 <> 0 AND id % 3 = 0)""",
    "hybrid_doc_type": f"""{_scores(WORDS, 5, 2)}, kept AS (SELECT doc_id, score FROM scored JOIN docs_v ON id = doc_id WHERE doc_type = 'guide')
SELECT doc_id, round(score, 6) AS score, (SELECT count(*) FROM kept) AS total_found FROM kept ORDER BY round(kept.score, 12) DESC, doc_id LIMIT 5""",
    "hybrid_link_types": f"{_scores(WORDS, TOP, 2, _TYPES)} {_SCORES}",
    "hybrid_sections": f"""{_scores(WORDS, 20, 2)},
best AS (SELECT doc_id, filepath FROM scored JOIN docs_v ON id = doc_id ORDER BY round(score, 12) DESC, doc_id LIMIT 20),
near AS (
  SELECT b.doc_id, filepath, row_number() OVER (PARTITION BY b.doc_id ORDER BY h.s DESC, h.section_id) - 1 AS place, heading, content, h.s AS score
  FROM best b JOIN hits h ON h.doc_id = b.doc_id JOIN sections_v v ON v.section_id = h.section_id),
opening AS (SELECT b.doc_id, filepath, 0 AS place, heading, substr(content, 1, 500) AS content, 0.0 AS score FROM best b JOIN sections_v v ON v.doc_id = b.doc_id AND section_order = 0)
SELECT doc_id, filepath, place, heading, content, round(score, 6) AS score FROM near WHERE place < 3
UNION ALL SELECT * FROM opening WHERE doc_id NOT IN (SELECT doc_id FROM near)""",
    "hybrid_linked_pages": f"""WITH {SQL},
pairs AS (SELECT source_doc_id AS doc_id, target_doc_id AS page, type FROM links_v WHERE target_doc_id IS NOT NULL UNION SELECT target_doc_id, source_doc_id, type FROM links_v WHERE target_doc_id IS NOT NULL),
texts AS (SELECT doc_id AS page, substr(string_agg(content, chr(10) || chr(10) ORDER BY section_order), 1, 500) AS summary FROM sections_v GROUP BY doc_id)
SELECT doc_id, page, type, title, filepath, summary FROM pairs JOIN docs_v ON id = page LEFT JOIN texts USING (page)""",
    "fulltext_snippets": f"""WITH {SQL},
found AS (SELECT section_id, content, coalesce(least(nullif(instr(lower(content), 'than'), 0), nullif(instr(lower(content), 'the'), 0)), 1) AS hit FROM sections_v WHERE content IS NOT NULL),
cut AS (SELECT section_id, content, greatest(least(hit - 16, length(content) - 65), 1) AS a FROM found)
SELECT section_id, CASE WHEN a > 1 THEN '...' ELSE '' END || regexp_replace(substr(content, a, 66), '(than|the)', '<mark>\\1</mark>', 'gi') || CASE WHEN a + 66 <= length(content) THEN '...' ELSE '' END AS snippet FROM cut""",
    "title_search": f"WITH {SQL} SELECT id, title FROM docs_v WHERE regexp_matches(title, '(?i)doc 0.0000')",
    "list_pages_of_type": f"WITH {SQL} SELECT id, title, (SELECT count(*) FROM links_v WHERE source_doc_id = id) AS link_count FROM docs_v WHERE doc_type = 'guide'",
    "page_payload": f"""WITH {SQL},
o AS (SELECT source_doc_id AS doc_id, string_agg(id || ':' || type, ',' ORDER BY title, filepath, type) AS outgoing FROM links_v JOIN docs_v ON id = target_doc_id GROUP BY 1),
b AS (SELECT target_doc_id AS doc_id, string_agg(id || ':' || type, ',' ORDER BY title, filepath, type) AS incoming FROM links_v JOIN docs_v ON id = source_doc_id GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n, sha256(string_agg(CASE WHEN coalesce(heading, '') = '' THEN content ELSE '## ' || heading || chr(10) || chr(10) || content END, chr(10) || chr(10) ORDER BY section_order)) AS h FROM sections_v GROUP BY doc_id),
r AS (SELECT doc_id, bool_or(is_stale AND last_synced_hash <> '') AS changed, bool_or(is_stale AND last_synced_hash = '') AS unknown, string_agg(file_path, ',' ORDER BY file_path) FILTER (is_stale) AS paths FROM checked_v GROUP BY doc_id)
SELECT d.id AS doc_id, title, h AS content_hash, coalesce(n, 0) AS sections, coalesce(outgoing, '') AS outgoing, coalesce(incoming, '') AS incoming,
  CASE WHEN changed THEN 'stale' WHEN unknown THEN 'untracked' ELSE 'fresh' END AS staleness, coalesce(paths, '') AS stale_refs
FROM docs_v d LEFT JOIN o ON o.doc_id = d.id LEFT JOIN b ON b.doc_id = d.id LEFT JOIN c ON c.doc_id = d.id LEFT JOIN r ON r.doc_id = d.id""",
    "markdown_link_contexts": """
WITH f AS (
  SELECT doc_id, '[[page ' || doc_id || '|implements]]' AS link, chr(10) || chr(10) AS gap,
    '# Page' || gap || 'See ' || link || ' and `[[code]]`, [[other|odd]] or [text](../b/p%20' || doc_id || '.md#part) and [web](https://example.org/x.md).' AS t FROM documents)
SELECT 'a/' || doc_id || '.md' AS filepath, substr(t, greatest(strpos(t, link) - 50, 1), length(link) + least(strpos(t, link) - 1, 50) + 50) AS context, 0 AS section_order FROM f""",
    "markdown_sections": """
WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS filepath, doc_id % 60 + 1 AS a, doc_id % 45 + 1 AS b, ceil(1.3::DOUBLE * (doc_id % 45 + 1)) < 32 AS small FROM documents),
parts AS (
  -- A second section of fewer than 32 tokens, and always the tiny one with its deeper heading, join the one before; the long one is cut at paragraphs.
  SELECT filepath, 0 AS section_order, 'A' AS heading, CASE WHEN small THEN a + b + 4 ELSE a END AS words FROM n
  UNION ALL SELECT filepath, 1, 'B', b + 4 FROM n WHERE NOT small
  UNION ALL SELECT filepath, k + CASE WHEN small THEN 1 ELSE 2 END, 'D', CASE WHEN k < 2 THEN 160 ELSE 80 END FROM n, (SELECT unnest([0, 1, 2]) AS k))
SELECT filepath, CAST(section_order AS INT) AS section_order, heading, CAST(ceil(1.3::DOUBLE * words) AS INT) AS token_count FROM parts""",
    "pending_embeddings": f"WITH {SQL} SELECT section_id, doc_id FROM sections_v WHERE section_id NOT IN (SELECT section_id FROM vectors_v)",
    "other_model_embeddings": f"WITH {SQL} SELECT section_id, doc_id FROM sections_v WHERE section_id IN (SELECT section_id FROM vectors_v) AND section_id % 3 = 0",
    "embedding_sink": f"""WITH {SQL}, n AS (SELECT section_id + 1 AS section_id FROM vectors_v WHERE section_id % 2 = 0)
SELECT s.section_id, CASE WHEN n.section_id IS NOT NULL THEN 2 ELSE CAST(len(embedding) AS INT) END AS dims,
  CASE WHEN n.section_id IS NOT NULL THEN 'newest' WHEN s.section_id % 3 = 0 THEN 'old' ELSE 'new' END AS embedding_model
FROM sections_v s LEFT JOIN vectors_v v USING (section_id) LEFT JOIN n USING (section_id) WHERE n.section_id IS NOT NULL OR v.section_id IS NOT NULL""",
    "embedding_input": f"""WITH {SQL}, w AS (SELECT section_id, content, CASE WHEN coalesce(heading, '') = '' THEN content ELSE heading || chr(10) || content END AS whole FROM sections_v WHERE content IS NOT NULL)
SELECT section_id, substr('passage: ' || whole, 1, 60) AS passage, substr('query: ' || content, 1, 40) AS "query", substr(whole, 1, 50) AS plain FROM w""",
    "embedding_jobs": "SELECT user_id AS section_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS position FROM events GROUP BY user_id",
    "vector_upsert": f"""WITH {SQL}, i AS (SELECT section_id, doc_id, embedding[1] AS x FROM vectors_v), m AS (SELECT CASE WHEN doc_id % 2 = 0 THEN section_id ELSE -section_id END AS section_id, doc_id FROM i WHERE section_id % 4 = 0)
SELECT section_id, doc_id, round(x, 6) AS x FROM i WHERE section_id NOT IN (SELECT section_id FROM m) UNION ALL SELECT section_id, doc_id, 9.0 FROM m""",
    "vector_remove": f"WITH {SQL} SELECT section_id, doc_id, round(embedding[1], 6) AS x FROM vectors_v WHERE doc_id NOT IN (SELECT id FROM docs_v WHERE id % 3 = 0)",
    "dangling_links": f"WITH {SQL} SELECT source_doc_id, type, target_title FROM links_v WHERE target_doc_id IS NULL",
    "link_sections": f"""WITH {SQL} SELECT source_doc_id, position, s.section_id AS source_section_id
FROM links_v l LEFT JOIN sections_v s ON s.doc_id = l.source_doc_id AND s.section_order = l.position - 1""",
    "link_detach": f"""WITH {SQL} SELECT source_doc_id, position, s.section_id AS source_section_id
FROM links_v l LEFT JOIN sections_v s ON s.doc_id = l.source_doc_id AND s.section_order = l.position - 1 AND s.section_id % 2 = 0""",
    "link_replace": f"WITH {SQL} SELECT source_doc_id, position, CASE WHEN source_doc_id % 4 = 0 THEN 'extends' ELSE type END AS type FROM links_v WHERE source_doc_id % 4 <> 0 OR position < 3",
    "section_replace": f"""WITH {SQL},
o AS (SELECT doc_id, section_order, content, section_id IN (SELECT section_id FROM vectors_v) AS embedded FROM sections_v),
n AS (SELECT doc_id, section_order, CASE WHEN section_id % 7 = 0 THEN content || '!' ELSE content END AS content FROM sections_v WHERE section_id % 11 <> 0
  UNION ALL SELECT doc_id, section_order + 50000, content FROM sections_v WHERE section_id % 13 = 0)
SELECT doc_id, section_order, sha256(content) AS content_hash, embedded FROM o
WHERE doc_id % 2 <> 0 OR doc_id NOT IN (SELECT doc_id FROM n)
UNION ALL SELECT n.doc_id, n.section_order, sha256(n.content), coalesce(o.content = n.content AND embedded, false) FROM n LEFT JOIN o USING (doc_id, section_order) WHERE n.doc_id % 2 = 0""",
    "refs_sync": f"WITH {SQL} SELECT doc_id, file_path, coalesce(hash, '') AS last_synced_hash, false AS is_stale FROM refs_v LEFT JOIN files_v USING (file_path)",
    "stale_flags": f"WITH {SQL} SELECT doc_id, file_path, is_stale FROM checked_v",
    "stale_paths": f"WITH {SQL} SELECT file_path FROM checked_v WHERE is_stale AND doc_id = {CENTER}",
    "skip_unchanged": f"WITH {SQL} SELECT filepath, CASE WHEN id % 6 = 0 THEN 'changed' ELSE body_hash END AS body_hash FROM docs_v WHERE id % 5 = 0 OR id % 6 = 0",
    "path_guard": f"WITH {SQL} SELECT 'a..b/' || filepath AS filepath FROM docs_v WHERE id % 3 = 2 AND id % 5 <> 0",
    "change_bursts": "SELECT CAST(user_id AS VARCHAR) AS filepath, arg_max(event_type, (ts, event_id)) AS type FROM events GROUP BY user_id",
    "fulltext_index_matches": f"""WITH {SQL} SELECT section_id FROM sections_v
WHERE content IS NOT NULL AND (section_id % 10 <> 1 OR section_id % 3 = 0) AND contains(lower(coalesce(heading, '') || chr(10) || content), 'than') AND contains(lower(coalesce(heading, '') || chr(10) || content), 'the')""",
    "json_sink": f"WITH {SQL} SELECT CAST(to_json({{'id': id, 'title': title, 'doc_type': doc_type}}) AS VARCHAR) AS value FROM docs_v",
    "schema_version": "SELECT CAST(max(r_regionkey) AS INT) AS version FROM region",
}

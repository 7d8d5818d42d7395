"""Inputs of the queries besides the graph: trees, generations, events and facts, as portable SQL over the projection."""

from __future__ import annotations

EXTRA = {
    "m_files": "SELECT key, path, blob_sha, package_key, CAST(regexp_extract(key, '([0-9]+)$', 1) AS BIGINT) AS id FROM g_files",
    "m_base": "SELECT path, blob_sha, package_key, id FROM m_files WHERE id % 11 <> 0",
    "m_head": """SELECT CASE WHEN id % 17 = 1 THEN concat('moved/', path) ELSE path END AS path,
 CASE WHEN id % 5 = 0 THEN md5(concat(blob_sha, 'x')) ELSE blob_sha END AS blob_sha, package_key, id FROM m_files WHERE id % 7 <> 0""",
    "m_changes": """SELECT 'modified' AS kind, concat('./', path) AS old_path, concat('a/../', path) AS new_path, CAST(0 AS BIGINT) AS score, package_key, id FROM m_files WHERE id % 5 = 0
UNION ALL SELECT 'modified', path, path, CAST(0 AS BIGINT), package_key, id FROM m_files WHERE id % 10 = 0
UNION ALL SELECT 'deleted', path, '', CAST(0 AS BIGINT), package_key, id FROM m_files WHERE id % 13 = 1
UNION ALL SELECT 'renamed', path, concat('moved//', path), CAST(100 AS BIGINT), package_key, id FROM m_files WHERE id % 19 = 2
UNION ALL SELECT 'added', '', concat('new/', CAST(id AS STRING), '/go.mod'), CAST(0 AS BIGINT), package_key, id FROM m_files WHERE id % 97 = 3
UNION ALL SELECT 'added', '', concat('../../', path), CAST(0 AS BIGINT), package_key, id FROM m_files WHERE id % 23 = 4""",
    "m_status": """SELECT 'modified' AS kind, path AS old_path, path AS new_path, CAST(1 AS BIGINT) AS tracked, md5(concat(blob_sha, 'w')) AS sha, package_key FROM m_files WHERE id % 8 = 0
UNION ALL SELECT 'deleted', path, '', CAST(1 AS BIGINT), '', package_key FROM m_files WHERE id % 9 = 1
UNION ALL SELECT 'renamed', path, concat('r/', path), CAST(1 AS BIGINT), blob_sha, package_key FROM m_files WHERE id % 72 = 26
UNION ALL SELECT 'added', '', concat('n/', CAST(id AS STRING), CASE WHEN id % 2 = 0 THEN '.go' ELSE '.txt' END), CAST(0 AS BIGINT), md5(concat('n', CAST(id AS STRING))), package_key FROM m_files WHERE id % 29 = 3""",
    "x_years": "SELECT DISTINCT year(o_orderdate) AS y FROM orders",
    "x_generations": """SELECT r_name AS repo_id, n_name AS worktree_id, CAST(y - 1994 AS BIGINT) AS generation_id, md5(concat(n_name, CAST(y AS STRING))) AS commit_sha,
 CASE WHEN y = 2001 THEN CASE WHEN n_nationkey % 4 = 0 THEN 'validated' ELSE 'active' END WHEN y = 2000 AND n_nationkey % 4 = 0 THEN 'active'
      WHEN (n_nationkey + y) % 5 = 0 THEN 'failed' ELSE 'retired' END AS state, CAST(y * 10000 AS BIGINT) AS created_at, CAST(2 AS BIGINT) AS schema_version
FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN x_years""",
    "x_worktrees": """SELECT r_name AS repo_id, n_name AS worktree_id, concat('/work/', lower(n_name)) AS worktree_path,
 md5(concat(n_name, CASE WHEN n_nationkey % 3 = 0 THEN '1999' WHEN n_nationkey % 4 = 0 THEN '2000' ELSE '2001' END)) AS observed_head, CAST(n_nationkey AS BIGINT) AS nk
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "x_repositories": """SELECT r_name AS repo_id, concat('example.org/', lower(r_name)) AS canonical_identity FROM region UNION ALL SELECT 'EMPTY', 'example.org/empty'""",
    "x_states": """SELECT w.repo_id, w.worktree_id, g.generation_id AS active_generation, coalesce(g.commit_sha, '') AS indexed_head,
 CASE WHEN g.generation_id IS NULL THEN 'unindexed' WHEN w.nk % 5 = 2 THEN 'stale' ELSE 'ready' END AS status
FROM x_worktrees w LEFT JOIN x_generations g ON w.repo_id = g.repo_id AND w.worktree_id = g.worktree_id AND g.state = 'active' AND w.nk % 6 <> 5""",
    "x_readers": "SELECT repo_id, worktree_id, CAST(2 AS BIGINT) AS generation_id FROM x_worktrees WHERE nk % 7 = 0",
    "x_events": """SELECT w.repo_id, w.worktree_id, CAST(event_id % 7 + 1 AS BIGINT) AS generation_id, CAST(event_id AS BIGINT) AS seq,
 CASE event_type WHEN 'view' THEN 'validate' WHEN 'click' THEN 'validate' WHEN 'purchase' THEN 'activate' WHEN 'signup' THEN 'activate' ELSE 'fail' END AS action
FROM events JOIN x_worktrees w ON user_id % 25 = w.nk WHERE event_type <> 'error' OR event_id % 9 = 0""",
    "x_refs": """SELECT w.repo_id, w.worktree_id, CAST(f.id % 7 + 1 AS BIGINT) AS generation_id, f.blob_sha FROM m_files f JOIN g_packages p ON p.key = f.package_key JOIN x_worktrees w ON w.nk = p.nk""",
    "x_blobs": "SELECT blob_sha, 'sha1' AS object_format, CAST(id * 10 AS BIGINT) AS byte_size FROM m_files UNION ALL SELECT md5(concat('loose', CAST(id AS STRING))), 'sha1', CAST(id AS BIGINT) FROM m_files WHERE id % 6 = 0",
    "x_cache": "SELECT blob_sha, 'sha1' AS object_format, CASE WHEN id % 15 = 0 THEN '{\"p\":' ELSE '{\"p\":1}' END AS syntax_json FROM m_files WHERE id % 3 = 0",
    "x_points": "SELECT concat('file:supplier/', CAST(user_id % 10 AS STRING)) AS file_key, CAST(floor(value) AS BIGINT) AS pos, CAST(event_id AS BIGINT) AS id FROM events",
    "x_spans": """SELECT file_key, start_line AS first, start_line + CAST(regexp_extract(key, '([0-9]+)$', 1) AS BIGINT) % 40 AS last, key AS symbol_key, CAST(regexp_extract(key, '([0-9]+)$', 1) AS BIGINT) AS ord
FROM g_symbols WHERE key LIKE 'symbol:part/%'""",
    "x_methods": "SELECT DISTINCT concat('type:', p_brand, '/', p_type) AS type_key, p_name AS method FROM part",
    "x_required": "SELECT DISTINCT concat('iface:', p_type, '/', CAST(p_size AS STRING)) AS interface_key, p_name AS method FROM part",
    "x_tests": "SELECT key, name, package_key FROM g_symbols WHERE kind = 'test'",
    "x_production": "SELECT key, CASE WHEN key LIKE 'symbol:order/%' THEN replace(name, 'order', 'Order') ELSE name END AS name, package_key, CAST(regexp_extract(key, '([0-9]+)$', 1) AS BIGINT) AS ord FROM g_symbols WHERE kind IN ('function', 'method')",
    "x_objects": """SELECT 'object' AS form, key AS name, key AS symbol_key FROM g_symbols WHERE key LIKE '%3' UNION ALL
SELECT 'canonical', concat('c:', substr(key, 8)), key FROM g_symbols WHERE key LIKE '%5' UNION ALL SELECT 'loose', concat('l:', substr(key, 8)), key FROM g_symbols WHERE key LIKE '%7'""",
    "x_uses": "SELECT evidence_id AS id, target_key AS object, concat('c:', substr(target_key, 8)) AS canonical, concat('l:', substr(target_key, 8)) AS loose FROM g_evidence",
    "x_sites": """SELECT source_key, target_key, CASE WHEN kind = 'unresolved_call' THEN 'unknown' WHEN kind = 'references' THEN 'conversion' ELSE 'function' END AS callee,
 CASE start_line % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'defer' ELSE '' END AS mode FROM g_evidence""",
    "x_old": """SELECT package_key, kind, receiver, name, path, start_line, key, md5(signature) AS digest FROM g_symbols WHERE key NOT LIKE '%1'""",
    "x_new": """SELECT package_key, kind, receiver, name, CASE WHEN key LIKE '%44' THEN concat('moved/', path) ELSE path END AS path, start_line,
 CASE WHEN key LIKE '%44' THEN concat(key, '-moved') ELSE key END AS key, CASE WHEN key LIKE '%6' THEN md5(concat(signature, 'x')) ELSE md5(signature) END AS digest FROM g_symbols WHERE key NOT LIKE '%2'""",
    "x_changed": "SELECT key FROM g_symbols WHERE key LIKE '%9'",
    "x_touched": "SELECT path FROM m_files WHERE id % 10 = 4",
    "x_local": """SELECT key, kind, package_key, file_key, concat(name, '_local') AS name, signature, receiver, path, start_line + 1 AS start_line, end_line + 1 AS end_line, exported FROM g_symbols WHERE key LIKE '%9' AND key NOT LIKE '%99'""",
    "x_export": """SELECT source_key AS id, '' AS kind, '' AS name, '' AS path, '' AS package, CAST(0 AS BIGINT) AS start_line, CAST(0 AS BIGINT) AS external, CAST(1 AS BIGINT) AS seed FROM g_edges WHERE kind = 'tests'
UNION ALL SELECT target_key, 'symbol', '', '', '', CAST(0 AS BIGINT), CASE WHEN target_key LIKE 'unresolved:%' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END, CAST(0 AS BIGINT) FROM g_edges WHERE kind IN ('tests', 'unresolved_call', 'calls')
UNION ALL SELECT key, kind, name, path, package_key, start_line, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM g_symbols WHERE exported = 1""",
    "x_rows": """SELECT e.source_key AS source, e.target_key AS target, CASE WHEN e.kind IN ('calls', 'possible_call') THEN 'calls' ELSE e.kind END AS kind, CASE WHEN e.start_line = 7 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS historical,
 CASE WHEN e.kind = 'possible_call' THEN 'possible' WHEN e.kind = 'tests' THEN 'inferred' ELSE 'exact' END AS confidence, coalesce(s.path, '') AS path, e.start_line AS start_line, e.details AS details
FROM g_evidence e LEFT JOIN g_symbols s ON s.key = e.source_key WHERE e.kind <> 'unresolved_call'""",
}

"""SQL for p1, p3, p4 and p5, over the whole tables."""

from __future__ import annotations

_ID = "replace(trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(92), '/')"


def nid(column: str) -> str:
    return _ID.format(column)


def _set(column: str, item: str = "x") -> str:
    return f"list_sort(list_distinct([{item} for x in coalesce({column}, [])]))"


P1 = f"""
WITH good AS (SELECT DISTINCT {nid('repo')} AS repo, snapshot_no FROM snapshot_index WHERE status = 'success'),
pairs AS (SELECT repo, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS prior_no FROM good),
rows_ AS (
  SELECT {nid('repo')} AS repo, {nid('slice_id')} AS slice_id, snapshot_no, delivered_at,
    [coalesce('V' || slice_domain, 'N'), coalesce('V' || slice_type, 'N'), coalesce('V' || extractor, 'N'), coalesce('V' || lang, 'N'),
     coalesce('V' || source_checksum, 'N'), coalesce('V' || line_no, 'N'), coalesce('V' || end_line, 'N'), coalesce('V' || {nid('file_path')}, 'N'),
     coalesce('V' || list_sort([k || '=' || json_extract(element, '$."' || k || '"')::VARCHAR for k in json_keys(element)])::VARCHAR, 'N'),
     {_set('source_files', nid('x'))}::VARCHAR, {_set('tags')}::VARCHAR] AS state
  FROM slice_snapshots WHERE slice_id IS NOT NULL),
latest AS (SELECT repo, slice_id, snapshot_no, arg_max(state, delivered_at) AS state FROM rows_ GROUP BY ALL),
cur AS (SELECT l.*, p.prior_no FROM latest l JOIN pairs p USING (repo, snapshot_no) WHERE prior_no IS NOT NULL),
pri AS (SELECT l.repo, l.slice_id, l.state, p.snapshot_no FROM latest l JOIN pairs p ON l.repo = p.repo AND l.snapshot_no = p.prior_no)
SELECT coalesce(c.repo, p.repo) AS repo, coalesce(c.slice_id, p.slice_id) AS slice_id, coalesce(c.snapshot_no, p.snapshot_no) AS snapshot_no,
  CASE WHEN p.repo IS NULL THEN 'added' WHEN c.repo IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM cur c FULL JOIN pri p ON c.repo = p.repo AND c.slice_id = p.slice_id AND c.snapshot_no = p.snapshot_no
WHERE p.repo IS NULL OR c.repo IS NULL OR c.state <> p.state
"""

P1_OLD = f"""
WITH c AS (SELECT * FROM ({P1}) WHERE change_kind <> 'added'),
good AS (SELECT DISTINCT {nid('repo')} AS repo, snapshot_no FROM snapshot_index WHERE status = 'success'),
pairs AS (SELECT repo, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS prior_no FROM good),
l AS (SELECT {nid('repo')} AS repo, {nid('slice_id')} AS slice_id, snapshot_no AS prior_no, arg_max({{'c': source_checksum, 'l': line_no}}, delivered_at) AS v FROM slice_snapshots GROUP BY ALL)
SELECT c.repo, c.slice_id, c.snapshot_no, c.change_kind, l.v.c AS old_source_checksum, l.v.l AS old_line_no
FROM c JOIN pairs p ON c.repo = p.repo AND c.snapshot_no = p.snapshot_no JOIN l ON l.repo = c.repo AND l.slice_id = c.slice_id AND l.prior_no = p.prior_no
"""

P3 = f"""
WITH RECURSIVE links AS (
  SELECT {nid('to_id')} AS child, min({nid('from_id')}) AS parent FROM merged_edges
  WHERE lower({nid('verb')}) = 'contains' AND from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY 1),
nodes AS (SELECT child AS node_id FROM links UNION SELECT parent FROM links),
tree AS (
  SELECT node_id, node_id AS root_id, 0 AS depth, node_id AS node_path FROM nodes WHERE node_id NOT IN (SELECT child FROM links)
  UNION ALL
  SELECT l.child, t.root_id, t.depth + 1, t.node_path || ' > ' || l.child FROM tree t JOIN links l ON l.parent = t.node_id),
bad AS (SELECT * FROM links WHERE child NOT IN (SELECT node_id FROM tree)),
up AS (SELECT child AS node_id, parent AS above FROM bad UNION SELECT u.node_id, l.parent FROM up u JOIN bad l ON l.child = u.above),
cyc AS (SELECT DISTINCT node_id FROM up WHERE node_id = above)
SELECT node_id, root_id, depth, node_path, 'ok' AS state FROM tree
UNION ALL
SELECT child, '', -1, '', CASE WHEN child IN (SELECT node_id FROM cyc) THEN 'cycle' ELSE 'under_cycle' END FROM bad
"""

_KEY = "|| '/' ||".join(nid(f"{{0}}{c}") for c in ("slice_domain", "slice_type", "slice_id"))

_ORPHANS = f"""
refs AS (
  SELECT DISTINCT ref_field, owner_id, {_KEY.format('r.')} AS target_id, recorded_at FROM (
    SELECT 'forward_refs' AS ref_field, {_KEY.format('')} AS owner_id, unnest(forward_refs) AS r, recorded_at FROM slices
    UNION ALL SELECT 'backward_refs', {_KEY.format('')}, unnest(backward_refs), recorded_at FROM slices)
  UNION SELECT 'merged_edges', edge_id::VARCHAR, {nid('to_id')}, recorded_at FROM merged_edges),
parents AS (
  SELECT DISTINCT 's' AS kind, {_KEY.format('')} AS target_id, created_at, deleted_at FROM slices
  UNION SELECT 'e', {nid('node_id')}, created_at, deleted_at FROM ws_nodes
  UNION SELECT 'e', {nid('system_id')}, NULL, NULL FROM external_systems),
keyed AS (SELECT *, CASE WHEN ref_field = 'merged_edges' THEN 'e' ELSE 's' END AS kind FROM refs WHERE target_id IS NOT NULL),
found AS (
  SELECT ref_field, owner_id, k.target_id, recorded_at,
    CASE WHEN count(p.target_id) = 0 THEN 'missing' WHEN bool_and(coalesce(p.created_at > recorded_at, false)) THEN 'late' ELSE 'deleted' END AS reason
  FROM keyed k LEFT JOIN parents p ON k.kind = p.kind AND k.target_id = p.target_id
  GROUP BY ALL
  HAVING NOT coalesce(bool_or(p.target_id IS NOT NULL AND coalesce(p.created_at <= recorded_at, true) AND coalesce(recorded_at < p.deleted_at, true)), false))
"""
P4 = f"WITH {_ORPHANS} SELECT DISTINCT ref_field, owner_id, target_id, reason FROM found"
P4_COUNTS = f"""
WITH {_ORPHANS}
SELECT CASE WHEN ref_field = 'merged_edges' THEN 'merged_edges' ELSE 'slices' END AS table_name, strftime(recorded_at, '%Y-%m') AS period, reason,
  count(*) AS n_refs, count(DISTINCT target_id) AS n_targets
FROM found GROUP BY ALL
"""

P5 = f"""
WITH runs AS (SELECT DISTINCT run_id, started_at FROM recon_runs WHERE status = 'success' AND started_at IS NOT NULL),
pairs AS (SELECT run_id, started_at, lag(started_at) OVER (ORDER BY started_at, run_id) AS prior_at FROM runs),
log AS (
  SELECT DISTINCT {nid('slice_id')} AS slice_id, extracted_at::TIMESTAMPTZ AS instant, {_set('source_files', nid('x'))} AS files, source_checksum, arrived_at
  FROM slice_metadata WHERE slice_id IS NOT NULL),
seen AS (
  SELECT run_id, slice_id, max(instant) AS instant, arg_max((files, source_checksum), instant) AS content,
    max(instant) FILTER (arrived_at <= prior_at) AS old_instant, arg_max((files, source_checksum), instant) FILTER (arrived_at <= prior_at) AS old_content
  FROM pairs JOIN log ON arrived_at <= started_at GROUP BY ALL)
SELECT run_id, slice_id FROM seen
WHERE old_instant IS NULL OR (instant <> old_instant AND (content[2] IS NULL OR old_content[2] IS NULL OR content <> old_content))
"""

ORACLE = {"p1_found": P1, "p1_old_values": P1_OLD, "p3_found": P3, "p4_found": P4, "p4_counts": P4_COUNTS, "p5_found": P5}

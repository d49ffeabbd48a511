"""SQL for the graph queries, over the whole tables."""

from __future__ import annotations

from graphlens.operators import search, workspace
from graphlens.plans import graph_queries as q
from graphlens.plans.data_oracle import _KEY, P1, nid

_K = _KEY.format("")
_SN = f"""sn AS (
  SELECT key, min(domain) AS domain, min(type) AS type, min(id) AS id, min(repo) AS repo, min(path) AS path, list_sort(list_distinct(coalesce(flatten(list(tags)), []))) AS tags,
    regexp_extract(min(id), '([^:/.]*)$', 1) AS name
  FROM (SELECT {_K} AS key, slice_domain AS domain, slice_type AS type, {nid('slice_id')} AS id, repo, {nid('source_files[1]')} AS path, coalesce(tags, []) AS tags FROM slices)
  WHERE key IS NOT NULL GROUP BY key)"""


def _refs(name: str, field: str) -> str:
    return f"{name} AS (SELECT DISTINCT src, dst FROM (SELECT src, {_KEY.format('r.')} AS dst FROM (SELECT {_K} AS src, unnest({field}) AS r FROM slices)) WHERE src IS NOT NULL AND dst IS NOT NULL)"


_SF, _SB = _refs("sf", "forward_refs"), _refs("sb", "backward_refs")
_WN = f"""wn AS (
  SELECT id, min(type) AS type, min(name) AS name, min(repo) AS repo FROM (
    SELECT {nid('node_id')} AS id, node_type AS type, name, repo FROM ws_nodes
    UNION ALL SELECT {nid('system_id')}, 'ExternalSystem', name, 'external' FROM external_systems) WHERE id IS NOT NULL GROUP BY id)"""
_WE = f"""we AS (
  SELECT DISTINCT {nid('from_id')} AS src, {nid('to_id')} AS dst, lower(trim(verb)) AS verb FROM merged_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND verb IS NOT NULL)"""
_PLACED = "pl AS (SELECT e.*, a.repo AS src_repo, a.type AS src_type, b.repo AS dst_repo, b.type AS dst_type FROM we e JOIN wn a ON e.src = a.id JOIN wn b ON e.dst = b.id)"


def _case(values: dict, default) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN verb = '{k}' THEN {lit(v)}" for k, v in values.items()) + f" ELSE {lit(default)} END"


_ONE = """kf AS (SELECT * FROM sf WHERE src IN (SELECT key FROM sn) AND dst IN (SELECT key FROM sn)),
kb AS (SELECT dst AS src, src AS dst FROM sb WHERE src IN (SELECT key FROM sn) AND dst IN (SELECT key FROM sn)),
one AS (SELECT src, dst, 'backward' AS missing FROM (SELECT * FROM kf EXCEPT SELECT * FROM kb) UNION ALL SELECT src, dst, 'forward' FROM (SELECT * FROM kb EXCEPT SELECT * FROM kf)),
iso AS (SELECT key FROM sn WHERE key NOT IN (SELECT src FROM sf UNION SELECT src FROM sb))"""


def _score(term: str) -> str:
    t = term.lower()
    return f"""CASE WHEN lower(id) = '{t}' THEN 100 WHEN contains(lower(id), '{t}') THEN 80 WHEN lower(name) = '{t}' THEN 75 WHEN contains(lower(name), '{t}') THEN 72
      WHEN contains(lower(path), '{t}') THEN 60 WHEN contains(lower(key), '{t}') THEN 40 WHEN len(list_filter(tags, lambda x: contains(lower(x), '{t}'))) > 0 THEN 35 ELSE 0 END"""


def _search(found: list[str], limit: int = 50) -> str:
    scores = ", ".join(f"({_score(t)})" for t in found)
    return f"""WITH {_SN}, sc AS (SELECT key, [{scores}] AS s FROM sn),
      t AS (SELECT key, list_sum(s) AS total, len(list_filter(s, lambda x: x > 0)) AS m FROM sc)
      SELECT key, (total + CASE WHEN m > 1 THEN (m - 1) * 20 ELSE 0 END)::INTEGER AS score FROM t WHERE total > 0 ORDER BY score DESC, key LIMIT {limit}"""


def _hubs(table: str, end: str, n: int, where: str = "true") -> str:
    return f"(SELECT {end} AS seed FROM {table} WHERE {where} GROUP BY {end} ORDER BY count(*) DESC, {end} LIMIT {n})"


def _ends(table: str) -> str:
    """Every end of an edge as a seed."""
    return f"(SELECT src AS seed FROM {table} UNION SELECT dst FROM {table})"


_EVERY = "(SELECT src AS seed FROM sf UNION SELECT dst FROM sf UNION SELECT key FROM sn)"


def _ball(links: str, seeds: str, depth: int | None) -> str:
    """Common tables: ball (seed, node, depth) by recursion; needs WITH RECURSIVE before."""
    if depth is None:
        return f"""walk AS (SELECT seed, seed AS node FROM {seeds} UNION SELECT w.seed, l.dst FROM walk w JOIN {links} l ON w.node = l.src), ball AS (SELECT seed, node, 0 AS depth FROM walk)"""
    return f"""walk AS (SELECT seed, seed AS node, 0 AS depth FROM {seeds} UNION SELECT w.seed, l.dst, w.depth + 1 FROM walk w JOIN {links} l ON w.node = l.src WHERE w.depth < {depth}),
      ball AS (SELECT seed, node, min(depth)::INTEGER AS depth FROM walk GROUP BY ALL)"""


_REV = "rev AS (SELECT dst AS src, src AS dst FROM sf)"
_BOTH = "both_ AS (SELECT src, dst FROM sf UNION SELECT dst, src FROM sf)"
_WBOTH = "both_ AS (SELECT src, dst FROM we UNION SELECT dst, src FROM we)"
# Heights over the implements edges: nodes on a cycle, or on a way between two, are taken out with their edges and have 0.
_HEIGHTS = """e AS (SELECT DISTINCT src, dst FROM we WHERE verb = 'implements'), n AS (SELECT src AS key FROM e UNION SELECT dst FROM e),
      way AS (SELECT src, dst FROM e UNION SELECT way.src, e.dst FROM way JOIN e ON way.dst = e.src), cyc AS (SELECT src AS key FROM way WHERE src = dst),
      core AS (SELECT key FROM cyc UNION (SELECT way.dst FROM way JOIN cyc ON way.src = cyc.key INTERSECT SELECT way.src FROM way JOIN cyc ON way.dst = cyc.key)),
      a AS (SELECT * FROM e WHERE src NOT IN (SELECT key FROM core)), up AS (SELECT key, 0 AS depth FROM n UNION SELECT a.src, up.depth + 1 FROM up JOIN a ON a.dst = up.key),
      h AS (SELECT key, max(depth)::INTEGER AS depth FROM up GROUP BY key)"""
_CL = "cl AS (SELECT DISTINCT src, dst FROM we WHERE verb IN ('implements', 'deploys_to', 'has_contract')), clr AS (SELECT dst AS src, src AS dst FROM cl), clv AS (SELECT * FROM we WHERE verb IN ('implements', 'deploys_to', 'has_contract'))"
_WB = f"WITH RECURSIVE {_WN}, {_WE}, {_WBOTH}, {_ball('both_', _ends('we'), 2)}, hit AS (SELECT b.*, n.repo, n.id FROM ball b LEFT JOIN wn n ON b.node = n.id WHERE depth > 0)"


def _admit(level: int) -> str:
    tier = _case(workspace.TIERS, 5)
    rule = {0: f"{tier} <= 1", 1: f"({tier} <= 2 OR ({tier} = 4 AND src_repo <> dst_repo))", 2: f"({tier} <= 3 OR ({tier} = 4 AND src_repo <> dst_repo))"}.get(level, "true")
    return f"sh AS (SELECT src, dst, verb FROM pl WHERE {rule})"


_G1 = """gr AS (SELECT n.id, CASE WHEN c.n >= 3 AND n.type NOT IN ('StateMachine', 'Bucket', 'Service') THEN n.type || '_group_' || n.repo ELSE n.id END AS group_id
  FROM wn n JOIN (SELECT repo, type, count(*) AS n FROM wn GROUP BY ALL) c ON n.repo = c.repo AND n.type = c.type)"""


_SEEN = "NOT (type = 'Topic' AND regexp_matches(lower(id), 'alarm|monitor')) AND type NOT IN ('Role', 'SecurityGroup', 'LogGroup', 'Alarm', 'Certificate', 'DNSRecord')"


def _compress(level: int) -> str:
    wn = _WN if level > 1 else f"{_WN.replace('wn AS', 'w0 AS', 1)}, wn AS (SELECT * FROM w0 WHERE {_SEEN})"
    groups = {0: "gr AS (SELECT id, 'Service_' || repo AS group_id FROM wn)", 1: _G1}.get(level, "gr AS (SELECT id, id AS group_id FROM wn)")
    return f"""WITH {wn}, {_WE}, {_PLACED}, {_admit(level)}, {groups}
      SELECT a.group_id AS from_group, b.group_id AS to_group, verb, count(*) AS multiplicity FROM sh JOIN gr a ON sh.src = a.id JOIN gr b ON sh.dst = b.id
      WHERE a.group_id <> b.group_id GROUP BY ALL"""


_SCAN = f"scan AS (SELECT repo, {nid('file_path')} AS path, arg_max(source_hash, (scanned_at, source_hash)) AS source_hash FROM source_files GROUP BY ALL)"
_BODY = "replace(body, chr(13), '')"
_EXT = f"regexp_extract({nid('file_path')}, '\\.([A-Za-z]+)$', 1)"


def _of(*ext: str) -> str:
    return f"(SELECT DISTINCT file_id, {_BODY} AS body FROM source_files WHERE body IS NOT NULL AND {_EXT} IN ({', '.join(repr(e) for e in ext)}))"


def _all_matches(rows: str, pattern: str, group: int = 1) -> str:
    return f"SELECT DISTINCT file_id, unnest(regexp_extract_all(body, '{pattern}', {group})) AS name FROM {rows}"


_DEC = r"(?m)^  - id: (DEC-\d+)\n    summary: [^\n]*\n    enables: \[([^\]\n]*)\]"
_words = list(dict.fromkeys(__import__("re").findall(r"[a-z0-9]+", q.TASK.lower())))
_W = "[" + ", ".join(f"'{w}'" for w in _words) + "]"

_RECORDS = f"""t AS (SELECT DISTINCT body, regexp_extract(body, '(?m)^id: ([^ ' || chr(10) || ']+)', 1) AS adr_id FROM {_of('yaml', 'yml')}), m AS (SELECT adr_id, unnest(regexp_extract_all(body, '{_DEC}', 0)) AS m FROM t WHERE adr_id <> ''),
  f AS (SELECT adr_id, regexp_extract(m, '(DEC-[0-9]+)', 1) AS dec, regexp_extract(m, 'enables: [[]([^]]*)[]]', 1) AS caps FROM m),
  decl AS (SELECT DISTINCT 'declares' AS rel_type, adr_id AS src, dec AS dst FROM f UNION SELECT DISTINCT 'enables', dec, cap FROM (SELECT dec, unnest(string_split_regex(caps, ', *')) AS cap FROM f) WHERE cap <> '')"""
_STEP = """SELECT seed, node, arg_min(rel_type, (NOT hard, rel_type)) AS via, bool_or(hard) AS hard FROM (SELECT f.seed, r.dst AS node, r.rel_type, r.rel_type IN ('implements', 'implemented_by') AS hard FROM {front} f JOIN cr r ON f.node = r.src {where}) WHERE (seed, node) NOT IN ({seen}) GROUP BY ALL"""
_LATER = "WHERE r.rel_type IN ('implements', 'implemented_by')"

_NF = f"nf AS (SELECT DISTINCT key, {nid('f')} AS file FROM (SELECT {_K} AS key, unnest(source_files) AS f FROM slices) WHERE key IS NOT NULL AND f IS NOT NULL)"
_STALE = f"""{_SCAN}, mt AS (SELECT {nid('slice_id')} AS slice_id, repo, {nid('f')} AS path, arg_max(source_checksum, (seq_no, source_checksum)) AS c FROM (SELECT slice_id, repo, seq_no, source_checksum, unnest(source_files) AS f FROM slice_metadata WHERE slice_id IS NOT NULL) GROUP BY ALL),
  stale AS (SELECT DISTINCT mt.path AS file FROM mt JOIN scan ON mt.repo = scan.repo AND mt.path = scan.path WHERE c <> source_hash)"""
_ENTRY = "coalesce(list_contains(tags, 'exported') OR domain = 'api', false)"


def _overview(by: str, where: str) -> str:
    return f"""WITH {_SN}, x AS (SELECT *, {_ENTRY} AS entry FROM sn WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY {by}, entry ORDER BY key) AS rank FROM x)
      SELECT {by}, count(*) AS n_nodes, coalesce(string_agg(name, ',' ORDER BY rank) FILTER (entry AND rank <= 5), '') AS entry_points FROM r GROUP BY {by}"""


ORACLE = {
    "strongest_edges": f"""SELECT {nid('from_id')} AS src, {nid('to_id')} AS dst, lower(trim(verb)) AS verb, CASE min(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE min(confidence) FILTER (confidence NOT IN ('high', 'medium')) END AS confidence,
      count(DISTINCT evidence)::INTEGER AS n_evidence FROM merged_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND verb IS NOT NULL GROUP BY 1, 2, 3""",
    "change_advice": f"""WITH RECURSIVE {_SN}, {_SF}, {_REV}, {_ball('rev', _ends('sf'), 2)}, w2 AS (SELECT seed, seed AS node, 0 AS depth FROM {_ends('sf')} UNION SELECT w2.seed, l.dst, w2.depth + 1 FROM w2 JOIN sf l ON w2.node = l.src WHERE w2.depth < 2),
      x AS (SELECT key AS seed, coalesce(n_dependents, 0)::BIGINT AS n_dependents, coalesce(n_impacted, 0) + 1 AS total, split_part(path, '/', -1) AS f FROM sn LEFT JOIN (SELECT seed, sum(u) AS n_dependents, sum(u + v) AS n_impacted FROM (SELECT seed, node, 1 AS u, 0 AS v FROM ball WHERE depth > 0
        UNION ALL SELECT DISTINCT seed, node, 0, 1 FROM w2 WHERE node <> seed) GROUP BY seed) k ON sn.key = k.seed)
      SELECT seed, n_dependents, CASE WHEN total > 20 THEN 'high' ELSE 'medium' END AS risk, CASE WHEN n_dependents > 5 THEN n_dependents || ' dependents: roll out in steps' WHEN n_dependents > 0 THEN n_dependents || ' dependents to review' ELSE 'no dependents' END AS review,
        CASE WHEN f LIKE '%.py' THEN 'tests/test_' || regexp_replace(f, '[.][^.]+$', '') || '.py' WHEN regexp_matches(f, '[.](ts|tsx|js|jsx)$') THEN regexp_replace(f, '[.][^.]+$', '') || '.test.ts,' || regexp_replace(f, '[.][^.]+$', '') || '.spec.ts' ELSE '' END AS tests FROM x""",
    "project_structure": f"""WITH f AS (SELECT DISTINCT repo, {nid('file_path')} AS path FROM source_files WHERE repo IS NOT NULL AND file_path IS NOT NULL),
      m AS (SELECT repo, 'language' AS mark, regexp_extract(path, '[.]([A-Za-z]+)$', 1) AS name FROM f UNION ALL SELECT repo, 'root', split_part(path, '/', 1) FROM f UNION ALL SELECT repo, 'framework', 'angular' FROM f WHERE regexp_matches(path, '(^|/)angular[.]json$')
        UNION ALL SELECT repo, 'framework', 'node' FROM f WHERE regexp_matches(path, '(^|/)package[.]json$') UNION ALL SELECT repo, 'framework', 'serverless' FROM f WHERE regexp_matches(path, '(^|/)(serverless|samconfig|template)[.](ya?ml|toml)$')
        UNION ALL SELECT repo, 'domain', 'frontend' FROM f WHERE regexp_matches(path, '(^|/)(frontend|components|ui|web)/') UNION ALL SELECT repo, 'domain', 'api' FROM f WHERE regexp_matches(path, '(^|/)(api|routes|handlers|controllers)/')
        UNION ALL SELECT repo, 'domain', 'data' FROM f WHERE regexp_matches(path, '(^|/)(data|models|repository|schemas?)/') UNION ALL SELECT repo, 'domain', 'infrastructure' FROM f WHERE regexp_matches(path, '(^|/)(infra|infrastructure|cloudformation|terraform)/')
        UNION ALL SELECT repo, 'domain', 'testing' FROM f WHERE regexp_matches(path, '(^|/)tests?/')) SELECT repo, mark, name, count(*) AS n_files FROM m WHERE name <> '' GROUP BY ALL""",
    "style_classes": f"""WITH t AS (SELECT file_id, regexp_replace(regexp_replace(body, '(?s)/[*].*?[*]/', '', 'g'), '"[^"\\n]*"', '', 'g') AS b FROM {_of('css')}), s AS (SELECT file_id, unnest(regexp_extract_all(b, '([^{{}};]*)[{{]', 1)) AS sel FROM t)
      SELECT DISTINCT file_id, unnest(regexp_extract_all(sel, '[.]([A-Za-z_][A-Za-z0-9_-]*)', 1)) AS name FROM s WHERE NOT starts_with(trim(sel, ' ' || chr(10)), '@')""",
    "decision_gravity": f"""WITH {_RECORDS}, en AS (SELECT src AS id FROM decl UNION SELECT dst FROM decl), d AS (SELECT id FROM en WHERE starts_with(id, 'DEC-')), e AS (SELECT DISTINCT src, dst FROM decl),
      p AS (SELECT d.id, a.src AS n FROM d JOIN e a ON a.dst = d.id UNION SELECT d.id, b.src FROM d JOIN e a ON a.dst = d.id JOIN e b ON b.dst = a.src), far AS (SELECT id, count(*) AS n FROM p WHERE n <> id GROUP BY id), c AS (SELECT src AS id, count(DISTINCT dst) AS n FROM decl WHERE rel_type = 'enables' GROUP BY src)
      SELECT d.id AS decision_id, coalesce(far.n, 0)::BIGINT AS dependents, 0::BIGINT AS enforces, 0::BIGINT AS governs, coalesce(c.n, 0)::BIGINT AS enables, 0::INTEGER AS consequences, (coalesce(far.n, 0) * 2 + coalesce(c.n, 0))::BIGINT AS gravity FROM d LEFT JOIN far ON d.id = far.id LEFT JOIN c ON d.id = c.id""",
    "gravity_summary": f"""WITH {_RECORDS}, en AS (SELECT src AS id FROM decl UNION SELECT dst FROM decl), d AS (SELECT id FROM en WHERE starts_with(id, 'DEC-')), e AS (SELECT DISTINCT src, dst FROM decl),
      p AS (SELECT d.id, a.src AS n FROM d JOIN e a ON a.dst = d.id UNION SELECT d.id, b.src FROM d JOIN e a ON a.dst = d.id JOIN e b ON b.dst = a.src), far AS (SELECT id, count(*) AS n FROM p WHERE n <> id GROUP BY id), c AS (SELECT src AS id, count(DISTINCT dst) AS n FROM decl WHERE rel_type = 'enables' GROUP BY src),
      g AS (SELECT coalesce(far.n, 0) * 2 + coalesce(c.n, 0) AS v FROM d LEFT JOIN far ON d.id = far.id LEFT JOIN c ON d.id = c.id) SELECT count(*) AS n_decisions, max(v)::BIGINT AS max_gravity, round(avg(v), 6) AS mean_gravity FROM g""",
    "record_boundaries": f"""WITH {_RECORDS}, en AS (SELECT src AS id FROM decl UNION SELECT dst FROM decl) SELECT id AS adr_id, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM decl WHERE rel_type = 'declares' AND src = id), '') AS declared FROM en WHERE NOT starts_with(id, 'DEC-') AND NOT starts_with(id, 'CAP-')""",
    "record_chains": f"""WITH {_RECORDS} SELECT DISTINCT src AS decision_id, rel_type AS relationship, dst AS target, CASE WHEN starts_with(dst, 'DEC-') THEN 'decision' WHEN starts_with(dst, 'CAP-') THEN 'capability' ELSE 'adr' END AS target_type FROM decl WHERE rel_type = 'enables' AND starts_with(src, 'DEC-')""",
    "identity_findings": f"""WITH m AS (SELECT (max(seq_no) + min(seq_no)) / 2 AS mid FROM slice_metadata), r AS (SELECT seq_no, {nid('f')} AS path, {nid('slice_id')} AS id, extractor_version AS x FROM (SELECT *, unnest(source_files) AS f FROM slice_metadata) WHERE f IS NOT NULL AND slice_id IS NOT NULL),
      o AS (SELECT path, max({{'id': id, 'x': coalesce(x, '')}}) AS v FROM r, m WHERE seq_no <= mid GROUP BY path), n AS (SELECT path, max({{'id': id, 'x': coalesce(x, '')}}) AS v FROM r, m WHERE seq_no > mid GROUP BY path)
      SELECT CASE WHEN o.v.x IS NOT DISTINCT FROM n.v.x THEN 'ERROR' ELSE 'INFO' END AS severity, path, o.v.id AS old_id, n.v.id AS new_id FROM o JOIN n USING (path) WHERE o.v.id <> n.v.id""",
    "source_excerpts": f"""WITH l AS (SELECT DISTINCT entity_uri AS key, concat_ws('|', repo, {nid('file_path')}) AS path, greatest(coalesce(line_start, 1), 1) AS a, line_end AS z FROM source_locators WHERE entity_uri IS NOT NULL AND repo IS NOT NULL),
      f AS (SELECT concat_ws('|', repo, {nid('file_path')}) AS path, string_split(replace(arg_max(body, (scanned_at, body)), chr(13), ''), chr(10)) AS b FROM source_files WHERE body IS NOT NULL AND repo IS NOT NULL GROUP BY 1),
      x AS (SELECT key, l.path, a, least(coalesce(z, len(b)), len(b)) AS z, b FROM l JOIN f ON l.path = f.path)
      SELECT key, path, array_to_string(list_transform(range(a, a + greatest(least(z - a + 1, 50), 0)), lambda i: CASE WHEN i <= len(b) THEN lpad(i::VARCHAR, 4, ' ') || ' | ' || b[i] END), chr(10)) AS source, z - a + 1 > 50 AS truncated FROM x""",
    "adaptive_debounced": """WITH e AS (SELECT *, epoch_us(ts) AS u FROM events), b AS (SELECT *, (count(*) OVER (PARTITION BY user_id ORDER BY u RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW)) >= 3
        OR len(list_distinct(list(user_id) OVER (ORDER BY u RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW))) >= 40 AS busy FROM e),
      g AS (SELECT *, max(u + CASE WHEN busy THEN 7200000000 ELSE 1800000000 END) OVER (PARTITION BY user_id ORDER BY u, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM b),
      r AS (SELECT *, sum(CASE WHEN until IS NULL OR u > until THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY u, event_id) AS run FROM g)
      SELECT user_id, min(ts) AS begins, max(ts) AS ends, count(*) AS n_events, arg_max(event_type, (ts, event_type)) AS last_event FROM r GROUP BY user_id, run""",
    "domain_index": f"WITH {_SN} SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY key) AS position, key FROM sn",
    "show_node": f"""WITH {_SN}, {_SF}, top AS ({_search([q.TERM], 1)}) SELECT 0 AS ord, key, 0 AS depth FROM top
      UNION ALL SELECT * FROM (SELECT (row_number() OVER (ORDER BY dst))::INTEGER AS ord, dst AS key, 1 AS depth FROM sf JOIN top ON sf.src = top.key WHERE dst <> src ORDER BY dst LIMIT 20)""",
    "implementation_context": f"WITH RECURSIVE {_SN}, {_SF}, {_ball('sf', _EVERY, 1)} SELECT seed, node, depth, domain, type, path FROM ball JOIN sn ON node = key",
    "related_implementations": f"WITH RECURSIVE {_SN}, {_SF}, {_BOTH}, {_ball('both_', _EVERY, 2)} SELECT seed, node, depth FROM ball JOIN sn a ON seed = a.key JOIN sn b ON node = b.key WHERE depth > 0 AND a.domain = b.domain AND a.type = b.type",
    "overview": _overview("domain", "true"),
    "overview_repos": _overview("repo, domain", "repo IS NOT NULL"),
    "key_components": f"WITH {_SN}, {_SF} SELECT dst AS key, count(*) AS n_dependents FROM sf WHERE dst IN (SELECT key FROM sn) GROUP BY dst HAVING count(*) > 3 ORDER BY n_dependents DESC, key LIMIT 10",
    "stack_kind": f"""WITH {_SN}, d AS (SELECT DISTINCT domain FROM sn), h AS (SELECT count(*) FILTER (domain = 'frontend') AS f, count(*) FILTER (domain = 'api') AS a, count(*) FILTER (domain = 'data') AS t, count(*) FILTER (domain = 'infrastructure') AS i, count(*) AS n_domains FROM d)
      SELECT (SELECT count(*) FROM sn) AS n_nodes, n_domains, CASE WHEN f + a + t = 3 THEN 'full stack' WHEN a + t = 2 THEN 'backend' WHEN i = 1 THEN 'infrastructure as code' WHEN n_domains > 3 THEN 'several domains' ELSE 'unknown' END AS stack FROM h""",
    "diagnostics": f"""WITH {_SN}, {_SF}, {_SB}, {_ONE}, x AS (SELECT (SELECT count(*) FROM sn) AS n_nodes, (SELECT count(*) FROM iso) AS n_isolated, (SELECT count(*) FROM (SELECT * FROM sf UNION ALL SELECT * FROM sb) WHERE src IN (SELECT key FROM sn)) AS l)
      SELECT n_nodes, n_isolated, round((n_nodes - n_isolated) / n_nodes, 6) AS connectivity, round(l / n_nodes, 6) AS avg_degree FROM x""",
    "scope_files": f"WITH RECURSIVE {_SN}, {_SF}, {_BOTH}, {_NF}, {_ball('both_', _EVERY, 2)} SELECT DISTINCT a.file AS target, b.file FROM ball JOIN nf a ON seed = a.key JOIN nf b ON node = b.key",
    "scope_freshness": f"""WITH RECURSIVE {_SN}, {_SF}, {_BOTH}, {_NF}, {_STALE}, {_ball('both_', _EVERY, 1)}, sc AS (SELECT DISTINCT a.file AS target, b.file FROM ball JOIN nf a ON seed = a.key JOIN nf b ON node = b.key),
      c AS (SELECT target, count(*) AS n_files, count(*) FILTER (file IN (SELECT file FROM stale)) AS n_stale FROM sc GROUP BY target)
      SELECT *, CASE WHEN n_stale = 0 THEN 'fresh' WHEN n_stale = n_files THEN 'stale' ELSE 'partial' END AS status, CASE WHEN n_stale = 0 THEN 'proceed' ELSE 'reconcile_first' END AS action FROM c""",
    "affected_keys": f"""WITH {_SF}, {_NF}, {_STALE}, hit AS (SELECT DISTINCT key FROM nf WHERE file IN (SELECT file FROM stale))
      SELECT key, 'changed' AS how FROM hit UNION ALL SELECT DISTINCT src, 'depends' FROM sf WHERE dst IN (SELECT key FROM hit) AND src NOT IN (SELECT key FROM hit)""",
    "entity_locators": f"""SELECT uri, entity_uri, repo, file_path FROM (SELECT entity_uri AS uri, entity_uri, repo, {nid('file_path')} AS file_path, row_number() OVER (PARTITION BY entity_uri ORDER BY repo NULLS FIRST, {nid('file_path')} NULLS FIRST) AS n FROM source_locators WHERE entity_uri IS NOT NULL) WHERE n = 1""",
    "node_matrix": f"WITH {_WE} SELECT src, dst, string_agg(verb, ',' ORDER BY verb) AS verbs FROM we GROUP BY src, dst",
    "repo_depth_advice": f"""WITH {_WN}, {_WE}, o AS (SELECT repo, count(*) AS n_nodes FROM wn GROUP BY repo), x AS (SELECT repo, count(*) AS e, count(DISTINCT src) AS s, count(DISTINCT dst) AS t FROM we JOIN wn ON src = id GROUP BY repo),
      m AS (SELECT o.repo, n_nodes, coalesce(e, 0) AS n_edges, coalesce(e / s, 0) AS b, coalesce(1 - t / e, 0) AS c FROM o LEFT JOIN x ON o.repo = x.repo),
      k AS (SELECT *, CASE WHEN n_edges = 0 THEN 'degenerate' WHEN b >= 3.5 THEN 'exploding' WHEN n_edges / n_nodes >= 2 THEN 'dense' WHEN c >= 0.75 THEN 'convergent' WHEN b <= 0.75 THEN 'sparse' ELSE 'balanced' END AS category FROM m)
      SELECT repo, n_nodes, n_edges, category, CASE category WHEN 'balanced' THEN 2 WHEN 'convergent' THEN 3 WHEN 'sparse' THEN 3 ELSE 1 END AS depth FROM k""",
    "node_names": f"""WITH {_WN} SELECT id, trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
      printf('%08x', list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(id, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 33 + c) & 4294967295)) AS hash,
      CASE WHEN length(name) > 12 THEN upper(name[1]) || name[2:9] || '...' ELSE upper(name[1]) || name[2:] END AS label FROM wn WHERE name IS NOT NULL""",
    "token_estimates": "SELECT DISTINCT file_id, repo, ceil(length(body) / 4)::INTEGER AS n_tokens FROM source_files WHERE body IS NOT NULL",
    "extractor_gaps": f"""SELECT kind, count(*) AS n_files FROM (SELECT DISTINCT file_id, CASE WHEN e = 'cs' THEN 'csharp' WHEN e = 'json' THEN 'json' WHEN e IN ('py', 'ts', 'css', 'scss') THEN NULL
      WHEN e IN ('yaml', 'yml') THEN CASE WHEN contains(b, 'AWSTemplateFormatVersion') OR contains(b, 'Type: AWS::') OR contains(b, 'adr_type:') THEN NULL ELSE 'yaml' END ELSE 'unknown' END AS kind
      FROM (SELECT file_id, {_EXT} AS e, coalesce(body, '') AS b FROM source_files)) WHERE kind IS NOT NULL GROUP BY kind""",
    "record_relationships": f"WITH {_RECORDS} SELECT rel_type, src, dst, 'explicit' AS origin FROM decl UNION ALL SELECT 'enabled_by', dst, src, 'derived' FROM decl WHERE rel_type = 'enables'",
    "record_governance": f"WITH {_RECORDS} SELECT src AS decision_id, 0::BIGINT AS n_governs, count(*) AS n_enables, 0::BIGINT AS n_enforces FROM decl WHERE rel_type = 'enables' GROUP BY src",
    "record_gaps": f"WITH {_RECORDS} SELECT DISTINCT rel_type, src AS source_id, dst AS missing_id FROM decl WHERE starts_with(dst, 'CAP-')",
    "consequence_surface": f"""WITH {_WE}, cr AS (SELECT src, dst, verb AS rel_type FROM we UNION SELECT dst, src, 'implemented_by' FROM we WHERE verb = 'implements'), s0 AS (SELECT seed, seed AS node FROM {_ends('we')}),
      s1 AS ({_STEP.format(front='s0', where='', seen='SELECT seed, node FROM s0')}), s2 AS ({_STEP.format(front='s1', where=_LATER, seen='SELECT seed, node FROM s0 UNION SELECT seed, node FROM s1')}),
      s3 AS ({_STEP.format(front='s2', where=_LATER, seen='SELECT seed, node FROM s0 UNION SELECT seed, node FROM s1 UNION SELECT seed, node FROM s2')}),
      a AS (SELECT *, 1 AS depth FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3) SELECT seed, node, depth, CASE WHEN hard THEN 'hard' ELSE 'soft' END AS tier, via FROM a""",
    "dependency_charts": f"""WITH {_WN}, {_WE}, {_PLACED}, x AS (SELECT src_repo, dst_repo, count(*) AS n, array_to_string(list_sort(list_distinct(list(verb))), ',') AS verbs FROM pl WHERE src_repo <> dst_repo GROUP BY ALL),
      l AS (SELECT src_repo, '  ' || regexp_replace(src_repo, '[^a-zA-Z0-9_]', '_', 'g') || ' -->|' || verbs || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '| ' || regexp_replace(dst_repo, '[^a-zA-Z0-9_]', '_', 'g') AS line FROM x)
      SELECT src_repo, 'graph LR' || chr(10) || array_to_string(list_sort(list(line)), chr(10)) AS chart FROM l GROUP BY src_repo""",
    "file_tags": f"""WITH f AS (SELECT DISTINCT file_id, {nid('file_path')} AS path FROM source_files), x AS (SELECT *, lower(path) AS p, regexp_extract(path, '[.]([A-Za-z]+)$', 1) AS e FROM f)
      SELECT DISTINCT file_id, unnest(list_filter(['layer:' || CASE WHEN regexp_matches(p, '/(api|routes|endpoints)/') THEN 'api' WHEN regexp_matches(p, '/(lambda|handlers)/') THEN 'lambda' WHEN regexp_matches(p, '/(services?|domain)/') THEN 'service' WHEN regexp_matches(p, '/(data|repository|models)/') THEN 'data'
          WHEN regexp_matches(p, '/(components|frontend|src/app)/') THEN 'frontend' WHEN regexp_matches(p, '/(cloudformation|infrastructure)/') THEN 'infrastructure' WHEN regexp_matches(p, '/(recon|rss)/') THEN 'recon' WHEN contains(p, '/scripts/') THEN 'scripts' WHEN regexp_matches(p, '/tests?/') THEN 'test' ELSE 'util' END,
        CASE WHEN e <> '' THEN 'lang:' || CASE e WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'cs' THEN 'csharp' ELSE e END END, CASE WHEN regexp_matches(p, '(^|/)tests?/|[._-](test|spec)[._]') THEN 'test' END], lambda t: t IS NOT NULL)) AS tag FROM x""",
    "topology": f"""WITH RECURSIVE {_WE}, {_HEIGHTS},
      j AS (SELECT h.*, coalesce(g.degree, 0) AS degree FROM h LEFT JOIN (SELECT src, count(*) AS degree FROM e GROUP BY src) g ON h.key = g.src),
      m AS (SELECT count(*) AS n_nodes, round(avg(depth), 6) AS avg_depth, max(depth) AS max_depth, quantile_disc(depth, 0.95) AS p95_depth, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree FROM j),
      p AS (SELECT *, CASE WHEN max_depth > 5 AND NOT max_degree > 20 AND avg_degree < 5 THEN 'component-tree' WHEN NOT max_depth > 5 AND max_degree > 20 AND avg_depth < 3 THEN 'microservices'
        WHEN avg_depth BETWEEN 2 AND 4 AND NOT max_degree > 20 THEN 'layered' WHEN avg_depth <= 2 AND avg_degree <= 3 THEN 'flat' ELSE 'mixed' END AS pattern FROM m)
      SELECT *, least(greatest(CASE WHEN pattern = 'component-tree' THEN 4 WHEN pattern IN ('layered', 'flat') THEN 2 ELSE 3 END, ceil(p95_depth * 0.6)), 5)::INTEGER AS recommended_depth FROM p""",
    "context_bundles": f"""WITH RECURSIVE {_SN}, {_SF}, b2 AS (SELECT src, dst FROM sf UNION SELECT dst, src FROM sf), {_ball('b2', _EVERY, 1)},
      l AS (SELECT node, min(u) AS source_uri FROM (SELECT {_K} AS node, {nid('source_files[1]')} AS u FROM slices) WHERE u IS NOT NULL AND node IS NOT NULL GROUP BY node),
      r AS (SELECT b.*, source_uri, row_number() OVER (PARTITION BY seed ORDER BY depth, b.node) AS rank FROM ball b LEFT JOIN l ON b.node = l.node),
      s AS (SELECT *, sum((source_uri IS NOT NULL AND rank <= 50)::INT) OVER (PARTITION BY seed ORDER BY depth, node) AS source_rank FROM r),
      x AS (SELECT *, CASE WHEN rank > 50 THEN 'node_limit' WHEN source_uri IS NULL THEN 'no_source' WHEN source_rank > 10 THEN 'source_limit' END AS reason FROM s)
      SELECT seed, node, depth, source_uri, reason IS NULL AS included, reason FROM x""",
    "graph_stats": f"""WITH {_SN}, {_SF}, c AS (SELECT src, count(*) AS refs FROM sf GROUP BY src), j AS (SELECT sn.*, c.refs FROM sn LEFT JOIN c ON sn.key = c.src)
      SELECT 'domain' AS level, domain AS value, count(*) AS n_nodes, coalesce(sum(refs), 0)::BIGINT AS n_refs FROM j GROUP BY domain
      UNION ALL SELECT 'type', type, count(*), coalesce(sum(refs), 0)::BIGINT FROM j GROUP BY type UNION ALL SELECT 'total', '*', count(*), coalesce(sum(refs), 0)::BIGINT FROM j""",
    "tag_counts": f"WITH {_SN} SELECT tag, count(*) AS n_nodes FROM (SELECT unnest(tags) AS tag FROM sn) GROUP BY tag",
    "by_tag": f"WITH {_SN} SELECT key FROM sn WHERE list_contains(list_transform(tags, lambda x: lower(x)), 'layer:core') OR contains(lower(path), '/core/')",
    "lookup_ids": f"WITH {_SN} SELECT domain, id, min(key) AS key FROM sn GROUP BY ALL",
    "broken_edges": f"WITH {_SN}, {_SF} SELECT src, dst FROM sf WHERE dst NOT IN (SELECT key FROM sn)",
    "one_sided": f"WITH {_SN}, {_SF}, {_SB}, {_ONE} SELECT * FROM one",
    "isolated": f"WITH {_SN}, {_SF}, {_SB}, {_ONE} SELECT * FROM iso",
    "health": f"""WITH {_SN}, {_SF}, {_SB}, {_ONE}, n AS (SELECT (SELECT count(*) FROM (SELECT * FROM sf UNION ALL SELECT * FROM sb) WHERE dst NOT IN (SELECT key FROM sn)) AS n_broken,
      (SELECT count(*) FROM one) AS n_one_sided, (SELECT count(*) FROM iso) AS n_isolated) SELECT *, n_broken = 0 AND n_one_sided = 0 AS is_healthy FROM n""",
    "search_exact": _search([q.TERM]),
    "search_question": _search(search.terms(q.QUESTION)),
    "search_fuzzy": f"""WITH {_SN}, s AS (SELECT key, round(greatest(1 - levenshtein(lower(id), '{q.FUZZY}') / greatest(length(id), {len(q.FUZZY)}),
        coalesce(1 - levenshtein(split_part(lower(path), '/', -1), '{q.FUZZY}') / greatest(length(split_part(path, '/', -1)), {len(q.FUZZY)}), 0)), 6) AS similarity FROM sn)
      SELECT key, floor(similarity * 39)::INTEGER AS score, similarity FROM s WHERE similarity >= 0.6 ORDER BY score DESC, similarity DESC, key LIMIT 50""",
    "entry_points": f"""WITH {_SN}, h AS ({' UNION ALL '.join(f"SELECT '{t}' AS term, key, {_score(t)} AS score FROM sn" for t in search.entry_terms(q.QUESTION))}),
      r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, key) AS rank FROM h WHERE score > 0)
      SELECT key, (count(*) * 10)::INTEGER AS score FROM r WHERE rank <= 20 GROUP BY key ORDER BY score DESC, key LIMIT 10""",
    "task_candidates": f"""WITH {_SN}, s AS (SELECT key, domain, list_distinct(string_split(trim(regexp_replace(lower(concat_ws(' ', id, path)), '[^a-z0-9]+', ' ', 'g')), ' ')) AS own, list_distinct(string_split_regex(lower(path), '[^a-z0-9]+')) AS p FROM sn),
      t AS (SELECT key, round(len(list_intersect(own, {_W})) / {len(_words)} + least(0.4, 0.1 * coalesce(len(list_intersect(p, {_W})), 0)) + CASE WHEN list_contains({_W}, lower(domain)) THEN 0.2 ELSE 0 END, 4) AS score FROM s)
      SELECT key, score::DOUBLE AS score FROM t WHERE score >= 0.05 ORDER BY score DESC, key LIMIT 5""",
    "similar": f"""WITH {_SN}, {_SF}, t AS (SELECT * FROM sn WHERE key IN {_hubs('sf', 'dst', 1)})
      SELECT sn.key, len(list_intersect(sn.tags, t.tags))::INTEGER AS shared_tags FROM sn JOIN t ON sn.type = t.type AND sn.key <> t.key
      WHERE len(list_intersect(sn.tags, t.tags)) > 0 OR sn.domain = t.domain ORDER BY shared_tags DESC, sn.key LIMIT 20""",
    "find": f"WITH {_SF}, top AS ({_search([q.TERM], 5)}), u AS (SELECT dst, count(*) AS n FROM sf GROUP BY dst) SELECT top.key, score, coalesce(n, 0) AS n_dependents FROM top LEFT JOIN u ON u.dst = top.key",
    "usages": f"WITH {_SF} SELECT dst AS key, count(*) AS n_users FROM sf GROUP BY dst",
    "dependencies_d2": f"WITH RECURSIVE {_SF}, {_ball('sf', _ends('sf'), 2)} SELECT * FROM ball WHERE depth > 0",
    "dependents_d2": f"WITH RECURSIVE {_SF}, {_REV}, {_ball('rev', _ends('sf'), 2)} SELECT * FROM ball WHERE depth > 0",
    "blast_d2": f"WITH RECURSIVE {_SF}, {_BOTH}, {_ball('both_', _ends('sf'), 2)} SELECT * FROM ball WHERE depth > 0",
    "blast_tiers": f"{_WB} SELECT seed, depth AS tier, count(repo) AS n_nodes, count(DISTINCT repo) AS n_repos, count(*) FILTER (repo IS NULL) AS n_dangling FROM hit GROUP BY ALL",
    "blast_risk": f"""{_WB}, m AS (SELECT seed, count(DISTINCT repo) AS n_repos, count(*) FILTER (depth >= 2) AS n_far, max(depth) AS max_tier FROM hit WHERE id IS NOT NULL GROUP BY seed)
      SELECT *, CASE WHEN n_repos >= 4 OR n_far >= 10 THEN 'critical' WHEN n_repos >= 3 OR n_far >= 5 THEN 'high' WHEN n_repos >= 2 OR n_far >= 2 THEN 'medium' ELSE 'low' END AS risk FROM m""",
    "closure_forward": f"WITH RECURSIVE {_WE}, {_CL}, {_ball('cl', _ends('clv'), None)} SELECT seed, node FROM ball WHERE node <> seed",
    "closure_reverse": f"WITH RECURSIVE {_WE}, {_CL}, {_ball('clr', _ends('clv'), None)} SELECT seed, node FROM ball WHERE node <> seed",
    "relevant_files": f"WITH RECURSIVE {_SN}, {_SF}, {_ball('sf', _EVERY, 1)}, f AS (SELECT {_K} AS key, unnest(source_files) AS f FROM slices) SELECT DISTINCT seed, {nid('f')} AS file FROM ball JOIN f ON ball.node = f.key",
    "shared_context": f"""WITH RECURSIVE {_SF}, {_BOTH}, {_ball('both_', _ends('sf'), 2)}
      SELECT a.seed, b.seed AS other, count(*) AS n_shared FROM ball a JOIN ball b ON a.node = b.node AND a.seed < b.seed GROUP BY ALL""",
    "context_domains": f"WITH RECURSIVE {_SN}, {_SF}, {_BOTH}, {_ball('both_', _EVERY, 2)} SELECT seed, domain, count(*) AS n_nodes FROM ball JOIN sn ON ball.node = sn.key GROUP BY ALL",
    "obligations": f"""WITH RECURSIVE {_SN}, {_SF}, {_BOTH}, {_ball('both_', _ends('sf'), 2)}, hit AS (SELECT b.*, path, repo, tags FROM ball b JOIN sn ON b.node = sn.key WHERE depth > 0),
      m AS (SELECT seed, count(*) AS n_impacted, count(*) FILTER (regexp_matches(lower(path), '(^|/)tests?/|[._-](test|spec)[._]|test_')) AS n_tests, count(DISTINCT repo) AS n_repos,
        sum(len(list_filter(tags, lambda x: starts_with(x, 'storage:'))))::BIGINT AS n_declared FROM hit GROUP BY seed)
      SELECT *, CASE WHEN n_impacted > 20 THEN 'high' WHEN n_impacted > 5 THEN 'medium' ELSE 'low' END AS risk FROM m""",
    "system_dependencies": f"WITH {_WN}, {_WE}, {_PLACED} SELECT src_repo, dst_repo, count(*) AS n_edges, array_to_string(list_sort(list_distinct(list(verb))), ',') AS verbs FROM pl WHERE src_repo <> dst_repo GROUP BY ALL",
    "verb_counts": f"WITH {_WE} SELECT verb, count(*) AS n_edges FROM we GROUP BY verb",
    "repo_types": f"WITH {_WN} SELECT repo, type, count(*) AS n_nodes FROM wn GROUP BY ALL",
    "component_integration": f"WITH {_WN}, {_WE}, {_PLACED}, x AS (SELECT unnest(list_distinct([src_repo, dst_repo])) AS repo, {_case(workspace.PATTERNS, 'Other')} AS pattern FROM pl) SELECT repo, pattern, count(*) AS n_edges FROM x GROUP BY ALL",
    "what_calls": f"WITH {_WE} SELECT DISTINCT dst AS id, src AS caller FROM we WHERE verb IN ('invokes', 'publishes', 'calls', 'triggers', 'publishes_to')",
    "group_sizes": f"WITH {_WN}, {_G1} SELECT group_id, count(*) AS n_members FROM gr GROUP BY group_id",
    "adjacency": f"WITH {_WN}, {_WE}, {_PLACED} SELECT src_type, dst_type, array_to_string(list_sort(list_distinct(list(verb))), ',') AS verbs FROM pl GROUP BY ALL",
    "first_wins": f"""SELECT id, repo, node_type FROM (SELECT {nid('node_id')} AS id, repo, node_type, row_number() OVER (PARTITION BY {nid('node_id')} ORDER BY created_at NULLS FIRST, repo NULLS FIRST, node_type NULLS FIRST) AS n FROM ws_nodes WHERE node_id IS NOT NULL) WHERE n = 1""",
    "identity_collisions": f"SELECT id, count(DISTINCT repo) AS n_repos, min(repo) AS first_repo, max(repo) AS last_repo FROM (SELECT {nid('to_id')} AS id, target_repo AS repo FROM merged_edges WHERE to_id IS NOT NULL) GROUP BY id HAVING count(DISTINCT repo) > 1",
    "merged_graph": f"""WITH {_WN}, e AS (SELECT {nid('from_id')} AS src, {nid('to_id')} AS dst, lower(trim(verb)) AS verb, confidence FROM merged_edges)
      SELECT DISTINCT src, dst, verb FROM e JOIN wn a ON e.src = a.id JOIN wn b ON e.dst = b.id WHERE verb IS NOT NULL AND (a.repo <> b.repo OR confidence IS NULL OR confidence = 'high')""",
    "relationship_pivot": f"WITH {_WE} SELECT src, " + ", ".join(f"count(DISTINCT dst) FILTER (verb = '{v}') AS {v}" for v in ("calls", "contains", "implements", "invokes", "reads", "writes")) + " FROM we GROUP BY src",
    "gravity": f"""WITH RECURSIVE {_WE}, e AS (SELECT * FROM we WHERE verb IN ('implements', 'contains', 'has_contract', 'deploys_to')), er AS (SELECT DISTINCT dst AS src, src AS dst FROM e),
      tops AS (SELECT DISTINCT src AS seed FROM e WHERE verb = 'implements'), {_ball('er', 'tops', 2)},
      w AS (SELECT src AS id, sum(CASE verb WHEN 'implements' THEN 3 WHEN 'deploys_to' THEN 1 ELSE 2 END)::BIGINT AS weighted FROM e WHERE src IN (SELECT seed FROM tops) GROUP BY src),
      f AS (SELECT seed AS id, count(*) AS n_dependents FROM ball WHERE depth > 0 GROUP BY seed)
      SELECT id, coalesce(weighted, 0) AS weighted, coalesce(n_dependents, 0) AS n_dependents, coalesce(n_dependents, 0) * 2 + coalesce(weighted, 0) AS gravity FROM w FULL JOIN f USING (id)""",
    "prefix_affinity": f"""WITH {_WN}, p AS (SELECT a.id AS src, b.id AS dst, list_max([n FOR n IN range(0, least(length(a.name), length(b.name)) + 1) IF substring(a.name, 1, n) = substring(b.name, 1, n)]) AS affinity
        FROM wn a JOIN wn b ON a.type = 'Queue' AND b.type = 'Topic' AND a.repo <> b.repo AND substring(a.name, 1, 10) = substring(b.name, 1, 10) AND length(a.name) >= 10 AND length(b.name) >= 10)
      SELECT src, dst, affinity::INTEGER AS affinity FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY affinity DESC, dst) AS n FROM p) WHERE n = 1""",
    "embodiment": f"""SELECT node_type, state, count(*) AS n_nodes FROM (SELECT {nid('node_id')} AS id, node_type, CASE WHEN count(source_path) = 0 THEN 'unlinked' WHEN count(source_hash) = 0 THEN 'partial' ELSE 'covered' END AS state FROM ws_nodes GROUP BY ALL) GROUP BY ALL""",
    "height": f"WITH RECURSIVE {_WE}, {_HEIGHTS} SELECT * FROM h",
    "change_counts": f"SELECT repo, snapshot_no, change_kind, count(*) AS n_slices FROM ({P1}) GROUP BY ALL",
    "locator_freshness": f"""WITH {_SCAN}, l AS (SELECT DISTINCT entity_uri, repo, {nid('file_path')} AS path, source_hash AS known FROM source_locators)
      SELECT DISTINCT entity_uri, CASE WHEN s.path IS NULL THEN 'missing_source' WHEN known IS NULL OR source_hash IS NULL THEN 'unhashed' WHEN known = source_hash THEN 'fresh' ELSE 'hash_mismatch' END AS state
      FROM l LEFT JOIN scan s ON l.repo = s.repo AND l.path = s.path""",
    "stale_slices": f"""WITH {_SCAN}, m AS (SELECT slice_id, repo, path, arg_max(c, (seq_no, c)) AS c FROM (SELECT {nid('slice_id')} AS slice_id, repo, {nid('f')} AS path, seq_no, {{'v': source_checksum}} AS c FROM (SELECT *, unnest(source_files) AS f FROM slice_metadata)) WHERE slice_id IS NOT NULL GROUP BY ALL)
      SELECT slice_id, path FROM m JOIN scan s USING (repo, path) WHERE c.v <> source_hash""",
    "checksum_drift": f"SELECT {nid('slice_id')} AS slice_id, extractor_version, count(DISTINCT source_checksum) AS n_checksums FROM slice_metadata WHERE slice_id IS NOT NULL AND extractor_version IS NOT NULL GROUP BY ALL HAVING count(DISTINCT source_checksum) > 1",
    "coverage": f"""WITH {_SCAN}, s AS (SELECT DISTINCT repo, {nid('f')} AS path FROM (SELECT repo, unnest(source_files) AS f FROM slices))
      SELECT repo, count(*) AS n_sources, count(f.path) AS n_found, round(count(f.path) / count(*), 6) AS coverage FROM (SELECT s.repo, s.path AS p, scan.path FROM s LEFT JOIN scan ON s.repo = scan.repo AND s.path = scan.path) f GROUP BY repo""",
    "schema_findings": " UNION ALL ".join(f"SELECT '{r}' AS rule, '{s}' AS severity, count(*) FILTER ({c}) AS n_rows FROM slice_snapshots" for r, s, c in (
        ("missing_id", "ERROR", "slice_id IS NULL"), ("missing_type", "ERROR", "slice_type IS NULL"), ("missing_file", "ERROR", "file_path IS NULL"), ("missing_line", "ERROR", "line_no IS NULL"), ("missing_extractor", "ERROR", "extractor IS NULL"),
        ("unknown_domain", "WARNING", "coalesce(slice_domain NOT IN ('graph', 'api', 'data', 'infrastructure', 'behavior', 'frontend', 'architecture'), true)"), ("empty_sources", "WARNING", "coalesce(len(source_files), 0) = 0"),
        ("bad_timestamp", "WARNING", r"NOT coalesce(regexp_matches(extracted_at, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d'), false)"), ("inverted_lines", "WARNING", "coalesce(end_line < line_no, false)"), ("missing_checksum", "INFO", "source_checksum IS NULL"))),
    "duplicate_ids": f"SELECT {nid('file_path')} AS id, count(DISTINCT kind) AS n_kinds, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT file_path, concat_ws('/', slice_domain, slice_type) AS kind FROM slice_snapshots WHERE file_path IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT kind) > 1",
    "id_changes": f"SELECT repo, {nid('file_path')} AS path, count(DISTINCT extractor) AS n_extractors, count(DISTINCT {nid('slice_id')}) AS n_ids FROM slice_snapshots GROUP BY ALL HAVING count(DISTINCT extractor) > 1",
    "manifest_diff": f"""WITH mid AS (SELECT (max(seq_no) + min(seq_no)) / 2 AS mid FROM slice_metadata), r AS (SELECT {nid('f')} AS path, seq_no, {{'v': source_checksum}} AS c FROM (SELECT *, unnest(source_files) AS f FROM slice_metadata)),
      a AS (SELECT path, arg_max(c, (seq_no, c)).v AS v FROM r, mid WHERE seq_no <= mid GROUP BY path), b AS (SELECT path, arg_max(c, (seq_no, c)).v AS v FROM r, mid WHERE seq_no > mid GROUP BY path)
      SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.path = b.path""",
    "signature_changes": f"""WITH r AS (SELECT repo, {nid('slice_id')} AS slice_id, snapshot_no, arg_max(s, (delivered_at, s)) AS s FROM (SELECT *, {{'v': element ->> '$.signature'}} AS s FROM slice_snapshots) GROUP BY ALL),
      p AS (SELECT *, lag(s.v) OVER (PARTITION BY repo, slice_id ORDER BY snapshot_no) AS before FROM r) SELECT repo, slice_id, snapshot_no FROM p WHERE s.v <> before""",
    "debounced": """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
      SELECT user_id, min(ts) AS begins, max(ts) AS ends, count(*) AS n_events, arg_max(event_type, (ts, event_type)) AS last_event FROM n GROUP BY user_id, run""",
    "transactions": """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 3 MINUTE, true)::INT AS fresh FROM events WINDOW w AS (ORDER BY ts)),
      n AS (SELECT *, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
      SELECT min(ts) AS begins, max(ts) AS ends, count(*) AS n_events, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS keys FROM n GROUP BY run HAVING count(DISTINCT event_type) >= 2""",
    "bursts": """WITH b AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM events)
      SELECT user_id, count(*) FILTER (n >= 3) AS n_in_burst, max(n) AS largest FROM b GROUP BY user_id""",
    "classify_files": f"""SELECT DISTINCT file_id, CASE WHEN x = 'py' THEN 'python' WHEN x = 'ts' THEN 'typescript' WHEN x = 'cs' THEN 'csharp' WHEN x IN ('css', 'scss') THEN 'css' WHEN x = 'json' THEN 'json'
        WHEN x IN ('yaml', 'yml') AND (contains(b, 'AWSTemplateFormatVersion') OR contains(b, 'Type: AWS::')) THEN 'cloudformation' WHEN x IN ('yaml', 'yml') AND contains(b, 'adr_type:') THEN 'adr-yaml' WHEN x IN ('yaml', 'yml') THEN 'yaml' ELSE 'unknown' END AS kind
      FROM (SELECT file_id, {_EXT} AS x, coalesce(body, '') AS b FROM source_files)""",
    "imports": f"""WITH m AS ({_all_matches(_of('py'), '(?m)^import ([A-Za-z0-9_.]+)')} UNION {_all_matches(_of('py'), '(?m)^from ([A-Za-z0-9_.]+) import ')} UNION {_all_matches(_of('ts'), "(?m)^import [^;''" + chr(92) + "n]*from ''([^''" + chr(92) + "n]+)''")})
      SELECT DISTINCT file_id, name AS target, starts_with(name, '.') OR starts_with(name, 'src/') AS is_internal FROM m""",
    "styles": f"""SELECT DISTINCT file_id, 'class' AS kind, name FROM ({_all_matches(_of('css'), '[.]([A-Za-z_][A-Za-z0-9_-]*)[^;{}]*[{]')}) UNION SELECT DISTINCT file_id, 'defines', name FROM ({_all_matches(_of('css'), '(--[A-Za-z0-9_-]+)' + chr(92) + 's*:')})
      UNION SELECT DISTINCT file_id, 'uses', name FROM ({_all_matches(_of('css'), 'var[(](--[A-Za-z0-9_-]+)[)]')})""",
    "resources": f"""WITH m AS ({_all_matches(_of('yaml', 'yml'), '(?m)^  ([A-Za-z0-9_]+):' + chr(92) + 'n    Type: (AWS::[A-Za-z0-9_:]+)', 0)})
      SELECT DISTINCT file_id, regexp_extract(name, '^  ([A-Za-z0-9_]+):', 1) AS logical_id, regexp_extract(name, 'Type: (AWS::[A-Za-z0-9_:]+)', 1) AS resource_type FROM m""",
    "decision_records": f"""SELECT * FROM (SELECT DISTINCT file_id, regexp_extract(body, '(?m)^id: ([^ ' || chr(10) || ']+)', 1) AS adr_id, regexp_extract(body, '(?m)^adr_type: ([^ ' || chr(10) || ']+)', 1) AS adr_type, regexp_extract(body, '(?m)^status: ([^ ' || chr(10) || ']+)', 1) AS status
      FROM {_of('yaml', 'yml')}) WHERE adr_id <> '' AND adr_type <> ''""",
    "decision_edges": f"""WITH t AS (SELECT DISTINCT body, regexp_extract(body, '(?m)^id: ([^ ' || chr(10) || ']+)', 1) AS adr_id FROM {_of('yaml', 'yml')}), m AS (SELECT adr_id, unnest(regexp_extract_all(body, '{_DEC}', 0)) AS m FROM t WHERE adr_id <> ''),
      f AS (SELECT adr_id, regexp_extract(m, '(DEC-[0-9]+)', 1) AS dec, regexp_extract(m, 'enables: [[]([^]]*)[]]', 1) AS caps FROM m)
      SELECT DISTINCT adr_id AS src, 'introduces' AS verb, dec AS dst FROM f UNION SELECT DISTINCT dec, 'enables', cap FROM (SELECT dec, unnest(string_split_regex(caps, ', *')) AS cap FROM f) WHERE cap <> ''""",
    "headings": r"""SELECT DISTINCT doc_id, length(regexp_extract(line, '^(#+)', 1))::INTEGER AS level, regexp_extract(line, '^#+ +(.*?) *$', 1) AS title
      FROM (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(replace(text, chr(13), ''), '(?ms)^[ \t]*```.*?(^[ \t]*```[^\n]*$|\z)', '', 'g'), '(?ms)^[ \t]*~~~.*?(^[ \t]*~~~[^\n]*$|\z)', '', 'g'), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^#{1,6} +[^ ]')""",
    "links": "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(https?://[A-Za-z0-9_./#?=&%-]+)', 1)) AS url FROM documents",
    **{f"compress_l{k}": _compress(k) for k in range(5)},
}

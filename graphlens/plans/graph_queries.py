"""Queries over the slice graph, the workspace graph, source files and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.functions.ids import norm_id, slice_key
from graphlens.operators import architecture, bundles, compact, context, delta, emit, explore, infer, pipeline, relations, render, search, structure, traverse, workspace
from graphlens.plans.data_queries import p1_found
from graphlens.session import table
from graphlens.sources import documents, extract, templates, typescript
from graphlens.sources import graphs as g
from graphlens.streaming import changes

QUESTION = "which registry and ledger triggers does the snapshot-cache handler use?"
TERM, FUZZY, TASK, TAG = "registry", "module-src-api-batch_snapshot", "merge the ledger snapshot in src/api handlers", "layer:core"


def _all(s: SparkSession, d: str):
    return g.slice_nodes(s, d), g.slice_edges(s, d), g.slice_edges(s, d, "backward")


def _ws(s: SparkSession, d: str):
    return g.workspace_nodes(s, d), g.workspace_edges(s, d)


def hubs(edges: DataFrame, n: int) -> DataFrame:
    """The ends to which most edges point."""
    return edges.groupBy("dst").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "dst").limit(n).select(F.col("dst").alias("seed"))


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of all edges: the seeds of the traversal reports. No other node reaches anything."""
    return edges.select(F.col("src").alias("seed")).union(edges.select("dst")).distinct()


def every(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes and all ends of edges: the seeds of reports on what a ball holds, its centre included."""
    return ends(edges).union(nodes.select("key")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def broken_edges(s, d):
    n, f, b = _all(s, d)
    return structure.broken_edges(n, f).select("src", "dst")


def one_sided(s, d):
    return structure.one_sided(*_all(s, d))


def isolated(s, d):
    return structure.isolated(*_all(s, d))


def health(s, d):
    return structure.health(*_all(s, d))


def graph_stats(s, d):
    n, f, _ = _all(s, d)
    return structure.stats(n, f)


def tag_counts(s, d):
    return g.slice_nodes(s, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n_nodes"))


def by_tag(s, d):
    return structure.by_tag(g.slice_nodes(s, d), TAG).select("key")


def lookup_ids(s, d):
    """Key of the first node of each id in a domain."""
    return g.slice_nodes(s, d).groupBy("domain", "id").agg(F.min("key").alias("key"))


def search_exact(s, d):
    return search.search_exact(g.slice_nodes(s, d), TERM)


def search_question(s, d):
    return search.search_exact(g.slice_nodes(s, d), QUESTION)


def search_fuzzy(s, d):
    return search.search_fuzzy(g.slice_nodes(s, d), FUZZY)


def entry_points(s, d):
    return search.entry_points(g.slice_nodes(s, d), QUESTION)


def task_candidates(s, d):
    return search.task_candidates(g.slice_nodes(s, d), TASK)


def similar(s, d):
    n, f, _ = _all(s, d)
    return search.similar(n, n.join(hubs(f, 1), n["key"] == F.col("seed"), "left_semi"))


def find(s, d):
    n, f, _ = _all(s, d)
    return context.find(n, f, TERM)


def usages(s, d):
    return context.usages(g.slice_edges(s, d))


def dependencies_d2(s, d):
    f = g.slice_edges(s, d)
    return traverse.reached(f, ends(f), 2)


def dependents_d2(s, d):
    f = g.slice_edges(s, d)
    return traverse.reached(reverse(f), ends(f), 2)


def blast_d2(s, d):
    f = g.slice_edges(s, d)
    return traverse.reached(traverse.both_ways(f), ends(f), 2)


def _ws_blast(s, d, counted, listed):
    """Of each blast what ``counted`` makes of its counts; for graphs too large for that, ``listed`` of its rows."""
    n, e = _ws(s, d)
    counts = compact.blast(e, n)
    return listed(traverse.reached(traverse.both_ways(e), ends(e), 2), n) if counts is None else counted(counts)


def blast_tiers(s, d):
    return _ws_blast(s, d, traverse.counted_tiers, traverse.tiers)


def blast_risk(s, d):
    return _ws_blast(s, d, traverse.counted_risk, traverse.risk)


def closure_forward(s, d):
    e = g.workspace_edges(s, d).filter("verb in ('implements', 'deploys_to', 'has_contract')")
    return traverse.reached(e, ends(e), None).filter("node <> seed").select("seed", "node")


def closure_reverse(s, d):
    e = g.workspace_edges(s, d).filter("verb in ('implements', 'deploys_to', 'has_contract')")
    return traverse.reached(reverse(e), ends(e), None).filter("node <> seed").select("seed", "node")


def walk_exact(s, d):
    f = g.slice_edges(s, d)
    return traverse.walk(f, ends(f))


def relevant_files(s, d):
    n, f, _ = _all(s, d)
    files = table(s, d, "slices").select(slice_key(F.col("slice_domain"), F.col("slice_type"), F.col("slice_id")).alias("key"), F.explode("source_files").alias("f"))
    return context.relevant_files(files.select("key", norm_id("f").alias("file")), traverse.bfs(f, every(n, f), 1))


def shared_context(s, d):
    """How many nodes the balls of each two nodes share; pairs that share none have no row."""
    f = g.slice_edges(s, d)
    if (counts := compact.shared_counts(f)) is not None:
        return counts
    ball = traverse.bfs(traverse.both_ways(f), ends(f), 2).select("seed", "node").distinct()
    other = ball.select(F.col("seed").alias("other"), "node")
    return ball.join(other, "node").filter("seed < other").groupBy("seed", "other").agg(F.count("*").alias("n_shared"))


def context_domains(s, d):
    n, f, _ = _all(s, d)
    return context.by_domain(n, traverse.bfs(traverse.both_ways(f), every(n, f), 2))


def obligations(s, d):
    n, f, _ = _all(s, d)
    hit = context.impact(n, f, ends(f), 2)
    declared = n.select(F.col("key").alias("node"), F.explode("tags").alias("obligation")).filter("obligation like 'storage:%'")
    return context.obligations(hit, declared)


def system_dependencies(s, d):
    return workspace.system_dependencies(*_ws(s, d))


def verb_counts(s, d):
    return g.workspace_edges(s, d).groupBy("verb").agg(F.count("*").alias("n_edges"))


def repo_types(s, d):
    return g.workspace_nodes(s, d).groupBy("repo", "type").agg(F.count("*").alias("n_nodes"))


def component_integration(s, d):
    return workspace.component_integration(*_ws(s, d))


def what_calls(s, d):
    return workspace.what_calls(g.workspace_edges(s, d))


def compress(level: int):
    return lambda s, d: workspace.compressed_edges(*_ws(s, d), level)


def group_sizes(s, d):
    return workspace.compressed_nodes(g.workspace_nodes(s, d), 1).groupBy("group_id").agg(F.count("*").alias("n_members"))


def adjacency(s, d):
    return workspace.adjacency(*_ws(s, d))


def _raw_nodes(s, d):
    return table(s, d, "ws_nodes").select(norm_id("node_id").alias("id"), "repo", "node_type", "created_at")


def first_wins(s, d):
    return workspace.first_wins(_raw_nodes(s, d).dropna(subset=["id"]), "id", ["created_at", "repo"]).select("id", "repo", "node_type")


def identity_collisions(s, d):
    """Targets which edges place in several repositories."""
    e = table(s, d, "merged_edges").select(norm_id("to_id").alias("id"), F.col("target_repo").alias("repo"))
    return workspace.identity_collisions(e.filter("id is not null"), "id")


def merged_graph(s, d):
    e = table(s, d, "merged_edges").select(norm_id("from_id").alias("src"), norm_id("to_id").alias("dst"), F.lower(F.trim("verb")).alias("verb"), "confidence")
    return workspace.merge_edges(g.workspace_nodes(s, d), e.dropna(subset=["src", "dst", "verb"]))


def relationship_pivot(s, d):
    return workspace.pivot_relationships(g.workspace_edges(s, d), ["calls", "contains", "implements", "invokes", "reads", "writes"])


def gravity(s, d):
    """Of every node that implements something."""
    e = g.workspace_edges(s, d).filter("verb in ('implements', 'contains', 'has_contract', 'deploys_to')")
    scored = e.filter("verb = 'implements'").select("src").distinct()
    return workspace.gravity(e.join(scored, "src", "left_semi"), {"implements": 3, "has_contract": 2, "contains": 2, "deploys_to": 1}, traverse.reached(reverse(e), scored, 2))


def prefix_affinity(s, d):
    return workspace.prefix_affinity(g.workspace_nodes(s, d), "Queue", "Topic")


def embodiment(s, d):
    """Share of each node type whose nodes a locator places in a file."""
    n = table(s, d, "ws_nodes").select(norm_id("node_id").alias("id"), "node_type", norm_id("source_path").alias("path"), "source_hash").distinct()
    per = n.groupBy("id", "node_type").agg(F.count("path").alias("paths"), F.count("source_hash").alias("hashes"))
    state = F.when(F.col("paths") == 0, "unlinked").when(F.col("hashes") == 0, "partial").otherwise("covered")
    return per.groupBy("node_type", state.alias("state")).agg(F.count("*").alias("n_nodes"))


def height(s, d):
    e = g.workspace_edges(s, d).filter("verb = 'implements'")
    n = e.select(F.col("src").alias("key")).union(e.select("dst")).distinct()
    return structure.longest_depths(n, e)


def topology(s, d):
    return structure.topology(height(s, d), g.workspace_edges(s, d).filter("verb = 'implements'"))


def change_counts(s, d):
    return p1_found(s, d).groupBy("repo", "snapshot_no", "change_kind").agg(F.count("*").alias("n_slices"))


def locator_freshness(s, d):
    return delta.locator_freshness(table(s, d, "source_locators"), table(s, d, "source_files"))


def stale_slices(s, d):
    return delta.stale_slices(table(s, d, "slice_metadata"), table(s, d, "source_files"))


def checksum_drift(s, d):
    return delta.drift(table(s, d, "slice_metadata"))


def coverage(s, d):
    return delta.coverage(table(s, d, "slices"), table(s, d, "source_files"))


def schema_findings(s, d):
    return delta.findings(table(s, d, "slice_snapshots"))


def duplicate_ids(s, d):
    """Files that slices of several kinds come from."""
    return delta.duplicate_ids(table(s, d, "slice_snapshots").withColumn("slice_id", F.col("file_path")))


def id_changes(s, d):
    return delta.id_changes(table(s, d, "slice_snapshots"))


def manifest_diff(s, d):
    """Checksums by file between the first and the last extraction of each file."""
    rows = table(s, d, "slice_metadata").select(F.explode("source_files").alias("f"), "seq_no", "source_checksum").select(norm_id("f").alias("path"), F.struct("seq_no", "source_checksum").alias("v"))
    mid = table(s, d, "slice_metadata").agg((F.max("seq_no") + F.min("seq_no")) / 2).first()[0] or 0.0
    old = rows.filter(F.col("v.seq_no") <= mid).groupBy("path").agg(F.max("v").alias("v")).select("path", F.col("v.source_checksum").alias("digest"))
    new = rows.filter(F.col("v.seq_no") > mid).groupBy("path").agg(F.max("v").alias("v")).select("path", F.col("v.source_checksum").alias("digest"))
    return delta.manifest_diff(old, new, "path", "digest")


def signature_changes(s, d):
    """Slices whose signature differs between two snapshots that follow each other."""
    v = F.max(F.struct("delivered_at", F.get_json_object("element", "$.signature").alias("signature"))).alias("v")
    rows = table(s, d, "slice_snapshots").groupBy("repo", norm_id("slice_id").alias("slice_id"), "snapshot_no").agg(v)
    w = Window.partitionBy("repo", "slice_id").orderBy("snapshot_no")
    pairs = rows.select("repo", "slice_id", "snapshot_no", F.col("v.signature").alias("now"), F.lag("v.signature").over(w).alias("before"))
    return pairs.filter("now <> before").select("repo", "slice_id", "snapshot_no")


def _events(s, d):
    return table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def debounced(s, d):
    out = changes.debounced(_events(s, d), "user_id", "event_type", "ts", "30 minutes")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begins", "ends")})


def adaptive_debounced(s, d):
    """Minutes stand for the milliseconds of a watch: half an hour of rest, two hours in a busy time."""
    out = changes.adaptive_debounced(_events(s, d), "user_id", "event_type", "ts", 1800, 7200, 7200, 40, 3)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begins", "ends")})


def transactions(s, d):
    out = changes.transactions_of_table(_events(s, d), "event_type", "ts", 180)
    return out.select(F.col("begins").cast("timestamp_ntz").alias("begins"), F.col("ends").cast("timestamp_ntz").alias("ends"), "n_events", F.array_join("keys", ",").alias("keys"))


def bursts(s, d):
    return changes.bursts(_events(s, d), "user_id", "ts", 3600, 3).groupBy("user_id").agg(F.count_if("in_burst").alias("n_in_burst"), F.max("n_recent").alias("largest"))


def _files(s, d):
    return table(s, d, "source_files")


def _records(s, d):
    """Entities and declared links of the decision records among the source files."""
    declared = extract.decision_edges(_files(s, d)).select(F.when(F.col("verb") == "introduces", "declares").otherwise("enables").alias("rel_type"), "src", "dst")
    ends = declared.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    kind = F.when(F.col("id").startswith("DEC-"), "decision").when(F.col("id").startswith("CAP-"), "capability").otherwise("adr")
    return ends.select("id", kind.alias("entity_type")), declared


def record_relationships(s, d):
    return architecture.derive(*_records(s, d))


def record_governance(s, d):
    e, declared = _records(s, d)
    return architecture.governance(e, architecture.derive(e, declared))


def record_gaps(s, d):
    """Enabled capabilities that no record declares."""
    e, declared = _records(s, d)
    return architecture.gaps(e.filter("entity_type <> 'capability'"), declared)


def consequence_surface(s, d):
    n, e = _ws(s, d)
    rels = e.select("src", "dst", F.col("verb").alias("rel_type")).unionByName(e.filter("verb = 'implements'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("implemented_by").alias("rel_type")))
    return architecture.consequences(rels, ends(e), 3)


def dependency_charts(s, d):
    deps = workspace.system_dependencies(*_ws(s, d))
    return render.flow_chart(deps, "src_repo", "src_repo", "dst_repo", render.multiplicity(F.col("verbs"), F.col("n_edges")))


def file_tags(s, d):
    return infer.tags(_files(s, d).select("file_id", norm_id("file_path").alias("path")).distinct())


def context_bundles(s, d):
    n, f, _ = _all(s, d)
    files = table(s, d, "slices").select(slice_key(F.col("slice_domain"), F.col("slice_type"), F.col("slice_id")).alias("node"), norm_id(F.try_element_at("source_files", F.lit(1))).alias("source_uri")).dropna()
    return bundles.bundle(f, every(n, f), files.distinct(), depth=1)


def _node_files(s, d):
    """key, file of all source files of each slice."""
    rows = table(s, d, "slices").select(slice_key(F.col("slice_domain"), F.col("slice_type"), F.col("slice_id")).alias("key"), F.explode("source_files").alias("f"))
    return rows.select("key", norm_id("f").alias("file")).dropna().distinct()


def _ball(s, d, depth: int = 2):
    n, f, _ = _all(s, d)
    return n, traverse.bfs(traverse.both_ways(f), every(n, f), depth)


def show_node(s, d):
    n, f, _ = _all(s, d)
    return explore.show(n, f, TERM)


def implementation_context(s, d):
    n, f, _ = _all(s, d)
    return explore.implementation_context(n, traverse.bfs(f, every(n, f), 1))


def related_implementations(s, d):
    return explore.related(*_ball(s, d))


def overview(s, d):
    return explore.overview(g.slice_nodes(s, d), ["domain"])


def overview_repos(s, d):
    return explore.overview(g.slice_nodes(s, d).filter("repo is not null"), ["repo", "domain"])


def key_components(s, d):
    n, f, _ = _all(s, d)
    return explore.key_components(n, f)


def stack_kind(s, d):
    return explore.stack_kind(g.slice_nodes(s, d))


def diagnostics(s, d):
    n, f, b = _all(s, d)
    return explore.diagnostics(n, f, b, structure.isolated(n, f, b))


def scope_files(s, d):
    return explore.scope_files(_node_files(s, d), _ball(s, d)[1])


def scope_freshness(s, d):
    return explore.freshness(explore.scope_files(_node_files(s, d), _ball(s, d, 1)[1]), stale_slices(s, d))


def affected_keys(s, d):
    """By the files whose newest scan differs from what slices were extracted from."""
    return explore.affected(_node_files(s, d), g.slice_edges(s, d), stale_slices(s, d).select(F.col("path").alias("file")))


def entity_locators(s, d):
    """The locator of every entity URI."""
    l = table(s, d, "source_locators").withColumn("file_path", norm_id("file_path"))
    wanted = l.filter("entity_uri is not null").select(F.col("entity_uri").alias("uri"), F.lit("entity").alias("kind"), F.col("entity_uri").alias("name")).distinct()
    return explore.locator_of(l, wanted)


def node_matrix(s, d):
    """Verbs between each two connected nodes."""
    return g.workspace_edges(s, d).groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("verb")), ",").alias("verbs"))


def repo_depth_advice(s, d):
    """Depth that traversals within each repository should take."""
    n, e = _ws(s, d)
    own = n.groupBy("repo").agg(F.count("*").alias("n_nodes"))
    at = e.join(n.select(F.col("id").alias("src"), "repo"), "src").groupBy("repo").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))
    both = own.join(at, "repo", "left").fillna(0)
    branching = F.when(F.col("n_src") > 0, F.col("n_edges") / F.col("n_src")).otherwise(0.0)
    convergence = F.when(F.col("n_edges") > 0, 1 - F.col("n_dst") / F.col("n_edges")).otherwise(0.0)
    return both.withColumn("a", explore.depth_advice(F.col("n_nodes"), F.col("n_edges"), branching, convergence, 5)).select("repo", "n_nodes", "n_edges", "a.category", "a.depth")


def node_names(s, d):
    """Slug, hash and shortened label of every workspace node."""
    n = g.workspace_nodes(s, d).filter("name is not null")
    return n.select("id", text.slug(F.col("name")).alias("slug"), text.djb2(F.col("id")).alias("hash"), text.shortened(text.title(F.col("name")), 12).alias("label"))


def token_estimates(s, d):
    """Estimated tokens of every file and repository of a scan."""
    return _files(s, d).filter("body is not null").select("file_id", "repo", text.token_estimate(F.col("body")).alias("n_tokens")).distinct()


def extractor_gaps(s, d):
    return explore.missing_extractors(extract.classify(_files(s, d)), ["python", "typescript", "css", "cloudformation", "adr-yaml"])


def _paths(s, d):
    return _files(s, d).select("file_id", "repo", norm_id("file_path").alias("path")).dropna().distinct()


def all_facts(s, d):
    """Facts of all extractors over all files."""
    files = _files(s, d)
    records = extract.decision_records(files).select("file_id", F.lit("adr").alias("kind"), F.col("adr_id").alias("name"), F.col("adr_type").alias("detail"))
    infra = templates.template_facts(files).select("file_id", "kind", "name", F.col("type").alias("detail"), F.col("target").alias("owner"))
    return relations.union_facts(extract.python_facts(files), typescript.typescript_facts(files), infra, extract.styles(files), records)


def slice_elements(s, d):
    return relations.elements(all_facts(s, d), _paths(s, d)).select("key", "domain", "type", "path", "name", "line")


def module_rows(s, d):
    out = relations.modules(_paths(s, d), all_facts(s, d))
    return out.select("module_id", "path", "layer", *[F.array_join(c, ",").alias(c) for c in ("internal", "external", "exports")]).distinct()


def _resolved_calls(called: str, defined: str):
    return lambda s, d: relations.calls(all_facts(s, d), _paths(s, d), called, defined)


def class_modules(s, d):
    return relations.contained(all_facts(s, d), _paths(s, d), "class").select("name", "module_id").distinct()


def function_modules(s, d):
    return relations.contained(all_facts(s, d), _paths(s, d), "function").select("name", "module_id").distinct()


def template_edges(s, d):
    return relations.depends(templates.template_facts(_files(s, d)))


def strongest_edges(s, d):
    """One edge for each pair and verb, by its highest confidence, with the number of texts that speak for it."""
    e = table(s, d, "merged_edges").select(norm_id("from_id").alias("src"), norm_id("to_id").alias("dst"), F.lower(F.trim("verb")).alias("verb"), "confidence", "evidence").dropna(subset=["src", "dst", "verb"])
    return emit.strongest(e).select("src", "dst", "verb", "confidence", F.size("evidence").alias("n_evidence"))


def change_advice(s, d):
    """What a refactoring of each node obliges to."""
    n, f, _ = _all(s, d)
    ahead, back = traverse.reached(f, ends(f), 2).withColumn("way", F.lit("dependencies")), traverse.reached(reverse(f), ends(f), 2).withColumn("way", F.lit("dependents"))
    return context.advice(ahead.unionByName(back), n, "refactor")


def project_structure(s, d):
    return documents.project_structure(_files(s, d))


def style_classes(s, d):
    """Classes of style sheets, every class of a selector."""
    return documents.document_facts(_files(s, d), "css").filter("kind = 'css_class'").select("file_id", "name").distinct()


def _bundle(s, d):
    """Of all records; ids that several of them declare are taken for mentions of one entity."""
    return pipeline.build(documents.document_facts(_files(s, d), "decision_record"), may_repeat=pipeline.ENTITY_KINDS)


def architecture_entities(s, d):
    return _bundle(s, d)["entities"].select("id", "entity_type", "record_id")


def architecture_relationships(s, d):
    return _bundle(s, d)["relationships"]


def evidence_subjects(s, d):
    return pipeline.subjects(_bundle(s, d)["entities"].filter("entity_type = 'adr'").select("id"), "valid")


def record_view(s, d):
    b = _bundle(s, d)
    return pipeline.record_view(b["entities"], b["relationships"]).select("adr_id", F.array_join("introduced", ",").alias("introduced"), F.array_join("related", ",").alias("related"))


def domain_index(s, d):
    return pipeline.indexes(g.slice_nodes(s, d))


def decision_gravity(s, d):
    e, declared = _records(s, d)
    return architecture.decision_gravity(e, declared)


def gravity_summary(s, d):
    return architecture.gravity_summary(decision_gravity(s, d))


def record_boundaries(s, d):
    return architecture.boundaries(*_records(s, d)).select("adr_id", F.array_join("declared", ",").alias("declared"))


def record_chains(s, d):
    return architecture.chains(*_records(s, d))


def identity_findings(s, d):
    """Between the first half of the extraction log and the second one."""
    rows = table(s, d, "slice_metadata").select("seq_no", F.explode("source_files").alias("f"), norm_id("slice_id").alias("id"), F.col("extractor_version").alias("extractor")).select("seq_no", norm_id("f").alias("path"), "id", "extractor")
    mid = table(s, d, "slice_metadata").agg((F.max("seq_no") + F.min("seq_no")) / 2).first()[0] or 0.0
    return delta.identity_findings(rows.filter(F.col("seq_no") <= mid), rows.filter(F.col("seq_no") > mid))


def source_excerpts(s, d):
    """The lines of each located entity in the newest scan of its file."""
    l = table(s, d, "source_locators").select(F.col("entity_uri").alias("key"), F.concat_ws("|", "repo", norm_id("file_path")).alias("path"), F.col("line_start").alias("first"), F.col("line_end").alias("last")).filter("key is not null and repo is not null").distinct()
    newest = _files(s, d).filter("body is not null and repo is not null").groupBy(F.concat_ws("|", "repo", norm_id("file_path")).alias("path")).agg(F.max(F.struct("scanned_at", "body")).alias("v")).select("path", "v.body")
    return render.excerpts(l, newest)


def _documents(reader: str):
    return lambda s, d: documents.document_facts(_files(s, d), reader)


QUERIES = {
    f.__name__: f
    for f in (
        architecture_entities, architecture_relationships, evidence_subjects, record_view, domain_index, decision_gravity, gravity_summary, record_boundaries, record_chains, identity_findings, source_excerpts, change_advice, project_structure, style_classes,
        all_facts, slice_elements, module_rows, class_modules, function_modules, template_edges, strongest_edges,
        show_node, implementation_context, related_implementations, overview, overview_repos, key_components, stack_kind, diagnostics, scope_files, scope_freshness, affected_keys, entity_locators, node_matrix, repo_depth_advice,
        node_names, token_estimates, extractor_gaps,
        graph_stats, tag_counts, by_tag, lookup_ids, broken_edges, one_sided, isolated, health, search_exact, search_question, search_fuzzy, entry_points, task_candidates, similar, find, usages,
        dependencies_d2, dependents_d2, blast_d2, blast_tiers, blast_risk, closure_forward, closure_reverse, walk_exact, relevant_files, shared_context, context_domains, obligations,
        system_dependencies, verb_counts, repo_types, component_integration, what_calls, group_sizes, adjacency, first_wins, identity_collisions, merged_graph, relationship_pivot, gravity, prefix_affinity,
        embodiment, height, topology, change_counts, locator_freshness, stale_slices, checksum_drift, coverage, schema_findings, duplicate_ids, id_changes, manifest_diff, signature_changes, debounced, adaptive_debounced, transactions, bursts,
        record_relationships, record_governance, record_gaps, consequence_surface, dependency_charts, file_tags, context_bundles,
    )
} | {
    "resolved_calls": _resolved_calls("call", "function"),
    "csharp_facts": _documents("csharp"), "component_facts": _documents("components"), "record_facts": _documents("decision_record"),
    "typescript_facts": lambda s, d: typescript.typescript_facts(_files(s, d)), "template_facts": lambda s, d: templates.template_facts(_files(s, d)),
    "compress_l0": compress(0), "compress_l1": compress(1), "compress_l2": compress(2), "compress_l3": compress(3), "compress_l4": compress(4),
    "classify_files": lambda s, d: extract.classify(_files(s, d)), "imports": lambda s, d: extract.imports(_files(s, d)), "styles": lambda s, d: extract.styles(_files(s, d)),
    "resources": lambda s, d: extract.resources(_files(s, d)), "decision_records": lambda s, d: extract.decision_records(_files(s, d)), "decision_edges": lambda s, d: extract.decision_edges(_files(s, d)),
    "headings": lambda s, d: extract.headings(table(s, d, "documents")), "links": lambda s, d: extract.links(table(s, d, "documents")), "python_facts": lambda s, d: extract.python_facts(_files(s, d)),
}

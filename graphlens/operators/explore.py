"""Looking around in a graph: single nodes with their surroundings, overviews, the scope of a change and its freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators import search, traverse

#: Entry points named for each domain, key components named, dependents from which on a node is one.
ENTRY_POINTS, KEY_COMPONENTS, KEY_DEPENDENTS = 5, 10, 3


def by_key(nodes: DataFrame, key: str) -> DataFrame:
    """The node of a key."""
    return nodes.filter(F.col("key") == key)


def resolved(nodes: DataFrame, target: str, repo: str | None = None) -> DataFrame:
    """The node that a target names: by its key, else the best that a search finds. One row or none."""
    found = search.narrowed(by_key(nodes, target), repo=repo).select("key").limit(1)
    return found if found.count() else search.search(nodes, target, 1, repo=repo).select("key")


def show(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 1, limit: int = 20, repo: str | None = None) -> DataFrame:
    """A node and what it depends on: ord (0 the node itself), key, depth. At most ``limit`` dependencies, walked depth first."""
    seed = resolved(nodes, target, repo).withColumnRenamed("key", "seed")
    own = seed.select(F.lit(0).alias("ord"), F.col("seed").alias("key"), F.lit(0).alias("depth"))
    return own.unionByName(traverse.walk(edges, seed, depth, limit).select("ord", F.col("node").alias("key"), "depth"))


def implementation_context(nodes: DataFrame, ball: DataFrame) -> DataFrame:
    """What lies around each seed, with place and type: seed, node, depth, domain, type, path. Dangling ends have no row."""
    return ball.join(nodes.select(F.col("key").alias("node"), "domain", "type", "path"), "node").select("seed", "node", "depth", "domain", "type", "path")


def related(nodes: DataFrame, ball: DataFrame) -> DataFrame:
    """Nodes of a ball which have the domain and the type of its seed: seed, node, depth."""
    kind = lambda end: nodes.select(F.col("key").alias(end), F.struct("domain", "type").alias(f"{end}_kind"))
    both = ball.filter("depth > 0").join(kind("seed"), "seed").join(kind("node"), "node")
    return both.filter(F.col("seed_kind") == F.col("node_kind")).select("seed", "node", "depth")


def overview(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Nodes of each group, and its first entry points by key: exported nodes and those of the api domain."""
    entry = F.array_contains("tags", "exported") | (F.col("domain") == "api")
    at = nodes.select(*by, "key", "name", F.coalesce(entry, F.lit(False)).alias("entry")).withColumn("rank", F.when(F.col("entry"), F.row_number().over(Window.partitionBy(*by, "entry").orderBy("key"))))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= ENTRY_POINTS, F.struct("rank", "name")))), lambda x: x["name"]), ",")
    return at.groupBy(*by).agg(F.count("*").alias("n_nodes"), first.alias("entry_points"))


def key_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes with the most dependents, if more than ``KEY_DEPENDENTS``: key, n_dependents."""
    users = edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("n_dependents")).filter(F.col("n_dependents") > KEY_DEPENDENTS)
    return users.join(nodes.select("key"), "key").orderBy(F.desc("n_dependents"), "key").limit(KEY_COMPONENTS)


def stack_kind(nodes: DataFrame) -> DataFrame:
    """What kind of system the domains of a graph speak of."""
    has = lambda d: F.coalesce(F.bool_or(F.col("domain") == d), F.lit(False))
    front, api, data = has("frontend"), has("api"), has("data")
    kind = F.when(front & api & data, "full stack").when(api & data, "backend").when(has("infrastructure"), "infrastructure as code").when(F.countDistinct("domain") > 3, "several domains")
    return nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct("domain").alias("n_domains"), kind.otherwise("unknown").alias("stack"))


def diagnostics(nodes: DataFrame, forward: DataFrame, backward: DataFrame, isolated: DataFrame) -> DataFrame:
    """Connectivity and degree of a graph in one row; an empty graph has 0 everywhere."""
    links = forward.select("src").unionByName(backward.select("src")).join(nodes.select(F.col("key").alias("src")), "src", "left_semi")
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("n_nodes", nodes), ("n_links", links), ("n_isolated", isolated))]
    wide = counted[0].unionByName(counted[1]).unionByName(counted[2])
    wide = wide.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in ("n_nodes", "n_links", "n_isolated")])
    share = lambda x: F.when(F.col("n_nodes") > 0, F.round(x / F.col("n_nodes"), 6)).otherwise(0.0)
    return wide.select("n_nodes", "n_isolated", share(F.col("n_nodes") - F.col("n_isolated")).alias("connectivity"), share(F.col("n_links")).alias("avg_degree"))


def scope_files(node_files: DataFrame, ball: DataFrame) -> DataFrame:
    """For each file the files that a change of it may concern: those of its nodes, and of the nodes in their balls.

    node_files: key, file; ball: seed, node, the seeds being all nodes. Distinct before each join, so a file of many nodes costs a row each.
    """
    own = node_files.select(F.col("key").alias("seed"), F.col("file").alias("target")).distinct()
    reach = ball.select("seed", "node").distinct().join(own, "seed").select("target", F.col("node").alias("key")).distinct()
    return reach.join(node_files.distinct(), "key").select("target", "file").distinct()


def freshness(scope: DataFrame, stale: DataFrame) -> DataFrame:
    """For each target how many files of its scope are stale, what that makes of it and what to do: fresh, partial or stale."""
    both = scope.join(stale.select(F.col("path").alias("file")).distinct().withColumn("is_stale", F.lit(True)), "file", "left")
    counts = both.groupBy("target").agg(F.count("*").alias("n_files"), F.count("is_stale").alias("n_stale"))
    status = F.when(F.col("n_stale") == 0, "fresh").when(F.col("n_stale") == F.col("n_files"), "stale").otherwise("partial")
    return counts.withColumn("status", status).withColumn("action", F.when(F.col("n_stale") == 0, "proceed").otherwise("reconcile_first"))


def preflight(node_files: DataFrame, ball: DataFrame, stale: DataFrame, refresh=None) -> tuple[DataFrame, bool]:
    """Freshness of every scope; if something is stale and ``refresh`` is given, it is called once and says what is stale then."""
    scope = scope_files(node_files, ball)
    state = freshness(scope, stale)
    if refresh is None or not state.filter("status <> 'fresh'").limit(1).count():
        return state, False
    return freshness(scope, refresh()), True


def affected(node_files: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Keys that a change of files concerns: nodes of these files, and one step further those that refer to them. changed: file."""
    hit = node_files.join(changed.select("file").distinct(), "file", "left_semi").select("key").distinct()
    users = edges.join(hit.withColumnRenamed("key", "dst"), "dst", "left_semi").select(F.col("src").alias("key"))
    return hit.withColumn("how", F.lit("changed")).unionByName(users.distinct().join(hit, "key", "left_anti").withColumn("how", F.lit("depends")))


def locator_of(locators: DataFrame, wanted: DataFrame) -> DataFrame:
    """The locator of each URI: by entity, or by workspace path, decision record or snapshot, as its kind says; the first by URI and path.

    wanted: uri, kind (entity, workspace, adr, graph), and name (repo/path or an id). Each kind is an equi-join of its own.
    """
    l = locators.select("entity_uri", "entity_id", "repo", "file_path", "source_uri", "graph_snapshot_hash").distinct()
    keys = {"entity": F.coalesce(F.col("entity_uri"), F.col("entity_id")), "workspace": F.concat_ws("/", "repo", "file_path"), "adr": F.col("entity_id"), "graph": F.concat_ws("@", "entity_id", "graph_snapshot_hash")}
    found = None
    for kind, key in keys.items():
        one = wanted.filter(F.col("kind") == kind).join(l.withColumn("name", key), "name").groupBy("uri").agg(F.min(F.struct("entity_uri", "repo", "file_path")).alias("at"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("uri").agg(F.min("at").alias("at")).select("uri", "at.entity_uri", "at.repo", "at.file_path")


def depth_advice(n_nodes: Column, n_edges: Column, branching: Column, convergence: Column, longest: int | None = None) -> Column:
    """Struct of category and depth that a traversal should take, by the shape of a graph; ``longest`` caps the depth."""
    density = F.when(n_nodes == 0, F.lit(0.0)).otherwise(n_edges / n_nodes)
    rules = (("empty", n_nodes == 0, 0), ("degenerate", n_edges == 0, 1), ("exploding", branching >= 3.5, 1), ("dense", density >= 2, 1), ("convergent", convergence >= 0.75, 3), ("sparse", branching <= 0.75, 3))
    category, depth = None, None
    for name, holds, d in rules:
        category = F.when(holds, name) if category is None else category.when(holds, name)
        depth = F.when(holds, d) if depth is None else depth.when(holds, d)
    depth = depth.otherwise(2)
    return F.struct(category.otherwise("balanced").alias("category"), (depth if longest is None else F.least(depth, F.lit(longest))).cast("int").alias("depth"))


def entry_lookup(nodes: DataFrame, name: str, ident: str = "id") -> DataFrame:
    """The node that a name means: the id itself, else the first id that contains it."""
    rank = F.when(F.col(ident) == name, 0).when(F.col(ident).contains(name), 1)
    return nodes.withColumn("_rank", rank).filter("_rank is not null").orderBy("_rank", ident).limit(1).drop("_rank")


def missing_extractors(files: DataFrame, known: list[str]) -> DataFrame:
    """Kinds of files that no extractor reads, with their number. files: file_id, kind."""
    return files.filter(~F.col("kind").isin(*known)).groupBy("kind").agg(F.count("*").alias("n_files"))

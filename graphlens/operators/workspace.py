"""Questions to a workspace graph: nodes (id, type, name, repo), edges (src, dst, verb)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How repositories work together, by verb.
PATTERNS = {"has_contract": "HTTP API", "reads": "Shared Database", "writes": "Shared Database", "publishes": "Event Stream", "consumes": "Event Stream", "invokes": "Invocation", "deploys_to": "Deployment"}
#: Tier of each verb; verbs not named have tier 5.
TIERS = {"calls": 1, "publishes": 1, "consumes": 1, "deploys_to": 2, "invokes": 2, "contains": 2, "has_contract": 3, "reads": 4, "writes": 4, "references": 5}
#: Types whose nodes are never grouped.
SINGLE_TYPES = ("StateMachine", "Bucket", "Service")
#: Types of helpers that overviews leave out.
AUXILIARY_TYPES = ("Role", "SecurityGroup", "LogGroup", "Alarm", "Certificate", "DNSRecord")
CALL_VERBS = ("invokes", "publishes", "calls", "triggers", "publishes_to")


def lookup(values: dict, c: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), c), F.lit(default))


def placed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with repository and type of both ends; dangling edges drop out."""
    side = lambda end: nodes.select(F.col("id").alias(end), F.col("repo").alias(f"{end}_repo"), F.col("type").alias(f"{end}_type"))
    return edges.join(side("src"), "src").join(side("dst"), "dst")


def system_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Verbs and number of edges between each two repositories."""
    cross = placed(nodes, edges).filter("src_repo <> dst_repo")
    return cross.groupBy("src_repo", "dst_repo").agg(F.count("*").alias("n_edges"), F.array_join(F.array_sort(F.collect_set("verb")), ",").alias("verbs"))


def component_integration(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that touch each repository, by pattern."""
    both = placed(nodes, edges).withColumn("repo", F.explode(F.array_distinct(F.array("src_repo", "dst_repo"))))
    return both.groupBy("repo", lookup(PATTERNS, F.col("verb"), "Other").alias("pattern")).agg(F.count("*").alias("n_edges"))


def what_calls(edges: DataFrame) -> DataFrame:
    """Distinct direct callers of each node, a row each."""
    return edges.filter(F.col("verb").isin(*CALL_VERBS)).select(F.col("dst").alias("id"), F.col("src").alias("caller")).distinct()


def admitted(nodes: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """Edges shown at a level of detail, 0 (least) to 4 (all)."""
    tier = lookup(TIERS, F.col("verb"), 5)
    shared = (tier == 4) & (F.col("src_repo") != F.col("dst_repo"))
    rule = {0: tier <= 1, 1: (tier <= 2) | shared, 2: (tier <= 3) | shared}.get(level, F.lit(True))
    return placed(nodes, edges).filter(rule)


def capability(endpoint: Column) -> Column:
    """Capability of an endpoint by its id ``Endpoint:repo:method:path-segments``: the first segment, or the one after ``api``."""
    path = F.filter(F.split(F.array_join(F.slice(F.split(endpoint, ":"), F.lit(4), F.greatest(F.size(F.split(endpoint, ":")) - 3, F.lit(0))), ":"), "-"), lambda x: x != "")
    first = F.lower(F.try_element_at(path, F.lit(1)))
    name = F.when(F.size(path) >= 2, F.when(first == "api", F.try_element_at(path, F.lit(2))).otherwise(first))
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1000)))


def overview_only(nodes: DataFrame) -> DataFrame:
    """Nodes without alarm topics and helpers, which overviews leave out."""
    alarm = (F.col("type") == "Topic") & F.lower("id").rlike("alarm|monitor")
    return nodes.filter(~alarm & ~F.col("type").isin(*AUXILIARY_TYPES))


def compressed_nodes(nodes: DataFrame, level: int, least: int = 3, least_capability: int = 2) -> DataFrame:
    """id → group_id of the compressed graph.

    0: repositories. 1: groups by repository and type. 2: endpoints by capability. 3 and 4: each for itself.
    Groups are counted first and joined back, as a window would gather each of them in one task.
    """
    if level == 0:
        return nodes.select("id", F.concat(F.lit("Service_"), "repo").alias("group_id"))
    if level > 2:
        return nodes.select("id", F.col("id").alias("group_id"))
    if level == 1:
        keyed, name = nodes.withColumn("part", F.col("type")), F.concat("part", F.lit("_group_"), "repo")
        big = (F.col("n") >= least) & ~F.col("type").isin(*SINGLE_TYPES)
    else:
        keyed = nodes.withColumn("part", F.when(F.col("type") == "Endpoint", capability(F.col("id"))))
        big, name = F.col("n") >= least_capability, F.concat("part", F.lit("_Domain_"), "repo")
    groups = keyed.filter("part is not null").groupBy("repo", "part").agg(F.count("*").alias("n"))
    return keyed.join(groups, ["repo", "part"], "left").select("id", F.when(big, name).otherwise(F.col("id")).alias("group_id"))


def compressed_edges(nodes: DataFrame, edges: DataFrame, level: int, least: int = 3, least_capability: int = 2) -> DataFrame:
    """Edges between compressed nodes with their multiplicity; loops drop out. Overviews (0, 1) leave helpers out."""
    nodes = overview_only(nodes) if level <= 1 else nodes
    groups = compressed_nodes(nodes, level, least, least_capability)
    shown = admitted(nodes, edges, level).select("src", "dst", "verb")
    ends = shown.join(groups.toDF("src", "from_group"), "src").join(groups.toDF("dst", "to_group"), "dst").filter("from_group <> to_group")
    return ends.groupBy("from_group", "to_group", "verb").agg(F.count("*").alias("multiplicity"))


def within(nodes: DataFrame, edges: DataFrame, level: int, most: int) -> tuple[int, DataFrame]:
    """(level, compressed edges) of the finest level up to ``level`` with at most ``most`` nodes.

    Each step down groups from two nodes on and capabilities from one; from level 4 it goes straight to 0.
    """
    least, least_capability = 3, 2
    while level > 0 and compressed_nodes(overview_only(nodes) if level <= 1 else nodes, level, least, least_capability).select("group_id").distinct().count() > most:
        level, least, least_capability = (0 if level == 4 else level - 1), 2, 1
    return level, compressed_edges(nodes, edges, level, least, least_capability)


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Matrix of node types: for each source type and target type the verbs between them."""
    cells = placed(nodes, edges).groupBy("src_type", "dst_type").agg(F.array_join(F.array_sort(F.collect_set("verb")), ",").alias("verbs"))
    return cells


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, by a minimum that is taken before the shuffle too."""
    rest = [c for c in rows.columns if c != key]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("first")
    return rows.groupBy(key).agg(first).select(key, *[F.col(f"first.{c}").alias(c) for c in rest])


def identity_collisions(rows: DataFrame, key: str, repo: str = "repo") -> DataFrame:
    """Ids that more than one repository claims."""
    return rows.groupBy(key).agg(F.countDistinct(repo).alias("n_repos"), F.min(repo).alias("first_repo"), F.max(repo).alias("last_repo")).filter("n_repos > 1")


def merge_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between known nodes, of confidence high or none within a repository, of any between repositories."""
    ends = placed(nodes, edges)
    return ends.filter((F.col("src_repo") != F.col("dst_repo")) | F.col("confidence").isNull() | (F.col("confidence") == "high")).select("src", "dst", "verb").distinct()


def pivot_relationships(edges: DataFrame, verbs: list[str]) -> DataFrame:
    """For each node its number of targets by verb, one column each."""
    return edges.groupBy("src").pivot("verb", verbs).agg(F.countDistinct("dst")).fillna(0)


def gravity(edges: DataFrame, weights: dict[str, int], reach: DataFrame) -> DataFrame:
    """Weighted consequences of each node: twice its dependents within reach, plus its edges by verb's weight."""
    own = edges.groupBy(F.col("src").alias("id")).agg(F.sum(lookup(weights, F.col("verb"), 0)).alias("weighted"))
    far = reach.groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("n_dependents"))
    return own.join(far, "id", "full_outer").fillna(0).withColumn("gravity", F.col("n_dependents") * 2 + F.col("weighted"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    least = F.least(F.length(a), F.length(b))
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), least), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))), F.lit(0))


def prefix_affinity(nodes: DataFrame, source_type: str, target_type: str, least: int = 10) -> DataFrame:
    """For each node of one type the node of another type, elsewhere, whose name begins most alike.

    Only names with ``least`` characters in common at the start can match, so these are the join key.
    """
    named = nodes.filter(F.length("name") >= least).select("id", "type", "repo", "name", F.substring("name", 1, least).alias("head"))
    a = named.filter(F.col("type") == source_type).select("head", F.col("id").alias("src"), F.col("repo").alias("src_repo"), F.col("name").alias("src_name"))
    b = named.filter(F.col("type") == target_type).select("head", F.col("id").alias("dst"), F.col("repo").alias("dst_repo"), F.col("name").alias("dst_name"))
    pairs = a.join(b, "head").filter("src_repo <> dst_repo").withColumn("affinity", shared_prefix(F.col("src_name"), F.col("dst_name")))
    best = pairs.groupBy("src").agg(F.min(F.struct((-F.col("affinity")).alias("less"), "dst")).alias("best"))
    return best.select("src", "best.dst", (-F.col("best.less")).cast("int").alias("affinity"))


def path_segments(path: Column) -> Column:
    """Segments of an HTTP path: lower case, parameters of any notation alike."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(path), r"[{\[][^}\]]*[}\]]|:\w+", ":param"), "/+", "/")
    return F.filter(F.split(plain, "/"), lambda s: s != "")


def _ends(segments: str, claim: bool) -> Column:
    """Join keys by the last two segments, so that no two paths meet whose ends differ as literals.

    l: both end in this literal. w: the claim ends in a parameter, e: the endpoint does, so the segment
    before decides. x, y: that one is a parameter too, of the claim or of the endpoint.
    """
    key = lambda tag, value: F.concat(F.lit(tag), value)
    last, before = F.element_at(segments, -1), F.element_at(segments, -2)
    wild, wilder = last == ":param", (last == ":param") & (before == ":param")
    own, other = ("w", "e") if claim else ("e", "w")
    mine, theirs = ("x", "y") if claim else ("y", "x")
    none = F.lit(None).cast("string")
    keys = [F.when(~wild, key("l", last)), F.when(wild, key(own, before)), key(other, before) if not claim else F.when(~wild, key(other, before)), F.when(wilder, F.lit(mine)), F.lit(theirs)]
    return F.array_compact(F.array(*keys, none))


def match_endpoints(claims: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Best endpoint of another repository for each HTTP call: equal paths, or one the end of the other.

    claims: claim_id, method, path, repo; endpoints: endpoint_id, method, path, repo. Paths of fewer than two
    segments match nothing. Equal paths win, then most literal segments, then the least endpoint id.
    """
    c = claims.select("claim_id", F.upper("method").alias("method"), F.col("repo").alias("c_repo"), path_segments(F.col("path")).alias("c")).filter("size(c) >= 2")
    e = endpoints.select("endpoint_id", F.upper("method").alias("method"), F.col("repo").alias("e_repo"), path_segments(F.col("path")).alias("e")).filter("size(e) >= 2")
    pairs = c.withColumn("end", F.explode(_ends("c", True))).join(e.withColumn("end", F.explode(_ends("e", False))), ["method", "end"]).filter("c_repo <> e_repo")
    n = F.least(F.size("c"), F.size("e"))
    tail = lambda col: F.slice(col, F.size(col) - n + 1, n)
    wild = lambda s: s == ":param"
    fits = F.forall(F.zip_with(tail("c"), tail("e"), lambda x, y: (x == y) | wild(x) | wild(y)), lambda ok: ok)
    literal = F.size(F.filter(F.zip_with(tail("c"), tail("e"), lambda x, y: (x == y) & ~wild(x)), lambda ok: ok))
    found = pairs.filter(fits).groupBy("claim_id").agg(F.min(F.struct((F.col("c") != F.col("e")).alias("inexact"), (-literal).alias("less"), "endpoint_id")).alias("best"))
    return found.select("claim_id", "best.endpoint_id", (~F.col("best.inexact")).alias("exact"))


def ranked(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """Top ``n`` of each value of ``by``; the sort keeps only n rows for each task and value."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= n)

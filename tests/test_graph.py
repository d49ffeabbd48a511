import pytest
from pyspark.sql import functions as F

from graphlens.operators import context, search, structure, traverse, workspace


@pytest.fixture(scope="module")
def nodes(spark):
    data = [
        ("graph/function/load_cache", "graph", "function", "load_cache", "alpha", "src/api/cache.py", "load_cache", ["layer:api", "Lang:Python"]),
        ("graph/function/lambda_handler", "graph", "function", "lambda_handler", "alpha", "src/api/main.py", "lambda_handler", []),
        ("graph/class/Cache", "graph", "class", "Cache", "beta", "lib/core/cache.ts", "Cache", ["layer:core"]),
        ("data/entity/user", "data", "entity", "user", "beta", None, "user", ["storage:memory"]),
        ("infrastructure/resource/cache-table", "infrastructure", "resource", "cache-table", "beta", "infra/a.yaml", "cache-table", []),
        ("graph/module/alone", "graph", "module", "alone", "gamma", "lib/x.ts", "alone", None),
    ]
    return spark.createDataFrame(data, "key string, domain string, type string, id string, repo string, path string, name string, tags array<string>")


@pytest.fixture(scope="module")
def chain(spark):
    """a→b→c→d and a→c: a deep first visit of c hides d from a depth-first walk of depth 2."""
    return spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("a", "b")], "src string, dst string")


def keys(df, column="key"):
    return [r[column] for r in df.collect()]


def test_exact_search_ranks_by_rule(nodes):
    got = [(r.key, r.score) for r in search.search_exact(nodes, "cache").collect()]
    assert got[0] == ("graph/class/Cache", 100) and ("graph/function/load_cache", 80) in got


def test_questions_add_a_bonus_for_more_terms(nodes):
    got = {r.key: r.score for r in search.search_exact(nodes, "where does load use the cache?").collect()}
    assert got["graph/function/load_cache"] == 80 + 80 + 20 and got["graph/class/Cache"] == 100


def test_question_without_terms_finds_nothing(nodes):
    assert search.search_exact(nodes, "what is it?").count() == 0
    assert search.terms("Show me the user_service!") == ["user_service"]
    assert search.entry_terms("triggers of finding-processor") == ["finding-processor"]


def test_fuzzy_only_where_exact_finds_nothing(nodes):
    assert keys(search.search(nodes, "lamda_handlr")) == ["graph/function/lambda_handler"]
    assert "similarity" not in search.search(nodes, "lamda_handlr").columns


@pytest.mark.parametrize(("tag", "found"), [("layer:api", 2), ("LANG:PYTHON", 2), ("lang:typescript", 2), ("handler:lambda", 1), ("storage:dynamodb", 1), ("aws:table", 1), ("nothing", 0)])
def test_tags_and_their_patterns(nodes, tag, found):
    assert structure.by_tag(nodes, tag).count() == found


def test_breadth_first_keeps_what_depth_first_hides(spark, chain):
    seed = spark.createDataFrame([("a",)], "s string")
    assert sorted((r.node, r.depth) for r in traverse.reached(chain, seed, 2).collect()) == [("b", 1), ("c", 1), ("d", 2)]
    assert [(r.ord, r.node, r.depth) for r in traverse.walk(chain, seed, 2).orderBy("ord").collect()] == [(1, "b", 1), (2, "c", 2)]


def test_walks_of_wide_nodes_keep_their_limit(spark):
    edges = spark.createDataFrame([("s", f"n{k:03d}") for k in range(300)] + [("n000", f"m{k:03d}") for k in range(300)], "src string, dst string")
    got = [(r.node, r.depth) for r in traverse.walk(edges, spark.createDataFrame([("s",)], "s string"), 2, 10).orderBy("ord").collect()]
    assert got == [("n000", 1), *((f"m{k:03d}", 2) for k in range(9))]


def test_closures_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = traverse.reached(edges, spark.createDataFrame([("a",), ("d",)], "s string"), None)
    assert sorted((r.seed, r.node, r.depth) for r in got.collect()) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]


def test_traversals_of_nothing(spark, chain):
    assert traverse.reached(chain, spark.createDataFrame([], "s string"), 2).count() == 0
    assert traverse.reached(chain.limit(0), spark.createDataFrame([("a",)], "s string"), None).count() == 0


def test_consistency_checks(spark, nodes, rows):
    k = [r.key for r in nodes.orderBy("key").collect()]
    forward = spark.createDataFrame([(k[0], k[1]), (k[1], "gone"), (k[2], k[3])], "src string, dst string")
    backward = spark.createDataFrame([(k[1], k[0]), (k[4], k[2])], "src string, dst string")
    assert rows(structure.broken_edges(nodes, forward).select("src", "dst")) == [(k[1], "gone")]
    assert rows(structure.one_sided(nodes, forward, backward)) == sorted([(k[2], k[3], "backward"), (k[2], k[4], "forward")])
    h = structure.health(nodes, forward, backward).first()
    assert (h.n_broken, h.n_one_sided, h.n_isolated, h.is_healthy) == (1, 2, 2, False)


def test_depth_and_pattern(spark, chain):
    n = spark.createDataFrame([(x,) for x in "abcd"], "key string")
    d = structure.longest_depths(n, chain)
    assert {r.key: r.depth for r in d.collect()} == {"a": 3, "b": 2, "c": 1, "d": 0}
    t = structure.topology(d, chain.distinct()).first()
    assert (t.max_depth, t.p95_depth, t.pattern, t.recommended_depth) == (3, 3, "flat", 2)


def test_workspace_grouping_and_levels(spark, rows):
    n = spark.createDataFrame([(f"r1:q{k}", "Queue", f"queue-name-{k}", "r1") for k in range(3)] + [("r2:b", "Bucket", "b", "r2"), ("r2:t", "Topic", "queue-name-1x", "r2")], "id string, type string, name string, repo string")
    e = spark.createDataFrame([("r1:q0", "r2:b", "writes"), ("r1:q1", "r2:b", "writes"), ("r1:q0", "r1:q1", "calls"), ("r1:q2", "gone", "calls"), ("r1:q0", "r2:t", "publishes")], "src string, dst string, verb string")
    assert rows(workspace.compressed_edges(n, e, 1)) == [("Queue_group_r1", "r2:b", "writes", 2), ("Queue_group_r1", "r2:t", "publishes", 1)]
    assert rows(workspace.compressed_edges(n, e, 0)) == [("Service_r1", "Service_r2", "publishes", 1)]
    assert rows(workspace.system_dependencies(n, e)) == [("r1", "r2", 3, "publishes,writes")]
    assert rows(workspace.prefix_affinity(n, "Queue", "Topic")) == [("r1:q0", "r2:t", 11), ("r1:q1", "r2:t", 12), ("r1:q2", "r2:t", 11)]


def test_endpoint_matching(spark, rows):
    c = spark.createDataFrame([(1, "get", "/api/users/{id}", "web"), (2, "GET", "/v1/api/orders", "web"), (3, "GET", "/users", "web"), (4, "GET", "/api/users", "svc")], "claim_id int, method string, path string, repo string")
    e = spark.createDataFrame([("e1", "GET", "api/users/:id", "svc"), ("e2", "GET", "/api/orders", "svc"), ("e3", "POST", "/api/orders", "svc"), ("e4", "GET", "/api/users", "svc")], "endpoint_id string, method string, path string, repo string")
    assert rows(workspace.match_endpoints(c, e)) == [(1, "e1", True), (2, "e2", False)]


def test_context_budget_marks_the_rest(spark, rows):
    r = spark.createDataFrame([("c", "b"), ("c", "a"), ("c", "d")], "ctx string, ref string")
    assert rows(context.budgeted(r, "ctx", ["ref"], 2).select("ref", "included")) == [("a", True), ("b", True), ("d", False)]


def test_first_wins_and_collisions(spark, rows):
    r = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("x", 1, "a"), ("y", 1, "a")], "id string, at int, repo string")
    assert rows(workspace.first_wins(r, "id", ["at"])) == [("x", 1, "a"), ("y", 1, "a")]
    assert rows(workspace.identity_collisions(r, "id")) == [("x", 2, "a", "b")]


def test_pivot_keeps_nodes_without_a_verb(spark, rows):
    e = spark.createDataFrame([("a", "b", "calls"), ("a", "c", "calls"), ("b", "c", "reads")], "src string, dst string, verb string")
    assert rows(workspace.pivot_relationships(e, ["calls", "reads"]).select(F.col("src"), "calls", "reads")) == [("a", 2, 0), ("b", 0, 1)]


def test_capabilities_and_size_valve(spark, rows):
    n = spark.createDataFrame([(f"Endpoint:r:GET:api-users-{k}", "Endpoint", "e", "r") for k in "abc"] + [("Endpoint:r:GET:orders-x", "Endpoint", "o", "r"), ("Endpoint:r:GET:x", "Endpoint", "x", "r"), ("q:b", "Bucket", "b", "q"), ("q:alarm-t", "Topic", "t", "q")], "id string, type string, name string, repo string")
    e = spark.createDataFrame([("Endpoint:r:GET:api-users-a", "q:b", "calls"), ("Endpoint:r:GET:api-users-b", "q:b", "calls"), ("Endpoint:r:GET:orders-x", "q:b", "calls"), ("q:alarm-t", "Endpoint:r:GET:x", "calls")], "src string, dst string, verb string")
    assert rows(workspace.compressed_edges(n, e, 2)) == [("Endpoint:r:GET:orders-x", "q:b", "calls", 1), ("Users_Domain_r", "q:b", "calls", 2), ("q:alarm-t", "Endpoint:r:GET:x", "calls", 1)]
    assert rows(workspace.compressed_edges(n, e, 0)) == [("Service_r", "Service_q", "calls", 3)]
    assert workspace.within(n, e, 3, 100)[0] == 3 and workspace.within(n, e, 3, 5)[0] == 2 and workspace.within(n, e, 4, 3)[0] == 0


def test_nested_stacks(spark, rows):
    from graphlens.operators import stacks

    s = spark.createDataFrame([("a", "X", "b"), ("b", "Y", "c"), ("a", "Z", None)], "parent_template string, logical_id string, child_template string")
    assert set(rows(stacks.topology(s))) == {("a", "root"), ("a#Z", "unresolved"), ("b", "child"), ("c", "child")}
    b = spark.createDataFrame([("c#p", "reference", "b#p"), ("b#p", "reference", "a#p"), ("a#p", "literal", "7"), ("x", "reference", "y"), ("y", "reference", "x"), ("g", "reference", "gone"), ("u", "unsupported", None)], "key string, kind string, value string")
    assert rows(stacks.resolve(b).select("key", "value", "reason")) == [("a#p", "7", None), ("b#p", "7", None), ("c#p", "7", None), ("g", None, "RESOURCE_NOT_FOUND"), ("u", None, "UNSUPPORTED_INTRINSIC"), ("x", None, "CYCLE_DETECTED"), ("y", None, "CYCLE_DETECTED")]
    assert {r.key: r.reason for r in stacks.resolve(b, 1).collect()}["c#p"] == "MAX_DEPTH_EXCEEDED"


def test_search_filters_truncation_and_further_rules(spark):
    data = [("d/t/alpha", "d", "t", "alpha", "alpha", "r", "a.py", [], "about beta things", None), ("d/u/gamma", "d", "u", "gamma", "gamma", "s", "b.py", [], None, "notes on beta"), ("e/t/beta", "e", "t", "beta", "beta", "r", "c.py", [], None, None)]
    n = spark.createDataFrame(data, "key string, domain string, type string, id string, name string, repo string, path string, tags array<string>, description string, docstring string")
    assert [(r.key, r.score) for r in search.search(n, "beta").collect()] == [("e/t/beta", 100), ("d/t/alpha", 70), ("d/u/gamma", 50)]
    page, more = search.search_page(n, "beta", 1)
    assert [r.key for r in page.collect()] == ["e/t/beta"] and more
    page, more = search.search_page(n, "beta", 5, domain="d", kind="u", repo="s")
    assert [r.key for r in page.collect()] == ["d/u/gamma"] and not more
    assert search.search_page(n, "betta", 5, fuzzy=False)[0].count() == 0 and search.search_page(n, "betta", 5)[0].count() == 1

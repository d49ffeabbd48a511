"""Registered queries against brute force on small tables: nothing is capped, bounded or left out."""

from collections import defaultdict

from graphlens.plans import graph_queries as q


def workspace_tables(spark, folder, edges, systems=()):
    """Tables of a workspace graph with these edges; the ends are nodes, the systems external ones."""
    d = str(folder)
    ids = sorted({x for e in edges for x in e[:2]} - set(systems))
    spark.createDataFrame(edges, "from_id string, to_id string, verb string").write.parquet(f"{d}/merged_edges.parquet")
    spark.createDataFrame([(x, "Service", x, f"r{k % 3}") for k, x in enumerate(ids)], "node_id string, node_type string, name string, repo string").write.parquet(f"{d}/ws_nodes.parquet")
    spark.createDataFrame([(x, x) for x in systems], "system_id string, name string").write.parquet(f"{d}/external_systems.parquet")
    return d


def ball(pairs, seed, depth):
    """node → depth of what is reached from the seed, without it."""
    ahead, at, front, k = defaultdict(set), {seed: 0}, {seed}, 0
    for a, b in pairs:
        ahead[a].add(b)
    while front and (depth is None or k < depth):
        k += 1
        front = {b for a in front for b in ahead[a]} - at.keys()
        at |= dict.fromkeys(front, k)
    return {n: x for n, x in at.items() if x}


def test_gravity_scores_every_node_that_implements(spark, tmp_path, rows):
    edges = [(f"n{k:02d}", f"i{k % 7}", "implements") for k in range(60)] + [(f"n{k:02d}", f"n{k // 2:02d}", "contains") for k in range(1, 60)] + [("x", "n00", "calls"), ("y", "n01", "deploys_to")]
    d, weights = workspace_tables(spark, tmp_path, edges), {"implements": 3, "contains": 2, "deploys_to": 1}
    back = [(b, a) for a, b, v in edges if v in weights]
    want = []
    for n in sorted({a for a, _, v in edges if v == "implements"}):
        own, far = sum(weights.get(v, 0) for a, _, v in edges if a == n), len(ball(back, n, 2))
        want.append((n, own, far, 2 * far + own))
    assert rows(q.gravity(spark, d)) == want and len(want) == 60


def test_heights_have_no_bound_and_cycles_have_none(spark, tmp_path, rows):
    links = [(f"c{k:02d}", f"c{k - 1:02d}") for k in range(1, 16)]
    links += [("p", "q"), ("q", "p"), ("q", "c05"), ("above", "p"), ("top", "above"), ("top", "c03"), ("p", "between"), ("between", "s"), ("s", "s")]
    d = workspace_tables(spark, tmp_path, [(*e, "implements") for e in links])
    want = {f"c{k:02d}": k for k in range(16)} | {"p": 0, "q": 0, "between": 0, "s": 0, "above": 1, "top": 4}
    assert dict(rows(q.height(spark, d))) == want


def test_blasts_start_from_external_systems_too(spark, tmp_path):
    edges = [(f"n{k:02d}", "hub", "calls") for k in range(15)] + [(f"n{k:02d}", f"m{k // 2}", "calls") for k in range(15)]
    d = workspace_tables(spark, tmp_path, edges, ["hub"])
    pairs = [e[:2] for e in edges] + [e[1::-1] for e in edges]
    want = ball(pairs, "hub", 2)
    got = {r.tier: r.n_nodes for r in q.blast_tiers(spark, d).filter("seed = 'hub'").collect()}
    assert got == {k: sum(x == k for x in want.values()) for k in (1, 2)}
    assert q.blast_risk(spark, d).filter("seed = 'hub'").first().risk == "high"


def test_every_node_is_a_seed(spark, tmp_path, rows):
    links = [(f"n{k:02d}", f"n{k // 3:02d}") for k in range(1, 30)] + [("n02", "n20"), ("n29", "gone")]
    d, ids = workspace_tables(spark, tmp_path, [(*e, "implements") for e in links]), [f"n{k:02d}" for k in range(31)]
    key, refs = "graph/function/{}".format, {n: [("graph", "function", b) for a, b in links if a == n] for n in ids}
    slices = [("graph", "function", n, "r", [f"{n}.py"], [], refs[n], []) for n in ids]
    ref = "array<struct<slice_domain string, slice_type string, slice_id string>>"
    schema = f"slice_domain string, slice_type string, slice_id string, repo string, source_files array<string>, tags array<string>, forward_refs {ref}, backward_refs {ref}"
    spark.createDataFrame(slices, schema).write.parquet(f"{d}/slices.parquet")
    nodes, back = sorted({*ids, "gone"}), [e[::-1] for e in links]

    def balls(pairs, depth, name):
        return {(name(s), name(n), x) for s in nodes for n, x in ball(pairs, s, depth).items()}

    assert set(rows(q.dependencies_d2(spark, d))) == balls(links, 2, key)
    assert set(rows(q.dependents_d2(spark, d))) == balls(back, 2, key)
    assert set(rows(q.blast_d2(spark, d))) == balls(links + back, 2, key)
    assert set(rows(q.closure_forward(spark, d))) == {(s, n) for s, n, _ in balls(links, None, str)}
    near = {s: {s, *ball(links, s, 1)} - {"gone"} for s in nodes}
    assert set(rows(q.relevant_files(spark, d))) == {(key(s), f"{n}.py") for s in nodes for n in near[s]}
    both = {s: {s, *ball(links + back, s, 2)} for s in nodes}
    assert set(rows(q.shared_context(spark, d))) == {(key(a), key(b), len(both[a] & both[b])) for a in nodes for b in nodes if a < b and both[a] & both[b]}
    assert {r.seed for r in q.context_bundles(spark, d).select("seed").distinct().collect()} == {key(n) for n in nodes}

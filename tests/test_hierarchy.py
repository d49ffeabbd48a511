import random

import pytest

from graphlens.operators import hierarchy

SCHEMA = "parent string, child string, depth string, n long"


def result(spark, links, **kw):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in links], SCHEMA)
    return {r.node_id: (r.root_id, r.depth, r.node_path, r.state) for r in hierarchy.hierarchies(df, **kw).collect()}


def brute(links):
    parent = {b: a for a, b in links if a is not None and b is not None}
    nodes = set(parent) | set(parent.values())
    out = {}
    for v in nodes:
        path, seen, x = [v], {v}, v
        while x in parent and parent[x] not in seen:
            x = parent[x]
            path.append(x)
            seen.add(x)
        if x not in parent:
            out[v] = (x, len(path) - 1, " > ".join(path[::-1]), "ok")
        else:
            at, cycle = parent[x], [parent[x]]
            while parent[at] != cycle[0]:
                at = parent[at]
                cycle.append(at)
            out[v] = ("", -1, "", "cycle" if v in cycle else "under_cycle")
    return out


def test_small_forest_with_cycles(spark):
    links = [("r", "a"), ("r", "b"), ("a", "c"), ("c", "d"), ("r", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "under"), ("under", "deep"), ("self", "self"), ("self", "below"), (None, "q"), ("q", None)]
    assert result(spark, links, chunk=2) == brute([x for x in links if None not in x])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_match_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{rng.randrange(k)}", f"n{k}") for k in range(1, 120) if rng.random() < 0.95]
    links += [(f"c{k}", f"c{(k + 1) % 7}") for k in range(7)] + [("c3", f"u{k}") for k in range(5)] + [(f"u{k}", f"v{k}") for k in range(5)]
    links += [(f"deep{k}", f"deep{k + 1}") for k in range(40)] + [("star", f"s{k}") for k in range(150)]
    assert result(spark, links, chunk=16) == brute(links)
    assert result(spark, links, chunk=16, peel_rounds=2, small=40) == brute(links)


def test_one_parent_of_a_hundred_thousand_children(spark, monkeypatch):
    """The hot parent is looked up apart, and what is left for one task is small."""
    monkeypatch.setattr("graphlens.operators.skew.HOT_FLOOR", 1000)
    links = spark.range(100_000).selectExpr("'hub' as parent", "concat('n', id) as child").union(spark.sql("select 'top' as parent, 'hub' as child union all select 'x', 'y' union all select 'y', 'x'"))
    out = hierarchy.hierarchies(links, small=150_000)
    got = {(r.state, r.depth): r["count"] for r in out.groupBy("state", "depth").count().collect()}
    assert got == {("ok", 0): 1, ("ok", 1): 1, ("ok", 2): 100_000, ("cycle", -1): 2}
    assert out.filter("node_path = concat('top > hub > ', node_id)").count() == 100_000


def test_no_links(spark):
    assert result(spark, []) == {}
    assert result(spark, [(None, None), ("a", None)]) == {}


def test_intervals_give_descendants(spark):
    df = spark.createDataFrame([("r", "a"), ("a", "b"), ("a", "c"), ("r", "d")], "parent string, child string")
    nodes = hierarchy.hierarchies(df)
    assert {r.node_id for r in hierarchy.descendants(nodes, "a").collect()} == {"b", "c"}
    assert {r.node_id for r in hierarchy.descendants(nodes, "r").collect()} == {"a", "b", "c", "d"}

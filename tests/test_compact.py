"""Searches over numbered nodes against brute force, and against the same searches by joins."""

import random

import pytest
from test_whole_jobs import ball, workspace_tables

from graphlens.operators import compact, traverse
from graphlens.plans import graph_queries as q


def listed(monkeypatch, name):
    """What is reached must not be listed where counts or arrays do."""
    monkeypatch.setattr(traverse, name, lambda *a: pytest.fail(f"{name} lists what is reached"))


def hub_edges():
    rng = random.Random(5)
    ids = [f"n{k:03d}" for k in range(420)]
    edges = {(x, hub, "calls") for hub, k in (("hub", 380), ("hub2", 330), ("hub3", 300)) for x in rng.sample(ids, k)}
    edges |= {(rng.choice(ids), rng.choice(ids), "reads") for _ in range(150)} | {("n001", "n001", "calls"), ("lone", "lone", "calls"), ("p", "q", "calls"), ("gone1", "n007", "calls"), ("gone1", "gone2", "calls"), ("gone2", "gone3", "calls")}
    return sorted(edges)


def test_blasts_of_hubs_are_counted_not_listed(spark, tmp_path, rows, monkeypatch):
    edges = hub_edges()
    d = workspace_tables(spark, tmp_path, edges, ["hub", "hub2", "gone1", "gone2", "gone3"])
    spark.createDataFrame([("hub", "h"), ("hub2", "h")], "system_id string, name string").write.mode("overwrite").parquet(f"{d}/external_systems.parquet")
    n, e = q._ws(spark, d)
    repo = {r.id: r.repo for r in n.collect()}
    pairs = [x[:2] for x in edges] + [x[1::-1] for x in edges]
    tiers, risks = [], []
    for s in sorted({x for p in pairs for x in p}):
        at = ball(pairs, s, 2)
        for k in {*at.values()}:
            own = [repo.get(x) for x, y in at.items() if y == k]
            tiers.append((s, k, sum(x is not None for x in own), len({*own} - {None}), own.count(None)))
        known = {x: k for x, k in at.items() if x in repo}
        if known:
            n_repos, far = len({repo[x] for x in known} - {None}), sum(k == 2 for k in known.values())
            level = "critical" if n_repos >= 4 or far >= 10 else "high" if n_repos >= 3 or far >= 5 else "medium" if n_repos >= 2 or far >= 2 else "low"
            risks.append((s, n_repos, far, max(known.values()), level))
    by_joins = [rows(traverse.tiers(b := traverse.reached(traverse.both_ways(e), q.ends(e), 2), n)), rows(traverse.risk(b, n))]
    listed(monkeypatch, "reached")
    got = [rows(q.blast_tiers(spark, d)), rows(q.blast_risk(spark, d))]
    assert got == by_joins == [sorted(tiers, key=repr), sorted(risks, key=repr)] and len({x[4] for x in risks}) > 2


def test_larger_graphs_go_by_joins(spark, tmp_path, rows, monkeypatch):
    d = workspace_tables(spark, tmp_path, hub_edges()[:300])
    want = rows(q.blast_tiers(spark, d))
    monkeypatch.setattr(compact, "LINKS", 100)
    n, e = q._ws(spark, d)
    assert compact.blast(e, n) is None and rows(q.blast_tiers(spark, d)) == want


def test_shared_context_shuffles_no_pairs(spark, tmp_path, rows, monkeypatch):
    from test_whole_jobs import ball as near

    rng = random.Random(6)
    links = sorted({(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(70)} | {("n59", f"n{k:02d}") for k in range(0, 40, 3)} | {("é", "n01"), ("z", "é"), ("self", "self")})
    ids, key = sorted({a for a, _ in links}), "graph/function/{}".format
    ref = "array<struct<slice_domain string, slice_type string, slice_id string>>"
    slices = [("graph", "function", n, [("graph", "function", b) for a, b in links if a == n]) for n in ids]
    spark.createDataFrame(slices, f"slice_domain string, slice_type string, slice_id string, forward_refs {ref}").write.parquet(f"{tmp_path}/slices.parquet")
    both = {s: {s, *near([*links, *(x[::-1] for x in links)], s, 2)} for x in links for s in x}
    want = sorted(((key(a), key(b), len(both[a] & both[b])) for a in both for b in both if a < b and both[a] & both[b]), key=repr)
    monkeypatch.setattr(compact, "BALLS", 10)
    assert rows(q.shared_context(spark, str(tmp_path))) == want
    monkeypatch.undo()
    listed(monkeypatch, "bfs")
    for name, value in (("STEP", 40), ("ROWS", 7), ("STEP", 1 << 22)):
        monkeypatch.setattr(compact, name, value)
        assert rows(q.shared_context(spark, str(tmp_path))) == want


def test_consequences_write_no_steps(spark, tmp_path, rows, monkeypatch):
    from graphlens.operators import architecture
    from graphlens.session import Scratch

    rng = random.Random(7)
    verbs = ["calls", "implements", "reads", "contradicts", "refines", "embodies"]
    links = sorted({(f"n{rng.randrange(50):02d}", f"n{rng.randrange(50):02d}", rng.choice(verbs)) for _ in range(160)} | {("n00", f"n{k:02d}", v) for k in range(50) for v in ("refines", "implements")})
    ranked = sorted(verbs, key=lambda v: (v not in architecture.HARD, v))
    want, nodes = [], sorted({x for a, b, _ in links for x in (a, b)})
    for s in nodes:
        seen, front = {s}, {s}
        for k in (1, 2, 3):
            best = {}
            for a, b, v in links:
                if a in front and b not in seen and (k == 1 or v in (*architecture.HARD, *architecture.SOFT)):
                    best[b] = min(best.get(b, 9), ranked.index(v))
            want += [(s, b, k, "hard" if ranked[x] in architecture.HARD else "soft", ranked[x]) for b, x in best.items()]
            seen, front = seen | best.keys(), {*best}
    r = spark.createDataFrame(links, "src string, dst string, rel_type string")
    seeds = spark.createDataFrame([(x,) for x in [*nodes, "elsewhere", "n00"]], "s string")
    monkeypatch.setattr(compact, "LINKS", 10)
    assert rows(architecture.consequences(r, seeds, 3)) == sorted(want, key=repr)
    monkeypatch.undo()
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    for step in (1 << 22, 60):
        monkeypatch.setattr(compact, "STEP", step)
        assert rows(architecture.consequences(r, seeds, 3)) == sorted(want, key=repr)
    assert saved == ["rels", "rels"]

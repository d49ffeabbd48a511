import json

import pytest

from graphlens import __main__ as command
from graphlens.operators import architecture, delta, render, search, stacks, traverse
from graphlens.sources import workspace

RELS = "src string, dst string, rel_type string"


def test_gravity_chains_and_coverage(spark, rows):
    e = spark.createDataFrame([("D1", "decision"), ("D2", "decision"), ("I1", "invariant"), ("I2", "invariant"), ("I3", "invariant"), ("R1", "rule"), ("C1", "component"), ("A1", "adr")], "id string, entity_type string")
    r = spark.createDataFrame([("D1", "I1", "enforces"), ("R1", "I1", "enforces"), ("D1", "I2", "enforces"), ("D1", "C1", "governs"), ("A1", "D1", "declares"), ("X", "A1", "references"), ("D2", "gone", "governs")], RELS)
    got = {x.decision_id: x for x in architecture.decision_gravity(e, r).collect()}
    assert (got["D1"].dependents, got["D1"].enforces, got["D1"].governs, got["D1"].gravity) == (2, 2, 1, 12) and got["D2"].gravity == 2
    assert rows(architecture.gravity_summary(architecture.decision_gravity(e, r))) == [(2, 12, 7.0)] and rows(architecture.gravity_summary(architecture.decision_gravity(e.limit(0), r))) == [(0, 0, 0.0)]
    assert rows(architecture.chains(e, r).select("decision_id", "target")) == [("D1", "C1"), ("D1", "I1"), ("D1", "I2")]
    assert rows(architecture.invariant_coverage(e, r)) == [("I1", "enforced"), ("I2", "partially_enforced"), ("I3", "unenforced")] and rows(architecture.boundaries(e, r)) == [("A1", ["D1"])]
    d = spark.createDataFrame([("a", "adr", 1, 1, 0), ("b", "adr", 0, 0, 0), ("c", "adr", 0, 1, None), ("d", "rule", 1, 1, 1)], "id string, entity_type string, embodiments int, attributed int, enforcing int")
    assert rows(architecture.embodiment_density(d)) == [("adr", 3, 1, 1, 0.333333)]


def test_canonical_invariants(spark, rows):
    m = spark.createDataFrame([("I1", "own.yaml", True), ("I1", "adr.yaml", False), ("I2", "b.yaml", False), ("I2", "a.yaml", False)], "id string, source string, standalone boolean")
    assert rows(architecture.canonical_invariants(m)) == [("I1", "own.yaml", True, 2), ("I2", "a.yaml", False, 2)]
    with pytest.raises(ValueError, match="I1"):
        architecture.canonical_invariants(m.union(spark.createDataFrame([("I1", "other.yaml", True)], m.schema)))


def test_identity_and_validators(spark, rows):
    cols = "path string, id string, extractor string"
    a, b = spark.createDataFrame([("f", "1", "x-v1"), ("g", "1", "x-v1"), ("h", "1", "x-v1")], cols), spark.createDataFrame([("f", "2", "x-v1"), ("g", "2", "x-v2"), ("h", "1", "x-v2"), (None, "q", "x")], cols)
    found = delta.identity_findings(a, b)
    assert rows(found.select("severity", "path")) == [("ERROR", "f"), ("INFO", "g")] and delta.mixed_versions(a.union(b)).count() == 1
    out = delta.validated({"identity": lambda: found.selectExpr("severity", "path as description"), "broken": lambda: 1 / 0}, spark)
    assert rows(delta.report(out)) == [("broken", "ERROR", 1), ("identity", "ERROR", 1), ("identity", "INFO", 1)] and delta.validated({}, spark).count() == 0
    h = spark.createDataFrame([(k, 1) for k in range(12)], "run int, v int")
    assert sorted(r.run for r in delta.kept_history(h, "run").collect()) == list(range(2, 12))


def test_snapshot_traverse_and_candidates(spark, rows):
    n = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s"), ("z", "t")], "id string, snapshot string")
    r = spark.createDataFrame([("a", "b", "s", "s"), ("b", "c", "s", "s"), ("c", "a", "s", "s"), ("c", "z", "s", "t")], "src string, dst string, snapshot string, dst_snapshot string")
    assert rows(traverse.snapshot_traverse(n, r, "a", "s", 1)) == [("a", 0), ("b", 1)] and traverse.snapshot_traverse(n, r, "z", "s").count() == 0
    with pytest.raises(ValueError, match="another snapshot"):
        traverse.snapshot_traverse(n, r, "a", "s")
    rels = spark.createDataFrame([("a", "b", "uses"), ("a", "b", "calls"), ("b", "c", "uses"), ("c", "d", "uses"), ("a", "gone", "uses")], RELS)
    found, out = traverse.candidates(rels, spark.createDataFrame([("a",)], "seed string"), spark.createDataFrame([(x,) for x in "abcd"], "node string"), 2)
    assert rows(found.select("node", "depth", "via")) == [("b", 1, "calls"), ("c", 2, "uses")] and rows(out.select("node", "reason")) == [("d", "beyond"), ("gone", "unknown")]


def test_stack_tables_and_excerpts(spark, rows):
    s = spark.createDataFrame([("root", "A", "child"), ("root", "B", "child"), ("root", "C", None)], "parent_template string, logical_id string, child_template string")
    assert rows(stacks.parameter_table(s, spark.createDataFrame([("child", "P", "1")], "template string, parameter string, default string"))) == [("root#A", "P", "1"), ("root#B", "P", "1")]
    assert rows(stacks.outputs(s, spark.createDataFrame([("child", "O", "v", "unsupported")], "template string, output string, value string, kind string")).select("stack_id", "unresolved")) == [("root#A", True), ("root#B", True)]
    x = render.excerpts(spark.createDataFrame([("k", "f", 2, 3), ("whole", "f", None, None), ("no", "g", 1, 1)], "key string, path string, first int, last int"), spark.createDataFrame([("f", "a\nb\nc\nd")], "path string, body string"), 3)
    assert rows(x.select("key", "source", "truncated")) == [("k", "   2 | b\n   3 | c", False), ("whole", "   1 | a\n   2 | b\n   3 | c", True)]


def test_scored_tasks(spark):
    n = spark.createDataFrame([("k1", "api", "get-users", "src/users/api.py", "users", ["http:get"]), ("k2", "data", "orders", "src/orders.py", "orders", [])], "key string, domain string, id string, path string, name string, tags array<string>")
    top = search.scored_tasks(n, "list users in src/users", "GET", "api").collect()
    assert top[0].key == "k1" and top[0].rationale == "2 words; method GET; path; domain api" and top[0].score == round(2 / 4 + 0.4 + 0.2 + 0.2, 4)
    assert search.scored_tasks(n, "???").count() == 0


def test_manifest_and_jsdoc(spark, tmp_path):
    (tmp_path / "workspace.yaml").write_text("repos:\n- {name: a, lang: python}\n- {name: b, path: ./x}\nexternal_systems:\n- {key: pay, url_patterns: [pay.example]}\n")
    (tmp_path / "a" / "app").mkdir(parents=True)
    root = workspace.find_root(str(tmp_path / "a" / "app"))
    m = workspace.parse_manifest((root / "workspace.yaml").read_text())
    assert [r["path"] for r in m["repos"]] == ["./a", "./x"] and m["external_systems"][0]["name"] == "pay" and workspace.repos(spark, m).count() == 2 and workspace.external_systems(spark, m).count() == 1
    c = workspace.repo_config(str(root), m["repos"][0])
    assert c["source_dirs"] == ["app"] and c["endings"] == ["py"] and workspace.repo_config(str(root), m["repos"][1])["source_dirs"] == ["."]
    for bad in ("repos: []", "x: 1", "repos: [{name: a}, {name: a}]", "repos: [{path: x}]"):
        with pytest.raises(ValueError):
            workspace.parse_manifest(bad)
    d = workspace.jsdoc("/**\n * Does it.\n * Twice.\n * @param {string} a - the a\n * @param [b=1] more\n * @returns {number} n\n * @deprecated since 2\n */")
    assert d == {"description": "Does it. Twice.", "params": [("a", "string", "the a"), ("b", None, "more")], "returns": "n", "tags": [("deprecated", "since 2")]}


def test_command_line(spark, capsys):
    d = "/root/testdata/sf0.001"
    command.main(["stats", d])
    assert any(json.loads(x)["level"] == "total" for x in capsys.readouterr().out.splitlines())
    key = command.answer(spark, "search", d, "registry", limit=1).first().key
    assert command.answer(spark, "show", d, key).filter("ord = 0").first().key == key
    for verb in ("deps", "rdeps", "blast"):
        assert command.answer(spark, verb, d, key).count() >= 0
    with pytest.raises(SystemExit):
        command.answer(spark, "tag", d, None)

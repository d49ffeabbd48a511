import json

import pytest
from pyspark.sql import functions as F

from graphlens.operators import architecture, bundles, infer, populate, render
from graphlens.plans import ask
from graphlens.sources import files


@pytest.fixture(scope="module")
def records(spark):
    e = spark.createDataFrame([("ADR-1", "adr"), ("D1", "decision"), ("R1", "rule"), ("I1", "invariant"), ("I2", "invariant"), ("C1", "component")], "id string, entity_type string")
    d = spark.createDataFrame([("enforces", "D1", "I1"), ("enforces", "R1", "I1"), ("governs", "D1", "C1"), ("declared_in", "D1", "ADR-1"), ("enables", "D1", "CAP-9"), ("enforces", "D1", "I1")], "rel_type string, src string, dst string")
    return e, d


def test_relationships_and_gaps(records, rows):
    e, d = records
    rels = architecture.derive(e, d)
    got = rows(rels)
    assert ("enforces", "D1", "I1", "explicit") in got and ("enforced_by", "I1", "D1", "derived") in got and ("declares", "ADR-1", "D1", "derived") in got and len(got) == 8
    assert rows(architecture.gaps(e, d)) == [("enables", "D1", "CAP-9")]
    assert rows(architecture.governance(e, rels)) == [("D1", 1, 0, 1)]
    assert rows(architecture.coverage(e, rels)) == [("I1", 1, 1, True), ("I2", 0, 0, False)]
    assert rows(architecture.subgraph(e, rels, ["decision", "invariant"], ["enforces"])) == [("enforces", "D1", "I1")]
    assert architecture.registry_errors(e, rels, architecture.gaps(e, d)).count() == 0
    assert rows(architecture.registry_errors(e.filter("id <> 'C1'"), rels, architecture.gaps(e, d))) == [("E402", "C1")]


def test_first_step_takes_any_relationship(spark, rows):
    r = spark.createDataFrame([("declares", "a", "b"), ("declares", "b", "x"), ("references", "b", "c"), ("enforces", "b", "c"), ("enables", "c", "d"), ("governs", "c", "a")], "rel_type string, src string, dst string")
    got = architecture.consequences(r, spark.createDataFrame([("a",)], "s string"))
    assert rows(got) == [("a", "b", 1, "soft", "declares"), ("a", "c", 2, "hard", "enforces"), ("a", "d", 3, "soft", "enables")]
    assert architecture.reach(r, spark.createDataFrame([("d",)], "s string"), 1, "reverse").first().node == "c"


def test_population(spark, rows):
    prior = spark.createDataFrame([("a", "1", "f"), ("b", "1", "f"), ("c", "1", "g"), ("d", None, "f")], "key string, digest string, file string")
    new = spark.createDataFrame([("a", "2", "f"), ("d", None, "f"), ("e", "1", "f")], "key string, digest string, file string")
    assert rows(populate.statuses(prior, new, "key", "digest")) == [("a", "updated"), ("b", "deleted"), ("c", "deleted"), ("d", "unchanged"), ("e", "created")]
    state, st = populate.populate(prior, new, "key", "digest", spark.createDataFrame([("f",)], "file string"))
    assert rows(st) == [("a", "updated"), ("b", "deleted"), ("c", "unchanged"), ("d", "unchanged"), ("e", "created")] and [r[0] for r in rows(state)] == ["a", "c", "d", "e"]


def test_enrichments(spark, rows):
    p = spark.createDataFrame([("f", "function", "(a)", "(b)", None, None, ["x"], ["x"], ["n"], ["n"], "v1", "v1"), ("c", "class", None, None, ["m"], ["m", "k"], ["x"], ["y"], ["n"], ["n", "o"], "v1", "v2")], "id string, type string, old_signature string, new_signature string, old_methods array<string>, new_methods array<string>, old_files array<string>, new_files array<string>, old_keys array<string>, new_keys array<string>, old_extractor string, new_extractor string")
    assert rows(populate.enrichments(p)) == [("c", "new_properties", "extractor"), ("c", "ownership_change", "extractor"), ("c", "structure_change", "extractor"), ("f", "signature_change", "source")]


def test_import_resolution_and_calls(spark, rows):
    f = spark.createDataFrame([(1, "r", "src/a/x.ts"), (2, "r", "src/b/y.ts"), (3, "r", "app/core/m.py"), (4, "r", "app/core/n.py"), (5, "q", "src/b/y.ts")], "file_id long, repo string, path string")
    i = spark.createDataFrame([(1, "../b/./y.js"), (1, "react"), (3, ".n"), (4, "app.core.m"), (4, "os")], "file_id long, target string")
    assert rows(infer.import_edges(f, i)) == [("r", "module-app-core-m", "module-app-core-n"), ("r", "module-app-core-n", "module-app-core-m"), ("r", "module-src-a-x", "module-src-b-y")]
    facts = spark.createDataFrame([(1, "function", "f"), (1, "call", "f"), (2, "call", "m.f"), (2, "call", "g"), (3, "function", "g"), (4, "function", "g")], "file_id long, kind string, name string")
    assert rows(infer.call_edges(facts)) == [(1, "f", 1, "same_file"), (2, "f", 1, "unique_name")]
    assert infer.call_edges(facts, strict=False).count() == 4
    assert [r[1] for r in rows(infer.tags(f.filter("file_id = 3")))] == ["lang:python", "layer:util"]


def test_charts_and_excerpts(spark):
    e = spark.createDataFrame([("r", "a:b", "c", "reads"), ("r", "a:a", "c", "calls")], "repo string, src string, dst string, verb string")
    assert render.flow_chart(e, "repo", "src", "dst", F.col("verb")).first().chart == "graph LR\n  a_a -->|calls| c\n  a_b -->|reads| c"
    r = spark.createDataFrame([("a\r\nb\nc\nd", "n" * 50, 2, 9)], "body string, name string, x int, y int").select(render.excerpt(F.col("body"), F.col("x"), F.col("y"), 2).alias("e"), render.label(F.col("name")).alias("l")).first()
    assert r.e == "   2 | b\n   3 | c" and len(r.l) == 40 and r.l.endswith("...")


def test_bundles_account_for_everything(spark, rows):
    edges = spark.createDataFrame([("s", "a"), ("s", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    loc = spark.createDataFrame([("s", "u0"), ("a", "u1"), ("a", "u2"), ("c", "u3")], "node string, source_uri string")
    b = bundles.bundle(edges, spark.createDataFrame([("s",)], "s string"), loc, limit=3, sources=1)
    assert rows(b.select("node", "included", "reason")) == [("a", False, "source_limit"), ("b", False, "no_source"), ("c", False, "node_limit"), ("s", True, None)]
    assert bundles.check(b).first().status == "valid" and bundles.fingerprints(b).first().fingerprint == bundles.fingerprints(b.repartition(3)).first().fingerprint
    assert bundles.canonical({"b": [2, 1], "a": None}) == '{"b":[2,1]}' and bundles.canonical({"b": [2, 1]}, True) == '{"b":[1,2]}'
    assert bundles.time_ordered_id()[14] == "7" and bundles.time_ordered_id()[19] in "89ab"


@pytest.mark.parametrize(("question", "kind"), [("Tell me about x", "describe"), ("show all y", "list"), ("What does a depend on", "dependencies"), ("what depends on b?", "dependents"), ("where is c", "locate"), ("Impact of d", "impact"), ("How are a and b related", "relationship"), ("hm", "unknown"), ("how does q work", "explain")])
def test_intents(question, kind):
    assert ask.intent(question) == kind


def test_answers(spark):
    nodes = spark.createDataFrame([("k/cache", "k", "t", "cache", "r", "a/cache.py", "cache", []), ("k/store", "k", "t", "store", "r", "a/store.py", "store", []), ("k/base", "k", "t", "base", "r", "a/base.py", "base", [])], "key string, domain string, type string, id string, repo string, path string, name string, tags array<string>")
    edges = spark.createDataFrame([("k/cache", "k/base"), ("k/store", "k/base")], "src string, dst string")
    g = ask.Graph(nodes, edges)
    assert [r.node for r in g.ask("dependencies of cache")[1].collect()] == ["k/base"]
    assert sorted(r.node for r in g.ask("what uses base")[1].collect()) == ["k/cache", "k/store"]
    assert [r.node for r in g.ask("relationship between cache and store")[1].collect()] and g.ask("where is store")[1].first().path == "a/store.py"
    assert g.ask("where is  STORE")[1] is g.ask("where is store")[1]


def test_source_trees_and_stored_slices(spark, tmp_path, rows):
    (tmp_path / "a/node_modules").mkdir(parents=True)
    (tmp_path / "a/x.py").write_text("x = 1\n")
    (tmp_path / "a/node_modules/y.py").write_text("y")
    first = files.manifest(files.discover(spark, str(tmp_path), "*.py"))
    assert [r.path for r in first.collect()] == ["a/x.py"]
    old = spark.createDataFrame(first.collect(), first.schema)
    (tmp_path / "a/x.py").write_text("x = 22\n")
    (tmp_path / "a/z.py").write_text("z")
    (tmp_path / "a/empty.py").write_text("")
    assert rows(files.changed_files(old, files.manifest(files.discover(spark, str(tmp_path), "*.py")))) == [("a/x.py", "modified"), ("a/z.py", "added")]
    doc = {"_slice": {"domain": "d", "type": "t", "id": "i", "tags": ["x"], "references": [{"domain": "d", "type": "t", "id": "j"}]}}
    df = spark.createDataFrame([("b.json", json.dumps(doc | {"late": 1})), ("a.json", json.dumps(doc)), ("c.json", "{bad"), ("d.json", "[1]"), ("e.json", None)], "path string, body string")
    s = files.slices(df, "json").collect()
    assert [(r.key, r.path, r.tags, r.refs[0].id) for r in s] == [("d/t/i", "a.json", ["x"], "j")]


def test_stored_slices_in_yaml(spark):
    pytest.importorskip("yaml")
    df = spark.createDataFrame([("a.yaml", "_slice:\n  domain: d\n  type: t\n  id: i\n---\n_slice: {domain: d, type: t, id: k}\n"), ("b.yaml", "a: [")], "path string, body string")
    assert sorted(r.key for r in files.slices(df).collect()) == ["d/t/i", "d/t/k"]

import random

import pytest
from pyspark.sql import functions as F

from graphlens.functions import text
from graphlens.operators import emit, explore, relations

FACTS = "file_id long, kind string, name string, line int, detail string, owner string"
FILES = "file_id long, repo string, path string"


def test_calls_by_file_import_and_unique_name(spark, rows):
    facts = spark.createDataFrame(
        [(1, "function", "here", 1, None, None), (1, "call", "here", 2, None, "f"), (1, "import", "./b.js", 1, "there", None), (1, "import", "./c.js", 2, "there", None), (1, "call", "there", 3, None, None), (1, "call", "only", 4, None, None), (1, "call", "both", 4, None, None), (1, "call", "nowhere", 4, None, None),
         (2, "function", "there", 1, None, None), (3, "function", "there", 1, None, None), (3, "function", "only", 1, None, None), (2, "function", "both", 1, None, None), (3, "function", "both", 1, None, None), (4, "call", "only", 1, None, None)], FACTS)
    files = spark.createDataFrame([(1, "r", "src/a.ts"), (2, "r", "src/b.ts"), (3, "r", "src/c.ts"), (4, "r", "src/d.ts")], FILES)
    assert rows(relations.calls(facts, files)) == [(1, "__module__", "only", 3, "unique_name"), (1, "__module__", "there", 3, "import"), (1, "f", "here", 1, "same_file")]
    assert relations.calls(facts.limit(0), files).count() == 0


def test_elements_modules_and_handlers(spark, rows):
    facts = spark.createDataFrame([(1, "function", "run", 3, None, None), (1, "function", "run", 9, None, None), (1, "method", "go", 4, None, "A"), (1, "call", "x", 1, None, None), (1, "import", "./z", 1, None, None), (1, "import", "os", 1, None, None), (1, "export", "run", 1, None, None)], FACTS)
    files = spark.createDataFrame([(1, "r", "app/services/main.py"), (2, "r", "x.py")], FILES)
    assert rows(relations.elements(facts, files).select("key", "line")) == [("graph/function/function:app/services/main.py:A.go", 4), ("graph/function/function:app/services/main.py:run", 3)]
    assert rows(relations.modules(files, facts)) == [("module-app-services-main", "app/services/main.py", "service", ["./z"], ["os"], ["run"]), ("module-x", "x.py", "util", [], [], [])]
    t = spark.createDataFrame([(9, "handler", "Fn", "t", "services.main.run", None), (9, "handler", "No", "t", "services.main.gone", None)], "file_id long, kind string, name string, type string, target string, detail string")
    assert rows(relations.handler_code(t, facts, files)) == [(9, "Fn", 1, "run")]


def test_requests_styles_and_injection(spark, rows):
    facts = spark.createDataFrame([(1, "http", "/api/items/1", 1, "GET", "f"), (1, "http", "?", 1, "GET", "f")], FACTS)
    ends = spark.createDataFrame([("get", "/v1/items"), ("POST", "/items"), ("GET", "/itemsets")], "method string, path string")
    assert rows(relations.requests(facts, ends)) == [(1, "/api/items/1", "GET", "/v1/items")]
    styles = spark.createDataFrame([(1, "uses", "--a"), (2, "defines", "--a"), (1, "defines", "--a"), (3, "uses", "--b")], "file_id long, kind string, name string")
    assert rows(relations.style_tokens(styles)) == [(1, 2)]
    classes = spark.createDataFrame([("A",), ("B",), ("Router",)], "name string")
    uses = spark.createDataFrame([("A", "B"), ("A", "A"), ("A", "Router"), ("A", "Gone")], "name string, used string")
    assert rows(relations.injected(classes, uses)) == [("A", "B")]


@pytest.mark.parametrize("seed", [1, 2])
def test_contains_join_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab-") for _ in range(rng.randrange(n)))
    a, b = [(k, word(9)) for k in range(40)] + [(99, None)], [(k, word(9)) for k in range(40)] + [(98, None)]
    l, r = spark.createDataFrame(a, "i int, a string"), spark.createDataFrame(b, "j int, b string")
    want = sorted((i, j) for i, x in a for j, y in b if x is not None and y is not None and ((len(y) >= 3 and y in x) or (len(x) >= 3 and x in y)))
    assert sorted((x.i, x.j) for x in emit.contains_join(l, "a", r, "b").collect()) == want


def test_emitted_edges(spark, rows):
    frame = spark.createDataFrame
    res = frame([("r", "Fn", "AWS::Lambda::Function"), ("r", "Fn2", "AWS::Lambda::Function"), ("r", "T", "AWS::DynamoDB::Table"), ("r", "Orders", "AWS::SQS::Queue"), ("r", "Sm", "AWS::StepFunctions::StateMachine"), ("s", "G", "AWS::Lambda::Function")], "repo string, logical_id string, type string")
    env = frame([("r", "Fn", "OTHER", "Fn2"), ("r", "Fn", "SELF", "Fn"), ("r", "Fn", "STRIPE_URL", "x"), ("s", "G", "HOST", "https://pay.example/v1")], "repo string, function string, variable string, target string")
    known, edges = emit.emit(
        res, frame([("r", "Sm", "Fn"), ("r", "Sm", "Gone")], "repo string, machine string, function string"), env, frame([("r", "Map", "Fn", "Orders", "AWS::SQS::Queue"), ("s", "M2", "G", "orders", "AWS::SQS::Queue")], "repo string, trigger string, function string, source string, source_type string"),
        frame([("r", "src/fn/db/x.py", "DynamoDB"), ("s", "src/x.py", "sqs")], "repo string, path string, service string"), frame([("r", "Fn", "src/fn/")], "repo string, function string, root string"),
        frame([("stripe", ["pay.example"]), ("zzz", [])], "key string, url_patterns array<string>"))
    assert known.count() == 6
    fn = "Function:r:fn"
    assert rows(edges.select("src", "dst", "verb", "confidence")) == sorted([
        (fn, "Function:r:fn2", "invokes", "high"), (fn, "Queue:r:orders", "consumes", "high"), (fn, "Table:r:t", "writes", "medium"), ("StateMachine:r:sm", fn, "deploys_to", "high"), ("Queue:r:orders", "Service:s", "publishes_to", "medium"),
        (fn, "ExternalSystem:stripe", "invokes", "high"), ("Function:s:g", "ExternalSystem:stripe", "invokes", "high")], key=repr)
    assert rows(emit.unresolved(known, frame([("r", "Gone"), ("r", "Fn")], "repo string, function string"), "function")) == [("r", "Gone")]
    calls = frame([("a", "b", "calls", "high"), ("a", "c", "calls", "medium")], "src string, dst string, verb string, confidence string")
    assert rows(emit.backlinks(calls)) == [("a", "references", "b"), ("b", "referenced_by", "a")]


def test_text_functions(spark):
    r = spark.createDataFrame([("  Hello, World-- ", "abcdefghijkl")], "a string, b string").select(text.slug(F.col("a")).alias("s"), text.djb2(F.lit("abc")).alias("h"), text.djb2(F.lit("")).alias("e"), text.shortened(F.col("b"), 10).alias("l"), text.token_estimate(F.col("b")).alias("t")).first()
    assert tuple(r) == ("hello-world", "0b885c8b", "00001505", "abcdefg...", 3)
    import re

    for glob, path, ok in (("src/**/*.ts", "src/a/b.ts", True), ("src/**/*.ts", "src/b.ts", True), ("*.ts", "a/b.ts", False), ("{a,b}.json", "b.json", True), ("x?.py", "x/.py", False)):
        assert bool(re.match(text.glob_pattern(glob), path)) is ok
    assert text.canonical({"b": [2, 1], "a": None}) == '{"b":[2,1]}' and text.canonical({"b": [2, 1]}, True) == '{"b":[1,2]}'


def test_locators_lookup_and_preflight(spark, rows):
    l = spark.createDataFrame([("e:1", "ADR-1", "r", "a.py", "u", "h", 1), ("e:2", "x", "r", "b.py", "u", "h", 1)], "entity_uri string, entity_id string, repo string, file_path string, source_uri string, graph_snapshot_hash string, uri int")
    wanted = spark.createDataFrame([("q1", "entity", "e:1"), ("q2", "workspace", "r/b.py"), ("q3", "adr", "ADR-1"), ("q4", "graph", "x@h"), ("q5", "entity", "gone")], "uri string, kind string, name string")
    assert rows(explore.locator_of(l, wanted).select("uri", "file_path")) == [("q1", "a.py"), ("q2", "b.py"), ("q3", "a.py"), ("q4", "b.py")]
    nodes = spark.createDataFrame([("abc",), ("ab",), ("xab",)], "id string")
    assert explore.entry_lookup(nodes, "ab").first().id == "ab" and explore.entry_lookup(nodes, "bc").first().id == "abc" and explore.entry_lookup(nodes, "q").count() == 0
    files = spark.createDataFrame([("k", "f1"), ("k", "f2"), ("m", "f3")], "key string, file string")
    ball = spark.createDataFrame([("k", "k"), ("m", "m")], "seed string, node string")
    stale = spark.createDataFrame([("f2",)], "path string")
    state, refreshed = explore.preflight(files, ball, stale, lambda: stale.limit(0))
    assert refreshed and {r.status for r in state.collect()} == {"fresh"}
    assert {(r.target, r.status) for r in explore.preflight(files, ball, stale)[0].collect()} == {("f1", "partial"), ("f2", "partial"), ("f3", "fresh")}

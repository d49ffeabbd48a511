from datetime import datetime, timedelta

import pytest

from graphlens.operators import delta
from graphlens.sources import extract
from graphlens.streaming import changes

T0 = datetime(2026, 1, 1)
S = lambda s: T0 + timedelta(seconds=s)


def test_manifest_diff(spark, rows):
    a = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", None), ("s", "1")], "path string, h string")
    b = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", None), ("t", "1")], "path string, h string")
    assert rows(delta.manifest_diff(a, b, "path", "h")) == [("p", "unchanged"), ("q", "modified"), ("r", "unchanged"), ("s", "deleted"), ("t", "added")]


def test_freshness(spark, rows):
    f = spark.createDataFrame([("r", "a\\b.py", "old", S(1)), ("r", "a/b.py", "new", S(2)), ("r", "c", None, S(1))], "repo string, file_path string, source_hash string, scanned_at timestamp")
    loc = spark.createDataFrame([("u1", "r", "a/b.py", "new"), ("u2", "r", "a/b.py", "old"), ("u3", "r", "c", "x"), ("u4", "r", "zz", "x")], "entity_uri string, repo string, file_path string, source_hash string")
    assert rows(delta.locator_freshness(loc, f)) == [("u1", "fresh"), ("u2", "hash_mismatch"), ("u3", "unhashed"), ("u4", "missing_source")]


def events(spark):
    return spark.createDataFrame([("a", "add", S(0)), ("a", "change", S(1)), ("a", "unlink", S(10)), ("b", "add", S(1))], "path string, event string, ts timestamp")


def test_debounce_and_transactions_of_a_table(spark, rows):
    got = changes.debounced(events(spark), "path", "event", "ts", "3 seconds")
    assert rows(got.select("path", "n_events", "last_event")) == [("a", 1, "unlink"), ("a", 2, "change"), ("b", 1, "add")]
    assert rows(changes.transactions(events(spark), "path", "ts", "3 seconds").select("n_events", "keys")) == [(3, ["a", "b"])]
    assert rows(changes.bursts(events(spark), "path", "ts", 2, 2).select("path", "in_burst")) == [("a", False), ("a", False), ("a", True), ("b", False)]


@pytest.mark.parametrize("bucket", [1, 7, 3600])
def test_runs_do_not_depend_on_buckets(spark, rows, bucket):
    e = spark.createDataFrame([(S(k),) for k in (0, 1, 3, 10, 12, 14, 16, 18, 30, 34, 35)], "ts timestamp")
    assert rows(changes.runs(e, "ts", 3, bucket).groupBy("run").count()) == [(S(0), 3), (S(10), 5), (S(30), 1), (S(34), 2)]
    assert rows(changes.transactions_of_table(events(spark), "path", "ts", 3).select("n_events", "keys")) == [(3, ["a", "b"])]


def test_debounce_of_a_stream(spark, tmp_path, rows):
    events(spark).unionByName(spark.createDataFrame([("z", "add", S(1000))], "path string, event string, ts timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, event string, ts timestamp").parquet(str(tmp_path / "in"))
    q = changes.debounced(stream, "path", "event", "ts", "3 seconds", watermark="5 seconds").writeStream.outputMode("append").format("memory").queryName("debounced_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("debounced_out").select("path", "n_events", "last_event")) == [("a", 1, "unlink"), ("a", 2, "change"), ("b", 1, "add")]


def test_refresh_hands_over_the_last_change_of_each_path(spark, tmp_path):
    spark.createDataFrame([("a", "add", "1", S(0)), ("a", "change", "2", S(5)), ("b", "add", "1", S(1))], "path string, event string, hash string, changed_at timestamp").write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("path string, event string, hash string, changed_at timestamp").parquet(str(tmp_path / "in"))
    q = changes.refresh(stream, lambda df, n: got.extend((r.path, r.event) for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [("a", "change"), ("b", "add")]


FILES = [
    (1, "a\\b.py", "import os\nfrom .x import y\n\n@app.get('/p')\ndef f(a):\n    return os.getenv('KEY') + os.environ['K2']\n\nclass M(Base):\n    v: int\n"),
    (2, "a.css", ".btn:hover { --gap: 1px; color: var(--ink); }\r\n"),
    (3, "t.yaml", "AWSTemplateFormatVersion: '1'\nResources:\n  Bucket:\n    Type: AWS::S3::Bucket\n"),
    (4, "d.yml", "id: ADR-1\nadr_type: logical\nstatus: accepted\ndecisions:\n  - id: DEC-1\n    summary: 's'\n    enables: [CAP-1, CAP-2]\n"),
    (5, "broken.py", "def f(:"),
    (6, None, None),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "file_id long, file_path string, body string")


def test_extraction(files, rows):
    assert rows(extract.classify(files)) == [(1, "python"), (2, "css"), (3, "cloudformation"), (4, "adr-yaml"), (5, "python"), (6, "unknown")] or [r[1] for r in rows(extract.classify(files))][:5] == ["python", "css", "cloudformation", "adr-yaml", "python"]
    assert rows(extract.imports(files)) == [(1, ".x", True), (1, "os", False)]
    assert rows(extract.styles(files)) == [(2, "class", "btn"), (2, "defines", "--gap"), (2, "uses", "--ink")]
    assert rows(extract.resources(files)) == [(3, "Bucket", "AWS::S3::Bucket")]
    assert rows(extract.decision_records(files)) == [(4, "ADR-1", "logical", "accepted")]
    assert rows(extract.decision_edges(files)) == [("ADR-1", "introduces", "DEC-1"), ("DEC-1", "enables", "CAP-1"), ("DEC-1", "enables", "CAP-2")]


def test_python_facts(files):
    got = {(r.kind, r.name, r.line, r.detail) for r in extract.python_facts(files).collect()}
    assert {("import", "os", 1, None), ("import", ".x", 2, "y"), ("endpoint", "/p", 5, "GET"), ("function", "f", 5, "a"), ("env", "KEY", 6, None), ("env", "K2", 6, None), ("class", "M", 8, "Base"), ("model", "M", 8, "v")} <= got


def test_batch_shapes_and_updates(spark, rows):
    b = spark.createDataFrame([(1, "a/x.py"), (1, "a/y.py"), (2, "a/x.py"), (2, "tests/test_x.py"), (2, "b/x.test.ts"), (3, "a/x.py"), (3, "b/z.py")], "batch int, path string")
    assert rows(changes.batch_shapes(b, "batch", "path").select("batch", "shape")) == [(1, "folder"), (2, "base_name"), (3, "none")]
    t = lambda s: datetime(2026, 1, 1, 0, 0, s)
    u = spark.createDataFrame([("r", t(10), t(20)), ("s", t(10), None)], "root string, started_at timestamp, finished_at timestamp")
    c = spark.createDataFrame([("p", "r", t(9)), ("p", "r", t(21)), ("p", "r", t(22)), ("p", "s", t(50)), ("p", "q", t(50))], "path string, root string, changed_at timestamp")
    assert [r.in_update for r in changes.in_update(c, u).orderBy("root", "changed_at").collect()] == [False, False, True, False, True]


def test_busy_times_across_buckets(spark):
    import random

    rng = random.Random(4)
    base = datetime(2026, 1, 1)
    data = [(k, rng.choice("abcde"), base + timedelta(seconds=rng.randrange(300))) for k in range(200)]
    df = spark.createDataFrame(data, "n int, key string, at timestamp")
    want = {n for n, key, at in data if len({k for _, k, x in data if 0 <= (at - x).total_seconds() <= 3}) >= 3 or sum(k == key and 0 <= (at - x).total_seconds() <= 3 for _, k, x in data) >= 2}
    got = changes.busy(df, "key", "at", 3, 3, 2).collect()
    assert {r.n for r in got if r.busy} == want and len(got) == 200


def test_busy_times_take_no_look_back_for_each_event(spark):
    import random

    rng = random.Random(9)
    base = datetime(2026, 1, 1)
    data = [(k, rng.choice([*"abcdefgh", None]), base + timedelta(seconds=rng.randrange(400)) + timedelta(days=rng.choice((0, 0, 3)))) for k in range(260)]
    df = spark.createDataFrame(data, "n int, key string, at timestamp")

    def want(keys, same):
        near = {n: [k for _, k, x in data if 0 <= (at - x).total_seconds() <= 4] for n, _, at in data}
        return {n for n, key, _ in data if len({*near[n]} - {None}) >= keys or near[n].count(key) >= same}

    for keys, same in ((3, 9), (4, 3), (9, 2), (2, 1), (99, 99)):
        out = changes.busy(df, "key", "at", 4, keys, same)
        got = out.collect()
        assert len(got) == 260 and {r.n for r in got if r.busy} == want(keys, same)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "RangeFrame, -" not in plan

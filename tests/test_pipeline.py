import uuid

import pytest

from graphlens.operators import pipeline, relations
from graphlens.session import shared_dir
from graphlens.sources import documents

ADR = """id: ADR-L-1
adr_type: logical
status: accepted
related_adrs: [ADR-PS-2, ADR-L-404]
decisions:
  - id: DEC-1
    enables: [CAP-1]
    enforces: [INV-1]
capabilities: [{id: CAP-1}]
invariants: [{id: INV-1}]
"""
PHYSICAL = "id: ADR-PS-2\nadr_type: physical-system\nstatus: accepted\ncapabilities: [{id: CAP-1}]\n"


def facts(spark, *texts):
    files = spark.createDataFrame([(k, f"{k}.yaml", t) for k, t in enumerate(texts)], "file_id long, file_path string, body string")
    return documents.document_facts(files, "decision_record")


def test_build_publish_and_evidence(spark, rows):
    f = facts(spark, ADR, PHYSICAL, "id: x\n", "a: [")
    parts = pipeline.build(f, spark.createDataFrame([("INV-1", "inv/INV-1.yaml")], "id string, source string"))
    assert rows(parts["entities"].select("id", "entity_type")) == [("ADR-L-1", "adr"), ("ADR-PS-2", "adr"), ("CAP-1", "capability"), ("DEC-1", "decision"), ("INV-1", "invariant"), ("SYS-2", "system")]
    assert parts["entities"].filter("id = 'INV-1'").first().source_ref == "inv/INV-1.yaml" and parts["entities"].filter("id = 'CAP-1'").first().further_refs == ["ADR-PS-2#CAP-1"]
    got = {(r.rel_type, r.src, r.dst): r.origin for r in parts["relationships"].collect()}
    assert got["enables", "DEC-1", "CAP-1"] == "explicit" and got["enabled_by", "CAP-1", "DEC-1"] == "derived" and got["referenced_by", "ADR-PS-2", "ADR-L-1"] == "derived"
    assert rows(parts["gaps"]) == [("references", "ADR-L-1", "ADR-L-404")]
    assert rows(pipeline.record_view(parts["entities"], parts["relationships"]).filter("adr_id = 'ADR-L-1'")) == [("ADR-L-1", ["CAP-1", "DEC-1"], ["ADR-PS-2"])]
    root = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    assert pipeline.open_bundle(spark, root)[0] == {"status": "missing"}
    assert pipeline.compile_bundle(spark, root, f, "b1", dry=True) == ("degraded", []) and pipeline.open_bundle(spark, root)[0]["status"] == "missing"
    assert pipeline.compile_bundle(spark, root, f, "b1") == ("degraded", [])
    note, read = pipeline.open_bundle(spark, root)
    assert note["entities"]["adr"] == 2 and rows(pipeline.subjects(read["manifest"], note["status"])) == [("adr_l", "ADR-L-1", "validates"), ("adr_ps", "ADR-PS-2", "validates")]
    assert pipeline.evidence(note, read, spark.createDataFrame([("f",)], "path string")) == {"version": "2", "bundle": "degraded", "freshness": "stale", "subjects": {"adr_l": 1, "adr_ps": 1}}


def test_double_declarations_are_errors(spark):
    status, errors = pipeline.compile_bundle(spark, "unused", facts(spark, ADR, ADR.replace("ADR-L-1", "ADR-L-3")), "b")
    assert status == "invalid" and "DEC-1" in errors[0]
    with pytest.raises(ValueError):
        pipeline.build(facts(spark, ADR, ADR.replace("ADR-L-1", "ADR-L-3")))


def test_sentinels_projections_indexes_and_throughput(spark, rows):
    h = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "repo string, hash string")
    assert rows(pipeline.unchanged(h, spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None)], "repo string, hash string"))) == [("a",)]
    chart = spark.createDataFrame([("graph LR",)], "chart string")
    out = pipeline.projections({"integration-L2": chart, "dependencies-L0": chart, "governance-L1": chart.limit(0)})
    assert sorted(r.file_name for r in out.collect()) == ["architecture-overview-L2.md", "dependency-projection-L0.md", "integration-topology-L2.md", "runtime-projection-L2.md"] and pipeline.projections({}) is None
    s = spark.createDataFrame([("d", f"k{k:02d}") for k in range(30)] + [("e", "z"), ("e", "z")], "domain string, key string")
    got = pipeline.indexes(s).collect()
    assert sorted((r.domain, r.position, r.key) for r in got) == [("d", k + 1, f"k{k:02d}") for k in range(30)] + [("e", 1, "z")]
    assert rows(pipeline.throughput(spark.createDataFrame([(1, "p", 2.0, 10), (2, "p", 3.0, 15), (1, "q", 0.0, 5)], "run int, phase string, seconds double, n_rows long"))) == [("p", 2, 2.5, 5.0), ("q", 1, 0.0, None)]


def test_further_edges(spark, rows):
    kn = "key string, name string"
    assert rows(relations.by_equal_name(spark.createDataFrame([("a", "n"), ("b", None)], kn), spark.createDataFrame([("c", "n"), ("a", "n")], kn), "uses")) == [("a", "c", "uses")]
    assert rows(relations.controls(spark.createDataFrame([("r", ["aws:s3", "x"])], "key string, tags array<string>"), spark.createDataFrame([("c", "S3"), ("c2", "sqs")], "key string, service string"))) == [("c", "r")]
    kp = "key string, path string"
    assert rows(relations.configured(spark.createDataFrame([("c", "infra/parameters/dev.json"), ("o", "other/x.json")], kp), spark.createDataFrame([("t", "infra/stack/a.yaml"), ("u", "infrastructure/b.yaml")], kp))) == [("c", "t")]
    assert rows(relations.named_files(spark.createDataFrame([("k", "./x.html"), ("k", None)], "key string, url string"), spark.createDataFrame([(1, "a/x.html"), (2, "a/xx.html")], "file_id long, path string"))) == [("k", 1)]
    f = spark.createDataFrame([(1, "env", "HOST", 1, None, None), (1, "sdk", "S3", 1, None, None), (1, "call", "x", 1, None, None)], "file_id long, kind string, name string, line int, detail string, owner string")
    assert rows(relations.behaviors(f, spark.createDataFrame([(1, "a/b.py")], "file_id long, path string"))) == [(1, "module-a-b", "aws:s3"), (1, "module-a-b", "env:HOST")]

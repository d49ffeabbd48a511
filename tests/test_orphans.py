from datetime import datetime

from pyspark.sql import functions as F

from graphlens.operators import orphans
from graphlens.session import Scratch

D = lambda d: datetime(2026, 1, d)
REFS = "target_id string, recorded_at timestamp_ntz, owner string, begins string, reason int"
PARENTS = "target_id string, begins timestamp_ntz, ends timestamp_ntz"


def found(spark, refs, parents, **kw):
    r = spark.createDataFrame([(t, at, o, "x", 1) for t, at, o in refs], REFS)
    p = spark.createDataFrame(parents, PARENTS)
    return sorted((x.owner, x.target_id, x.reason) for x in orphans.orphan_references(r, p, Scratch(spark, "t"), **kw).collect())


def test_reasons_and_bounds(spark):
    parents = [("k", D(5), D(10)), ("k", D(20), None), ("k", D(20), None), ("late", D(9), None), ("gone", D(1), D(2)), ("ever", None, None)]
    refs = [("k", D(5), "at-begin"), ("k", D(9), "inside"), ("k", D(10), "at-end"), ("k", D(4), "before"), ("k", D(25), "again"), ("late", D(8), "early"), ("gone", D(2), "after"), ("ever", D(1), "ok"), ("none", D(1), "m"), (None, D(1), "null"), ("none", None, "m-null"), ("k", None, "k-null")]
    assert found(spark, refs, parents) == [("after", "gone", "deleted"), ("at-end", "k", "deleted"), ("before", "k", "late"), ("early", "late", "late"), ("m", "none", "missing"), ("m-null", "none", "missing")]


def test_hot_targets_give_the_same(spark):
    refs = [("hot", D(1 + k % 28), f"o{k}") for k in range(300)] + [("cold", D(3), "c")]
    parents = [("hot", D(10), D(20))]
    assert found(spark, refs, parents, floor=5) == found(spark, refs, parents, floor=10**9)


def test_empty_tables(spark):
    assert found(spark, [], [("a", None, None)]) == []
    assert found(spark, [("a", D(1), "o")], []) == [("o", "a", "missing")]


def test_report_counts_by_table_and_month(spark, rows):
    df = spark.createDataFrame([("forward_refs", "t", D(1), "late"), ("backward_refs", "t", D(2), "late"), ("merged_edges", "u", D(3), "missing")], "ref_field string, target_id string, recorded_at timestamp_ntz, reason string")
    assert rows(orphans.orphan_report(df)) == [("merged_edges", "2026-01", "missing", 1, 1), ("slices", "2026-01", "late", 2, 1)]


def test_graph_references_without_ids_are_none(spark):
    ref = "array<struct<slice_domain string, slice_type string, slice_id string>>"
    s = spark.createDataFrame([("a", "d", "t", [("d", "t", None), ("d", "t", " x\\y "), ("d", "t", " x\\y ")], None, D(1))], f"slice_id string, slice_domain string, slice_type string, forward_refs {ref}, backward_refs {ref}, recorded_at timestamp_ntz")
    e = spark.createDataFrame([(1, None, D(1)), (2, "k", D(1))], "edge_id long, to_id string, recorded_at timestamp_ntz")
    a, b = orphans.graph_references(s, e)
    assert [r.target_id for r in a.collect()] == ["d/t/x/y"] and [r.target_id for r in b.select(F.col("target_id")).collect()] == ["k"]

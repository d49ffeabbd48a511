import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphlens.functions.ids import canonical_json, marked, norm_id, row_hash, set_hash
from graphlens.operators import snapshots
from graphlens.session import forget, shared_dir

SCHEMA = "repo string, slice_id string, snapshot_no int, delivered_at timestamp, value string, row_hash string"
T = [datetime(2026, 1, d) for d in range(1, 9)]


def changes(spark, data, listed):
    rows = spark.createDataFrame(data, SCHEMA)
    index = spark.createDataFrame(listed, "repo string, snapshot_no int")
    return snapshots.snapshot_changes(spark, rows, index, "repo", ["slice_id"], "snapshot_no", "delivered_at", row_hash(F.col("value")))


def test_added_removed_changed_and_same(spark, rows):
    data = [("r", "a", 1, T[0], "x", "clash"), ("r", "b", 1, T[0], "x", None), ("r", "c", 1, T[0], "x", ""), ("r", "a", 2, T[1], "x", None), ("r", "b", 2, T[1], "y", None), ("r", "d", 2, T[1], None, None)]
    assert rows(changes(spark, data, [("r", 1), ("r", 2)])) == [("r", "b", 2, "changed"), ("r", "c", 2, "removed"), ("r", "d", 2, "added")]


def test_skipped_snapshots_compare_with_the_last_good_one(spark, rows):
    data = [("r", "a", 1, T[0], "x", None), ("r", "a", 2, T[1], "broken", None), ("r", "a", 3, T[2], "y", None), ("s", "q", 2, T[1], "x", None), ("s", "q", 3, T[2], "x", None)]
    assert rows(changes(spark, data, [("r", 1), ("r", 3), ("s", 2), ("s", 3)])) == [("r", "a", 3, "changed")]


def test_latest_delivery_counts_and_null_is_a_value(spark, rows):
    data = [("r", "a", 1, T[0], None, None), ("r", "a", 2, T[5], "", None), ("r", "a", 2, T[1], None, None), ("r", "b", 1, T[0], "x", None), ("r", "b", 1, T[0], "x", None), ("r", "b", 2, None, "y", None), ("r", "b", 2, T[1], "x", None)]
    assert rows(changes(spark, data, [("r", 1), ("r", 2), ("r", 2)])) == [("r", "a", 2, "changed")]


def test_listed_snapshot_without_rows_removes_all(spark, rows):
    assert rows(changes(spark, [("r", "a", 1, T[0], "x", None)], [("r", 1), ("r", 2)])) == [("r", "a", 2, "removed")]


@pytest.mark.parametrize(("data", "listed"), [([], []), ([], [("r", 1), ("r", 2)]), ([("r", "a", 1, T[0], "x", None)], []), ([("r", None, 1, T[0], "x", None), (None, "a", 2, T[0], "x", None)], [("r", 1), ("r", 2)])])
def test_empty_tables_and_null_keys_give_nothing(spark, data, listed):
    assert changes(spark, data, listed).count() == 0


def test_stored_index_takes_one_snapshot_a_call(spark, rows, monkeypatch):
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    frame = lambda data: spark.createDataFrame(data, "repo string, slice_id string, row_hash long, change_kind string")
    of = lambda *groups: spark.createDataFrame([(g,) for g in groups], "repo string")
    call = lambda data, n, *groups: snapshots.SnapshotStore(spark, root, "repo", ["slice_id"]).process(frame(data), n, of(*groups))
    assert call([("r", "a", 1, None), ("r", "b", 1, None), ("x", "q", 1, None)], 1, "r").count() == 0
    with monkeypatch.context() as m:
        m.setattr(snapshots, "rename", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            call([("r", "a", 2, None)], 2, "r")
    assert rows(call([("r", "a", 2, None), ("s", "z", 1, None)], 2, "r", "s")) == [("r", "a", "changed"), ("r", "b", "removed")]
    assert rows(call([], 2, "r")) == [("r", "a", "changed"), ("r", "b", "removed")]  # published: not compared again
    assert rows(call([("s", "z", 1, None), ("s", "y", 1, None)], 3, "s")) == [("s", "y", "added")]
    assert rows(call([("r", "a", 2, None), ("r", "b", 5, None)], 4, "r")) == [("r", "b", "added")]
    forget(spark)


def test_more_groups_than_are_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(snapshots, "BROADCAST_GROUPS", 0)
    data = [("r", "a", 1, T[0], "x", None), ("r", "a", 2, T[1], "y", None), ("s", "b", 2, T[1], "x", None), ("r", "a", 3, T[2], "y", None), ("s", "c", 3, T[2], "x", None)]
    assert rows(changes(spark, data, [("r", 1), ("r", 2), ("s", 2), ("s", 3), ("r", 3)])) == [("r", "a", 2, "changed"), ("s", "b", 3, "removed"), ("s", "c", 3, "added")]


def test_old_values_only_for_changes(spark, rows):
    prior = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "c", 3)], "repo string, slice_id string, v int")
    found = spark.createDataFrame([("r", "a", "changed"), ("r", "z", "added")], "repo string, slice_id string, change_kind string")
    assert rows(snapshots.with_old_values(found, prior, ["repo", "slice_id"], ["v"]).select("slice_id", "old_v")) == [("a", 1)]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [('{"x":1,"y":[1,2]}', ' { "y" : [1, 2],\n"x":1 }', True), ('{"x":1}', '{"x":1.0}', True), ('{"x":"\\u0041"}', '{"x":"A"}', True), ('{"x":[1,2]}', '{"x":[2,1]}', False), ("{}", None, False), ("null", None, False), ("{bad", "{bad", True), ("{bad", '"{bad"', False), ('{"x":null}', "{}", False)],
)
def test_json_compares_by_value(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(marked(canonical_json(F.col("a"))).alias("a"), marked(canonical_json(F.col("b"))).alias("b"))
    r = df.first()
    assert (r.a == r.b) is same


def test_sets_and_ids(spark):
    df = spark.createDataFrame([(["b", "a\\x ", "b"], ["a/x", "b"], None, [], ["a", "bc"], ["ab", "c"], [None], [])], "a array<string>, b array<string>, c array<string>, d array<string>, e array<string>, f array<string>, g array<string>, h array<string>")
    r = df.select(*[set_hash(F.col(c), norm_id).alias(c) for c in df.columns]).first()
    assert r.a == r.b and r.c == r.d and r.e != r.f and r.g != r.h

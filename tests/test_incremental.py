import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphlens.operators import incremental
from graphlens.session import listing, shared_dir

T0 = datetime(2026, 1, 1)
H = lambda h: T0 + timedelta(hours=h)
LOG = "slice string, instant timestamp, content string, sum string, arrived timestamp, key int, version string"
RUNS = "run_id int, started_at timestamp"


def log_of(spark, data):
    df = spark.createDataFrame([(*r, 1, "clash") for r in data], LOG)
    return incremental.versions(df, F.col("slice"), F.col("instant"), F.xxhash64("content", F.coalesce("sum", F.lit("-"))), F.col("sum").isNull(), F.col("arrived"))


def replayed(spark, data, runs, **kw):
    return sorted((r.run_id, r.key) for r in incremental.replay(log_of(spark, data), "arrived", spark.createDataFrame(runs, RUNS), **kw).collect())


def brute(data, runs):
    out, before = [], {}
    for run, at in sorted(runs, key=lambda r: (r[1], r[0])):
        now = {}
        for key, instant, content, check, arrived in data:
            if key is not None and arrived is not None and arrived <= at and (key not in now or (instant or datetime.min) > (now[key][0] or datetime.min)):
                now[key] = (instant, content, check)
        for key, v in now.items():
            old = before.get(key)
            if old is None or (old[0] != v[0] and (old[2] is None or v[2] is None or old[1:] != v[1:])):
                out.append((run, key))
        before = now
    return sorted(out)


CASES = [
    ("a", H(1), "x", "1", H(1)), ("a", H(1), "x", "1", H(30)), ("a", H(2), "x", "1", H(12)), ("a", H(3), "y", "1", H(22)),
    ("b", H(5), "x", None, H(1)), ("b", H(6), "x", None, H(11)), ("c", H(9), "x", "1", H(1)), ("c", H(4), "y", "2", H(11)), (None, H(1), "x", "1", H(1)), ("d", None, "x", "1", H(1)), ("d", H(1), "x", "1", H(11)), ("e", H(1), "x", "1", None), ("f", H(1), "x", "1", H(99)),
]
RUN_ROWS = [(1, H(10)), (2, H(20)), (3, H(30))]


def test_replay_matches_brute_force(spark):
    assert replayed(spark, CASES, RUN_ROWS) == brute(CASES, RUN_ROWS) == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "b"), (3, "a")]


@pytest.mark.parametrize("seed", [3, 4])
def test_random_logs_with_a_hot_key(spark, seed):
    rng = random.Random(seed)
    data, used = [], {}
    for _ in range(400):
        key, hour = rng.choice(["hot"] * 3 + [f"k{rng.randrange(40)}"] * 6), rng.randrange(200)
        content = used.setdefault((key, hour), (rng.choice("xyz"), rng.choice(["1", "2", None])))
        data.append((key, H(hour), *content, H(rng.randrange(200))))
    runs = [(k, H(20 * k)) for k in range(1, 9)]
    assert replayed(spark, data, runs, bits=8) == brute(data, runs)


def test_empty_inputs(spark):
    assert replayed(spark, [], RUN_ROWS) == [] and replayed(spark, CASES, []) == []


def test_store_runs_once_and_survives_an_aborted_run(spark, monkeypatch):
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store = incremental.MerkleStore(spark, root, bits=8)
    got = []
    for run, at in RUN_ROWS:
        seen = log_of(spark, CASES).filter(F.col("arrived") <= F.lit(at)).select("key", "version")
        if run == 2:
            with monkeypatch.context() as m:
                m.setattr(incremental, "rename", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
                with pytest.raises(RuntimeError):
                    store.process(seen, run)
            assert not [x for x in listing(spark, root) if x.endswith("2") and x.startswith("run-")]
        got += [(run, r.key) for r in store.process(seen, run).collect()]
        again = sorted(r.key for r in store.process(seen, run).collect())
        assert again == sorted(k for n, k in got if n == run)
    assert sorted(got) == brute(CASES, RUN_ROWS)


def test_store_reads_and_writes_only_leaves_that_differ(spark, monkeypatch):
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store = incremental.MerkleStore(spark, root, bits=8, split_keys=1)
    data = [(f"k{k}", H(1), "x", "1", H(1)) for k in range(2000)]
    assert store.process(log_of(spark, data).select("key", "version"), 1).count() == 2000
    read = []
    state = incremental.MerkleStore.state

    def noted(self, *a):
        df = state(self, *a)
        read.append((df.inputFiles(), df.count()))
        return df

    monkeypatch.setattr(incremental.MerkleStore, "state", noted)
    changed = log_of(spark, [*data, ("k7", H(2), "y", "1", H(2))]).select("key", "version")
    assert [r.key for r in store.process(changed, 2).collect()] == ["k7"]
    files = {f.rsplit("/", 2)[1] for f in read[0][0] if "/changed/" in f}
    rewritten = spark.read.parquet(f"{root}/run-{2:012d}/changed").count()
    assert len(files) == 1 and 1 <= rewritten < 40 and 0 < read[0][1] < 40
    # The descent decides what is read: with every leaf below a differing node taken for differing more of the state is.
    monkeypatch.setattr(incremental, "descend", lambda new, old, bits, branches: new.filter((F.col("level") == 2) & F.shiftright("node", 4).isin(branches)).select("node"))
    again = log_of(spark, [*data, ("k7", H(3), "z", "1", H(3))]).select("key", "version")
    assert [r.key for r in store.process(again, 3).collect()] == ["k7"] and spark.read.parquet(f"{root}/run-{3:012d}/changed").count() > rewritten
    assert read[1][1] > read[0][1]


def test_trees_grow_with_the_keys_and_forget_what_is_gone(spark):
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store = incremental.MerkleStore(spark, root)
    state = lambda ks, h: log_of(spark, [(f"k{k}", H(h), f"v{h}", "1", H(1)) for k in ks]).select("key", "version")
    assert store.process(state(range(10), 1), 1).count() == 10
    assert store.process(state(range(3000), 1), 2).count() == 2990
    assert store.process(state(range(5, 3000), 1), 3).count() == 0
    assert sorted(r.key for r in store.process(state(range(3000), 1), 4).collect()) == [f"k{k}" for k in range(5)]
    assert store.process(state(range(3000), 1), 5).count() == 0 and store.process(state([], 1), 6).count() == 0


def test_descent_visits_only_differing_nodes(spark):
    uneven = lambda odd: incremental.tree_of(log_of(spark, [(f"k{k}", H(1 + (k == odd)), "x", "1", H(1)) for k in range(99)]).select("key", "version"), 5)
    assert [r.node for r in incremental.descend(uneven(37), uneven(None), 5, list(range(16))).collect()] == [spark.range(1).select(incremental.key_range(F.lit("k37"), 5)).first()[0]]
    tree = lambda odd: incremental.tree_of(log_of(spark, [(f"k{k}", H(1 + (k == odd)), "x", "1", H(1)) for k in range(500)]).select("key", "version"), 8)
    leaf = spark.range(1).select(incremental.key_range(F.lit("k37"), 8)).first()[0]
    assert [r.node for r in incremental.descend(tree(37), tree(None), 8, [leaf >> 4]).collect()] == [leaf]
    assert incremental.descend(tree(37), tree(37), 8, list(range(16))).count() == 0 and incremental.descend(tree(37), tree(None), 8, []).count() == 0

"""Processing only new or changed records, with a Merkle tree over key ranges."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphlens.session import Scratch, delete, exists, listing, read_text, rename, write_text

#: Bits by which a level of the tree is finer than the one above.
LEVEL_BITS = 4
#: Keys of a leaf, and keys from which on the state of a run lies in a folder for each node below the root.
LEAF_KEYS, SPLIT_KEYS = 4, 1 << 22


def leaf_bits(keys: int) -> int:
    """Bits of the key's hash that name a leaf, for about ``LEAF_KEYS`` keys in each."""
    return min(48, max(LEVEL_BITS, (max(keys, 1) // LEAF_KEYS).bit_length()))


def depth_of(bits: int) -> int:
    """Level of the leaves; the root has level 0. The last level may be less than ``LEVEL_BITS`` finer."""
    return -(-bits // LEVEL_BITS)


def key_range(key: Column, bits: int) -> Column:
    """The leaf of a key: the range of the hash space in which its hash lies."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def versions(log: DataFrame, key: Column, instant: Column, digest: Column, unsure: Column, *more: Column) -> DataFrame:
    """key, version (instant, digest, unsure), and ``more``; rows with a null key are no records.

    ``instant`` orders the versions of a record, null first. ``unsure`` versions differ from every other
    one in content, whatever the digests.
    """
    return log.select(key.alias("key"), F.struct(instant.alias("instant"), digest.alias("digest"), unsure.alias("unsure")).alias("version"), *more).filter("key is not null")


def is_case(old: str, new: str) -> Column:
    """A newer version which is the first one, differs from the one before, or can't be told."""
    o, n = F.col(old), F.col(new)
    newer = ~o["instant"].eqNullSafe(n["instant"])
    return n.isNotNull() & (o.isNull() | (newer & (o["unsure"] | n["unsure"] | (o["digest"] != n["digest"]))))


def version_hash(key: str, version: str) -> Column:
    """What a record adds to its leaf's digest; 0 for no record."""
    v = F.col(version)
    return F.when(v.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(key, F.coalesce(v["instant"].cast("string"), F.lit("-")), v["digest"], v["unsure"]))


def tree_of(state: DataFrame, bits: int) -> DataFrame:
    """All nodes of the tree over ``state`` (key, version): level, node, digest, n; level 0 is the root.

    A leaf's digest mixes the xor of its records' hashes with its number; a node's is the xor of its
    leaves', so that all levels come from one pass over the leaves. Everything is aggregated before it is shuffled.
    """
    leaves = state.groupBy(key_range(F.col("key"), bits).alias("leaf")).agg(F.bit_xor(version_hash("key", "version")).alias("x"), F.count("*").alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(depth_of(bits))))
    nodes = leaves.select(level.alias("level"), "leaf", F.xxhash64("leaf", "x").alias("digest"), "n")
    node = F.expr(f"shiftright(leaf, greatest(0, {bits} - level * {LEVEL_BITS}))")
    return nodes.groupBy("level", node.alias("node")).agg(F.bit_xor("digest").alias("digest"), F.sum("n").alias("n"))


def descend(new: DataFrame, old: DataFrame, bits: int, branches: list[int]) -> DataFrame:
    """The leaves (node) that differ between two trees, reached through differing nodes only.

    branches: the nodes below the root that differ, at most ``2 ** LEVEL_BITS``; below other nodes nothing is looked at.
    """
    both = new.select("level", "node", "digest").unionByName(old.select("level", "node", "digest"))
    differing, depth = None, depth_of(bits)
    finer = lambda k: min(bits, k * LEVEL_BITS)
    for k in range(min(2, depth), depth + 1):
        # A node of one tree only differs too: then its digest stands alone.
        at = both.filter((F.col("level") == k) & F.shiftright("node", finer(k) - finer(1)).isin(branches))
        at = at.groupBy("node").agg(F.bit_xor("digest").alias("digest"), F.count("*").alias("n")).filter("digest <> 0 or n = 1").select("node")
        if differing is not None:
            at = at.withColumn("up", F.shiftright("node", finer(k) - finer(k - 1))).join(differing.select(F.col("node").alias("up")), "up", "left_semi").select("node")
        differing = at
    return differing


class Generation:
    """What a run publishes: parts written out of sight, then made visible at once by one rename.

    A run that dies before the rename leaves nothing visible and may simply be repeated; one
    that is repeated after it finds its generation and leaves it as it is.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.final, self.staged = spark, f"{root}/{name}", f"{root}/.staged-{uuid.uuid4().hex[:12]}"

    def write(self, name: str, df: DataFrame, *split: str) -> DataFrame:
        """Write a part and return it as read back."""
        df.write.partitionBy(*split).parquet(f"{self.staged}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.staged}/{name}")

    def commit(self, note: dict) -> str:
        write_text(self.spark, f"{self.staged}/note.json", json.dumps(note))
        if not rename(self.spark, self.staged, self.final):
            delete(self.spark, self.staged)
        return self.final


def publish(spark: SparkSession, root: str, generation: str, parts: dict[str, DataFrame], note: dict) -> str:
    """Write parts (output, tree, ...) and make them visible at once; nothing happens if the generation exists."""
    g = Generation(spark, root, generation)
    if not exists(spark, g.final):
        for name, df in parts.items():
            g.write(name, df)
        g.commit(note)
    return g.final


class MerkleStore:
    """State of an incremental job in shared storage: for each successful run its tree and its changed leaves.

    A generation holds the records of the leaves that differed in its run, cases marked; all other leaves
    stay where they are, and the tree names for each leaf the run that wrote it last. So a run reads
    the leaves that differ and writes them anew, and nothing else of the state.
    """

    def __init__(self, spark: SparkSession, root: str, bits: int | None = None, split_keys: int = SPLIT_KEYS):
        self.spark, self.root, self.bits, self.split_keys = spark, root.rstrip("/"), bits, split_keys

    def last(self, before: str | None = None) -> str | None:
        done = [g for g in listing(self.spark, self.root) if g.startswith("run-") and (before is None or g < before)]
        return f"{self.root}/{done[-1]}" if done else None

    def process(self, current: DataFrame, run_no: int) -> DataFrame:
        """Keys that are new or changed since the last successful run, published as run ``run_no``.

        current: all versions that this run sees, as of ``versions``. Run numbers grow. To call it
        again for a run that was published gives that run's output; an aborted one is done anew.

        The tree is built from ``current``, compared with the saved one from the root down, and only the leaves that
        differ are extracted, on both sides. Leaves hold about ``LEAF_KEYS`` keys; when the keys have outgrown that by a level,
        the saved state is read whole once and the tree built anew with more levels.
        """
        generation = f"run-{run_no:012d}"
        if not exists(self.spark, f"{self.root}/{generation}"):
            self._run(current, run_no, generation)
        return self.outputs([run_no]).select("key")

    def outputs(self, runs: list[int]) -> DataFrame:
        """run, key: what published runs had to process."""
        note = json.loads(read_text(self.spark, f"{self.root}/run-{runs[0]:012d}/note.json"))
        return self._changed(runs, note).filter("is_case").select("run", "key")

    def _changed(self, runs: list[int], note: dict, branches: list[int] | None = None) -> DataFrame:
        """Stored records of runs; of some nodes below the root only, where these have folders of their own."""
        paths = [f"{self.root}/run-{run:012d}/changed" for run in runs]
        if branches is not None and note["split"]:
            wanted = {f"branch={b}" for b in branches}
            paths = [f"{p}/{name}" for p in paths for name in listing(self.spark, p) if name in wanted]
        rows = StructType.fromJson(note["schema"])
        return self.spark.read.schema(rows).option("recursiveFileLookup", True).parquet(*paths) if paths else self.spark.createDataFrame([], rows)

    def state(self, prior: str, branches: list[int] | None = None, leaves: DataFrame | None = None) -> DataFrame:
        """leaf, key, version as run ``prior`` left them; of some nodes below the root and some leaves, if these are given."""
        note = json.loads(read_text(self.spark, f"{prior}/note.json"))
        tree = self.spark.read.parquet(f"{prior}/tree").filter(F.col("level") == depth_of(note["bits"]))
        at = tree.select(F.col("node").alias("leaf"), F.col("written").alias("run"))
        if leaves is not None:
            at = at.join(leaves.select(F.col("node").alias("leaf")), "leaf", "left_semi")
        rows = self._changed(note["live"], note, branches)
        return rows.join(at, ["leaf", "run"], "left_semi").select("leaf", "key", "version")

    def _run(self, current: DataFrame, run_no: int, generation: str) -> None:
        prior = self.last(generation)
        note = json.loads(read_text(self.spark, f"{prior}/note.json")) if prior else {"bits": 0, "keys": current.select("key").distinct().count(), "upper": [], "split": False}
        bits = leaf_bits(note["keys"])
        bits = self.bits or (bits if bits >= note["bits"] + LEVEL_BITS else note["bits"] or bits)
        depth, split = depth_of(bits), note["keys"] >= self.split_keys
        top = F.shiftright("leaf", bits - LEVEL_BITS).cast("int") if split else F.lit(0)
        kept = prior is not None and note["bits"] == bits and note["split"] == split
        state = current.groupBy("key").agg(F.max("version").alias("version"))
        g = Generation(self.spark, self.root, generation)
        tree = tree_of(state, bits)
        old_state = state.limit(0) if prior is None else None if kept else self.state(prior)
        saved = self.spark.read.parquet(f"{prior}/tree") if kept else tree_of(old_state, bits).withColumn("written", F.lit(-1))
        was = saved.filter(F.col("level") == depth).select(F.lit(depth).alias("level"), "node", F.col("digest").alias("was"), F.col("written").alias("was_written"))
        written = F.when(F.lit(kept) & (F.col("digest") == F.col("was")), F.col("was_written")).otherwise(F.lit(run_no)).cast("int")
        tree = g.write("tree", tree.join(was, ["level", "node"], "left").select("level", "node", "digest", "n", F.when(F.col("level") == depth, written).alias("written")))
        # At most a row for each run still in use, and for each node of the two upper levels.
        top_node = F.when(F.col("level") <= 1, F.col("node"))
        seen = tree.filter((F.col("level") <= 1) | (F.col("level") == depth)).groupBy("level", top_node.alias("node"), F.when(F.col("level") <= 1, F.col("digest")).alias("digest"), "written").agg(F.sum("n").alias("n")).collect()
        live = sorted({r.written for r in seen if r.level == depth}) or [run_no]
        upper = sorted((r.node, r.digest) for r in seen if r.level == 1)
        branches = sorted({node for node, _ in set(upper) ^ {tuple(x) for x in note["upper"]}})
        keys = sum(r.n for r in seen if r.level == 0)
        leaves = descend(tree, saved, bits, branches) if kept else tree.filter(F.col("level") == depth).select("node")
        stale = self.state(prior, branches, leaves) if kept else old_state
        leaf = key_range(F.col("key"), bits)
        fresh = state.withColumn("leaf", leaf)
        fresh = fresh.join(leaves.select(F.col("node").alias("leaf")), "leaf", "left_semi") if kept else fresh
        changed = fresh.join(stale.select("key", F.col("version").alias("old")), "key", "left")
        changed = changed.select("leaf", "key", "version", is_case("old", "version").alias("is_case"), F.lit(run_no).alias("run"))
        g.write("changed", changed.withColumn("branch", top), "branch")
        g.commit({"run": run_no, "after": prior, "bits": bits, "split": split, "keys": keys, "upper": upper, "live": live, "schema": changed.schema.jsonValue()})


def replay(log: DataFrame, arrived: str, runs: DataFrame, bits: int | None = None) -> DataFrame:
    """What each run of a history had to process: run_id, key.

    log: as of ``versions`` with the column ``arrived``. runs: ``run_id``, ``started_at`` of the successful
    runs. A run sees the rows that arrived at or before its start, and goes through ``MerkleStore.process`` after the one before it.

    Defined results: rows without arrival or after the last run are not seen; runs without a start do not
    exist; of two runs with the same start the second finds nothing; repeated rows count once.

    The log is shuffled once, reduced to the best version of each key between two runs (maxima are taken before the shuffle
    too, so a record with very many versions is at most one row a run), in buckets of the key; the runs read those without a shuffle.
    """
    spark = log.sparkSession
    scratch = Scratch(spark, "replay")
    order = [(r[0], r[1]) for r in runs.filter("started_at is not null and run_id is not null").distinct().orderBy("started_at", "run_id").select("run_id", "started_at").collect()]
    if not order:
        return log.select(F.lit(0).alias("run_id"), "key").limit(0)
    starts = F.array(*[F.lit(s) for _, s in order])
    seen_at = F.size(F.filter(starts, lambda s: s < F.col(arrived)))
    seen = log.filter(F.col(arrived) <= F.lit(order[-1][1])).select("key", "version", seen_at.alias("run_at"))
    best = scratch.save_bucketed(seen.groupBy("key", "run_at").agg(F.max("version").alias("version")), "log", ["key"])
    store = MerkleStore(spark, f"{scratch.root}/store", bits)
    for k in range(len(order)):
        store.process(best.filter(F.col("run_at") <= k).select("key", "version"), k)
    ids = F.array(*[F.lit(i) for i, _ in order])
    return store.outputs(list(range(len(order)))).select(F.element_at(ids, F.col("run") + 1).alias("run_id"), "key")

"""What changed between full snapshots: a bucketed key-to-hash index of the last one."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from graphlens.session import Scratch, delete, exists, listing, open_bucketed, read_text, rename, shuffle_partitions, write_text


#: Groups whose scope is broadcast to a probe: a row of some 50 bytes each. More are joined.
BROADCAST_GROUPS = 100_000


class KeyHashIndex:
    """Key → hash of the last snapshot of every group, in files bucketed by key.

    The rows of a new snapshot arrive bucketed alike, so a probe is a merge of equal buckets
    without a shuffle. After a probe the index of the new state takes the place of the old.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, keys: list[str], group: str, buckets: int | None = None):
        self.spark, self.scratch, self.keys, self.group = spark, scratch, keys, group
        self.buckets = buckets or shuffle_partitions(spark)
        self.current: DataFrame | None = None

    def bucketed(self, df: DataFrame, name: str, split: str | None = None, placed: bool = False, path: str | None = None) -> DataFrame:
        return self.scratch.save_bucketed(df, name, self.keys, split, placed, self.buckets, path)

    def advance(self, new: DataFrame, covered: DataFrame, name: str, path: str | None = None, n_groups: int | None = None) -> DataFrame:
        """Probe with a snapshot (keys, row_hash) and swap: keys and ``change_kind`` of what differs.

        covered: group and ``has_prior``, the groups that the snapshot covers, and whether they had one before. All others stay as they are.
        The rows written hold keys, old and new hash, kind and the hash to keep; the next index is a filter on them.
        """
        old = self.current.select(*self.keys, F.col("row_hash").alias("old_hash"))
        both = old.join(new.select(*self.keys, F.col("row_hash").alias("new_hash")), self.keys, "full_outer")
        few = (covered.count() if n_groups is None else n_groups) <= BROADCAST_GROUPS
        scope = covered.select(self.group, "has_prior")
        both = both.join(F.broadcast(scope) if few else scope, self.group, "left")
        in_scope = F.col("has_prior").isNotNull()
        kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed")
        both = both.withColumn("change_kind", F.when(F.col("has_prior"), kind)).withColumn("row_hash", F.when(in_scope, F.col("new_hash")).otherwise(F.col("old_hash"))).drop("has_prior", "new_hash", "old_hash")
        probed = self.bucketed(both, name, placed=few, path=path)
        self.current = probed.filter("row_hash is not null")
        return probed.filter("change_kind is not null").select(*self.keys, "change_kind")


class SnapshotStore:
    """A stored index: one call for each snapshot that arrives, in whatever session.

    Each generation holds the index after a snapshot, changes marked, and appears by one rename; a snapshot
    whose run died is simply given again, one that was published is not compared again.
    """

    def __init__(self, spark: SparkSession, root: str, group: str, keys: list[str], buckets: int | None = None):
        self.spark, self.root, self.group, self.keys = spark, root.rstrip("/"), group, [group, *keys]
        self.buckets = buckets or shuffle_partitions(spark)

    def _opened(self, generation: str) -> tuple[DataFrame, dict]:
        note = json.loads(read_text(self.spark, f"{self.root}/{generation}/note.json"))
        return open_bucketed(self.spark, f"{self.root}/{generation}/index", note["columns"], self.keys, note["buckets"]), note

    def process(self, rows: DataFrame, number: int, groups: DataFrame) -> DataFrame:
        """Keys and ``change_kind`` of snapshot ``number`` against the last one of each group.

        rows: keys and ``row_hash``, one for each key, as of ``latest_per_snapshot``. groups: the groups that the snapshot covers; for
        those it has no rows of everything is removed, the first one of a group yields nothing.
        """
        generation = f"snapshot-{number:012d}"
        if not exists(self.spark, f"{self.root}/{generation}"):
            done = [g for g in listing(self.spark, self.root) if g.startswith("snapshot-") and g < generation]
            index, note = self._opened(done[-1]) if done else (None, {"groups": [], "buckets": self.buckets})
            scratch = Scratch(self.spark, "snapshot")
            idx = KeyHashIndex(self.spark, scratch, self.keys, self.group, note["buckets"])
            staged = f"{self.root}/.staged-{uuid.uuid4().hex[:12]}"
            known = self.spark.read.parquet(f"{self.root}/{done[-1]}/groups") if done else groups.select(self.group).limit(0)
            covered = scratch.save(groups.select(self.group).dropna().distinct().join(known.withColumn("has_prior", F.lit(True)), self.group, "left").fillna(False, ["has_prior"]), "covered")
            idx.current = index.filter("row_hash is not null") if index is not None else rows.limit(0)
            columns = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in self.keys), "change_kind string", "row_hash bigint"])
            idx.advance(rows.join(covered, self.group, "left_semi"), covered, f"snapshot_{number}", f"{staged}/index")
            known.unionByName(covered.select(self.group)).distinct().write.parquet(f"{staged}/groups")
            write_text(self.spark, f"{staged}/note.json", json.dumps({"number": number, "buckets": note["buckets"], "columns": columns}))
            if not rename(self.spark, staged, f"{self.root}/{generation}"):
                delete(self.spark, staged)
        return self._opened(generation)[0].filter("change_kind is not null").select(*self.keys, "change_kind")


def latest_per_snapshot(rows: DataFrame, keys: list[str], number: str, delivered: str, row_hash: Column) -> DataFrame:
    """One row for each key and snapshot: the hash of the row delivered last.

    The maximum is taken before the shuffle too, so repeated deliveries and hot keys shrink to a
    row for each task. Of rows delivered at the same time with different contents the one with
    the greater hash counts. A null delivery time counts as the earliest. Rows with a null key or
    snapshot number are not part of any snapshot.
    """
    named = rows.select(*keys, number, F.struct(F.col(delivered).alias("at"), row_hash.alias("hash")).alias("version"))
    named = named.dropna(subset=[*keys, number])
    return named.groupBy(*keys, number).agg(F.max("version").alias("version")).select(*keys, number, F.col("version.hash").alias("row_hash"))


def snapshot_changes(
    spark: SparkSession, rows: DataFrame, index: DataFrame, group: str, keys: list[str], number: str, delivered: str, row_hash: Column
) -> DataFrame:
    """Changes between each snapshot of a group and the group's previous one.

    rows: full snapshots with ``group``, the other ``keys``, ``number``, ``delivered`` and whatever
    ``row_hash`` reads; more columns do no harm. index: ``group`` and ``number`` of the snapshots
    that count. Result: group, keys, number (the later one), ``change_kind``.

    Defined results: the first snapshot of a group yields nothing; a listed snapshot without rows
    removes everything; rows of snapshots that are not listed are ignored; repeated rows and
    listings count once; empty tables give an empty result.

    The rows are shuffled once, as key, number and hash, into the buckets of the index; then each
    snapshot number is one merge of buckets. Iterates over the distinct snapshot numbers, of which
    there is one for each delivery, not over groups or rows.
    """
    scratch = Scratch(spark, "snapshots")
    all_keys = [group, *keys]
    listed = index.select(group, number).dropna().distinct()
    numbers = [r[0] for r in listed.select(number).distinct().orderBy(number).collect()]
    result = StructType([*(rows.schema[k] for k in all_keys), StructField(number, IntegerType()), StructField("change_kind", StringType())])
    if not numbers:
        return spark.createDataFrame([], result)
    listed = scratch.save(listed.withColumn("has_prior", F.col(number) > F.min(number).over(Window.partitionBy(group))), "listed")
    n_groups = listed.select(group).distinct().count()
    hashes = latest_per_snapshot(rows, all_keys, number, delivered, row_hash).join(listed, [group, number], "left_semi")
    idx = KeyHashIndex(spark, scratch, all_keys, group)
    staged = idx.bucketed(hashes, "staged", split=number)
    idx.current = staged.filter(F.col(number) == numbers[0])
    found: list[DataFrame] = []
    for n in numbers[1:]:
        changed = idx.advance(staged.filter(F.col(number) == n), listed.filter(F.col(number) == n), f"probe_{n}", n_groups=n_groups)
        found.append(changed.select(*all_keys, F.lit(n).cast("int").alias(number), "change_kind"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], result)


def with_old_values(changes: DataFrame, prior: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The prior values of changed and removed records only.

    ``prior`` holds one row for each key. Its columns come back as ``old_<name>``; added records
    are left out, as they have none.
    """
    wanted = changes.filter(F.col("change_kind").isin("changed", "removed"))
    return wanted.join(prior.select(*keys, *[F.col(c).alias(f"old_{c}") for c in columns]), keys)

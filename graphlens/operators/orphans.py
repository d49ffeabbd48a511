"""References to records that do not exist, never did or come only later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.ids import norm_id, slice_key
from graphlens.operators.skew import HOT_FLOOR, salted_join
from graphlens.session import Scratch


def lifetimes(rows: DataFrame, key, created: str | None = None, deleted: str | None = None) -> DataFrame:
    """key, begins, ends of each distinct lifetime; without ``created`` the record is always there."""
    when = lambda c: (F.col(c) if c else F.lit(None)).cast("timestamp_ntz")
    return rows.select(key.alias("target_id"), when(created).alias("begins"), when(deleted).alias("ends")).filter("target_id is not null").distinct()


def orphan_references(refs: DataFrame, parents: DataFrame, scratch: Scratch, floor: int = HOT_FLOOR) -> DataFrame:
    """References whose target does not exist at their time.

    refs: ``target_id``, ``recorded_at`` and any further columns. parents: ``target_id``, ``begins``,
    ``ends`` as of ``lifetimes``; null begins is since ever, null ends is still there. Result: the
    columns of refs (but for a column of that name) and ``reason``: missing (no lifetime at all), late (all begin later), deleted.

    Defined results: null targets are no reference; without ``recorded_at`` a reference is a case
    only if its target is missing; repeated rows stay as they are in refs; without parents all
    references are missing.

    Left anti-join of the distinct targets and times with the lifetimes, hot targets split by time.
    Only what is found gets joined with the parents again, for the reason, and with the referring
    rows, by target and time, so that a hot target is spread there too.
    """
    refs = refs.drop("reason")
    keys = scratch.save(refs.select("target_id", "recorded_at").filter("target_id is not null").distinct(), "keys")
    alive = lambda l, r: (
        (r["begins"].isNull() | l["recorded_at"].isNull() | (r["begins"] <= l["recorded_at"]))
        & (r["ends"].isNull() | l["recorded_at"].isNull() | (l["recorded_at"] < r["ends"]))
    )
    lost = scratch.save(salted_join(keys, parents, "target_id", "left_anti", "recorded_at", alive, floor=floor), "lost")
    began = parents.groupBy("target_id").agg(F.min(F.coalesce("begins", F.lit("0001-01-01").cast("timestamp_ntz"))).alias("first_begins"))
    known = salted_join(lost, began, "target_id", "left", "recorded_at", floor=floor)
    reason = F.when(F.col("right_target_id").isNull(), "missing").when(F.col("first_begins") > F.col("recorded_at"), "late").otherwise("deleted")
    known = known.select(F.col("target_id").alias("lost_id"), F.col("recorded_at").alias("lost_at"), reason.alias("reason"))
    on = (refs["target_id"] == F.col("lost_id")) & refs["recorded_at"].eqNullSafe(F.col("lost_at"))
    return refs.join(known, on).drop("lost_id", "lost_at")


def graph_references(slices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references of slices and of workspace edges: ref_field, owner_id, target_id, recorded_at; repeated rows repeat."""
    owner = slice_key(F.col("slice_domain"), F.col("slice_type"), F.col("slice_id"))
    parts = []
    for field in ("forward_refs", "backward_refs"):
        one = slices.select(owner.alias("owner_id"), "recorded_at", F.explode(F.array_distinct(field)).alias("ref"))
        parts.append(one.select(F.lit(field).alias("ref_field"), "owner_id", slice_key(F.col("ref.slice_domain"), F.col("ref.slice_type"), F.col("ref.slice_id")).alias("target_id"), "recorded_at"))
    of_edges = edges.select(F.lit("merged_edges").alias("ref_field"), F.col("edge_id").cast("string").alias("owner_id"), norm_id("to_id").alias("target_id"), "recorded_at")
    return parts[0].unionByName(parts[1]).filter("target_id is not null"), of_edges.filter("target_id is not null")


def graph_orphans(slices: DataFrame, edges: DataFrame, nodes: DataFrame, systems: DataFrame, floor: int = HOT_FLOOR) -> DataFrame:
    """Orphans of both kinds, each once: ref_field, owner_id, target_id, recorded_at, reason.

    Repeated references only come together when orphans are left of them: to make them distinct before would shuffle all.
    """
    scratch = Scratch(slices.sparkSession, "orphans")
    of_slices, of_edges = graph_references(slices, edges)
    keys = lifetimes(slices, slice_key(F.col("slice_domain"), F.col("slice_type"), F.col("slice_id")), "created_at", "deleted_at")
    ids = lifetimes(nodes, norm_id("node_id"), "created_at", "deleted_at").unionByName(lifetimes(systems, norm_id("system_id"))).distinct()
    return orphan_references(of_slices, keys, scratch, floor).unionByName(orphan_references(of_edges, ids, scratch, floor)).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table and month of the reference."""
    source = F.when(F.col("ref_field") == "merged_edges", "merged_edges").otherwise("slices")
    return orphans.groupBy(source.alias("table_name"), F.date_format("recorded_at", "yyyy-MM").alias("period"), "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("target_id").alias("n_targets"))

"""Queries p1, p3, p4 and p5 over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.functions.ids import canonical_json, marked, norm_id, row_hash, set_hash
from graphlens.operators import hierarchy, incremental, orphans, snapshots
from graphlens.session import Scratch, table


def slice_state_hash():
    """Everything that makes a slice's state, without snapshot, extraction and delivery."""
    plain = [marked(F.col(c)) for c in ("slice_domain", "slice_type", "extractor", "lang", "source_checksum", "line_no", "end_line")]
    return F.xxhash64(*plain, marked(norm_id("file_path")), marked(canonical_json(F.col("element"))), set_hash(F.col("source_files"), norm_id), set_hash(F.col("tags")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "slice_snapshots").withColumns({"repo": norm_id("repo"), "slice_id": norm_id("slice_id")})
    index = table(spark, d, "snapshot_index").filter("status = 'success'").withColumn("repo", norm_id("repo"))
    out = snapshots.snapshot_changes(spark, rows, index, "repo", ["slice_id"], "snapshot_no", "delivered_at", slice_state_hash())
    return out.select("repo", "slice_id", "snapshot_no", "change_kind")


def p1_old_values(spark: SparkSession, d: str) -> DataFrame:
    """Checksum and line before the change, fetched for changed and removed slices only."""
    rows = table(spark, d, "slice_snapshots").withColumns({"repo": norm_id("repo"), "slice_id": norm_id("slice_id")})
    index = table(spark, d, "snapshot_index").filter("status = 'success'").select(norm_id("repo").alias("repo"), "snapshot_no").distinct()
    prior = index.withColumn("prior_no", F.lag("snapshot_no").over(Window.partitionBy("repo").orderBy("snapshot_no"))).dropna()
    found = Scratch(spark, "old-values").save(p1_found(spark, d).join(prior, ["repo", "snapshot_no"]), "changes")
    before = rows.withColumnRenamed("snapshot_no", "prior_no").join(found.filter("change_kind <> 'added'"), ["repo", "slice_id", "prior_no"], "left_semi")
    last = before.groupBy("repo", "slice_id", "prior_no").agg(F.max(F.struct("delivered_at", slice_state_hash().alias("h"), "source_checksum", "line_no")).alias("v"))
    values = last.select("repo", "slice_id", "prior_no", "v.source_checksum", "v.line_no")
    out = snapshots.with_old_values(found, values, ["repo", "slice_id", "prior_no"], ["source_checksum", "line_no"])
    return out.select("repo", "slice_id", "snapshot_no", "change_kind", "old_source_checksum", "old_line_no")


def contains_links(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "merged_edges").filter(F.lower(norm_id("verb")) == "contains")
    return edges.select(norm_id("from_id").alias("parent"), norm_id("to_id").alias("child"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchies(contains_links(spark, d)).select("node_id", "root_id", "depth", "node_path", "state")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.graph_orphans(*(table(spark, d, t) for t in ("slices", "merged_edges", "ws_nodes", "external_systems")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_field", "owner_id", "target_id", "reason").distinct()


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def metadata_log(spark: SparkSession, d: str) -> DataFrame:
    return incremental.versions(
        table(spark, d, "slice_metadata"),
        norm_id("slice_id"),
        F.col("extracted_at").try_cast("timestamp"),
        F.xxhash64(set_hash(F.col("source_files"), norm_id), row_hash(F.col("source_checksum"))),
        F.col("source_checksum").isNull(),
        F.col("arrived_at"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "recon_runs").filter("status = 'success'").select("run_id", "started_at")
    return incremental.replay(metadata_log(spark, d), "arrived_at", runs).select("run_id", F.col("key").alias("slice_id"))


QUERIES = {"p1_found": p1_found, "p1_old_values": p1_old_values, "p3_found": p3_found, "p4_found": p4_found, "p4_counts": p4_counts, "p5_found": p5_found}

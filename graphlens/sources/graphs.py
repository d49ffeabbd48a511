"""The graphs that the domain tables hold, as DataFrames of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.ids import norm_id, slice_key
from graphlens.session import table


def _key(prefix: str = ""):
    return slice_key(F.col(f"{prefix}slice_domain"), F.col(f"{prefix}slice_type"), F.col(f"{prefix}slice_id"))


def slice_nodes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each slice key over all its lifetimes: key, domain, type, id, repo, path, name, tags."""
    rows = table(spark, d, "slices").select(
        _key().alias("key"), "slice_domain", "slice_type", norm_id("slice_id").alias("id"), "repo", norm_id(F.try_element_at("source_files", F.lit(1))).alias("path"), F.explode_outer("tags").alias("tag")
    )
    nodes = rows.filter("key is not null").groupBy("key").agg(
        F.min("slice_domain").alias("domain"), F.min("slice_type").alias("type"), F.min("id").alias("id"), F.min("repo").alias("repo"), F.min("path").alias("path"), F.array_sort(F.collect_set("tag")).alias("tags")
    )
    return nodes.withColumn("name", F.regexp_extract("id", r"([^:/.]*)$", 1))


def slice_edges(spark: SparkSession, d: str, direction: str = "forward") -> DataFrame:
    """Distinct references src → dst, as the slices list them forward or backward."""
    refs = table(spark, d, "slices").select(_key().alias("src"), F.explode(F.array_distinct(f"{direction}_refs")).alias("r"))
    return refs.select("src", _key("r.").alias("dst")).dropna().distinct()


def workspace_nodes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each workspace node and external system: id, type, name, repo."""
    nodes = table(spark, d, "ws_nodes").select(norm_id("node_id").alias("id"), F.col("node_type").alias("type"), "name", "repo")
    systems = table(spark, d, "external_systems").select(norm_id("system_id").alias("id"), F.lit("ExternalSystem").alias("type"), "name", F.lit("external").alias("repo"))
    return nodes.unionByName(systems).filter("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("type", "name", "repo")])


def workspace_edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges src, dst, verb; verbs trimmed and in lower case."""
    edges = table(spark, d, "merged_edges").select(norm_id("from_id").alias("src"), norm_id("to_id").alias("dst"), F.lower(F.trim("verb")).alias("verb"))
    return edges.dropna().distinct()

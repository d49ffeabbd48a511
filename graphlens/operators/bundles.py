"""Context bundles: what lies around an entry point, with sources, exclusions and a fingerprint."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators import traverse


def canonical(value, sort_arrays: bool = False) -> str:
    """JSON text with sorted keys and without undefined members; with sorted arrays too, if asked for."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(v[k]) for k in sorted(v) if v[k] is not None}
        if isinstance(v, (list, tuple)):
            items = [plain(x) for x in v]
            return sorted(items, key=lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)) if sort_arrays else items
        return v

    return json.dumps(plain(value), separators=(",", ":"), ensure_ascii=False)


def time_ordered_id() -> str:
    """A UUID of version 7, for snapshots; made by the driver."""
    import time

    n = (int(time.time() * 1000) << 80) | (uuid.uuid4().int & ((1 << 76) - 1))
    return str(uuid.UUID(int=(n & ~(0xF << 76) & ~(0x3 << 62)) | (0x7 << 76) | (0x2 << 62)))


def bundle(edges: DataFrame, seeds: DataFrame, locators: DataFrame, depth: int = 2, limit: int = 50, sources: int = 10) -> DataFrame:
    """seed, node, depth, source_uri, included, reason of what lies around each seed.

    locators: node, source_uri. Nearest nodes first, then by id; beyond ``limit`` nodes or ``sources`` sources
    a row stays, marked as excluded and why: nothing is dropped silently.
    """
    ball = traverse.bfs(traverse.both_ways(edges), seeds, depth)
    one = locators.groupBy("node").agg(F.min("source_uri").alias("source_uri"))
    w = Window.partitionBy("seed").orderBy("depth", "node")
    ranked = ball.withColumn("rank", F.row_number().over(w)).join(one, "node", "left")
    with_source = ranked.withColumn("source_rank", F.sum(F.when(F.col("source_uri").isNotNull() & (F.col("rank") <= limit), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    reason = F.when(F.col("rank") > limit, "node_limit").when(F.col("source_uri").isNull(), "no_source").when(F.col("source_rank") > sources, "source_limit")
    return with_source.select("seed", "node", "depth", "source_uri", reason.isNull().alias("included"), reason.alias("reason"))


def fingerprints(rows: DataFrame) -> DataFrame:
    """Hash of each bundle's included nodes, whatever the order of its rows."""
    line = F.concat_ws("\t", "node", "depth", F.coalesce("source_uri", F.lit("")))
    return rows.filter("included").groupBy("seed").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256).alias("fingerprint"))


def check(rows: DataFrame) -> DataFrame:
    """Whether each bundle holds its seed, has sources and accounts for everything."""
    m = rows.groupBy("seed").agg(
        F.max(F.col("node") == F.col("seed")).alias("has_seed"), F.count_if("included").alias("n_included"), F.count_if(~F.col("included") & F.col("reason").isNull()).alias("n_unexplained")
    )
    status = F.when(~F.col("has_seed") | (F.col("n_unexplained") > 0), "invalid").when(F.col("n_included") == 0, "empty").otherwise("valid")
    return m.select("seed", "n_included", status.alias("status"))

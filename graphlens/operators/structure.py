"""Counts, lookups, consistency checks and topology of a graph (key, ...) with edges (src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.session import Scratch


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and outgoing references by domain, by type and in total, in one pass."""
    out = edges.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("refs"))
    both = nodes.select("key", "domain", "type").join(out, "key", "left")
    grouped = both.groupingSets([["domain"], ["type"], []], "domain", "type").agg(F.count("key").alias("n_nodes"), F.coalesce(F.sum("refs"), F.lit(0)).alias("n_refs"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 1, "domain").when(F.col("g") == 2, "type").otherwise("total")
    return grouped.select(level.alias("level"), F.coalesce("domain", "type", F.lit("*")).alias("value"), "n_nodes", "n_refs")


def by_tag(nodes: DataFrame, tag: str) -> DataFrame:
    """Nodes that carry a tag, whatever its case, or match its pattern."""
    category, _, value = tag.lower().partition(":")
    path = F.lower("path")
    patterns = {
        "handler": (F.col("type") == "function") & F.col("id").contains("lambda_handler") if value == "lambda" else F.lit(False),
        "layer": path.contains(f"/{value}/"),
        "lang": F.element_at(F.split(path, r"\."), -1).isin({"python": ["py"], "typescript": ["ts", "tsx"]}.get(value, [])),
        "aws": (F.col("domain") == "infrastructure") & F.lower("key").contains(value),
        "kind": (F.col("domain") == "infrastructure") & F.lower("key").contains(value),
        "storage": (F.col("domain") == "data") & (F.col("type") == "entity") if value == "dynamodb" else F.lit(False),
    }
    carries = F.exists("tags", lambda t: F.lower(t) == tag.lower())
    return nodes.filter(carries | F.coalesce(patterns.get(category, F.lit(False)), F.lit(False)))


def broken_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    return edges.join(nodes.select(F.col("key").alias("dst")), "dst", "left_anti")


def one_sided(nodes: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """References between existing nodes which the other end does not list: src, dst, side that is missing."""
    keys = nodes.select("key")
    known = lambda e: e.join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi").join(keys.withColumnRenamed("key", "src"), "src", "left_semi")
    back = known(backward).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ahead = known(forward)
    missing_back = ahead.join(back, ["src", "dst"], "left_anti").select("src", "dst", F.lit("backward").alias("missing"))
    return missing_back.unionByName(back.join(ahead, ["src", "dst"], "left_anti").select("src", "dst", F.lit("forward").alias("missing")))


def isolated(nodes: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Nodes without references either way."""
    linked = forward.select("src").union(backward.select("src")).distinct().withColumnRenamed("src", "key")
    return nodes.select("key").join(linked, "key", "left_anti")


def health(nodes: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Broken, one-sided and isolated counts; isolated nodes do not make a graph unhealthy."""
    parts = {"n_broken": broken_edges(nodes, forward.union(backward)), "n_one_sided": one_sided(nodes, forward, backward), "n_isolated": isolated(nodes, forward, backward)}
    counts = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    wide = counts.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in parts])
    return wide.withColumn("is_healthy", (F.col("n_broken") == 0) & (F.col("n_one_sided") == 0))


def _layers(edges: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Sources of ``edges`` by the longest way down, from 1 on, and the edges between what lies on or above a cycle.

    A node joins the layer of the round in which the last of its targets is taken away, however many rounds that takes.
    """
    layers = []
    layer = scratch.save(edges.select(F.col("dst").alias("n")).distinct().join(edges.select(F.col("src").alias("n")), "n", "left_anti"), "layer")
    while layer.limit(1).count():
        rest = scratch.save(edges.join(layer.select(F.col("n").alias("dst")), "dst", "left_anti").select("src", "dst"), "rest")
        layer = scratch.save(edges.select(F.col("src").alias("n")).distinct().join(rest.select(F.col("src").alias("n")), "n", "left_anti"), "layer")
        layers.append(layer)
        edges = rest
    return layers, edges


def longest_depths(nodes: DataFrame, edges: DataFrame, key: str = "key") -> DataFrame:
    """Longest way down from each node: key, depth; rounds go on until every node has its depth.

    Nodes without outgoing edges have depth 0. So have nodes of cycles, and those on a way from one cycle to
    another: edges that leave them do not count, and nodes above them count up from there.
    """
    scratch = Scratch(nodes.sparkSession, "depths")
    valid = edges.join(nodes.select(F.col(key).alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    valid = scratch.save(valid, "edges")
    layers, cyclic = _layers(valid, scratch)
    left = cyclic.count()
    if left:
        # From above, what no remaining edge points at is on no cycle.
        before = None
        while left != before:
            cyclic = scratch.save(cyclic.join(cyclic.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "cyclic")
            before, left = left, cyclic.count()
        layers, _ = _layers(scratch.save(valid.join(cyclic.select("src").distinct(), "src", "left_anti").select("src", "dst"), "acyclic"), scratch)
    parts = [nodes.select(F.col(key).alias("n"), F.lit(0).alias("depth")), *[layer.withColumn("depth", F.lit(k)) for k, layer in enumerate(layers, 1)]]
    return reduce(DataFrame.unionByName, parts).groupBy(F.col("n").alias(key)).agg(F.max("depth").alias("depth"))


def pattern(avg_depth: Column, max_depth: Column, avg_degree: Column, max_degree: Column) -> Column:
    """Kind of architecture by depth and degree; the first rule that holds."""
    deep, wide = max_depth > 5, max_degree > 20
    return (
        F.when(deep & ~wide & (avg_degree < 5), "component-tree")
        .when(~deep & wide & (avg_depth < 3), "microservices")
        .when((avg_depth >= 2) & (avg_depth <= 4) & ~wide, "layered")
        .when((avg_depth <= 2) & (avg_degree <= 3), "flat")
        .otherwise("mixed")
    )


def topology(depths: DataFrame, edges: DataFrame, key: str = "key") -> DataFrame:
    """Depth and degree of a graph, its pattern and the depth that traversals should take."""
    degree = edges.groupBy(F.col("src").alias(key)).agg(F.count("*").alias("degree"))
    both = depths.join(degree, key, "left").fillna(0, ["degree"])
    m = both.agg(F.count("*").alias("n_nodes"), F.round(F.avg("depth"), 6).alias("avg_depth"), F.max("depth").alias("max_depth"),
                 F.expr("cast(percentile_disc(0.95) within group (order by depth) as int)").alias("p95_depth"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree"))
    m = m.withColumn("pattern", pattern(F.col("avg_depth"), F.col("max_depth"), F.col("avg_degree"), F.col("max_degree")))
    base = F.when(F.col("pattern") == "component-tree", 4).when(F.col("pattern").isin("layered", "flat"), 2).otherwise(3)
    return m.withColumn("recommended_depth", F.least(F.greatest(base, F.ceil(F.col("p95_depth") * 0.6)), F.lit(5)).cast("int"))

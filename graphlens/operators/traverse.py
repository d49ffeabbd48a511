"""Traversals of edges (src, dst): bounded searches, closures, ordered walks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.session import Scratch


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """seed, node, depth of everything reached from each seed within ``depth`` steps, seeds included at 0.

    seeds: one column. Without a depth the search goes on until nothing is new: a closure. All seeds
    advance together; each round joins only the last frontier and writes it, so no plan grows with depth.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "bfs")
    links = scratch.save(edges.select("src", "dst").distinct(), "edges")
    start = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct()
    frontier = scratch.save(start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")), "frontier")
    parts, k = [frontier], 0
    seen_parts = [frontier]
    while depth is None or k < depth:
        k += 1
        step = frontier.join(links, frontier["node"] == links["src"]).select("seed", F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, [p.select("seed", "node") for p in seen_parts])
        frontier = scratch.save(step.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(k)), "frontier")
        if not frontier.limit(1).count():
            break
        parts.append(frontier)
        seen_parts.append(frontier)
        if len(seen_parts) > 8:
            seen_parts = [scratch.save(seen.unionByName(frontier.select("seed", "node")), "seen")]
    return reduce(DataFrame.unionByName, parts)


def reached(edges: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """As ``bfs``, without the seeds themselves."""
    return bfs(edges, seeds, depth).filter("depth > 0")


def tiers(ball: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes and repositories of each tier of a blast: seed, tier, n_nodes, n_repos, n_dangling."""
    known = ball.join(nodes.select(F.col("id").alias("node"), "repo"), "node", "left")
    return known.groupBy("seed", F.col("depth").alias("tier")).agg(F.count("repo").alias("n_nodes"), F.countDistinct("repo").alias("n_repos"), F.count_if(F.col("repo").isNull()).alias("n_dangling"))


def risk(ball: DataFrame, nodes: DataFrame) -> DataFrame:
    """Risk of changing each seed, by repositories affected and nodes two or more steps away."""
    known = ball.join(nodes.select(F.col("id").alias("node"), "repo"), "node")
    m = known.groupBy("seed").agg(F.countDistinct("repo").alias("n_repos"), F.count_if(F.col("depth") >= 2).alias("n_far"), F.max("depth").alias("max_tier"))
    return _rated(m)


def _rated(m: DataFrame) -> DataFrame:
    level = F.when((F.col("n_repos") >= 4) | (F.col("n_far") >= 10), "critical").when((F.col("n_repos") >= 3) | (F.col("n_far") >= 5), "high")
    return m.withColumn("risk", level.when((F.col("n_repos") >= 2) | (F.col("n_far") >= 2), "medium").otherwise("low"))


def counted_tiers(counts: DataFrame) -> DataFrame:
    """As ``tiers``, from the counts of ``compact.blast``."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.col(f"rows{k}").alias("n"), F.col(f"placed{k}").alias("n_nodes"), F.col(f"repos{k}").alias("n_repos")) for k in (1, 2)]))
    return counts.select("seed", rows.alias("t")).filter("t.n > 0").select("seed", "t.tier", "t.n_nodes", "t.n_repos", (F.col("t.n") - F.col("t.n_nodes")).alias("n_dangling"))


def counted_risk(counts: DataFrame) -> DataFrame:
    """As ``risk``, from the counts of ``compact.blast``."""
    some = counts.filter("known1 + known2 > 0")
    return _rated(some.select("seed", F.col("repos").alias("n_repos"), F.col("known2").alias("n_far"), F.when(F.col("known2") > 0, 2).otherwise(1).alias("max_tier")))


def _walker(depth: int, limit: int):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for seed, links in zip(pdf["seed"], pdf["links"]):
                ahead: dict[str, list[str]] = {}
                for x in links:
                    ahead.setdefault(x["src"], []).append(x["dst"])
                order, seen, stack = [], {seed}, [(seed, 0, None)]
                while stack and len(order) < limit:
                    node, at, via = stack.pop()
                    if node != seed:
                        if node in seen:
                            continue
                        seen.add(node)
                        order.append((seed, len(order) + 1, node, at, via))
                    if at < depth:
                        stack += [(n, at + 1, node) for n in sorted(ahead.get(node, ()), reverse=True) if n not in seen]
                rows += order
            yield pd.DataFrame(rows, columns=["seed", "ord", "node", "depth", "via"])

    return walk


def walk(edges: DataFrame, seeds: DataFrame, depth: int = 2, limit: int = 100) -> DataFrame:
    """Depth-first walk in the order of targets, each node visited once: seed, ord, node, depth, via.

    Unlike a breadth-first search a node met deep first is not opened again nearer by, so the result is
    a part of the ball of that depth. At most ``limit`` nodes are visited, so of each node's targets only the
    first 2 · limit can ever matter: no more go on to the next level or to the worker that walks.
    """
    scratch = Scratch(edges.sparkSession, "walk")
    links = edges.select("src", "dst").distinct()
    frontier = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct().withColumn("node", F.col("seed"))
    first = F.row_number().over(Window.partitionBy("seed", "src").orderBy("dst"))
    levels = []
    for _ in range(depth):
        ahead = frontier.join(links, F.col("node") == F.col("src")).select("seed", "src", "dst").withColumn("n", first).filter(F.col("n") <= 2 * limit).drop("n")
        levels.append(scratch.save(ahead, "level"))
        frontier = levels[-1].select("seed", F.col("dst").alias("node")).distinct()
    inside = reduce(DataFrame.unionByName, levels).select("seed", F.struct("src", "dst").alias("link"))
    return inside.groupBy("seed").agg(F.collect_set("link").alias("links")).mapInPandas(_walker(depth, limit), "seed string, ord int, node string, depth int, via string")


def snapshot_traverse(nodes: DataFrame, relationships: DataFrame, start: str, snapshot: str, depth: int | None = None) -> DataFrame:
    """node, depth of what a node of a snapshot reaches, the node itself included; nothing if the snapshot has no such node.

    nodes: id, snapshot; relationships: src, dst, snapshot, dst_snapshot. A relationship that leaves the snapshot on the way is an error.
    """
    own = nodes.filter(F.col("snapshot") == snapshot).select("id").distinct()
    rels = relationships.filter(F.col("snapshot") == snapshot)
    seed = own.filter(F.col("id") == start).select(F.col("id").alias("seed"))
    ball = bfs(rels.filter(F.col("dst_snapshot") == snapshot).select("src", "dst"), seed, depth)
    opened = ball if depth is None else ball.filter(F.col("depth") < depth)
    foreign = rels.filter(F.col("dst_snapshot") != snapshot).join(opened.select(F.col("node").alias("src")), "src", "left_semi").limit(1).collect()
    if foreign:
        raise ValueError(f"{foreign[0].src} refers to {foreign[0].dst} of another snapshot")
    return ball.select("node", "depth")


def candidates(relationships: DataFrame, seeds: DataFrame, known: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """What seeds reach forward over the relationships supplied, and what stays outside, with the reason.

    relationships: src, dst, rel_type; known: node. First: seed, node, depth, via (the least relationship that leads there). Second: seed, node, reason: unknown for targets that are
    no known nodes, beyond for targets of the last step's nodes. Nothing is inferred backwards.
    """
    inside = relationships.join(known.select(F.col("node").alias("dst")), "dst", "left_semi")
    ball = Scratch(relationships.sparkSession, "candidates").save(bfs(inside.select("src", "dst"), seeds, depth), "ball")
    before = ball.select("seed", F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    via = before.join(inside, "src").groupBy("seed", F.col("dst").alias("node"), "depth").agg(F.min("rel_type").alias("via"))
    found = ball.filter("depth > 0").join(via, ["seed", "node", "depth"])
    far = ball.join(relationships.select(F.col("src").alias("node"), "dst"), "node").select("seed", F.col("dst").alias("node"), "depth").distinct()
    out = far.join(ball.select("seed", "node"), ["seed", "node"], "left_anti").join(known.select("node", F.lit(True).alias("is_known")).distinct(), "node", "left")
    reason = F.when(F.col("is_known").isNull(), "unknown").otherwise("beyond")
    return found, out.select("seed", "node", reason.alias("reason")).distinct()

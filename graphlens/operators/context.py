"""Composite questions: what belongs to a task, what a change obliges to, what two nodes share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators import search, traverse


def find(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Best nodes with the number of their direct dependents."""
    top = search.search_exact(nodes, query, limit)
    users = edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("n_dependents"))
    return top.join(users, "key", "left").fillna(0, ["n_dependents"])


def usages(edges: DataFrame) -> DataFrame:
    """Direct users of each node, by count."""
    return edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("n_users"))


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """What a change of each seed may reach, with repository and whether it is a test."""
    ball = traverse.reached(traverse.both_ways(edges), seeds, depth)
    known = ball.join(nodes.select(F.col("key").alias("node"), "path", "repo"), "node")
    return known.select("seed", "node", "depth", "repo", F.lower("path").rlike(r"(^|/)tests?/|[._-](test|spec)[._]|test_").alias("is_test"))


def relevant_files(nodes_files: DataFrame, ball: DataFrame) -> DataFrame:
    """Distinct source files of the nodes of each ball. nodes_files: key, file."""
    return ball.join(nodes_files, F.col("node") == F.col("key")).select("seed", "file").distinct()


def shared(ball: DataFrame, a: str, b: str) -> DataFrame:
    """Nodes that lie in the balls of both seeds."""
    one = lambda s: ball.filter(F.col("seed") == s).select("node")
    return one(a).join(one(b), "node", "left_semi").distinct()


def by_domain(nodes: DataFrame, ball: DataFrame) -> DataFrame:
    """How many nodes of each domain a ball holds."""
    return ball.join(nodes.select(F.col("key").alias("node"), "domain"), "node").groupBy("seed", "domain").agg(F.count("*").alias("n_nodes"))


def obligations(impacted: DataFrame, declared: DataFrame) -> DataFrame:
    """What a change of each seed obliges to: declared obligations of its nodes, derived ones by size, and the risk.

    declared: node, obligation.
    """
    own = impacted.join(declared, "node").groupBy("seed").agg(F.count("*").alias("n_declared"))
    size = impacted.groupBy("seed").agg(F.count("*").alias("n_impacted"), F.count_if(F.col("is_test")).alias("n_tests"), F.countDistinct("repo").alias("n_repos"))
    level = F.when(F.col("n_impacted") > 20, "high").when(F.col("n_impacted") > 5, "medium").otherwise("low")
    return size.join(own, "seed", "left").fillna(0, ["n_declared"]).withColumn("risk", level)


#: Change types and what each obliges to besides what is declared and derived.
CHANGES = ("modify", "rename", "delete", "refactor", "add")


def advice(impacted: DataFrame, nodes: DataFrame, change: str) -> DataFrame:
    """For each seed of an impact: n_dependents, risk, review and suggested tests, by the type of the change.

    impacted: seed, node, depth, way (dependents or dependencies). Tests are named by the convention of the seed's language.
    """
    counts = impacted.groupBy("seed").agg(F.count_if(F.col("way") == "dependents").alias("n_dependents"), F.count("*").alias("n_impacted"))
    at = nodes.select(F.col("key").alias("seed"), "id", "type", "path").join(counts, "seed", "left").fillna(0, ["n_dependents", "n_impacted"])
    n, ident = F.col("n_dependents"), F.col("id")
    if change in ("delete", "rename"):
        word = "Delete" if change == "delete" else "Rename"
        review = F.concat(F.lit(f"{word} "), ident, F.lit(": "), n.cast("string"), F.lit(" to update"))
    else:
        review = F.when(n > 5, F.concat(n.cast("string"), F.lit(" dependents: roll out in steps"))).when(n > 0, F.concat(n.cast("string"), F.lit(" dependents to review"))).otherwise("no dependents")
    total = F.col("n_impacted") + 1
    risk = F.lit("high") if change == "delete" else F.when(total > 20, "high").when((total > 5) | F.lit(change == "refactor"), "medium").otherwise("low")
    file = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(file, r"\.[^.]+$", "")
    tests = F.when(file.endswith(".py"), F.concat(F.lit("tests/test_"), stem, F.lit(".py"))).when(file.rlike(r"\.(ts|tsx|js|jsx)$"), F.concat(stem, F.lit(".test.ts,"), stem, F.lit(".spec.ts"))).otherwise("")
    return at.select("seed", "n_dependents", risk.alias("risk"), review.alias("review"), F.coalesce(tests, F.lit("")).alias("tests"))


def invalidated(impacted: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims (node, claim) about nodes that a change of each seed reaches, or about the seed: seed, claim; each once."""
    hit = impacted.select("seed", "node").unionByName(impacted.select("seed", F.col("seed").alias("node"))).distinct()
    return hit.join(claims, "node").select("seed", "claim").distinct()


def budgeted(refs: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` references of each context, and the rest marked as excluded."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return refs.withColumn("rank", rank).withColumn("included", F.col("rank") <= n)

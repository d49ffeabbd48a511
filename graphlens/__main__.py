"""Command line: python -m graphlens VERB DIR [ARGUMENT] [--depth N] [--limit N]; rows come out as JSON, one a line.

DIR holds the tables. Verbs: stats, health, search TEXT, fuzzy TEXT, tag TAG, show KEY, deps KEY, rdeps KEY, blast KEY, query NAME.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators import explore, search, structure, traverse
from graphlens.plans import data_queries, graph_queries
from graphlens.session import local_session
from graphlens.sources import graphs

VERBS = ("stats", "health", "search", "fuzzy", "tag", "show", "deps", "rdeps", "blast", "query")


def answer(spark: SparkSession, verb: str, tables: str, argument: str | None, depth: int = 2, limit: int = 50) -> DataFrame:
    """The rows that a verb asks for."""
    nodes, edges = graphs.slice_nodes(spark, tables), graphs.slice_edges(spark, tables)
    if verb == "stats":
        return structure.stats(nodes, edges)
    if verb == "health":
        return structure.health(nodes, edges, graphs.slice_edges(spark, tables, "backward"))
    if argument is None:
        raise SystemExit(f"{verb} needs an argument")
    if verb == "search":
        return search.search(nodes, argument, limit)
    if verb == "fuzzy":
        return search.search_fuzzy(nodes, argument, limit=limit)
    if verb == "tag":
        return structure.by_tag(nodes, argument).select("key").orderBy("key").limit(limit)
    if verb == "show":
        return explore.show(nodes, edges, argument, 1, limit)
    if verb == "query":
        return (data_queries.QUERIES | graph_queries.QUERIES)[argument](spark, tables)
    seed = explore.resolved(nodes, argument).withColumnRenamed("key", "seed")
    way = {"deps": edges, "rdeps": graph_queries.reverse(edges), "blast": traverse.both_ways(edges)}[verb]
    return traverse.walk(way, seed, depth, limit).select("ord", F.col("node").alias("key"), "depth", "via").orderBy("ord")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="graphlens", description=__doc__)
    parser.add_argument("verb", choices=VERBS)
    parser.add_argument("tables")
    parser.add_argument("argument", nargs="?")
    parser.add_argument("--depth", type=int, default=2)
    parser.add_argument("--limit", type=int, default=50)
    a = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    for row in answer(spark, a.verb, a.tables, a.argument, a.depth, a.limit).toJSON().toLocalIterator():
        print(row)


if __name__ == "__main__":
    main()

"""Results as text: flow charts, tables with numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chart_id(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")


def label(c: Column, longest: int = 40) -> Column:
    """A name, cut and ended by dots where it is too long."""
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest - 3), F.lit("..."))).otherwise(c)


def multiplicity(verb: Column, n: Column) -> Column:
    return F.when(n > 1, F.concat(verb, F.lit(" ("), n, F.lit(")"))).otherwise(verb)


def flow_chart(edges: DataFrame, by: str, src: str, dst: str, text: Column) -> DataFrame:
    """One chart for each value of ``by``: a line for each edge, in order of its ends."""
    line = F.concat(F.lit("  "), chart_id(F.col(src)), F.lit(" -->|"), text, F.lit("| "), chart_id(F.col(dst)))
    lines = edges.select(by, line.alias("line")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return lines.select(by, F.concat(F.lit("graph LR\n"), F.array_join("lines", "\n")).alias("chart"))


def excerpt(body: Column, first: Column, last: Column, longest: int = 50) -> Column:
    """Lines first to last of a text, at most ``longest``, each with its number."""
    n = F.greatest(F.least(last - first + 1, F.lit(longest)), F.lit(0))
    lines = F.slice(F.split(F.replace(body, F.lit("\r"), F.lit("")), "\n"), first, n)
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + first).cast("string"), 4, " "), F.lit(" | "), x)), "\n")


def excerpts(slices: DataFrame, files: DataFrame, longest: int = 50) -> DataFrame:
    """key, path, source and whether it is cut, for slices (key, path, first, last) and files (path, body); a file is read once for all its slices.

    Slices without lines give the beginning of their file; slices without a file have no row.
    """
    first = F.greatest(F.coalesce("first", F.lit(1)), F.lit(1))
    at = slices.join(files.select("path", "body").filter("body is not null"), "path").withColumn("_first", first)
    total = F.size(F.split("body", "\n"))
    at = at.withColumn("_last", F.least(F.coalesce("last", total), total))
    return at.select("key", "path", excerpt(F.col("body"), F.col("_first"), F.col("_last"), longest).alias("source"), (F.col("_last") - F.col("_first") + 1 > longest).alias("truncated"))


def state_chart(groups: DataFrame) -> DataFrame:
    """One chart of all groups (group_id, label, members): a node each, in order, with the number of its members. Of one report."""
    line = F.concat(F.lit("  "), chart_id(F.col("group_id")), F.lit('["'), label(F.col("label"), 50), F.when(F.col("members") > 1, F.concat(F.lit(" ("), F.col("members"), F.lit(")"))).otherwise(""), F.lit('"]'))
    return groups.agg(F.concat(F.lit("graph LR\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("chart"))

"""Edges between modules, functions and classes, inferred from extracted facts by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers by parts of a path in lower case, the first that is found; else util.
LAYERS = (
    ("api", ("/api/", "/routes/", "/endpoints/")),
    ("lambda", ("/lambda/", "/handlers/")),
    ("service", ("/service/", "/services/", "/domain/")),
    ("data", ("/data/", "/repository/", "/models/")),
    ("frontend", ("/components/", "/frontend/", "/src/app/")),
    ("infrastructure", ("/cloudformation/", "/infrastructure/")),
    ("recon", ("/recon/", "/rss/")),
    ("scripts", ("/scripts/",)),
    ("test", ("/tests/", "/test/")),
)


def module_id(path: Column) -> Column:
    """``module-`` and the path without extension, joined by dashes."""
    return F.concat(F.lit("module-"), F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "/", "-"))


def layer(path: Column) -> Column:
    """Layer of a module by its path."""
    low, out = F.lower(path), None
    for name, parts in LAYERS:
        hit = reduce(lambda x, y: x | y, [low.contains(part) for part in parts])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("util")


def resolve_relative(path: Column, target: Column) -> Column:
    """Path (without extension) that a relative import names, by path algebra."""
    folder = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    parts = F.concat(folder, F.split(F.regexp_replace(target, r"\.(js|ts|jsx|tsx|mjs)$", ""), "/"))
    step = lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolve_python(path: Column, target: Column) -> Column:
    """Path (without extension) that a Python import names: dotted from the root, or relative by leading dots."""
    dots = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(target, r"^\.+", ""), r"\.", "/")
    folder = F.split(path, "/")
    up = F.array_join(F.slice(folder, F.lit(1), F.greatest(F.size(folder) - dots, F.lit(0))), "/")
    return F.when(dots == 0, rest).otherwise(F.concat_ws("/", F.when(up != "", up), F.when(rest != "", rest)))


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Module → module for each import whose target is a file of the same repository.

    files: file_id, repo, path; imports: file_id, target.
    """
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    known = files.select("repo", stem.alias("stem"), F.col("path").alias("to_path")).distinct()
    from_ts = F.col("path").endswith(".ts")
    to = imports.join(files.select("file_id", "repo", "path").distinct(), "file_id").withColumn("stem", F.when(from_ts, resolve_relative(F.col("path"), F.col("target"))).otherwise(resolve_python(F.col("path"), F.col("target"))))
    return to.join(known, ["repo", "stem"]).filter("path <> to_path").select("repo", module_id(F.col("path")).alias("src"), module_id(F.col("to_path")).alias("dst")).distinct()


def call_edges(facts: DataFrame, strict: bool = True) -> DataFrame:
    """File → function for each call: to a function of the same file, else to the only file that has one of that name.

    facts: file_id, kind, name. ``strict`` false also takes names that several files define.
    """
    functions = facts.filter("kind = 'function'").select("file_id", "name").distinct()
    called = facts.filter("kind = 'call'").select("file_id", F.element_at(F.split("name", r"\."), -1).alias("name")).distinct()
    own = called.join(functions, ["file_id", "name"]).select("file_id", "name", F.col("file_id").alias("target_file"), F.lit("same_file").alias("how"))
    owners = functions.groupBy("name").agg(F.count("*").alias("n"))
    rest = called.join(functions, ["file_id", "name"], "left_anti").join(owners if not strict else owners.filter("n = 1"), "name").drop("n")
    far = rest.join(functions.select(F.col("file_id").alias("target_file"), "name"), "name").select("file_id", "name", "target_file", F.lit("unique_name").alias("how"))
    return own.unionByName(far)


def handler_edges(facts: DataFrame) -> DataFrame:
    """Endpoint → function of the same line of the same file."""
    e = facts.filter("kind = 'endpoint'").select("file_id", "line", F.col("name").alias("path"), F.col("detail").alias("method"))
    return e.join(facts.filter("kind = 'function'").select("file_id", "line", F.col("name").alias("function")), ["file_id", "line"])


def tags(files: DataFrame) -> DataFrame:
    """Tags of each file by its path and extension."""
    ext = F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)
    lang = F.when(ext == "py", "python").when(ext == "ts", "typescript").when(ext == "cs", "csharp").otherwise(ext)
    found = F.array_compact(F.array(F.concat(F.lit("layer:"), layer(F.col("path"))), F.when(lang != "", F.concat(F.lit("lang:"), lang)), F.when(F.lower("path").rlike(r"(^|/)tests?/|[._-](test|spec)[._]"), F.lit("test"))))
    return files.select("file_id", F.explode(found).alias("tag")).distinct()


def reverse_edges(edges: DataFrame) -> DataFrame:
    """The references back, a row each."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()

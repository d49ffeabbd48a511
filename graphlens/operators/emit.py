"""From the resources of repositories to workspace edges: deployments, invocations, consumers, channels, external systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.text import slug

#: Types of resources that run code; services of an SDK and the types of node that they reach.
FUNCTIONS = ("AWS::Lambda::Function", "AWS::Serverless::Function")
SERVICES = {"dynamodb": "AWS::DynamoDB::Table", "sqs": "AWS::SQS::Queue", "sns": "AWS::SNS::Topic", "s3": "AWS::S3::Bucket"}
#: Verb of the edge to what an SDK of a service reaches.
SDK_VERBS = {"dynamodb": "writes", "sqs": "publishes", "sns": "publishes", "s3": "writes"}


def node_id(kind: Column, repo: Column, name: Column) -> Column:
    """Id of a workspace node: type:repo:name, name and repository as slugs."""
    return F.concat_ws(":", kind, slug(repo), slug(name))


def nodes(resources: DataFrame) -> DataFrame:
    """node_id, repo, logical_id, type of the resources (repo, logical_id, type) of repositories."""
    return resources.select(node_id(F.element_at(F.split("type", "::"), -1), F.col("repo"), F.col("logical_id")).alias("node_id"), "repo", "logical_id", "type").dropna().distinct()


def _edges(df: DataFrame, src: str, dst: str, verb, confidence: str, evidence: Column) -> DataFrame:
    return df.filter(F.col(src) != F.col(dst)).select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.lit(verb) if isinstance(verb, str) else verb).alias("verb"), F.lit(confidence).alias("confidence"), evidence.alias("evidence")).distinct()


def _node(known: DataFrame, logical: str, out: str, *types: str) -> DataFrame:
    df = known.filter(F.col("type").isin(*types)) if types else known
    return df.select("repo", F.col("logical_id").alias(logical), F.col("node_id").alias(out), F.col("type").alias(f"{out}_type"))


def deploys(known: DataFrame, machines: DataFrame) -> DataFrame:
    """State machine → function for each reference of its definition. machines: repo, machine, function."""
    at = machines.join(_node(known, "machine", "src_node"), ["repo", "machine"]).join(_node(known, "function", "dst_node"), ["repo", "function"])
    return _edges(at, "src_node", "dst_node", "deploys_to", "high", F.concat(F.lit("definition:"), F.col("machine")))


def invokes(known: DataFrame, environment: DataFrame) -> DataFrame:
    """Function → function that a variable of its environment names. environment: repo, function, variable, target."""
    at = environment.join(_node(known, "function", "src_node", *FUNCTIONS), ["repo", "function"]).join(_node(known, "target", "dst_node", *FUNCTIONS), ["repo", "target"])
    return _edges(at, "src_node", "dst_node", "invokes", "high", F.concat(F.lit("env:"), F.col("variable")))


def consumes(known: DataFrame, triggers: DataFrame) -> DataFrame:
    """Function → source of its trigger, if that is a resource of the repository. triggers: repo, trigger, function, source."""
    at = triggers.join(_node(known, "function", "src_node", *FUNCTIONS), ["repo", "function"]).join(_node(known, "source", "dst_node"), ["repo", "source"])
    return _edges(at, "src_node", "dst_node", "consumes", "high", F.concat(F.lit("trigger:"), F.col("trigger")))


def accesses(known: DataFrame, usages: DataFrame, roots: DataFrame, environment: DataFrame) -> DataFrame:
    """Function → table, queue, topic or bucket which code below its root reaches by an SDK.

    usages: repo, path, service. roots: repo, function, root (folder of its code). The target is the variable of the function's
    environment that names a resource of the service's type; without one, the repository's only resource of that type, at medium confidence.
    Paths join roots by each of their folders, so no range of paths is compared with all roots.
    """
    parts = F.split("path", "/")
    folders = usages.select("repo", "path", F.lower("service").alias("service"), F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root")).distinct()
    of_service = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("service"))
    by = folders.join(roots.select("repo", "function", F.regexp_replace("root", "/+$", "").alias("root")).distinct(), ["repo", "root"]).withColumn("wanted", of_service(SERVICES)).withColumn("verb", of_service(SDK_VERBS))
    by = by.filter("wanted is not null").select("repo", "function", "service", "wanted", "verb").distinct().join(_node(known, "function", "src_node", *FUNCTIONS), ["repo", "function"])
    targets = environment.select("repo", "function", "target").distinct().join(_node(known, "target", "dst_node"), ["repo", "target"]).select("repo", "function", "dst_node", F.col("dst_node_type").alias("wanted"))
    direct = by.join(targets, ["repo", "function", "wanted"])
    sole = known.groupBy("repo", F.col("type").alias("wanted")).agg(F.count("*").alias("n"), F.min("node_id").alias("dst_node")).filter("n = 1").drop("n")
    guessed = by.join(targets, ["repo", "function", "wanted"], "left_anti").join(sole, ["repo", "wanted"])
    how = F.concat(F.lit("sdk:"), F.col("service"))
    return _edges(direct, "src_node", "dst_node", F.col("verb"), "high", how).unionByName(_edges(guessed, "src_node", "dst_node", F.col("verb"), "medium", how))


def substrings(c: Column, least: int) -> Column:
    """All distinct substrings of at least ``least`` characters."""
    n = F.length(c)
    cut = lambda i: F.transform(F.sequence(F.lit(least), n - i + 1), lambda k: F.substring(c, i, k))
    return F.when(n >= least, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n - least + 1), cut)))).otherwise(F.array().cast("array<string>"))


def contains_join(left: DataFrame, a: str, right: DataFrame, b: str, least: int = 3) -> DataFrame:
    """Rows of ``left`` and ``right`` where one of the texts a, b contains the other, which has at least ``least`` characters.

    An equi-join: each text gives its substrings, some hundreds for a name, and these join the other side's whole texts. So no row is
    compared with all others. Rows that match both ways come once.
    """
    l, r = left.withColumn("_l", F.monotonically_increasing_id()), right.withColumn("_r", F.monotonically_increasing_id())
    within = lambda big, c, small, s: big.withColumn("_t", F.explode(substrings(F.col(c), least))).join(small.withColumn("_t", F.col(s)), "_t").drop("_t")
    return within(l, a, r, b).unionByName(within(r, b, l, a)).dropDuplicates([*left.columns, *right.columns]).drop("_l", "_r")


def channels(known: DataFrame, triggers: DataFrame) -> DataFrame:
    """Topic or queue of a repository → service of another one whose trigger names it, or part of its name. triggers: repo, source_type, source."""
    refs = triggers.select(F.col("repo").alias("to_repo"), F.when(F.lower("source_type").contains("sns") | F.lower("source_type").contains("topic"), "Topic").when(F.lower("source_type").contains("sqs") | F.lower("source_type").contains("queue"), "Queue").alias("channel"), slug(F.col("source")).alias("ref")).dropna().distinct()
    own = known.select(F.col("node_id").alias("src_node"), F.col("repo").alias("from_repo"), F.element_at(F.split("type", "::"), -1).alias("channel_kind"), slug(F.col("logical_id")).alias("channel_name")).filter("channel_kind in ('Topic', 'Queue')")
    both = contains_join(refs, "ref", own, "channel_name").filter("channel = channel_kind and to_repo <> from_repo")
    both = both.withColumn("service", F.concat(F.lit("Service:"), slug(F.col("to_repo"))))
    return _edges(both, "src_node", "service", "publishes_to", "medium", F.concat_ws(" ", F.col("channel"), F.col("ref")))


def external(known: DataFrame, environment: DataFrame, systems: DataFrame) -> DataFrame:
    """Function → external system whose key is part of a variable's name or value, or one of whose patterns is part of the value.

    systems: key, url_patterns. Keys and patterns are whole texts of an equi-join with the substrings of names and values.
    """
    at = environment.join(_node(known, "function", "src_node", *FUNCTIONS), ["repo", "function"])
    marks = systems.select("key", F.lower("key").alias("mark"), F.lit(True).alias("is_key")).unionByName(systems.select("key", F.explode("url_patterns").alias("mark"), F.lit(False).alias("is_key")).withColumn("mark", F.lower("mark"))).filter("mark <> ''").distinct()
    text = lambda c, is_name: at.select("src_node", "variable", F.explode(substrings(F.lower(c), 2)).alias("mark"), F.lit(is_name).alias("is_name"))
    hit = text("variable", True).unionByName(text("target", False)).join(marks, "mark").filter("is_key or not is_name")
    hit = hit.withColumn("dst_node", F.concat(F.lit("ExternalSystem:"), slug(F.col("key"))))
    return _edges(hit, "src_node", "dst_node", "invokes", "high", F.concat(F.lit("env:"), F.col("variable")))


def strongest(edges: DataFrame) -> DataFrame:
    """One edge for each src, dst and verb: the highest confidence, and all that speaks for it, sorted."""
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).when(F.col("confidence").isNotNull(), 2).otherwise(3)
    return edges.groupBy("src", "dst", "verb").agg(F.min(F.struct(rank.alias("rank"), "confidence")).alias("c"), F.array_sort(F.collect_set("evidence")).alias("evidence")).select("src", "dst", "verb", "c.confidence", "evidence")


def backlinks(edges: DataFrame) -> DataFrame:
    """References on both ends of calls that are sure: key, direction, other."""
    sure = edges.filter("verb = 'calls' and confidence = 'high'")
    return sure.select(F.col("src").alias("key"), F.lit("references").alias("direction"), F.col("dst").alias("other")).unionByName(sure.select(F.col("dst").alias("key"), F.lit("referenced_by").alias("direction"), F.col("src").alias("other"))).distinct()


def unresolved(known: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Names (repo, ``name``) of what is wanted that are no resource of their repository."""
    return wanted.select("repo", name).dropna().distinct().join(known.select("repo", F.col("logical_id").alias(name)), ["repo", name], "left_anti")


def emit(resources: DataFrame, machines: DataFrame, environment: DataFrame, triggers: DataFrame, usages: DataFrame, roots: DataFrame, systems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a workspace from the resources of its repositories; every edge once, by its strongest evidence."""
    known = nodes(resources)
    of_type = triggers.select("repo", F.col("source_type"), "source")
    parts = [deploys(known, machines), invokes(known, environment), consumes(known, triggers), accesses(known, usages, roots, environment), channels(known, of_type), external(known, environment, systems)]
    return known, strongest(reduce(DataFrame.unionByName, parts))

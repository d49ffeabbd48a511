"""From facts to slices and edges: normalised elements, modules, import maps, calls, and the links between kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators import infer
from graphlens.operators.skew import salted_join

#: Domain and type of the slice that a fact of each kind becomes. Facts of other kinds make no slice of their own.
ELEMENTS = {
    "function": ("graph", "function"), "method": ("graph", "function"), "class": ("graph", "class"), "endpoint": ("api", "endpoint"), "model": ("data", "schema"),
    "resource": ("infrastructure", "resource"), "parameter": ("infrastructure", "parameter"), "output": ("infrastructure", "output"), "index": ("infrastructure", "gsi"), "trigger": ("infrastructure", "trigger"),
    "state_machine": ("infrastructure", "state_machine_definition"), "lambda_ref": ("infrastructure", "asl_lambda_ref"), "sdk": ("behavior", "aws_sdk_usage"), "env": ("behavior", "env_var_access"), "calls": ("behavior", "function_calls"),
    "component": ("frontend", "component"), "service": ("frontend", "service"), "pipe": ("frontend", "pipe"), "directive": ("frontend", "directive"), "guard": ("frontend", "guard"), "routes": ("frontend", "routes"), "template": ("frontend", "template"),
    "styles": ("frontend", "styles"), "tokens": ("frontend", "design-tokens"), "adr": ("architecture", "adr"), "invariant": ("architecture", "invariant"), "decision": ("architecture", "decision"), "capability": ("architecture", "capability"),
}
#: Class names that are no services of a program, though constructors name them.
BUILT_IN = frozenset("HttpClient Router ActivatedRoute Location Title Meta FormBuilder ElementRef Renderer2 ChangeDetectorRef NgZone Injector Store".split())


def union_facts(*parts: DataFrame) -> DataFrame:
    """Facts of all extractors as file_id, kind, name, line, detail, owner; columns that an extractor lacks are null."""
    columns = {"file_id": "long", "kind": "string", "name": "string", "line": "int", "detail": "string", "owner": "string"}
    one = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
    return reduce(DataFrame.unionByName, map(one, parts)).distinct()


def elements(facts: DataFrame, files: DataFrame) -> DataFrame:
    """key, domain, type, id, file_id, path, line, name of the slices that facts become; one row for each key, the first by line.

    files: file_id, repo, path. The id names path and element, methods by their class.
    """
    domain = F.create_map(*[F.lit(x) for k, (d, _) in ELEMENTS.items() for x in (k, d)])
    kind = F.create_map(*[F.lit(x) for k, (_, t) in ELEMENTS.items() for x in (k, t)])
    full = F.when(F.col("kind") == "method", F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))
    rows = facts.filter(F.col("kind").isin(*ELEMENTS)).join(files.select("file_id", "path").distinct(), "file_id")
    rows = rows.select(F.try_element_at(domain, F.col("kind")).alias("domain"), F.try_element_at(kind, F.col("kind")).alias("type"), "file_id", "path", "line", full.alias("name"))
    rows = rows.withColumn("id", F.concat(F.col("type"), F.lit(":"), F.col("path"), F.lit(":"), F.col("name"))).withColumn("key", F.concat_ws("/", "domain", "type", "id"))
    first = rows.groupBy("key", "domain", "type", "id", "path", "name").agg(F.min(F.struct("line", "file_id")).alias("at"))
    return first.select("key", "domain", "type", "id", "path", "name", "at.line", "at.file_id")


def modules(files: DataFrame, facts: DataFrame) -> DataFrame:
    """module_id, path, layer, and the sorted internal and external imports and exports of each file with a module.

    An import is internal if it begins with a dot or with src/. Lists are of one file.
    """
    inner = F.col("name").startswith(".") | F.col("name").startswith("src/")
    kept = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("name"))))
    per = facts.filter(F.col("kind").isin("import", "export")).groupBy("file_id").agg(
        kept((F.col("kind") == "import") & inner).alias("internal"), kept((F.col("kind") == "import") & ~inner).alias("external"), kept(F.col("kind") == "export").alias("exports")
    )
    none = F.array().cast("array<string>")
    return files.select("file_id", "path").distinct().join(per, "file_id", "left").select(
        infer.module_id(F.col("path")).alias("module_id"), "path", infer.layer(F.col("path")).alias("layer"), *[F.coalesce(c, none).alias(c) for c in ("internal", "external", "exports")]
    )


def import_map(facts: DataFrame) -> DataFrame:
    """file_id, local, target, name of the names that a file imports; of several imports of a name the last one counts."""
    named = facts.filter("kind = 'import' and detail is not null").select("file_id", F.coalesce("owner", "detail").alias("local"), "line", F.col("name").alias("target"), F.col("detail").alias("name"))
    return named.groupBy("file_id", "local").agg(F.max(F.struct("line", "target", "name")).alias("v")).select("file_id", "local", "v.target", "v.name")


def resolved_imports(imported: DataFrame, files: DataFrame) -> DataFrame:
    """``import_map`` with the file that each target names: file_id, local, name, to_file. files: file_id, repo, path."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    known = files.select("repo", stem.alias("stem"), F.col("file_id").alias("to_file")).distinct()
    at = imported.join(files.select("file_id", "repo", "path").distinct(), "file_id")
    at = at.withColumn("stem", F.when(F.col("path").endswith(".ts"), infer.resolve_relative(F.col("path"), F.col("target"))).otherwise(infer.resolve_python(F.col("path"), F.col("target"))))
    return at.join(known, ["repo", "stem"]).select("file_id", "local", "name", "to_file").distinct()


def calls(facts: DataFrame, files: DataFrame, called: str = "call", defined: str = "function") -> DataFrame:
    """Edges file_id, caller, name, to_file, how of calls (or constructions, or method calls) to what files define.

    In this order: defined in the same file; imported by that name; and, in files that import names but not this one, defined by exactly one file. A name
    that very many files define or call is split by file. ``how``: same_file, import or unique_name. Without a caller it is __module__.
    """
    own = facts.filter(F.col("kind") == defined).select("file_id", "name").distinct()
    use = facts.filter(F.col("kind") == called).select("file_id", F.element_at(F.split("name", r"\."), -1).alias("name"), F.coalesce("owner", F.lit("__module__")).alias("caller")).distinct()
    same = use.join(own, ["file_id", "name"]).withColumn("to_file", F.col("file_id")).withColumn("how", F.lit("same_file"))
    rest = use.join(own, ["file_id", "name"], "left_anti")
    resolved = resolved_imports(import_map(facts), files)
    by_import = rest.join(resolved.select("file_id", F.col("local").alias("name"), F.col("name").alias("real"), "to_file"), ["file_id", "name"])
    by_import = by_import.join(own.select(F.col("file_id").alias("to_file"), F.col("name").alias("real")), ["to_file", "real"], "left_semi").select("file_id", "name", "caller", "to_file").withColumn("how", F.lit("import"))
    mapped = import_map(facts)
    free = rest.join(mapped.select("file_id").distinct(), "file_id", "left_semi").join(mapped.select("file_id", F.col("local").alias("name")), ["file_id", "name"], "left_anti")
    unique = own.groupBy("name").agg(F.count("*").alias("n"), F.min("file_id").alias("to_file")).filter("n = 1").select("name", "to_file")
    far = salted_join(free, unique, "name", "inner", "file_id").select("file_id", "name", "caller", "to_file").withColumn("how", F.lit("unique_name"))
    columns = ("file_id", "caller", "name", "to_file", "how")
    return same.select(*columns).unionByName(by_import.select(*columns)).unionByName(far.select(*columns)).distinct()


def contained(facts: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """Element → module of its file: file_id, name, module_id."""
    return facts.filter(F.col("kind") == kind).select("file_id", "name").distinct().join(files.select("file_id", infer.module_id(F.col("path")).alias("module_id")).distinct(), "file_id")


def depends(templates: DataFrame) -> DataFrame:
    """Resource → resource, index → table and template → resource within one template: file_id, src, dst, verb."""
    of = lambda kind: templates.filter(F.col("kind") == kind)
    parts = (
        of("dependency").select("file_id", F.col("name").alias("src"), F.col("target").alias("dst"), F.lit("depends_on").alias("verb")),
        of("index").select("file_id", F.col("name").alias("src"), F.col("target").alias("dst"), F.lit("index_of").alias("verb")),
        of("resource").select("file_id", F.lit("template").alias("src"), F.col("name").alias("dst"), F.lit("declares").alias("verb")),
    )
    return reduce(DataFrame.unionByName, parts).distinct()


def handler_code(templates: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """Function of a template → function of a file: the handler a.b.f names f in a file whose path ends in a/b.py: file_id, name, to_file, function.

    Joined by the whole ending: each path gives one for each of its folders.
    """
    split = F.split("target", r"[./]")
    at = templates.filter("kind = 'handler'").select("file_id", "name", F.array_join(F.slice(split, 1, F.size(split) - 1), "/").alias("ending"), F.element_at(split, -1).alias("function"))
    parts = F.split(F.regexp_replace("path", r"\.[^./]+$", ""), "/")
    ends = files.filter("path rlike '[.](py|ts|js)$'").select(F.col("file_id").alias("to_file"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1 << 30), "/"))).alias("ending"))
    code = facts.filter("kind = 'function'").select(F.col("file_id").alias("to_file"), F.col("name").alias("function")).distinct()
    return at.join(ends.distinct(), "ending").join(code, ["to_file", "function"], "left_semi").select("file_id", "name", "to_file", "function").distinct()


def style_tokens(styles: DataFrame) -> DataFrame:
    """Style sheet → sheet that defines a variable it uses: file_id, to_file. styles: file_id, kind (defines, uses), name."""
    used = styles.filter("kind = 'uses'").select("file_id", "name").distinct()
    defined = styles.filter("kind = 'defines'").select(F.col("file_id").alias("to_file"), "name").distinct()
    return salted_join(used, defined, "name", "inner", "file_id").filter("file_id <> to_file").select("file_id", "to_file").distinct()


def requests(facts: DataFrame, endpoints: DataFrame) -> DataFrame:
    """HTTP request → endpoint with the same method whose path has the request's second segment: file_id, url, method, endpoint.

    endpoints: method, path. Joined by method and segment: each path gives one row for each of its segments.
    """
    segment = F.try_element_at(F.split("name", "/"), F.lit(3))
    at = facts.filter("kind = 'http'").select("file_id", F.col("name").alias("url"), F.upper("detail").alias("method"), F.coalesce(segment, F.try_element_at(F.split("name", "/"), F.lit(2))).alias("segment")).filter("segment <> ''")
    ends = endpoints.select(F.upper("method").alias("method"), F.col("path").alias("endpoint"), F.explode(F.array_distinct(F.split("path", "/"))).alias("segment")).distinct()
    return at.join(ends, ["method", "segment"]).select("file_id", "url", "method", "endpoint").distinct()


def injected(classes: DataFrame, uses: DataFrame) -> DataFrame:
    """Class → class that it has injected, built-in ones left out: src, dst. classes: name; uses: name (of the class), used (type name)."""
    wanted = uses.filter(~F.col("used").isin(*BUILT_IN) & (F.col("used") != F.col("name"))).select(F.col("name").alias("src"), F.col("used").alias("dst")).distinct()
    return wanted.join(classes.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def both_sides(edges: DataFrame) -> DataFrame:
    """Every reference on both of its ends: key, direction, other."""
    ahead = edges.select(F.col("src").alias("key"), F.lit("forward").alias("direction"), F.col("dst").alias("other"))
    return ahead.unionByName(edges.select(F.col("dst").alias("key"), F.lit("backward").alias("direction"), F.col("src").alias("other"))).distinct()


def by_equal_name(left: DataFrame, right: DataFrame, verb: str) -> DataFrame:
    """src, dst, verb of rows (key, name) with the same name: schemas and tables, templates and the components of their tags, routes and components or guards."""
    both = salted_join(left.select(F.col("key").alias("src"), "name").dropna().distinct(), right.select(F.col("key").alias("dst"), "name").dropna().distinct(), "name", "inner", "src")
    return both.filter("src <> dst").select("src", "dst", F.lit(verb).alias("verb")).distinct()


def controls(tagged: DataFrame, wanted: DataFrame) -> DataFrame:
    """Control → resource of the service that it is for: src, dst. tagged: key, tags; wanted: key, service."""
    at = tagged.select(F.col("key").alias("dst"), F.explode("tags").alias("tag")).distinct()
    return wanted.select(F.col("key").alias("src"), F.concat(F.lit("aws:"), F.lower("service")).alias("tag")).distinct().join(at, "tag").select("src", "dst").distinct()


def configured(configs: DataFrame, templates: DataFrame) -> DataFrame:
    """Configuration → template below its folder: src, dst. Both: key, path; the part ``parameters`` of a folder stands for none. Joined by each folder of a template."""
    folder = lambda c: F.regexp_replace(F.regexp_extract(c, "^(.*)/[^/]*$", 1), "(^|/)parameters(/|$)", "$1")
    parts = F.split("path", "/")
    above = templates.select(F.col("key").alias("dst"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n - 1), "/"))).alias("folder")).distinct()
    own = configs.select(F.col("key").alias("src"), F.regexp_replace(folder(F.col("path")), "/+$", "").alias("folder")).distinct()
    return own.join(above, "folder").select("src", "dst").distinct()


def named_files(uses: DataFrame, files: DataFrame) -> DataFrame:
    """Component → template or style sheet of a URL: src, file_id. uses: key, url; files: file_id, path. The file has the URL's last part as its name."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    return uses.select(F.col("key").alias("src"), last(F.col("url")).alias("name")).dropna().distinct().join(files.select("file_id", last(F.col("path")).alias("name")), "name").select("src", "file_id").distinct()


def behaviors(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Environment and SDK use → module of its file, with the tag that it gives: file_id, module_id, tag."""
    tag = F.when(F.col("kind") == "env", F.concat(F.lit("env:"), F.col("name"))).otherwise(F.concat(F.lit("aws:"), F.lower("name")))
    used = facts.filter(F.col("kind").isin("env", "sdk")).select("file_id", tag.alias("tag")).distinct()
    return used.join(files.select("file_id", infer.module_id(F.col("path")).alias("module_id")).distinct(), "file_id").select("file_id", "module_id", "tag")

"""Facts from source files by pattern: languages, imports, styles, templates, decision records, headings."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.ids import norm_id
from graphlens.session import ship


def unix(body: Column) -> Column:
    """Text with one kind of line end."""
    return F.replace(body, F.lit("\r"), F.lit(""))


def extension(path: Column) -> Column:
    return F.regexp_extract(norm_id(path), r"\.([A-Za-z]+)$", 1)


def classify(files: DataFrame) -> DataFrame:
    """file_id and kind of each file: by extension, YAML by its content."""
    ext, body = extension(F.col("file_path")), F.coalesce("body", F.lit(""))
    kind = (
        F.when(ext == "py", "python").when(ext == "ts", "typescript").when(ext == "cs", "csharp").when(ext.isin("css", "scss"), "css").when(ext == "json", "json")
        .when(ext.isin("yaml", "yml") & (body.contains("AWSTemplateFormatVersion") | body.contains("Type: AWS::")), "cloudformation")
        .when(ext.isin("yaml", "yml") & body.contains("adr_type:"), "adr-yaml").when(ext.isin("yaml", "yml"), "yaml").otherwise("unknown")
    )
    return files.select("file_id", kind.alias("kind")).distinct()


def of_kind(files: DataFrame, *extensions: str) -> DataFrame:
    return files.filter(extension(F.col("file_path")).isin(*extensions) & F.col("body").isNotNull()).select("file_id", norm_id("file_path").alias("path"), unix(F.col("body")).alias("body"))


def matches(files: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """file_id, path, name of each distinct match."""
    return files.select("file_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(pattern), F.lit(group)))).alias("name"))


def imports(files: DataFrame) -> DataFrame:
    """file_id, target, is_internal of the imports of Python and TypeScript files, by pattern: broken files give theirs too."""
    py, one = of_kind(files, "py"), r"[\w.]+(?:[ \t]+as[ \t]+\w+)?"
    listed = matches(py, rf"(?m)^[ \t]*import[ \t]+({one}(?:[ \t]*,[ \t]*{one})*)").select("file_id", "path", F.explode(F.split("name", ",")).alias("name"))
    parts = listed.select("file_id", "path", F.regexp_extract("name", r"([\w.]+)", 1).alias("name")).unionByName(matches(py, r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b"))
    ts = matches(of_kind(files, "ts"), r"""(?m)^[ \t]*import\s+(?:[^;'"()]*?\bfrom\s*)?['"]([^'"\n]+)['"]""")
    both = parts.unionByName(ts)
    return both.select("file_id", F.col("name").alias("target"), (F.col("name").startswith(".") | F.col("name").startswith("src/")).alias("is_internal")).distinct()


def styles(files: DataFrame) -> DataFrame:
    """file_id, kind, name of classes, variables defined and variables used in style sheets."""
    css = of_kind(files, "css")
    kinds = {"class": r"\.([A-Za-z_][\w-]*)(?=[^;{}]*\{)", "defines": r"(--[\w-]+)\s*:", "uses": r"var\((--[\w-]+)\)"}
    out = None
    for kind, pattern in kinds.items():
        one = matches(css, pattern).select("file_id", F.lit(kind).alias("kind"), "name")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def resources(files: DataFrame) -> DataFrame:
    """file_id, logical_id, resource_type of the resources of templates."""
    pattern = r"(?m)^  (\w+):\n    Type: (AWS::[\w:]+)"
    found = of_kind(files, "yaml", "yml").select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(pattern), F.lit(0)))).alias("m"))
    return found.select("file_id", F.regexp_extract("m", pattern, 1).alias("logical_id"), F.regexp_extract("m", pattern, 2).alias("resource_type"))


def decision_records(files: DataFrame) -> DataFrame:
    """file_id, adr_id, adr_type, status of decision records; those without id or type are none."""
    text = of_kind(files, "yaml", "yml")
    first = lambda p: F.regexp_extract("body", p, 1)
    return text.select("file_id", first(r"(?m)^id: (\S+)").alias("adr_id"), first(r"(?m)^adr_type: (\S+)").alias("adr_type"), first(r"(?m)^status: (\S+)").alias("status")).filter("adr_id <> '' and adr_type <> ''").distinct()


def decision_edges(files: DataFrame) -> DataFrame:
    """Relationships in decision records: record introduces decision, decision enables capability."""
    text = of_kind(files, "yaml", "yml").withColumn("adr_id", F.regexp_extract("body", r"(?m)^id: (\S+)", 1)).filter("adr_id <> ''")
    block = r"(?m)^  - id: (DEC-\d+)\n    summary: [^\n]*\n    enables: \[([^\]\n]*)\]"
    found = text.select("adr_id", F.explode(F.regexp_extract_all("body", F.lit(block), F.lit(0))).alias("m")).select("adr_id", F.regexp_extract("m", block, 1).alias("dec"), F.regexp_extract("m", block, 2).alias("caps"))
    introduces = found.select(F.col("adr_id").alias("src"), F.lit("introduces").alias("verb"), F.col("dec").alias("dst"))
    enables = found.select(F.col("dec").alias("src"), F.lit("enables").alias("verb"), F.explode(F.split("caps", ", *")).alias("dst"))
    return introduces.unionByName(enables.filter("dst <> ''")).distinct()


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, level, title of the headings of Markdown texts; lines of fenced code are none."""
    prose = unix(F.col("text"))
    for fence in ("```", "~~~"):
        prose = F.regexp_replace(prose, rf"(?ms)^[ \t]*{fence}.*?(?:^[ \t]*{fence}[^\n]*$|\z)", "")
    lines = docs.select("doc_id", F.explode(F.split(prose, "\n")).alias("line")).filter(F.col("line").rlike("^#{1,6} +[^ ]"))
    return lines.select("doc_id", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.regexp_extract("line", "^#+ +(.*?) *$", 1).alias("title")).distinct()


def links(docs: DataFrame) -> DataFrame:
    """doc_id, url of the web addresses in texts."""
    return docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(https?://[A-Za-z0-9_./#?=&%-]+)"), F.lit(1)))).alias("url")).distinct()


#: Decorator methods that declare routes.
_ROUTES = frozenset("get post put delete patch options head".split())


def _python_facts(body: str) -> list[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(body)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
    out: list[tuple] = []

    def dotted(node) -> str:
        return f"{dotted(node.value)}.{node.attr}" if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else "?"

    def text(node) -> str | None:
        return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None

    for node in ast.walk(tree):
        line = getattr(node, "lineno", None)
        if isinstance(node, ast.Import):
            out += [("import", a.name, line, a.asname) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [("import", f"{'.' * node.level}{node.module or ''}", line, a.name) for a in node.names]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("function", node.name, line, ",".join(a.arg for a in node.args.args)))
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and (path := text(d.args[0])) is not None:
                    if d.func.attr in _ROUTES:
                        out.append(("endpoint", path, line, d.func.attr.upper()))
                    elif d.func.attr == "route":
                        methods = next(([text(x) or "?" for x in k.value.elts] for k in d.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple))), ["GET"])
                        out += [("endpoint", path, line, m) for m in methods]
                if isinstance(d, ast.Call) and dotted(d.func) in ("implements_adr", "enforces_invariant"):
                    out += [("intent", a, line, dotted(d.func)) for x in d.args if (a := text(x)) is not None]
        elif isinstance(node, ast.ClassDef):
            fields = [x.target.id for x in node.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
            out.append(("class", node.name, line, ",".join(dotted(b) for b in node.bases)))
            if fields:
                out.append(("model", node.name, line, ",".join(fields)))
        elif isinstance(node, ast.Call):
            name = dotted(node.func)
            if name in ("os.getenv", "os.environ.get") and node.args and (key := text(node.args[0])) is not None:
                out.append(("env", key, line, None))
            elif name.endswith((".client", ".resource")) and node.args and (service := text(node.args[0])) is not None:
                out.append(("sdk", service, line, name))
            out.append(("call", name, line, None))
        elif isinstance(node, ast.Subscript) and dotted(node.value) == "os.environ" and (key := text(node.slice)) is not None:
            out.append(("env", key, line, None))
    return out


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(f, *fact) for f, body in zip(pdf["file_id"], pdf["body"]) for fact in _python_facts(body)]
        yield pd.DataFrame(rows, columns=["file_id", "kind", "name", "line", "detail"])


def python_facts(files: DataFrame) -> DataFrame:
    """Imports, functions, classes, models, endpoints, environment, SDK use, calls and declared intent of Python files.

    file_id, kind, name, line, detail; files that do not parse give none. Runs in the tasks that scan.
    """
    ship(files.sparkSession)
    rows = of_kind(files, "py").select("file_id", "body")
    return rows.mapInPandas(_facts, "file_id long, kind string, name string, line int, detail string")

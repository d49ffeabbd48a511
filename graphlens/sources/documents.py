"""Facts from C#, component frameworks, style sheets, JSON, decision records and Markdown, file by file."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.ids import norm_id
from graphlens.functions.text import glob_pattern
from graphlens.session import ship
from graphlens.sources import templates
from graphlens.sources.extract import of_kind
from graphlens.sources.typescript import _matching, tokens

SCHEMA = "file_id long, kind string, name string, line int, detail string, owner string"

_CS_SKIP = re.compile(r'//[^\n]*|/\*.*?\*/|@"(?:[^"]|"")*"|\$?"(?:[^"\\\n]|\\.)*"', re.S)
_CS_CLASS = re.compile(r"\bclass\s+(\w+)(?:<[^>]*>)?\s*(?::\s*([^{]+?))?\s*(?:where[^{]*)?\{")
_CS_ROUTE = re.compile(r'\[Route\("([^"]*)"\)\]')
_CS_VERB = re.compile(r'\[Http(Get|Post|Put|Delete|Patch|Head|Options)(?:\("([^"]*)"[^)]*\))?\]')
_CS_ACTION = re.compile(r"(?:public|private|protected|internal)\s+(?:async\s+)?[\w<>\[\]?,\s]+?\s+(\w+)\s*\(")
_CS_SERVICE = re.compile(r"\.Add(Singleton|Scoped|Transient)<\s*(\w+)\s*(?:,\s*(\w+)\s*)?>")


def csharp(text: str) -> Iterator[tuple]:
    """Classes with their bases, routes of controllers (prefix and verb) with their actions, registered services."""
    # What is blanked keeps its place: comments, and for classes strings too; routes are in strings.
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    plain, code = _CS_SKIP.sub(lambda m: blank(m) if m[0].startswith("/") else m[0], text), _CS_SKIP.sub(blank, text)
    line = lambda at: plain.count("\n", 0, at) + 1
    spaces = re.findall(r"\bnamespace\s+([\w.]+)", plain)
    classes = list(_CS_CLASS.finditer(code))
    for k, m in enumerate(classes):
        bases = [b.strip() for b in (m[2] or "").split(",") if b.strip()]
        yield "class", m[1], line(m.start()), ",".join(bases) or None, spaces[0] if spaces else None
        before = plain[classes[k - 1].end() if k else 0 : m.start()]
        prefix = _CS_ROUTE.findall("\n".join(before.splitlines()[-5:]))
        if not prefix or not any("Controller" in b for b in bases):
            continue
        body = plain[m.end() : classes[k + 1].start() if k + 1 < len(classes) else len(plain)]
        for v in _CS_VERB.finditer(body):
            after = body[v.end() : v.end() + 600]
            own = v[2] or next(iter(_CS_ROUTE.findall("\n".join(after.splitlines()[:3]))), "")
            path = prefix[-1] + (f"/{own}" if own else "")
            action = _CS_ACTION.search(after)
            yield "endpoint", path.replace("[controller]", re.sub("Controller$", "", m[1]).lower()), line(m.end() + v.start()), v[1].upper(), f"{m[1]}.{action[1] if action else '?'}"
    for m in _CS_SERVICE.finditer(plain):
        yield "registration", m[2], line(m.start()), m[1].lower(), m[3] or m[2]


#: Class decorators of a component framework and the kind of slice that each makes; methods of an interface that make a class a guard.
DECORATORS = {"Component": "component", "Injectable": "service", "Pipe": "pipe", "Directive": "directive"}
GUARDS = frozenset("CanActivate CanActivateChild CanDeactivate CanLoad CanMatch Resolve".split())


def _options(toks: list, at: int) -> dict[str, str]:
    """Texts of the members of the object literal at ``at``: strings as they are, lists joined by commas."""
    out, end, k = {}, _matching(toks, at), at + 1
    while k < end:
        if toks[k][0] in ("name", "string") and k + 1 < end and toks[k + 1][1] == ":":
            stop = k + 2
            while stop < end and toks[stop][1] != ",":
                stop = _matching(toks, stop) + 1 if toks[stop][1] in "([{" else stop + 1
            out[toks[k][1].strip("'\"")] = ",".join(t[1].strip("'\"`") for t in toks[k + 2 : stop] if t[0] in ("string", "name", "number"))
            k = stop
        k += 1
    return out


def components(text: str) -> Iterator[tuple]:
    """Components, services, pipes, directives, guards and routes of a TypeScript file, with what they have injected, take in and give out."""
    toks = tokens(text)
    word = lambda k: toks[k][1] if 0 <= k < len(toks) else ""
    decorated: tuple[str, dict] | None = None
    for k, (kind, value, line) in enumerate(toks):
        if value == "@" and word(k + 1) in DECORATORS and word(k + 2) == "(":
            decorated = word(k + 1), _options(toks, k + 3) if word(k + 3) == "{" else {}
        elif value == "class" and kind == "name" and k + 1 < len(toks) and toks[k + 1][0] == "name":
            name = word(k + 1)
            start = next((j for j in range(k, len(toks)) if word(j) == "{"), len(toks))
            end = _matching(toks, start)
            head = {word(j) for j in range(k + 2, start)}
            if GUARDS & head:
                yield "guard", name, line, ",".join(sorted(GUARDS & head)), None
            if decorated:
                what, options = decorated
                label = options.get("selector") or options.get("name") or options.get("providedIn")
                if not GUARDS & head:
                    yield DECORATORS[what], name, line, label, None
                for key in ("templateUrl", "styleUrls", "styleUrl", "imports"):
                    for part in filter(None, options.get(key, "").split(",")):
                        yield {"templateUrl": "template_url", "imports": "uses"}.get(key, "style_url"), part, line, None, name
            for j in range(start, end):
                if word(j) in ("@",) and word(j + 1) in ("Input", "Output") and word(j + 2) == "(":
                    at = _matching(toks, j + 2) + 1
                    while word(at) in ("public", "readonly", "set", "get", "override"):
                        at += 1
                    yield word(j + 1).lower(), word(at), toks[j][2], None, name
                elif word(j) == "constructor" and word(j + 1) == "(":
                    close = _matching(toks, j + 1)
                    for i in range(j + 2, close):
                        if word(i) == ":" and i + 1 < close and toks[i + 1][0] == "name":
                            yield "injects", word(i + 1), toks[i][2], word(i - 1), name
                elif word(j) == "inject" and word(j + 1) == "(" and j + 2 < end and toks[j + 2][0] == "name":
                    yield "injects", word(j + 2), toks[j][2], None, name
            decorated = None
        elif value == "{" and word(k + 1) == "path" and word(k + 2) == ":":
            options = _options(toks, k)
            yield "route", options["path"], line, options.get("component") or options.get("loadComponent") or options.get("loadChildren"), options.get("canActivate")
        elif kind == "name" and re.fullmatch(r"\w*[gG]uard", value) and word(k - 1) in ("const", "function") and (word(k + 1) in ("=", ":", "(")):
            yield "guard", value, line, "function", None


_TAG = re.compile(r"<([a-z][\w-]*-[\w-]*)\b|\s\*([a-zA-Z]+)=|@(if|for|switch|defer)\b|\[\(?([a-zA-Z]\w*)\)?\]=|\|\s*([a-z]\w*)")


def html(text: str) -> Iterator[tuple]:
    """Child components, structural directives, bindings and pipes of a template, each once."""
    plain, seen = re.sub(r"<!--.*?-->", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S), set()
    for m in _TAG.finditer(plain):
        fact = next((kind, m[g]) for g, kind in ((1, "child"), (2, "directive"), (3, "directive"), (4, "binding"), (5, "pipe")) if m[g])
        if fact not in seen:
            seen.add(fact)
            yield *fact, plain.count("\n", 0, m.start()) + 1, None, None


def css(text: str) -> Iterator[tuple]:
    """Classes (with parts by & in nested rules), variables defined and used, media queries, states and animations of a style sheet; comments and strings do not count."""
    plain = re.sub(r"/\*.*?\*/|//[^\n]*(?=\n|$)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    line = lambda at: plain.count("\n", 0, at) + 1
    for m in re.finditer(r"([^{};]*)\{", plain):
        if not m[1].strip().startswith("@"):
            for c in re.finditer(r"\.([A-Za-z_][\w-]*)|&(__|--)([\w-]+)", m[1]):
                yield "css_class", c[1] or c[2] + c[3], line(m.start(1) + c.start()), None, None
            for c in re.finditer(r"(?<!:):([a-z-]+)", m[1]):
                yield "state", c[1], line(m.start(1) + c.start()), None, None
    for pattern, kind in ((r"(--[\w-]+)\s*:\s*([^;}]*)", "defines"), (r"var\(\s*(--[\w-]+)()", "uses"), (r"(?m)^\s*(\$[\w-]+)\s*:\s*([^;]+);", "scss_variable"), (r"@media\s+([^{]+?)\s*()\{", "media"), (r"@keyframes\s+([\w-]+)()", "animation")):
        for m in re.finditer(pattern, plain):
            yield kind, m[1], line(m.start()), m[2].strip() or None, None
            if kind == "scss_variable" and ("breakpoint" in m[1] or "screen" in m[1]):
                yield "breakpoint", m[1], line(m.start()), m[2].strip(), None


_ARN = re.compile(r"arn:aws[\w-]*:lambda:[^:]*:[^:]*:function:([\w-]+)")


def state_machine(text: str) -> Iterator[tuple]:
    """A state machine and the functions that its states call; nested branches and maps too. Other JSON gives nothing."""
    try:
        doc = json.loads(text)
    except (ValueError, RecursionError):
        return
    if not isinstance(doc, dict) or not isinstance(doc.get("States"), dict):
        return
    yield "state_machine", "root", 0, doc.get("StartAt") if isinstance(doc.get("StartAt"), str) else None, None
    todo, seen = [doc], set()
    while todo:
        states = todo.pop().get("States")
        for name, state in states.items() if isinstance(states, dict) else ():
            if not isinstance(state, dict):
                continue
            todo += [x for x in [*(state.get("Branches") or []), state.get("Iterator"), state.get("ItemProcessor")] if isinstance(x, dict)]
            resource = state.get("Resource") if isinstance(state.get("Resource"), str) else ""
            call = (state.get("Parameters") or {}).get("FunctionName") if isinstance(state.get("Parameters"), dict) else None
            found = _ARN.findall(resource)
            if "lambda:invoke" in resource and isinstance(call, str) and ".$" not in call:
                found += _ARN.findall(call) or ([call] if ":" not in call else [])
            for ref in found:
                if ref not in seen:
                    seen.add(ref)
                    yield "lambda_ref", ref, 0, str(name), None


#: Lists of a decision record and the kind of each of their entries.
CHILDREN = {"invariants": "invariant", "decisions": "decision", "capabilities": "capability", "component_specifications": "component", "systems": "system", "rejected_alternatives": "rejection", "rules": "rule"}
#: Lists of ids in a record or an entry, and the relationship that each makes.
LINKS = {"related_adrs": "references", "supersedes": "supersedes", "implements": "implements", "implements_logical": "implements", "enables": "enables", "enforces": "enforces", "governs": "governs", "depends_on": "depends_on", "enforces_invariants": "enforces"}
_TYPES = frozenset("logical physical physical-system physical-component".split())


def decision_record(text: str) -> Iterator[tuple]:
    """A decision record in YAML with its entries and links: adr, one row for each entry (owner the record), link rows (detail the relationship, owner its source).

    Records without id or of an unknown type give nothing.
    """
    if templates.yaml is None:
        return
    try:
        doc = templates.yaml.load(text, Loader=templates._Loader)
    except (templates.yaml.YAMLError, ValueError, RecursionError):
        return
    if not isinstance(doc, dict) or not isinstance(doc.get("id"), str) or doc.get("adr_type") not in _TYPES:
        return
    adr = doc["id"]
    yield "adr", adr, 1, str(doc.get("status")), str(doc["adr_type"])

    def links(entry: dict, source: str) -> Iterator[tuple]:
        for key, verb in LINKS.items():
            for target in entry.get(key) if isinstance(entry.get(key), list) else ():
                if isinstance(target, str):
                    yield "link", target, 1, verb, source

    yield from links(doc, adr)
    for key, kind in CHILDREN.items():
        for entry in doc.get(key) if isinstance(doc.get(key), list) else ():
            ident = (entry.get("id") or entry.get("component_id")) if isinstance(entry, dict) else entry
            if isinstance(ident, str):
                yield kind, ident, 1, str(entry.get("summary") or entry.get("name") or "") or None if isinstance(entry, dict) else None, adr
                yield from links(entry, ident) if isinstance(entry, dict) else ()


_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)


def markdown(text: str) -> Iterator[tuple]:
    """Headings with their level, ids of records, and links to other documents; code blocks do not count."""
    plain = _FENCE.sub(lambda m: re.sub(r"[^\n]", "", m[0]), text)
    for n, row in enumerate(plain.splitlines(), 1):
        if m := re.match(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", row):
            yield "heading", m[2], n, str(len(m[1])), None
        for m in re.finditer(r"\[([^\]]*)\]\(([^)\s#]+)[^)]*\)", row):
            yield "external_link" if re.match(r"[a-z]+:", m[2]) else "internal_link", m[2], n, m[1] or None, None
        for m in re.finditer(r"\b(?:ADR-[A-Z]+-\d+|INV-\d+|DEC-\d+|CAP-\d+)\b", row):
            yield "mention", m[0], n, None, None


def _runner(read: Callable[[str], Iterator[tuple]]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(f, *fact) for f, body in zip(pdf["file_id"], pdf["body"]) for fact in read(body)]
            yield pd.DataFrame(found, columns=["file_id", "kind", "name", "line", "detail", "owner"])

    return rows


#: Extensions that each reader takes.
READERS = {"csharp": (csharp, ("cs",)), "components": (components, ("ts",)), "html": (html, ("html", "htm")), "css": (css, ("css", "scss")), "state_machine": (state_machine, ("json",)), "decision_record": (decision_record, ("yaml", "yml")), "markdown": (markdown, ("md",))}


def document_facts(files: DataFrame, reader: str) -> DataFrame:
    """file_id, kind, name, line, detail, owner of what one reader finds in its files. Null bodies give none; broken texts what can be read."""
    ship(files.sparkSession)
    read, extensions = READERS[reader]
    return of_kind(files, *extensions).select("file_id", "body").mapInPandas(_runner(read), SCHEMA)


#: Parts of a path that say what a JSON file is for.
JSON_KINDS = (("control", ("/controls/", "/controls-catalog/")), ("schema", ("/schemas/", "/schema/")), ("config", ("/parameters/", "/params/")), ("reference", ("/seed-data/", "/reference/")))


def json_kind(path: Column, globs: dict[str, list[str]] | None = None) -> Column:
    """What a JSON file is for: by globs given for control, schema or config, else by its folders; null if it says nothing."""
    out = None
    for kind, patterns in (globs or {}).items():
        for p in patterns:
            out = F.when(path.rlike(glob_pattern(p)), kind) if out is None else out.when(path.rlike(glob_pattern(p)), kind)
    for kind, parts in JSON_KINDS:
        for part in parts:
            out = F.when(path.contains(part), kind) if out is None else out.when(path.contains(part), kind)
    return out


def json_records(files: DataFrame, globs: dict[str, list[str]] | None = None) -> DataFrame:
    """file_id, kind, key, value of the members at the top of JSON files with a purpose, values as JSON; parsed in the JVM. Other files give none."""
    rows = of_kind(files, "json").withColumn("kind", json_kind(F.concat(F.lit("/"), F.col("path")), globs)).filter("kind is not null")
    members = F.from_json(F.to_json(F.try_parse_json("body")), "map<string,string>")
    return rows.select("file_id", "kind", F.explode(members).alias("key", "value"))


#: Files and folders that tell of a framework or of a part of a project.
PROJECT_MARKS = (("framework", "angular", r"(^|/)angular\.json$"), ("framework", "node", r"(^|/)package\.json$"), ("framework", "python", r"(^|/)(pyproject\.toml|setup\.py|requirements[^/]*\.txt)$"), ("framework", "dotnet", r"\.(csproj|sln)$"), ("framework", "serverless", r"(^|/)(serverless|samconfig|template)\.(ya?ml|toml)$"),
                 ("domain", "frontend", r"(^|/)(frontend|components|ui|web)/"), ("domain", "api", r"(^|/)(api|routes|handlers|controllers)/"), ("domain", "data", r"(^|/)(data|models|repository|schemas?)/"), ("domain", "infrastructure", r"(^|/)(infra|infrastructure|cloudformation|terraform)/"), ("domain", "testing", r"(^|/)tests?/"))


def project_structure(files: DataFrame) -> DataFrame:
    """repo, mark (framework, domain, language, root), name, n_files: what the paths of a repository tell of it."""
    at = files.select("repo", norm_id("file_path").alias("path")).dropna().distinct()
    marks = F.array_compact(F.array(*[F.when(F.col("path").rlike(p), F.struct(F.lit(mark).alias("mark"), F.lit(name).alias("name"))) for mark, name, p in PROJECT_MARKS],
                                    F.struct(F.lit("language").alias("mark"), F.regexp_extract("path", r"\.([A-Za-z]+)$", 1).alias("name")), F.struct(F.lit("root").alias("mark"), F.element_at(F.split("path", "/"), 1).alias("name"))))
    return at.select("repo", F.explode(marks).alias("m")).groupBy("repo", "m.mark", "m.name").agg(F.count("*").alias("n_files")).filter("name <> ''")

"""The manifest of a workspace, its repositories and what each is read with: small files, read by the driver."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:
    yaml = None

#: Names under which a manifest is looked for; folders of sources by language, and the endings of each language.
NAMES = ("workspace.yaml", "workspace.yml")
SOURCE_DIRS = {"python": ("src", "app", "lib"), "typescript": ("src", "lib", "packages"), "csharp": ("src",), "cloudformation": ("cloudformation", "infrastructure", "templates"), "json": ("schemas", "controls", "parameters"), "css": ("src", "styles")}
ENDINGS = {"python": ("py",), "typescript": ("ts", "tsx"), "csharp": ("cs",), "cloudformation": ("yaml", "yml", "json"), "json": ("json",), "css": ("css", "scss"), "angular": ("ts", "html"), "adr-yaml": ("yaml",), "markdown": ("md",)}


def find_root(start: str) -> Path | None:
    """The nearest folder, from ``start`` upwards, with a manifest; null if there is none."""
    at = Path(start).resolve()
    return next((folder for folder in (at, *at.parents) if any((folder / name).is_file() for name in NAMES)), None)


def parse_manifest(text: str) -> dict:
    """schema_version, output_dir, repos and external_systems of a manifest, with defaults; a repository without a name or a double one is an error."""
    if yaml is None:
        raise RuntimeError("manifests need a YAML library")
    doc = yaml.safe_load(text)
    if not isinstance(doc, dict) or not isinstance(doc.get("repos"), list) or not doc["repos"]:
        raise ValueError("a manifest lists repos")
    repos, seen = [], set()
    for r in doc["repos"]:
        name = r.get("name") if isinstance(r, dict) else r
        if not isinstance(name, str) or not name.strip() or name in seen:
            raise ValueError(f"repository {name!r} has no name or a double one")
        seen.add(name)
        spec = r if isinstance(r, dict) else {}
        langs = spec.get("lang") or []
        repos.append({"name": name, "path": spec.get("path") or f"./{name}", "kind": spec.get("kind") or "application", "lang": [langs] if isinstance(langs, str) else list(langs)})
    systems = [{"key": e["key"], "name": e.get("name") or e["key"], "kind": e.get("kind") or "service", "url_patterns": list(e.get("url_patterns") or [])} for e in doc.get("external_systems") or [] if isinstance(e, dict) and e.get("key")]
    return {"schema_version": str(doc.get("schema_version", "1.0")), "output_dir": doc.get("output_dir") or ".workspace", "repos": repos, "external_systems": systems}


def repo_config(root: str, repo: dict) -> dict:
    """What a repository is read with: its languages (all if it names none), folders of sources that exist (else all of it) and endings."""
    base = Path(root, repo["path"])
    languages = [x for x in repo.get("lang") or ENDINGS if x in ENDINGS]
    dirs = sorted({d for x in languages for d in SOURCE_DIRS.get(x, ()) if (base / d).is_dir()}) or ["."]
    return {"name": repo["name"], "root": str(base), "languages": languages, "source_dirs": dirs, "endings": sorted({e for x in languages for e in ENDINGS[x]})}


def repos(spark: SparkSession, manifest: dict) -> DataFrame:
    """The repositories of a manifest as rows."""
    return spark.createDataFrame([(r["name"], r["path"], r["kind"], r["lang"]) for r in manifest["repos"]], "name string, path string, kind string, lang array<string>")


def external_systems(spark: SparkSession, manifest: dict) -> DataFrame:
    """The external systems of a manifest as rows."""
    return spark.createDataFrame([(e["key"], e["name"], e["kind"], e["url_patterns"]) for e in manifest["external_systems"]], "key string, name string, kind string, url_patterns array<string>")


def jsdoc(comment: str) -> dict:
    """description, params (name, type, text), returns and other tags of a documentation comment."""
    import re

    lines = [re.sub(r"^\s*\*?\s?", "", x) for x in re.sub(r"^/\*\*|\*/$", "", comment.strip()).splitlines()]
    parts, current = {"description": "", "params": [], "returns": None, "tags": []}, []
    blocks: list[tuple[str, list[str]]] = [("description", current)]
    for x in lines:
        if m := re.match(r"@(\w+)\s*(.*)", x):
            current = [m[2]]
            blocks.append((m[1], current))
        else:
            current.append(x)
    for tag, body in blocks:
        text = " ".join(filter(None, (b.strip() for b in body)))
        if tag == "description":
            parts["description"] = text
        elif tag in ("param", "arg", "argument"):
            m = re.match(r"(?:\{([^}]*)\}\s*)?\[?([\w.$]+)[^\]\s]*\]?\s*-?\s*(.*)", text)
            parts["params"].append((m[2], m[1], m[3]) if m else (text, None, ""))
        elif tag in ("returns", "return"):
            parts["returns"] = re.sub(r"^\{[^}]*\}\s*", "", text)
        else:
            parts["tags"].append((tag, text))
    return parts

"""Facts from infrastructure templates, read by a YAML parser: resources, dependencies, endpoints, tables, triggers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.session import ship
from graphlens.sources.extract import of_kind

try:
    import yaml
except ImportError:  # templates give no facts then
    yaml = None

#: Types of an event of a serverless function, and the kind of its source.
EVENT_SOURCES = {"SQS": "Queue", "SNS": "Topic", "DynamoDB": "Stream", "Kinesis": "Stream", "S3": "Bucket", "Api": "Endpoint", "HttpApi": "Endpoint", "Schedule": "Schedule", "ScheduleV2": "Schedule", "EventBridgeRule": "Rule", "CloudWatchEvent": "Rule"}
#: Properties of an event that name its source.
_SOURCE_KEYS = ("Queue", "Topic", "Stream", "Bucket", "EventSourceArn", "Schedule", "ScheduleExpression")
_SUB = re.compile(r"\$\{([A-Za-z0-9]+)[^}]*\}")
_MAIN = "file_id long, kind string, name string, type string, target string, detail string"

if yaml is not None:

    class _Loader(yaml.SafeLoader):
        """YAML whose short tags become the long form of functions; dates stay text."""

    def _function(loader, suffix, node):
        value = loader.construct_scalar(node) if isinstance(node, yaml.ScalarNode) else loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else loader.construct_mapping(node, deep=True)
        return {suffix if suffix in ("Ref", "Condition") else f"Fn::{suffix}": value}

    _Loader.add_multi_constructor("!", _function)
    _Loader.add_constructor("tag:yaml.org,2002:timestamp", lambda loader, node: loader.construct_scalar(node))


def load(text: str) -> dict | None:
    """A template as a mapping; null if the text is none, or no template."""
    if yaml is None:
        return None
    try:
        doc = yaml.load(text, Loader=_Loader)  # noqa: S506  (a subclass of the safe loader)
    except (yaml.YAMLError, ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) and isinstance(doc.get("Resources"), dict) else None


def references(value) -> Iterator[str]:
    """Names that functions within a value refer to."""
    if isinstance(value, dict):
        for key, inner in value.items():
            if key == "Ref" and isinstance(inner, str):
                yield inner
            elif key == "Fn::GetAtt":
                first = inner.split(".")[0] if isinstance(inner, str) else inner[0] if isinstance(inner, list) and inner else None
                if isinstance(first, str):
                    yield first
            elif key == "Fn::Sub":
                yield from _SUB.findall(inner if isinstance(inner, str) else inner[0] if isinstance(inner, list) and inner and isinstance(inner[0], str) else "")
                if isinstance(inner, list):
                    yield from references(inner[1:])
            else:
                yield from references(inner)
    elif isinstance(value, list):
        for inner in value:
            yield from references(inner)


def _one(value) -> str | None:
    """A value as it is, or the one name it refers to."""
    return value if isinstance(value, str) else next(references(value), None)


def _api_path(resources: dict, name: str | None) -> str:
    """Full path of an API resource, by its chain of parents; a cycle ends it."""
    parts, seen = [], set()
    while name in resources and name not in seen and resources[name].get("Type") == "AWS::ApiGateway::Resource":
        seen.add(name)
        props = resources[name].get("Properties") or {}
        parts.append(str(props.get("PathPart", "")))
        name = _one(props.get("ParentId"))
    return "/" + "/".join(reversed(parts))


def facts(text: str) -> list[tuple]:
    """(kind, name, type, target, detail) of everything that a template declares."""
    doc = load(text)
    if doc is None:
        return []
    resources = {str(k): v for k, v in doc["Resources"].items() if isinstance(v, dict) and isinstance(v.get("Type"), str)}
    out: list[tuple] = []
    for name, spec in (doc.get("Parameters") or {}).items():
        spec = spec if isinstance(spec, dict) else {}
        out.append(("parameter", str(name), spec.get("Type"), None, None if spec.get("Default") is None else str(spec["Default"])))
    for name, spec in (doc.get("Outputs") or {}).items():
        spec = spec if isinstance(spec, dict) else {}
        out.append(("output", str(name), None, _one(spec.get("Value")), _one((spec.get("Export") or {}).get("Name")) if isinstance(spec.get("Export"), dict) else None))
    for name, spec in resources.items():
        kind, props = spec["Type"], spec.get("Properties") if isinstance(spec.get("Properties"), dict) else {}
        out.append(("resource", name, kind, None, None))
        needs = spec.get("DependsOn") or []
        explicit = [needs] if isinstance(needs, str) else [x for x in needs if isinstance(x, str)]
        for target in dict.fromkeys([*explicit, *references(props)]):
            if target in resources and target != name:
                out.append(("dependency", name, "explicit" if target in explicit else "reference", target, None))
        for key, value in props.items():
            if isinstance(value, (str, int, float, bool)):
                out.append(("property", name, kind, str(key), str(value)))
        out += _of_type(resources, name, kind, props)
    return [tuple(None if x is None else str(x) for x in row) for row in out]


def _of_type(resources: dict, name: str, kind: str, props: dict) -> list[tuple]:
    out: list[tuple] = []
    listed = lambda v: [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []
    if kind in ("AWS::Lambda::Function", "AWS::Serverless::Function"):
        if isinstance(props.get("Handler"), str):
            out.append(("handler", name, kind, props["Handler"], _one(props.get("CodeUri") or props.get("Code"))))
        for key, value in ((props.get("Environment") or {}).get("Variables") or {}).items() if isinstance(props.get("Environment"), dict) else ():
            out.append(("environment", name, str(key), _one(value), None))
        for event, spec in (props.get("Events") or {}).items() if isinstance(props.get("Events"), dict) else ():
            if not isinstance(spec, dict) or spec.get("Type") not in EVENT_SOURCES:
                continue
            own = spec.get("Properties") if isinstance(spec.get("Properties"), dict) else {}
            if spec["Type"] in ("Api", "HttpApi"):
                path = str(own.get("Path", "/"))
                path = path if path.startswith("/") else f"/{path}"
                out.append(("endpoint", path, str(own.get("Method", "ANY")).upper(), name, "serverless"))
                source = path
            else:
                source = next((s for k in _SOURCE_KEYS if (s := _one(own.get(k)))), None)
            out.append(("trigger", str(event), EVENT_SOURCES[spec["Type"]], name, source))
    elif kind == "AWS::Lambda::EventSourceMapping":
        source = _one(props.get("EventSourceArn"))
        out.append(("trigger", name, resources.get(source, {}).get("Type", "EventSource"), _one(props.get("FunctionName")), source))
    elif kind == "AWS::Events::Rule":
        out += [("trigger", name, "Rule", _one(t.get("Arn")), _one(props.get("ScheduleExpression")) or name) for t in listed(props.get("Targets")) if _one(t.get("Arn"))]
    elif kind == "AWS::ApiGateway::Method" and str(props.get("HttpMethod", "")).upper() != "OPTIONS":
        target = next((r for r in references(props.get("Integration")) if resources.get(r, {}).get("Type") == "AWS::Lambda::Function"), None)
        out.append(("endpoint", _api_path(resources, _one(props.get("ResourceId"))), str(props.get("HttpMethod", "ANY")).upper(), target, "v1"))
    elif kind == "AWS::ApiGatewayV2::Route":
        route = str(props.get("RouteKey", ""))
        verb, _, path = route.partition(" ")
        method, path = ("WEBSOCKET", route) if route.startswith("$") else (verb.upper(), path) if path else ("ANY", route)
        out.append(("endpoint", path, method, next(references(props.get("Target")), None), "v2"))
    elif kind in ("AWS::DynamoDB::Table", "AWS::Serverless::SimpleTable"):
        keys = [f"{k.get('AttributeName')}:{k.get('KeyType')}" for k in listed(props.get("KeySchema"))]
        attributes = {str(a.get("AttributeName")): str(a.get("AttributeType")) for a in listed(props.get("AttributeDefinitions"))}
        detail = {"attributes": attributes, "keys": keys, "billing": props.get("BillingMode", "PROVISIONED"), "stream": bool(props.get("StreamSpecification"))}
        out.append(("model", name, kind, _one(props.get("TableName")), json.dumps(detail, sort_keys=True)))
        for group, label in (("GlobalSecondaryIndexes", "gsi"), ("LocalSecondaryIndexes", "lsi")):
            for x in listed(props.get(group)):
                out.append(("index", str(x.get("IndexName")), label, name, ",".join(f"{k.get('AttributeName')}:{k.get('KeyType')}" for k in listed(x.get("KeySchema")))))
    elif kind == "AWS::CloudFormation::Stack":
        out.append(("stack", name, kind, _one(props.get("TemplateURL")), json.dumps(props.get("Parameters") or {}, sort_keys=True, default=str)))
    return out


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(f, *fact) for f, body in zip(pdf["file_id"], pdf["body"]) for fact in facts(body)]
        yield pd.DataFrame(rows, columns=["file_id", "kind", "name", "type", "target", "detail"])


def template_facts(files: DataFrame) -> DataFrame:
    """file_id, kind, name, type, target, detail of what templates (YAML or JSON) declare.

    Kinds: resource, dependency (explicit or by reference, within the template), parameter, output, property, handler,
    environment, endpoint (type is the method), trigger, model, index, stack. Texts that do not parse, or are no templates, give none; null
    bodies give none. Only texts that name Resources are parsed, in the tasks that scan.
    """
    ship(files.sparkSession)
    rows = of_kind(files, "yaml", "yml", "json", "template").filter(F.col("body").contains("Resources")).select("file_id", "body")
    return rows.mapInPandas(_rows, _MAIN)

"""A JSON Schema (2020-12) of rule documents, for editors.

What a schema can't say (patterns, captures, names that are used twice, whole
numbers in plain digits, ranges) is left to the loader.
``python -m ruleloom.rule_schema`` prints it; ``rules.schema.json`` is a copy.
"""

from __future__ import annotations

import json
from typing import Any

from ruleloom.config import DEPENDENCY_TYPES, MOST_INT, NOT_IN_ALLOWED, SCOPES, SEVERITIES

Schema = dict[str, Any]


def closed(properties: Schema, *required: str, **more: Any) -> Schema:
    """An object with these fields and no others."""
    return {"type": "object", "properties": properties, "additionalProperties": False} | ({"required": list(required)} if required else {}) | more


def listed(item: Schema) -> Schema:
    return {"type": "array", "items": item, "minItems": 1}


def without(*names: str) -> Schema:
    return {"properties": dict.fromkeys(names, False)}


def rule_schema() -> Schema:
    patterns, types = {"$ref": "#/$defs/patterns"}, {"$ref": "#/$defs/types"}
    paths = {"path": patterns, "pathNot": patterns}
    named = {"name": {"type": "string", "minLength": 1, "not": {"const": NOT_IN_ALLOWED}}, "comment": {"type": "string"}}
    counted = {"orphan": {"type": "boolean"}, "numberOfDependentsLessThan": {"type": "integer", "minimum": 1, "maximum": MOST_INT}, "numberOfDependentsMoreThan": {"type": "integer", "minimum": 0, "maximum": MOST_INT}}
    typed = {"dependencyTypes": types, "dependencyTypesNot": types}
    severity = {"enum": list(SEVERITIES)}
    far = {"reachable": {"type": "boolean"}, "reachableFilePathNot": patterns, "moreUnstable": {"const": True}}
    target = closed(
        paths | typed | far,
        dependentRequired={"reachable": ["path"], "reachableFilePathNot": ["reachable"]},
        allOf=[
            {"if": {"required": ["reachable"]}, "then": without(*typed, "moreUnstable")},
            {"if": {"required": ["moreUnstable"]}, "then": {"properties": {"dependencyTypes": {"contains": {"const": "local"}}, "dependencyTypesNot": {"not": {"contains": {"const": "local"}}}}}},
        ],
    )
    folder = {"if": {"properties": {"scope": {"const": "folder"}}, "required": ["scope"]}, "then": {"properties": {"from": without("orphan", "packageName"), "to": without(*typed, "reachable", "reachableFilePathNot")}}}
    source = closed(paths | {"packageName": patterns} | counted)
    defs = {
        "patterns": listed({"type": "string"}),
        "types": listed({"enum": list(DEPENDENCY_TYPES)}),
        "forbidden": closed(named | {"severity": severity, "scope": {"enum": list(SCOPES)}, "from": source, "to": target}, "name", "from", "to", allOf=[folder]),
        "required": closed(named | {"severity": severity, "from": closed(paths | {"packageName": patterns}), "to": closed(paths | typed, minProperties=1)}, "name", "from", "to"),
        "allowed": closed(named | {"from": source, "to": closed(paths | typed)}, "name", "from", "to"),
    }
    lists = {k: {"type": "array", "items": {"$ref": f"#/$defs/{k}"}} for k in ("forbidden", "required", "allowed")}
    head = {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Dependency rules"}
    return head | closed(lists | {"allowedSeverity": severity}) | {"$defs": defs}


def text() -> str:
    return json.dumps(rule_schema(), indent=2) + "\n"


if __name__ == "__main__":
    print(text(), end="")

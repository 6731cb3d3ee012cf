"""The schema against the loader. ``fits`` knows the keywords in use."""

import json
import os

import pytest

import ruleloom
from ruleloom import queries
from ruleloom.config import from_dict
from ruleloom.rule_schema import rule_schema, text
from tests.test_config import REJECTED

TYPES = {"object": dict, "array": list, "string": str, "boolean": bool}
#: What only the loader can tell.
LOADER = ("duplicate field", "another rule", "regular expression", "plain digits", "over 2 and under 3", "captured", "capture", "the first", "in brackets", "has 0 groups", "reachable is false", "not a name", "from.path", "not ${1}")


def fits(value, schema, root):
    if isinstance(schema, bool):
        return schema
    if "$ref" in schema:
        at = root
        for name in schema["$ref"].removeprefix("#/").split("/"):
            at = at[name]
        if not fits(value, at, root):
            return False
    kind = schema.get("type")
    if kind == "integer" and (isinstance(value, bool) or not isinstance(value, int)) or kind in TYPES and not isinstance(value, TYPES[kind]):
        return False
    tests = ["const" not in schema or value == schema["const"], "enum" not in schema or value in schema["enum"], "not" not in schema or not fits(value, schema["not"], root)]
    tests += [fits(value, s, root) for s in schema.get("allOf", ())]
    if "if" in schema and fits(value, schema["if"], root):
        tests.append(fits(value, schema["then"], root))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        tests += [fits(v, known[k], root) if k in known else schema.get("additionalProperties", True) for k, v in value.items()]
        tests += [k in value for k in schema.get("required", ())] + [len(value) >= schema.get("minProperties", 0)]
        tests += [n in value for k, names in schema.get("dependentRequired", {}).items() if k in value for n in names]
    if isinstance(value, list):
        tests += [fits(v, schema.get("items", True), root) for v in value] + [len(value) >= schema.get("minItems", 0)]
        tests.append("contains" not in schema or any(fits(v, schema["contains"], root) for v in value))
    if isinstance(value, str):
        tests.append(len(value) >= schema.get("minLength", 0))
    if isinstance(value, int) and not isinstance(value, bool):
        tests.append(schema.get("minimum", value) <= value <= schema.get("maximum", value))
    return all(tests)


def test_the_copy_is_current():
    with open(os.path.join(os.path.dirname(ruleloom.__file__), "rules.schema.json")) as f:
        assert f.read() == text()


@pytest.mark.parametrize("document,path,message", REJECTED)
def test_rejected_by_both(document, path, message):
    if any(x in message for x in LOADER):
        pytest.skip("only the loader can tell")
    assert not fits(json.loads(document), rule_schema(), rule_schema())


def test_accepted_by_both():
    documents = [queries.WHOLE, queries.BASELINE_DOCUMENT, {"allowed": []}, {"allowed": queries.ALLOWED, "allowedSeverity": "error"}, {"required": [queries.REQUIRED, queries.REQUIRED_CAPTURE]}]
    documents += [{"forbidden": [r]} for r in (queries.REACH_PLAIN, queries.UNREACH_PLAIN, queries.UNSTABLE_FOLDER, queries.UNSTABLE_MODULE, queries.FOLDER_DEPENDENTS, queries.ORPHAN, queries.NOT_TYPES, queries.OWN_KEY)]
    for d in documents:
        assert from_dict(d) and fits(d, rule_schema(), rule_schema())

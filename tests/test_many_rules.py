"""What patterns ask for, templates with captures, and documents of many rules."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ruleloom import config as rules
from ruleloom.functions import literals
from ruleloom.functions.re2 import compile_re2, compile_template, expand
from ruleloom.plans import index
from ruleloom.plans.rules import evaluate, template_matches
from tests import trees
from tests.trees import M, relations


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("^cmd/", "cmd/"), (r"^a\.b-c", "a.b-c"), ("^ab*", "a"), ("^ab?c", "a"), ("^ab+", "a"), ("^ab{2}", "a"), ("a", ""), ("^a|b", ""), ("^(a|b)c", ""), ("^a(b|c)", "a"), ("^a[b|c]", "a"), ("(?i)^a", ""), ("^a(?i)b", "a"), ("(?m)^a", ""), ("^", ""), ("^é\U0001f600x", "é\U0001f600x"), (r"^a\|b", "a|b"), (r"^\Qa|b", "a|b"), (r"^a\x41", "aA"), ("^a$", "a"), (r"^a\pL", "a"), (r"^[\]|]|b", "")],
)
def test_prefix(pattern, want):
    assert literals.prefix(compile_re2(pattern).java) == want


@pytest.mark.parametrize(
    ("template", "want"),
    [("^a/$1$", (("a/", 1, ""), True, True)), ("$1", (("", 1, ""), False, False)), ("^$2-$1", (("", 2, "-", 1, ""), True, False)), (r"x\.$1$", (("x.", 1, ""), False, True)), ("^a(?:/$1)?$", None), ("^[0-9]*$1$", None), ("(?i)a$1", None), ("a$1*", None), (r"^$1\\z", (("", 1, r"\z"), True, False)), ("a|$1", None), ("^$1|a$", None)],
)
def test_plain(template, want):
    found = literals.plain(compile_template(template))
    assert (found and (found.parts, found.first, found.last)) == want


def test_antichain():
    assert literals.antichain(["ab", "a", "b/c", "b", "b", "bc", "c"]) == ["a", "b", "c"]


TEMPLATES = ["^a/$1$", "^a/$1", "$1", "$1$", "^x[0-9]*$1$", "^(?:a|$1)b", "a|^$1$", "(?i)^$1", "$2$1", r"\b$1\b", "^$1*b", "(?m)^$1$", r"^\Qa.\E$1", "(?s)a.$1", "^(a)$2(b)$1$", "$1+$", r"$1\\z", r"^$1\.", "[^a]$1", "^.?$1$2.?$"]


def test_templates_match_as_expanded_patterns(spark):
    """The same answers as RE2 with the captures written into the pattern."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["a", "b", "a/", ".", "A", "\n", "*", "$", "\\", "1", "é", "x", "\U0010ffff"]) for _ in range(rng.randrange(4)))
    rows = []
    for _ in range(260):
        c1, c2 = word(), word()
        rows += [(c1, c2, rng.choice(["", "a/", "x12", "a", "b", "a."]) + rng.choice([c1, c2 + c1, c1 + "b", c1 + c1, word()]) + rng.choice(["", "", "b", "x"]))]
    df = spark.createDataFrame(rows, "c1 string, c2 string, t string")
    found = F.array("c1", "c2")
    got = df.select("*", *(template_matches(F.col("t"), (compile_template(x),), found).alias(f"m{i}") for i, x in enumerate(TEMPLATES))).collect()
    for i, x in enumerate(TEMPLATES):
        for r in got:
            want = duckdb.execute("SELECT regexp_matches(?, ?)", [r.t, expand(x, ["", r.c1, r.c2])]).fetchone()[0]
            assert r[f"m{i}"] == want, (x, r)


def found(spark, tree, document):
    files, imports = relations(spark, tree)
    rows = evaluate(rules.from_dict(document), files, imports).collect()
    return sorted((r["rule"], r["severity"], r["from"]["path"], r["from"]["line"], r["to"]["path"] if r["to"] else "") for r in rows)


def many(n, seed):
    """Rules of all shapes with prefixes that nest, repeat and are missing."""
    rng = random.Random(seed)
    sources = ["^recipes/", "^recipes/bread", "^run/", "^(shop|oven)/", "bread", "^recipes/|^oven/", "^flour", "^", r"^recipes/cake/cake\.go$", "(?i)^OVEN"]
    targets = ["^oven", "^oven/heat$", "^flour$", "fmt", "^cellar|^fixtures", "^fixtures$", "^os$", "^$1", "^(?:$1|oven)/"]
    out = []
    for i in range(n):
        source = {"path": rng.sample(sources, rng.randrange(1, 3))} if rng.random() < 0.8 else {}
        path = rng.sample(targets[:7], rng.randrange(1, 3))
        if rng.random() < 0.2:
            source, path = {"path": ["^([a-z]+)/"]}, rng.sample(targets, 2)
        target = {"path": path}
        kind = rng.choice(["edge", "edge", "folder", "source", "reach"])
        more = {"scope": "folder"} if kind == "folder" else {}
        if kind == "source":
            source, target = source | {"numberOfDependentsMoreThan": 0}, {}
        if kind == "reach":
            target |= {"reachable": True}
        out.append({"name": f"r{i:03d}", "severity": rng.choice(["error", "info"]), "from": source, "to": target} | more)
    return out


def test_many_rules_equal_few_at_a_time(spark, monkeypatch):
    document = many(120, 3)
    got = found(spark, trees.BAKERY, {"forbidden": document})
    monkeypatch.setattr(index, "TOGETHER", 1000)
    assert got and got == found(spark, trees.BAKERY, {"forbidden": document})


def test_many_required_rules(spark, monkeypatch):
    tree = [(f"svc/s{i}/a.go", f"s{i}", [(3, f"{M}/log/l{i % 5}"), (4, "fmt")]) for i in range(12)]
    document = {"required": [{"name": f"q{i:02d}", "from": {"path": [f"^svc/s{i % 13}/", f"^svc/s1{i % 3}"]}, "to": {"path": [f"^log/l{i % 4}$"]}} for i in range(40)]}
    got = found(spark, tree, document)
    monkeypatch.setattr(index, "TOGETHER", 1000)
    assert got and got == found(spark, tree, document)


def test_many_rules_scan_once(spark):
    """As many scans and joins for 120 rules as for one, but for the index."""
    files, imports = relations(spark, trees.BAKERY)
    document = [{"name": f"r{i}", "from": {"path": ["^recipes/"]}, "to": {"path": [f"^oven{i}"]}} for i in range(120)]
    plan = lambda n: evaluate(rules.from_dict({"forbidden": document[:n]}), files, imports)._jdf.queryExecution().optimizedPlan().toString()
    one, all_ = plan(1), plan(120)
    assert all_.count("LogicalRDD") + all_.count("LocalRelation") == one.count("LogicalRDD") + one.count("LocalRelation") + 1
    assert all_.count("Join") == one.count("Join") + 1 and all_.count("Union") == 0


def test_chosen(spark):
    tests = [F.lit(i) for i in range(37)]
    rows = spark.range(37).select("id", index.chosen(F.col("id"), tests).alias("x")).collect()
    assert all(r.id == r.x for r in rows)

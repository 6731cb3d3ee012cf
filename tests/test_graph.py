import random

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import closure
from ruleloom.operators.graph import Graph
from ruleloom.operators.resolve import check_module_path, cleaned, dependency_type, resolved_path
from tests.trees import own, relations

TREE = [
    ("cmd/app/main.go", "main", own("internal/a")),
    ("internal/a/one.go", "a", own("internal/b", "internal/b", "internal/missing")),
    ("internal/a/two.go", "a", own("internal/c")),
    ("internal/b/b.go", "b", own("internal/c")),
    ("internal/c/c.go", "c", []),
    ("internal/lonely/l.go", "lonely", []),
    ("internal/self/s.go", "self", own("internal/self")),
]


@pytest.fixture(scope="module")
def graph(spark):
    return Graph(*relations(spark, TREE))


def names(df):
    return {r[0].removeprefix("internal/") for r in df.collect()}


def test_degrees(graph):
    degree = {r.package_path.removeprefix("internal/"): (r.fan_in, r.fan_out) for r in graph.stability.collect()}
    assert degree == {"cmd/app": (0, 1), "a": (1, 3), "b": (1, 1), "c": (2, 0), "lonely": (0, 0), "missing": (1, 0), "self": (0, 0)}
    value = {r.package_path: r.instability for r in graph.instability.collect()}
    assert (value["internal/a"], value["internal/self"], value["internal/c"]) == (0.75, 0.0, 0.0)
    assert names(graph.imported) == {"a", "b", "c", "missing", "self"}
    assert names(graph.packages) == {"cmd/app", "a", "b", "c", "lonely", "self"}
    assert [r[0] for r in graph.dependents("internal/c").collect()] == ["internal/a", "internal/b"]
    assert [r[0] for r in graph.dependencies("internal/a").collect()] == ["internal/b", "internal/c", "internal/missing"]


def test_closures(spark, graph):
    seed = lambda *s: spark.createDataFrame([("", x) for x in s], "root string, node string")
    reach = lambda edges, s: {r.node.removeprefix("internal/") for r in closure.forward_closure(edges, s, graph.nodes).collect()}
    assert reach(graph.edges, seed("internal/a")) == {"a", "b", "c", "missing"}
    assert reach(graph.edges, seed("internal/unknown")) == set()
    assert reach(graph.edges_without(~F.col("path").endswith("two.go")), seed("internal/a")) == {"a", "c"}
    back = closure.reverse_closure(graph.edges, seed("internal/c"), graph.nodes)
    assert {r.node.removeprefix("internal/") for r in back.collect()} == {"cmd/app", "a", "b", "c"}


def search(pairs, seeds):
    """(root, node) by depth-first search."""
    out = set(seeds)
    stack = list(seeds)
    while stack:
        root, node = stack.pop()
        for a, b in pairs:
            if a == node and (root, b) not in out:
                out.add((root, b))
                stack.append((root, b))
    return sorted(out)


def test_fixpoint_against_search(spark, monkeypatch):
    monkeypatch.setattr(closure, "ROUNDS", 5)
    rng = random.Random(3)
    for n, m in ((12, 20), (25, 30), (12, 11)):
        pairs = {(f"p{rng.randrange(n)}", f"p{rng.randrange(n)}") for _ in range(m)} if m != 11 else {(f"p{i}", f"p{i + 1}") for i in range(11)}
        edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
        seeds = [(f"r{i}", f"p{i}") for i in range(0, n, 5)]
        got = closure.reachable(edges, spark.createDataFrame(seeds * 2, "root string, node string"))
        assert sorted(map(tuple, got.collect())) == search(pairs, seeds)


def test_resolver(spark):
    cases = [
        ("example.com/acme/app", "fmt", "fmt", "stdlib"), ("example.com/acme/app", "net/http", "net/http", "stdlib"), ("example.com/acme/app", "example.com/acme/app", ".", "local"),
        ("example.com/acme/app", "example.com/acme/app/internal/report", "internal/report", "local"), ("example.com/acme/app", "example.com/acme/application/report", "example.com/acme/application/report", "module"),
        ("acme/project", "acme/project/report", "report", "local"), ("example.com/acme/app", "corp/internal", "corp/internal", "stdlib"), ("a.b", "C", "", "unresolved"), ("a.b", "", "", "unresolved"),
    ]
    for module, path, want, kind in cases:
        df = spark.createDataFrame([(path,)], "p string").select(resolved_path(F.col("p"), module), dependency_type(F.col("p"), module))
        assert tuple(df.first()) == (want, kind)
    for bad in ("", " a", "a/", "a\n"):
        with pytest.raises(ValueError):
            check_module_path(bad)


def test_cleaned(spark):
    cases = {"": "", ".": ".", "a/b": "a/b", "a//b": "a/b", "./a": "a", "a/": "a", "a/../b": "b", "a/..": ".", "../a": "../a", "/..": "/", "/a/./b/": "/a/b", "a/b/../../..": "..", "..a/b": "..a/b", "a/.b": "a/.b"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", cleaned(F.col("p"))).collect()
    assert {r[0]: r[1] for r in rows} == cases

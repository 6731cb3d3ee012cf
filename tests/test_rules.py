"""Rules over small trees, and the traps of their semantics."""

import pytest

from ruleloom import config as rules
from ruleloom.plans.rules import ORDER, evaluate, ordered
from tests import trees
from tests.trees import M, own, relations


def forbid(name, source, target, **more):
    return {"name": name, "severity": "error", "from": source, "to": target} | more


def found(spark, tree, document):
    """(rule, from path, line, to path or None) of each violation, in order."""
    files, imports = relations(spark, tree)
    rows = ordered(evaluate(rules.from_dict(document), files, imports)).collect()
    return [(r["rule"], r["from"]["path"], r["from"]["line"], r["to"]["path"] if r["to"] else None) for r in rows]


LOCAL = {"dependencyTypes": ["local"]}
PLAIN = {"reachableFilePathNot": [r"_test\.go$"]}
CORPUS = [
    (trees.BAKERY, {"forbidden": [forbid("a", {"path": ["^recipes/"], "pathNot": [r"rye\.go$"]}, {"path": ["^oven(?:/|$)"]} | LOCAL)]}, [("a", "recipes/bread/bread.go", 4, "oven/heat")]),
    (trees.BAKERY, {"forbidden": [forbid("f", {"path": ["^recipes/", "^shop/till$"]}, {"path": ["^oven", "^fixtures$"]}, scope="folder")]}, [("f", "recipes/bread", 0, "oven/heat"), ("f", "shop/till", 0, "fixtures"), ("f", "shop/till", 0, "oven")]),
    (trees.HINGE, {"forbidden": [forbid("m", {}, {"moreUnstable": True}), forbid("f", {}, {"moreUnstable": True}, scope="folder")]}, [("f", "hinge", 0, "pins"), ("m", "hinge/hinge.go", 4, "pins")]),
    (trees.BAKERY, {"forbidden": [forbid("few", {"path": [r"^(flour|oven)/[a-z]+\.go$"], "numberOfDependentsLessThan": 2}, {}), forbid("hub", {"path": ["^flour/"], "numberOfDependentsMoreThan": 2}, {})]}, [("few", "oven/oven.go", 1, None)]),
    (trees.BAKERY, {"forbidden": [forbid("o", {"orphan": True}, {})]}, [("o", "attic/box.go", 1, None), ("o", "shop/stand.go", 1, None)]),
    (trees.BAKERY, {"forbidden": [forbid("p", {"pathNot": ["^run/"], "packageName": ["^main$"]}, {})]}, [("p", "shop/stand.go", 1, None)]),
    (trees.BAKERY, {"forbidden": [forbid("t", {"path": [r"till\.go$"]}, {"path": ["^cellar$"], "reachable": True}), forbid("n", {"path": [r"till\.go$"]}, {"path": ["^cellar$"], "reachable": True} | PLAIN)]}, [("t", "shop/till/till.go", 3, "cellar")]),
    (trees.BAKERY, {"required": [{"name": "q", "severity": "error", "from": {"path": ["^recipes/"]}, "to": {"path": ["^flour$"]} | LOCAL}]}, [("q", "recipes/bread/rye.go", 1, None)]),
    (trees.GATES, {"forbidden": [forbid("c", {"path": ["^gate/x(y?)/", "^gate/([a-z]+)/"]}, {"path": ["^house(?:/$1)?$"]})]}, [("c", "gate/north/a.go", 3, "house/north"), ("c", "gate/north/a.go", 5, "house"), ("c", "gate/x/x.go", 3, "house")]),
    (trees.BAKERY, {"allowed": [{"name": "k", "from": {"path": ["^recipes/"]}, "to": LOCAL}, {"name": "rest", "from": {"pathNot": ["^recipes/"]}, "to": {}}], "allowedSeverity": "error"}, [("not-in-allowed", "recipes/cake/cake.go", 3, "fmt")]),
    (trees.BAKERY, {"forbidden": [forbid("u", {"path": ["^run/"]}, {"path": ["^(flour|cellar|attic)$"], "reachable": False} | PLAIN), forbid("v", {"path": ["^run/"]}, {"path": ["^(flour|cellar|attic)$"], "reachable": False}), forbid("w", {"path": ["^oven/"]}, {"path": ["^flour$"], "reachable": False} | PLAIN)]}, [("u", "attic/box.go", 1, None), ("u", "cellar/cellar.go", 1, None), ("v", "attic/box.go", 1, None), ("w", "flour/flour.go", 1, None), ("w", "flour/mill_test.go", 1, None)]),
]


@pytest.mark.parametrize("case", range(len(CORPUS)))
def test_corpus(spark, case):
    tree, document, want = CORPUS[case]
    assert found(spark, tree, document) == want


def test_reach_rules_may_ask_for_facts(spark):
    to = {"path": ["^cellar$"], "reachable": True}
    rules_ = [forbid("few", {"path": ["^recipes/"], "numberOfDependentsLessThan": 1}, to), forbid("some", {"path": ["^recipes/"], "numberOfDependentsMoreThan": 0}, to), forbid("alone", {"orphan": True}, to)]
    assert found(spark, trees.BAKERY, {"forbidden": rules_}) == [("few", "recipes/cake/cake.go", 4, "cellar"), ("some", "recipes/bread/bread.go", 3, "cellar")]


def test_targets_with_captures_are_reached(spark):
    """What a capture names can't be dropped before files are joined."""
    tree = [("a/one/x.go", "one", own("hub")), ("a/two/x.go", "two", own("hub")), ("hub/hub.go", "hub", own("z/one", "z/two")), ("z/one/z.go", "one", []), ("z/two/z.go", "two", [])]
    rules_ = [forbid("c", {"path": ["^a/([a-z]+)/"]}, {"path": ["^z/$1$"], "reachable": True}), forbid("d", {"path": ["^a/one/"]}, {"path": ["^z/"], "pathNot": ["^z/two$"], "reachable": True})]
    assert found(spark, tree, {"forbidden": rules_}) == [("c", "a/one/x.go", 3, "z/one"), ("c", "a/two/x.go", 3, "z/two"), ("d", "a/one/x.go", 3, "z/one")]


def test_nothing_is_made_distinct(spark):
    tree = [("a/a.go", "a", [(3, "fmt"), (3, "fmt"), (4, "fmt")])]
    assert len(found(spark, tree, {"forbidden": [forbid("x", {"path": ["a", "^a/"]}, {"path": ["fmt", "^f"]})]})) == 3


def test_own_package_and_seeds_are_reachable(spark):
    tree = [("a/a_test.go", "a_test", own("a")), ("a/a.go", "a", own("b")), ("b/b.go", "b", [])]
    rule = forbid("x", {"path": ["^a/a_test"]}, {"path": [".*"], "reachable": True})
    assert found(spark, tree, {"forbidden": [rule]}) == [("x", "a/a_test.go", 3, "a"), ("x", "a/a_test.go", 3, "b")]


def test_unreachable_without_seeds_is_everything(spark):
    rule = forbid("x", {"path": ["^none/"]}, {"path": ["^(flour|oven)"], "reachable": False})
    assert len(found(spark, trees.BAKERY, {"forbidden": [rule]})) == 4


def test_cycle_and_least_line(spark):
    tree = [("a/a.go", "a", [(9, f"{M}/b"), (4, f"{M}/c")]), ("b/b.go", "b", own("c")), ("c/c.go", "c", own("b"))]
    rule = forbid("x", {"path": ["^a/"]}, {"path": ["^b$"], "reachable": True})
    assert found(spark, tree, {"forbidden": [rule]}) == [("x", "a/a.go", 4, "b")]


def test_unscanned_targets_are_nodes(spark):
    tree = [("a/a.go", "a", own("missing"))]
    rules_ = [forbid("r", {}, {"path": ["^missing$"], "reachable": True}), forbid("f", {}, {"path": ["missing"]}, scope="folder"), forbid("u", {"path": ["^zzz"]}, {"path": ["^missing$"], "reachable": False})]
    assert found(spark, tree, {"forbidden": rules_}) == [("f", "a", 0, "missing"), ("r", "a/a.go", 3, "missing")]


def test_filter_spares_the_initiating_import(spark):
    tree = [("a/a_test.go", "a", own("b")), ("b/b.go", "b", own("c")), ("c/c.go", "c", [])]
    rule = forbid("x", {}, {"path": ["^c$"], "reachable": True, "reachableFilePathNot": [r"_test\.go$"]})
    assert ("x", "a/a_test.go", 3, "c") in found(spark, tree, {"forbidden": [rule]})
    dead = forbid("u", {"path": ["^a/"]}, {"path": ["^[bc]$"], "reachable": False, "reachableFilePathNot": [r"_test\.go$"]})
    assert [p for _, p, _, _ in found(spark, tree, {"forbidden": [dead]})] == ["b/b.go", "c/c.go"]


def test_edge_stays_if_some_file_supports_it(spark):
    tree = [("s/s.go", "s", own("a")), ("a/a_test.go", "a", own("b")), ("a/a.go", "a", own("b")), ("b/b.go", "b", [])]
    rule = forbid("x", {"path": ["^s/"]}, {"path": ["^b$"], "reachable": True, "reachableFilePathNot": [r"_test\.go$"]})
    assert found(spark, tree, {"forbidden": [rule]}) == [("x", "s/s.go", 3, "b")]


def test_severity_order_ignore_and_empty_allowed(spark):
    tree = [("a/a.go", "a", [(3, "fmt")])]
    document = {"forbidden": [forbid("z", {}, {}), forbid("y", {}, {}, severity="ignore"), forbid("x", {}, {}, severity="info")], "allowed": []}
    assert [r for r, *_ in found(spark, tree, document)] == ["not-in-allowed", "x", "z"]
    assert ORDER[1] == "severity"


def test_unresolved_and_bare_module_paths(spark):
    tree = [("a/a.go", "a", [(3, "C"), (4, M), (5, f"{M}/"), (6, "corp/x"), (7, "a.io/x")])]
    files, imports = relations(spark, tree)
    rows = [(r.resolved_path, r.dependency_type) for r in imports.orderBy("line").collect()]
    assert rows == [("", "unresolved"), (".", "local"), ("", "local"), ("corp/x", "stdlib"), ("a.io/x", "module")]
    assert [t for *_, t in found(spark, tree, {"allowed": []})] == ["C", ".", f"{M}/", "corp/x", "a.io/x"]


def test_many_rules_in_one_document(spark):
    document = {"forbidden": [forbid(f"r{i:03d}", {"path": ["^recipes/bread/b"]}, {"path": [f"^(oven/heat|x{i})$"]}) for i in range(256)]}
    got = found(spark, trees.BAKERY, document)
    assert [r for r, *_ in got] == [f"r{i:03d}" for i in range(256)]


def test_required_with_captures(spark):
    tree = [("svc/a/a.go", "a", own("log/a")), ("svc/b/b.go", "b", own("log/a"))]
    document = {"required": [{"name": "q", "from": {"path": ["^svc/([a-z]+)/"]}, "to": {"path": ["^log/$1$"]}}]}
    assert found(spark, tree, document) == [("q", "svc/b/b.go", 1, None)]

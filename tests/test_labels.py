"""Reachability as bits, components and condensed closures, against search."""

import random

import pytest

from ruleloom import config as rules
from ruleloom.operators import components as comp
from ruleloom.operators import labels
from ruleloom.plans.rules import evaluate
from tests.trees import M, relations


def graph(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"p{rng.randrange(n)}", f"p{rng.randrange(n)}") for _ in range(m)})


def search(pairs, root):
    """All that a root reaches, itself too."""
    after = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    seen, stack = {root}, [root]
    while stack:
        for b in after.get(stack.pop(), ()):
            if b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


@pytest.mark.parametrize("forwards", [True, False])
def test_both_sides_give_the_same_pairs(spark, monkeypatch, forwards):
    """Two views, cycles, more roots than a word has bits, rounds that merge."""
    monkeypatch.setattr(labels, "ROUNDS", 3)
    pairs = graph(150, 200, 1)
    views = [[True, i % 4 > 0] for i in range(len(pairs))]
    edges = spark.createDataFrame([(*p, v) for p, v in zip(pairs, views, strict=True)], "src string, dst string, views array<boolean>")
    roots = [(v, f"p{i}") for i in range(0, 150, 1 if forwards else 2) for v in (0, 1)]
    targets = [(v, f"p{i}") for i in range(0, 150, 1 if not forwards else 3) for v in (0, 1)] + [(1, "elsewhere")]
    kept = [[p for p, v in zip(pairs, views, strict=True) if v[k]] for k in (0, 1)]
    want = sorted((v, r, x) for v, r in roots for x in search(kept[v], r) if (v, x) in set(targets))
    frame = lambda rows: spark.createDataFrame(rows, "view int, node string")
    got = labels.reached(edges, frame(roots), frame(targets), forwards).select("view", "root", "node").collect()
    assert sorted(map(tuple, got)) == want


def test_bits_of_a_word(spark):
    rows = spark.range(130).selectExpr("id").select(labels.bit(labels.F.col("id")).alias("b")).collect()
    assert [r.b for r in rows] == [1 << (i & 63) if i & 63 < 63 else -(1 << 63) for i in range(130)]


@pytest.mark.parametrize(("n", "m", "seed"), [(40, 60, 1), (25, 0, 4)])
def test_components(spark, n, m, seed):
    """Random graphs, and one that is a ring of rings with a tail."""
    pairs = graph(n, m, seed) if m else [*((f"a{i}", f"a{(i + 1) % 9}") for i in range(9)), *((f"b{i}", f"b{(i + 1) % 4}") for i in range(4)), ("a3", "b2"), ("b1", "t0"), *((f"t{i}", f"t{i + 1}") for i in range(12)), ("s", "s"), ("s", "a0")]
    edges = spark.createDataFrame(pairs + pairs[:3], "src string, dst string")
    nodes = {x for p in pairs for x in p}
    reach = {x: search(pairs, x) for x in nodes}
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in nodes}
    got = comp.components(edges).collect()
    assert len(got) == len(nodes) and {r.node: r.component for r in got} == want
    seeds = [(f"r{i}", x) for i, x in enumerate(sorted(nodes)[::4])] + [("far", "nowhere")]
    closed = comp.Condensed(edges).closure(spark.createDataFrame(seeds, "root string, node string")).collect()
    assert sorted(map(tuple, closed)) == sorted({(r, y) for r, x in seeds for y in reach.get(x, {x})})


def test_roots_of_one_component_share_a_search(spark, monkeypatch):
    """A ring of 50 with a tail, and a node outside; members are dealt by few."""
    seen, search_all = [], comp.Edges.closure
    monkeypatch.setattr(comp.Edges, "closure", lambda self, seeds: (seen.append(seeds.distinct().count()), search_all(self, seeds))[1])
    monkeypatch.setattr(comp, "MEMBERS", 7, raising=False)
    pairs = [(i, (i + 1) % 50) for i in range(50)] + [(3, 100), (100, 101)]
    seeds = [(i, i) for i in range(50)] + [(0, 100), (7, 999), (8, None)]
    got = comp.Condensed(spark.createDataFrame(pairs, "src long, dst long")).closure(spark.createDataFrame(seeds, "root long, node long"))
    want = {(r, x) for r in range(50) for x in [*range(50), 100, 101]} | {(7, 999), (8, None)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert seen[-1] == 2  # the ring's, and the tail's


def test_components_of_no_edges(spark):
    assert comp.components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_many_unreach_rules_share_one_search(spark):
    """More rules than a word has bits, in two views."""
    tree = [(f"p{i}/f{'_test' if i % 5 == 0 else ''}.go", f"p{i}", [(3, f"{M}/p{2 * i + 1}"), (4, f"{M}/p{2 * i + 2}")] if i < 20 else []) for i in range(41)]
    skip = {"reachableFilePathNot": [r"_test\.go$"]}
    rules_ = [{"name": f"r{i:03d}", "from": {"path": [f"^p{i % 41}/"]}, "to": {"path": [f"^p[0-9]*{i % 7}$"], "reachable": False} | (skip if i % 3 == 0 else {})} for i in range(150)]
    files, imports = relations(spark, tree)
    got = sorted((r["rule"], r["from"]["path"]) for r in evaluate(rules.from_dict({"forbidden": rules_}), files, imports).collect())
    every = [(f"p{i}", f"p{2 * i + k}") for i in range(20) for k in (1, 2)]
    plain = [(f"p{i}", f"p{2 * i + k}") for i in range(20) if i % 5 for k in (1, 2)]
    want = []
    for i in range(150):
        met = search(plain if i % 3 == 0 else every, f"p{i % 41}")
        want += [(f"r{i:03d}", path) for path, name, _ in tree if name.endswith(str(i % 7)) and name not in met]
    assert got == sorted(want)

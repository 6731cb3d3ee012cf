from collections import Counter

import numpy as np
import xxhash

from ruleloom.llm import simhash
from ruleloom.llm.common import table


def brute_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, radius=2):
    label = {i: i for i, _ in items}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, (i, a) in enumerate(items):
        for j, b in items[:n]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in items}


def test_whole_table(spark, small):
    docs = table(spark, small, "documents")
    items = [(r.doc_id, brute_fp(r.text)) for r in docs.collect()]
    want = brute_components(items)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in items}


def test_tree_join_is_exact(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    points = [base]
    for _ in range(3):  # chains of near fingerprints, and a dense ball
        points.append(points[-1][:800] ^ (np.uint64(1) << rng.integers(0, 64, 800, dtype=np.uint64)))
    ball = np.full(400, base[0])
    for _ in range(3):
        ball = ball ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    points = np.unique(np.concatenate([*points, ball]))
    rng.shuffle(points)
    assert (simhash.components(points, 2) == brute_labels(points)).all()
    tree = simhash.build_tree(points, 32, 2)
    shards = [set(at.tolist()) for _, at in simhash.route(tree, points, 2)]
    assert len(shards) > 8
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    member = [{k for k, s in enumerate(shards) if x in s} for x in range(len(points))]
    assert all(member[a] & member[b] for a, b in zip(i.tolist(), j.tolist(), strict=True))


def shards_of(n, shards):
    points = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    tree = simhash.build_tree(points[: simhash.PER_SHARD * shards], shards, 2)
    return [len(at) for _, at in simhash.route(tree, points, 2)]


def test_as_many_shards_as_asked():
    sizes = shards_of(50_000, 64)
    assert len(sizes) == 64
    assert sum(sizes) <= 3.2 * 50_000 and max(sizes) <= 2 * sum(sizes) / 64


def test_sample_that_no_cut_makes_smaller():
    same = np.full(1000, 7, np.uint64)
    assert simhash.build_tree(same, 8, 2) == []
    assert simhash.build_tree(np.array([], np.uint64), 8, 2) == []
    some = np.concatenate([same, np.random.default_rng(1).integers(0, 2**63, 400, dtype=np.uint64)])
    assert len(list(simhash.route(simhash.build_tree(some, 8, 2), some, 2))) == 8


def brute_labels(points):
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    label = np.arange(len(points))
    while True:
        new = np.array([label[row].min() for row in close])
        if (new == label).all():
            return label
        label = new


def test_long_chain_of_labels(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in simhash.component_labels(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_odd_rows(spark, docs_of, odd_rows):
    got = simhash.near_duplicates(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    zero = Counter(r.component_id for r in got if r.fingerprint == "0" * 16)
    assert zero == {0: 3}
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert simhash.near_duplicates(docs_of([])).count() == 0
    kept = simhash.keep_first(docs_of(odd_rows))
    assert kept.columns == docs_of(odd_rows).columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [(False, i) for i in (0, 3, 4, 5, 7, 8, 8)]


def test_null_id_bridges(spark):
    """1 and 2 are four bits apart; what only null ids have links them."""
    fps = spark.createDataFrame([(1, 0b0011), (None, 0), (None, 0), (2, 0b1100), (None, 0b1111 << 40), (9, -1)], "doc_id long, fp long")
    got = Counter((r.doc_id, r.component_id) for r in simhash.linked(fps).collect())
    assert got == {(1, 1): 1, (2, 1): 1, (None, 1): 2, (None, None): 1, (9, 9): 1}


def test_hot_groups_and_shards(spark, monkeypatch):
    """A third of all rows in one fingerprint, a third in one component, and
    more shards than partitions: rows equal brute force."""
    monkeypatch.setattr(simhash, "SMALL_SHARD", 16)
    rng = np.random.default_rng(8)
    ball = np.unique(np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)))
    far = rng.integers(0, 2**63, 300, dtype=np.uint64)
    points = [5] * 400 + ball.tolist() + far.tolist() + (far[:50] ^ np.uint64(6)).tolist()
    rows = [(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(rng.permutation(points).tolist())]
    fps = spark.createDataFrame(rows, "doc_id long, fp long").repartition(7)
    values = np.unique(np.array([f for _, f in rows], np.int64))
    label, least = brute_labels(values.view(np.uint64)), {}
    of = dict(zip(values.tolist(), label.tolist(), strict=True))
    for i, f in rows:
        least[of[f]] = min(least.get(of[f], i), i)
    assert {r.doc_id: (r.fp, r.component_id) for r in simhash.linked(fps).collect()} == {i: (f, least[of[f]]) for i, f in rows}
    links = simhash.near_links(fps.select("fp").distinct(), 2).collect()
    most = Counter(x for r in links for x in r)
    assert max(most.values()) < 100  # no hub has a link to each of its component


def test_clashing_columns(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    for name in ("fp", "label", "component_id", "part", "n", "now", "rep", "shard"):
        docs = docs.withColumn(name, simhash.F.lit("mine"))
    assert simhash.near_duplicates(docs).count() == len(odd_rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.component_id for r in kept.collect()} == {"mine"}

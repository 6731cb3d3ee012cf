import math
from collections import Counter

import numpy as np
import pytest

from ruleloom import shared
from ruleloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, a string, score long"


def by_hand(rows, every=100, positives=5, most=5, low=80, high=100, limit=1 << 24):
    ok = [(i, label, [max(-limit, min(limit, math.floor(256 * float(np.float32(x))))) for x in v]) for i, v, label, *_ in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (anchor, label, v) in enumerate(ok):
        if anchor % every:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), i, of) for j, (i, of, w) in enumerate(ok) if j != k]  # noqa: B905
        for p, pid in sorted(((s, i) for s, i, of in scores if of == label), key=lambda x: (-x[0], x[1]))[:positives]:
            found = sorted(((s, i) for s, i, of in scores if of != label and low * p <= 100 * s <= high * p), key=lambda x: (-x[0], x[1]))[:most]
            out += [(anchor, pid, rank, i, p, s) for rank, (s, i) in enumerate(found, 1)]
    return out


def random_rows(n, dim, seed, labels=3):
    """Coarse components, so that scores tie."""
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-2, 3, (n, dim)) / 4
    return [(i, [float(x) for x in v], int(rng.integers(0, labels)), "x", i) for i, v in enumerate(vectors)]


@pytest.mark.parametrize(("dim", "seed"), [(3, 1), (64, 2), (70, 3), (600, 4)])
def test_equals_all_scores(spark, monkeypatch, dim, seed):
    """Many blocks, chunks of dimensions that don't divide, ties, negative scores."""
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rows = random_rows(230, dim, seed)
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), every=10)
    want = by_hand(rows, every=10)
    assert want and Counter(map(tuple, got.collect())) == Counter(want)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = random_rows(60, 4, 5) + [
        (100, None, 1, "x", 0), (100, [1.0, None, 0.0, 0.0], 1, "x", 0), (200, [nan, 0.0, 0.0, 0.0], 1, "x", 0), (200, [inf, 0.0, 0.0, 0.0], 1, "x", 0), (300, [1.0, 1.0, 1.0, 1.0], None, "x", 0),
        (None, [1.0] * 4, 1, "x", 0), (400, [], 1, "x", 0), (500, [0.5], 1, "x", 0), (600, [0.5] * 9, 1, "x", 0), (700, [0.5] * 4, 1, "x", 0), (700, [0.5] * 4, 1, "x", 0), (700, [0.5] * 4, 2, "x", 0),
        (800, [1e30, -1e30, 0.0, 1.0], -1, "x", 0), (-100, [0.3, -0.2, 0.1, 0.9], -1, "x", 0),
    ]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA))
    assert Counter(map(tuple, got.collect())) == Counter(by_hand(rows))


@pytest.mark.parametrize("rows", [[], random_rows(9, 4, 6)[1:], [(0, [1.0], 1, "x", 0)], [(0, None, None, "x", 0)], [(0, [], 1, "x", 0), (1, [], 1, "x", 0), (2, [], 2, "x", 0)]])
def test_few_rows(spark, rows):
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA))
    assert Counter(map(tuple, got.collect())) == Counter(by_hand(rows))


def test_one_label_and_copies_hold_most_rows(spark):
    rows = [(i, [0.5, 0.25, 0.0, 1.0] if i % 3 else [i % 7 / 8, i % 5 / 8, 0.5, 1.0], 0 if i % 4 else i % 10, "x", 0) for i in range(600)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA))
    assert Counter(map(tuple, got.collect())) == Counter(by_hand(rows))


def test_products_are_exact_at_the_limit():
    a = np.full((2, 96), negatives.LIMIT, np.int32)
    b = np.stack([np.full(96, negatives.LIMIT), np.arange(96) - 2**24 + 1]).astype(np.int32)
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    assert negatives.product(a, b).tolist() == want
    assert negatives.restored(negatives.stored(np.array(want)), 2, 2).tolist() == want


def test_thresholds_are_whole_numbers():
    for score in range(-300, 300):
        assert negatives.ceil_of(80, score) == math.ceil(80 * score / 100)


def test_tiles_are_not_kept_and_blocks_not_broadcast(spark, monkeypatch, tmp_path):
    """What is written follows the rows, not the scores (800 x 1,600 here), and
    what the grid repeats doesn't go through the driver."""
    monkeypatch.setattr(shared, "shared_folder", lambda _: str(tmp_path))
    got = negatives.mine(spark.createDataFrame(random_rows(1600, 64, 7), SCHEMA).repartition(2), every=2)
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 800 * 1600
    plan = got._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "BroadcastExchange" not in plan
    assert got.count() > 0


@pytest.mark.parametrize("dim", [4, 40])
def test_each_kind_of_number(spark, monkeypatch, dim):
    """Sums beyond floats and beyond doubles, ties of most rows, many blocks."""
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "HELD", 2)
    for size in (1.0, 2.0**10, 2.0**15, 2.0**16):
        rows = [(i, [size * (1 - (i * j) % 3 / 16) if i % 5 else size for j in range(dim)], i % 3, "x", 0) for i in range(200)]
        got = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(2), every=20)
        assert Counter(map(tuple, got.collect())) == Counter(by_hand(rows, every=20))

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ruleloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def level_by_hand(sizes, weights, total, epochs):
    """Clamps one source after the other, the one that is most above first."""
    free, level = dict(enumerate(sizes)), None
    left = Fraction(min(total, epochs * sum(sizes)))
    while free:
        level = left / sum(weights[i] for i in free)
        above = [i for i in free if epochs * free[i] < weights[i] * level]
        if not above:
            return level
        worst = max(above, key=lambda i: weights[i] * level / max(free[i], Fraction(1, 10**9)))
        left -= epochs * free.pop(worst)
    return level


@pytest.mark.parametrize("seed", range(6))
def test_water_level(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, rng.randrange(1000), rng.randrange(10**6)]) for _ in range(rng.randrange(1, 12))]
    weights = [rng.randrange(1, 50) for _ in sizes]
    total = rng.choice([sum(sizes), sum(sizes) // 3, 2 * sum(sizes), 10 * sum(sizes) + 5])
    df = spark.createDataFrame(list(zip(sizes, weights, strict=True)), "source_size long, weight long")
    level = mixing.water_level(df, total)
    rows = mixing.planned(df, level).collect()
    want = level_by_hand(sizes, weights, total, 3)
    targets = [min(3 * s, w * want) for s, w in zip(sizes, weights, strict=True)]
    got = {(r.source_size, r.weight): r.target for r in rows}
    for s, w, t in zip(sizes, weights, targets, strict=True):
        assert got[s, w] == pytest.approx(float(t), rel=1e-9)
    assert sum(r.target for r in rows) == pytest.approx(min(total, 3 * sum(sizes)), rel=1e-9)
    for r in rows:
        assert r.whole <= 3 and 0 <= r.goal < max(1, r.source_size) and (r.whole * r.source_size + r.goal <= r.target + 1)


def by_source(docs, rows):
    return {r.key: r for r in rows.join(mixing.sized(docs).select("doc_id", "key").distinct(), "doc_id").groupBy("key").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()}


def test_targets_are_met_in_a_hot_source(spark):
    rows = [(i, "w " * (1 + i * i % 97), "en", "hot" if i % 3 == 0 else f"s{i % 11}", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mixture(docs)
    for r in by_source(docs, found).values():
        assert abs(r.taken - r.target) <= r.most / 2 + 1
    again = mixing.mixture(docs.repartition(7))
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, again.collect()))
    assert found.where("taken > 3 * size").isEmpty()


def test_odd_rows(docs_of, odd_rows, spark):
    rows = [(i, t, "en", None if (i or 0) % 2 else "src0", 0) for i, t in odd_rows] + [(30, "a b", "en", "", 0), (31, "c", "en", "\U0001f600", 0), (32, "d e", "en", "￿", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r["size"]): r for r in mixing.mixture(docs).collect()}
    assert sum(1 for _ in got) == len({(i, len((t or "").split())) for i, t, *_ in rows})
    assert got[0, 0].taken == 0 and got[1, 0].source_size == got[5, 3].source_size
    ranks = {r.key: r["rank"] for r in mixing.numbered(mixing.sized(docs).select("key").distinct()).collect()}
    assert [k for k, _ in sorted(ranks.items(), key=lambda x: x[1])] == ["=", "=src0", "=￿", "=\U0001f600", "n"]
    assert mixing.mixture(docs_of([])).count() == 0
    assert [r.taken for r in mixing.mixture(docs_of([(1, None), (2, "")])).collect()] == [0, 0]


def test_words_are_runs_without_ascii_white_space(spark):
    df = spark.createDataFrame([("a\x0bb\x1c c d e\n\t",), (None,), (" ",), ("x",)], "t string")
    assert [r[0] for r in df.select(mixing.size(F.col("t"))).collect()] == [3, 0, 0, 1]


def test_mixed_repeats_whole_rows_whatever_their_columns(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 3}", i, "x", -i) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, key string, `draw.d` long")
    times = {r.doc_id: r.times for r in mixing.mixture(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in times.items() if n})
    assert set(map(tuple, out.collect())) <= set(map(tuple, rows))


def test_equal_ids_share_a_draw(docs_of):
    rows = mixing.mixture(docs_of([(i // 4, "w w w") for i in range(400)])).collect()
    assert len(rows) == 400 and len({(r.doc_id, r.taken) for r in rows}) == 100

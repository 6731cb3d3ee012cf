import zlib
from itertools import product

import numpy as np
import pytest

from ruleloom.llm import toxicity
from ruleloom.llm.common import table


@pytest.fixture(scope="module")
def costs(spark):
    return toxicity.trigram_costs(toxicity.corpus_trigrams(table(spark, "/root/testdata/sf0.01", "documents")))


def test_counts_cover_the_corpus(spark, small):
    docs = table(spark, small, "documents")
    want = np.zeros(toxicity.SYMBOLS**3)
    for r in docs.collect():
        s = [0, 0, *(ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0 for c in r.text.lower()), 0, 0]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            want[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    got = toxicity.corpus_trigrams(docs)
    assert (got[1:] == want[1:]).all()


@pytest.mark.parametrize("seen,word", [("m0ron", "moron"), ("s c u m", "scum"), ("tra5h", "trash"), ("stuuupid", "stupid"), ("$tupid", "stupid"), ("l.o.s.e.r", "loser"), ("cl0wn", "clown"), ("d1sgust1ng", "disgusting"), ("1d10t", "idiot"), ("mör0n", "moron"), ("s c ü m", "scum")])
def test_restores(costs, seen, word):
    assert toxicity.disguised([f"Say {seen.upper()} now".encode()]) == [{seen}]
    assert toxicity.disguised([f"Слово {seen} знак now".encode()]) == [{seen}]
    assert toxicity.decode(seen, costs) == word


def test_restores_at_any_length(costs):
    read = lambda text: {w for f in toxicity.Restorer(costs).features([text.encode()]) for w in f}
    assert b"stupid" in read("so st" + "u" * 90 + "pid")
    assert b"idiot" in read("x, " + "Y o u a r e a n i d i o t " * 1)
    assert {b"you", b"are"} & read("x, " + "y o u a r e a n i d i o t " * 40) and b"idiot" in read("x, " + "y o u a r e a n i d i o t " * 40)
    assert b"ass" in read("an a s s, he") and b"scum" in read("s c u m")
    assert b"moron" in read("m0r" + "o" * 30 + "n") and toxicity.disguised([b"in 1 3 5 rows"]) == [set()]


@pytest.mark.parametrize("seen", ["a1b", "m00n", "t3$t", "s.c.m", "baad", "mör0n"])
def test_viterbi_is_the_best_path(costs, seen):
    spaced = "." in seen
    best = None
    for path in product(*(toxicity.options(seen, i, spaced) for i in range(len(seen)))):
        word = "".join(c for c, _ in path)
        s = [0, 0, *(int(toxicity.SYMBOL[ord(c)]) for c in word), 0]
        cost = sum(p for _, p in path) + sum(costs[a, b, c] for a, b, c in zip(s, s[1:], s[2:], strict=False))
        best = min(best or (cost, word), (cost, word))
    assert toxicity.decode(seen, costs) == best[1]


def test_vocabulary_does_not_follow_partitions(spark, costs):
    # "plain" is in a fifth of all rows, toxic or not
    rows = [(f"row{i} {'plain' if i // 20 % 5 == 0 else 'other'} {'vermin' if i % 20 < 2 else 'fine'}", int(i % 20 < 2)) for i in range(600)]
    frame = spark.createDataFrame(rows, "text string, toxic int")
    one = toxicity.vocabulary(frame.coalesce(1), costs)
    assert b"vermin" in one and b"plain" not in one
    assert toxicity.vocabulary(frame.repartition(60), costs) == one


def test_scores_do_not_follow_partitions(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append(sorted(map(tuple, toxicity.toxicity(docs, labels).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert found[0] == found[1] == found[2] and sum(r[3] for r in found[0]) > 20


def test_features_and_scores_by_hand(spark, costs):
    """Vocabulary, features and score of a whole table, text by text."""
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")

    def terms(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
        words = set("".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in low).split(" ")) - {""}
        for w in toxicity.disguised([text.encode()])[0]:
            words |= {toxicity.decode(w, costs)} | (set(toxicity.decode(w, costs, True).split()) if set(w) & set(" .-_") else set())
        words = {w.encode() for w in words}
        return words | {b"^" + w[:k] for w in words for k in toxicity.BEGINNINGS if len(w) > k}

    rows = [(r.text, r.toxic) for r in toxicity.labelled(docs, labels).collect()]
    p, n = {}, {}
    for text, toxic in rows:
        for t in terms(text or ""):
            n[t], p[t] = n.get(t, 0) + 1, p.get(t, 0) + toxic
    yes = sum(t for _, t in rows)
    base = np.log(yes / (len(rows) - yes))
    z = {t: (np.log((p[t] + 0.5) / (n[t] - p[t] + 0.5)) - base) / np.sqrt(1 / (p[t] + 0.5) + 1 / (n[t] - p[t] + 0.5)) for t in n if p[t] >= toxicity.LEAST_ROWS}
    want = sorted((t for t in z if z[t] >= toxicity.LEAST_Z and t), key=lambda t: (-z[t], t))
    assert len(want) < toxicity.FEATURES and set(toxicity.vocabulary(toxicity.labelled(docs, labels), costs)) == set(want)
    model = toxicity.train(docs, labels)
    assert set(model.weights) <= set(want) and model.weights
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        z = model.bias + sum(w for t, w in model.weights.items() if t in terms(r.text or ""))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    recall = np.mean([p for t, p in held if t == 1])
    false = np.mean([p for t, p in held if t == 0])
    print("recall", recall, "false", false)
    assert recall > 0.8 and false < 0.03


def test_odd_rows(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(3, 0, 1), (5, 1, 0), (5, 1, 1), (None, 1, 1), (6, 1, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs_of(odd_rows), labels).collect()
    assert len(rows) == len(odd_rows) and len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert {r.score for r in toxicity.toxicity(docs_of(odd_rows), labels.where("1 = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs_of([]), labels).count() == 0

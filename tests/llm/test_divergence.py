import re
from collections import Counter, defaultdict

import pytest

from ruleloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, g long, p0 string"
FOLD = {c: c + 32 for c in range(65, 91)}


def by_hand(rows, min_documents, top):
    """Every term of every group, counts of zero included."""
    groups, counts, docs = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        g = (lang or "", source or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        groups.add(g), counts[g].update(found), docs[g[0]].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_documents)
        v, own = len(kept), sorted(g for g in groups if g[0] == lang)
        shares = {}
        whole = Counter()
        for g in own:
            whole.update({t: counts[g][t] for t in kept})
        for name, found in [*((g, counts[g]) for g in own), (None, whole)]:
            size = sum(found[t] for t in kept)
            shares[name] = {t: 1 + 10**9 * (found[t] + 2) // (size + 2 * v) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for g in own:
            pairs = [(sum(f(shares[g][t], shares[h][t]) for t in kept), h[1]) for h in own if h != g]
            terms = [(f(shares[g][t], shares[None][t]), t) for t in kept if counts[g][t] and shares[g][t] > shares[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(*g, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return out


def odd(odd_rows):
    texts = [t for _, t in odd_rows] + ["Übel übel ÜBEL naïve_1 İ a.b'c\x00d \U0001f600x", "same text here" * 3, "The the THE"]
    rows = [(i, t, ("en", "", None, "de")[i % 4], ("a", None, "", "￿", "\U0001f600")[i % 5], i, "x") for i, t in enumerate(texts * 3)]
    return rows + [(900, None, "fr", "only", 1, "x"), (901, "", "it", "one", 1, "x"), (902, "!", "it", "two", 1, "x"), (7, "same text", "en", "a", 1, "x"), (7, "same text", "en", "a", 1, "x"), (None, "same", "en", "b", 1, "x")]


@pytest.mark.parametrize(("least", "top", "block"), [(1, 3, 64), (2, 10, 1), (3, 10, 2), (10, 10, 64), (10**6, 10, 2)])
def test_equals_a_count_of_every_term(spark, odd_rows, monkeypatch, least, top, block):
    """Also with blocks that hold fewer sources than a language has."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = odd(odd_rows)
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA), least, top)
    assert Counter(map(tuple, got.collect())) == Counter(by_hand(rows, least, top))


def test_tasks_hand_on_in_parts(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "SLICE", 2)
    rows = odd(odd_rows)
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), 2)
    assert Counter(map(tuple, got.collect())) == Counter(by_hand(rows, 2, 10))


def test_hot_source_and_empty_table(spark):
    rows = [(i, f"w{i % 13} x{i % 7} hot", "en", "big" if i % 3 else f"s{i % 9}", 0, "") for i in range(900)]
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA))
    assert Counter(map(tuple, got.collect())) == Counter(by_hand(rows, 10, 10))
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_beyond_long(spark):
    """Counts of 10^12, as common words have in a large corpus."""
    df = spark.createDataFrame([(10**12, 7 * 10**13, 10**6)], "n long, size long, v long")
    got = df.select(divergence.share(df.n, df["size"], df.v)).first()[0]
    assert got == 1 + 10**9 * (10**12 + 2) // (7 * 10**13 + 2 * 10**6)

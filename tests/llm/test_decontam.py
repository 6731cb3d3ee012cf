import hashlib
import re

import numpy as np

from ruleloom.llm import decontam
from ruleloom.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, limit=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        s = words(t)
        for win in [s[i : i + limit] for i in range(len(s) - limit + 1)] or ([s] if s else []):
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
    return len(w), hit, found


def test_matcher_against_brute_force():
    rng = np.random.default_rng(3)
    for turn in range(200):
        letters = "abcd" if turn % 2 else "ab"
        word = lambda n: " ".join(rng.choice(list(letters + "xy"), n))  # noqa: B023, E731
        limit = int(rng.integers(1, 6))
        items = [(i, word(int(rng.integers(0, 9)))) for i in range(int(rng.integers(0, 6)))]
        m = decontam.Matcher([(i, t.encode()) for i, t in items], limit)
        for _ in range(5):
            text = word(int(rng.integers(0, 40)))
            n, spans, found = m.match(text.encode())
            want = brute(text, items, limit)
            assert (n, {i for s, e in spans for i in range(s, e)}, found) == want
            assert sum(e - s for s, e in spans) == len(want[1])


def test_whole_table(spark, small):
    docs, bench = table(spark, small, "documents"), table(spark, small, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    windows = {}
    for i, t in items:
        s = words(t)
        for win in [tuple(s[k : k + 10]) for k in range(len(s) - 9)] or ([tuple(s)] if s else []):
            windows.setdefault(win, set()).add(i)
    sizes = {len(w) for w in windows}
    got = {r.doc_id: r for r in decontam.contamination(docs, bench).collect()}
    some = 0
    for r in docs.collect():
        w, hit, found = words(r.text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (x := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= x
        g = got.pop(r.doc_id)
        names = ",".join(sorted(map(str, found)))
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
        some += bool(hit)
    assert not got and some


def test_odd_rows_and_removal(spark, docs_of, odd_rows):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, "alpha beta"), (4, "alpha beta"), (None, "no name item")], "item_id long, text string")
    rows = [*odd_rows, (20, "Intro! One two, three four five six seven eight nine ten; eleven outro"), (21, "see Alpha-Beta and no name item"), (22, "alpha beta")]
    docs = docs_of(rows)
    got = {r.doc_id: r for r in decontam.contamination(docs, bench).collect()}
    assert (got[20].n_words, got[20].n_hit, got[20].n_items) == (13, 11, 1)
    assert (got[21].n_hit, got[21].n_items) == (5, 1)
    assert (got[0].n_words, got[0].contaminated) == (0, False)
    left = decontam.decontaminated(docs, bench, coverage=0.9)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[20] == "Intro!  outro" and 22 not in texts and texts[0] is None
    assert decontam.contamination(docs, bench.where("1 = 0")).where("contaminated").count() == 0
    assert decontam.contamination(docs_of([]), bench).count() == 0


def test_many_groups_give_equal_rows(spark, small, docs_of, odd_rows, monkeypatch):
    """A benchmark far beyond an automaton's bound, items beyond a piece."""
    monkeypatch.setattr(decontam, "PIECE_WORDS", 30)
    bench = table(spark, small, "benchmark").select("item_id", "text")
    long = " ".join(r.text for r in bench.orderBy("item_id").limit(5).collect())
    bench = bench.union(spark.createDataFrame([(10**6, long), (10**6 + 1, "word"), (None, long[:200]), (10**6 + 2, None)], "item_id long, text string"))
    docs = table(spark, small, "documents").select("doc_id", "text").union(docs_of([*odd_rows, (5, "same text here")]).select("doc_id", "text"))
    docs = docs.withColumn("hits", decontam.F.lit("mine")).withColumn("h", decontam.F.lit(1)).withColumn("passes", decontam.F.lit("mine"))
    assert len(list(decontam.matchers(bench, 10, 10**9))) == 1 and len(list(decontam.matchers(bench, 10, 1500))) > 2
    one, many = (sorted(map(str, decontam.contamination(docs, bench, most=m).collect())) for m in (10**9, 1500))
    assert one == many and any("contaminated=True" in r for r in one)
    one, many = (sorted(map(str, decontam.decontaminated(docs, bench, most=m).collect())) for m in (10**9, 1500))
    assert one == many and len(one) < docs.count()

import hashlib

import numpy as np
import pytest

from ruleloom.llm import edit_fingerprint as ef
from ruleloom.llm.common import table


def brute_digits(w, text):
    """The walk step by step, then the samples."""
    points = ef.code_points(text)
    cls = w.classes(points)
    read, i, step = [], 0, 0
    while i < len(points):
        read.append(int(points[i]))
        stay = int(w.stay[cls[i], step % ef.PERIOD])
        # the walk leaves its character at the first step that moves
        left = 1
        while left < stay:
            read.append(int(points[i]))
            left += 1
        step += stay
        i += 1
    out = []
    for s in range(len(w.salt)):
        if not read:
            out.append(0)
            continue
        at = max(r for r in w.records[s].tolist() if r < len(read))
        v = ((read[at] * int(w.mix[1]) + 1) * int(w.salt[s])) % (1 << 64)
        out.append(v >> 60)
    return out


def test_walk_against_steps():
    w, rng = ef.Walk(16), np.random.default_rng(2)
    texts = ["", "a", "ab", "abc"] + ["".join(rng.choice(list("abcdé😀 "), int(n))) for n in rng.integers(0, 400, 40)]
    got = w.fingerprints([ef.code_points(t) for t in texts])
    assert got.tolist() == [brute_digits(w, t) for t in texts]


def check(rows, docs):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    texts = [t or "" for _, t in docs]
    w = ef.walk()
    left = list(rows)
    for k, (i, _) in enumerate(docs):
        t, f = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        e = t[: len(t) - half] + f[:half]
        p = w.fingerprints([ef.code_points(x) for x in (t, e, f)])
        want = (i, len(t), hashlib.sha256(e.encode()).hexdigest(), ef.hex_of(p[0]), ef.hex_of(p[1]), ef.likeness(p[0], p[1]), ef.likeness(p[0], p[2]))
        left.remove(want)
    assert not left


def test_whole_table(spark, small):
    docs = table(spark, small, "documents")
    rows = [tuple(r) for r in ef.with_next(docs).collect()]
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    edits, nexts = np.mean([r[5] for r in rows]), np.mean([r[6] for r in rows])
    assert edits > 0.4 and nexts < 0.25


def test_odd_rows(spark, docs_of, odd_rows):
    check([tuple(r) for r in ef.with_next(docs_of(odd_rows)).collect()], odd_rows)
    check([tuple(r) for r in ef.with_next(docs_of([(4, "alone here")])).collect()], [(4, "alone here")])
    assert ef.with_next(docs_of([])).count() == 0


def nearest(rows, got, least=0.8):
    """How many of those with an earlier near one are found; what is found has
    to be near."""
    prints = [(i, np.frombuffer(f.encode(), np.uint8)) for i, f in rows]
    wanted = hits = 0
    for i, p in prints:
        near = {j for j, q in prints if j < i and ((p == q).mean() - 1 / 16) / (15 / 16) >= least}
        assert got[i] is None or got[i] in near
        wanted += bool(near)
        hits += bool(near) and got[i] is not None
    return hits, wanted


def changed(rng, text, edits):
    for _ in range(edits):
        k = int(rng.integers(0, len(text)))
        text = text[:k] + "qz"[int(rng.integers(0, 2))] * int(rng.integers(0, 2)) + text[k + int(rng.integers(0, 2)) :]
    return text


@pytest.mark.parametrize("levels", [1, 3])
def test_near_documents(spark, small, docs_of, monkeypatch, levels):
    """Copies, edited texts, and a crowd that agrees on most digits: what is
    found is near, and recall by fingerprint is 0.9 or more."""
    monkeypatch.setattr(ef, "LEVELS", levels)
    rng = np.random.default_rng(levels)
    texts = [r.text for r in table(spark, small, "documents").orderBy("doc_id").limit(120).collect()]
    texts += [changed(rng, texts[int(rng.integers(0, 120))][:3000], int(n)) for n in rng.integers(0, 9, 150)]
    head = "".join(rng.choice(list("abcdefghij klmno"), 2000))
    texts += [head + "".join(rng.choice(list("abcdefghij klmno"), 500)) for _ in range(120)]
    docs = docs_of(list(enumerate(texts))).withColumn("near", ef.F.lit("mine")).withColumn("f", ef.F.lit("mine"))
    rows = ef.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    hits, wanted = nearest([(r.doc_id, r.fingerprint) for r in rows], {r.doc_id: r.near_id for r in rows})
    print("recall", hits / wanted, "of", wanted)
    assert wanted > 80 and hits >= 0.9 * wanted


@pytest.mark.parametrize("edits", [4, 40])
def test_near_documents_in_a_crowd(spark, docs_of, edits):
    """Chains of ever more edited texts, all in the same buckets."""
    rng = np.random.default_rng(edits)
    texts = ["".join(rng.choice(list("abcdefghij klmno"), 2500)) for _ in range(3)]
    for _ in range(350):
        texts.append(changed(rng, texts[int(rng.integers(0, len(texts)))], edits))
    rows = ef.near_duplicates(docs_of(list(enumerate(texts)))).collect()
    hits, wanted = nearest([(r.doc_id, r.fingerprint) for r in rows], {r.doc_id: r.near_id for r in rows})
    print("recall", hits / wanted, "of", wanted)
    assert wanted > 100 and hits >= 0.9 * wanted


def test_near_odd_rows(spark, docs_of, odd_rows):
    rows = ef.near_duplicates(docs_of([*odd_rows, (None, "same text here"), (30, "same text here")])).collect()
    assert len(rows) == len(odd_rows) + 2
    got = {(r.doc_id, r.fingerprint): r.near_id for r in rows}
    same = {r.fingerprint for r in rows if r.doc_id == 30}.pop()
    assert (got[5, same], got[6, same], got[30, same], got[None, same]) == (None, 5, 5, 5)
    assert ef.near_duplicates(docs_of([])).count() == 0

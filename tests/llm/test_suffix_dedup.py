import hashlib

import numpy as np
import pytest

from ruleloom.llm import suffix_dedup as sd
from ruleloom.llm.common import table


def brute(texts, length):
    """Removed flags of texts in order."""
    seen, gone = set(), []
    for t in texts:
        g = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                g[i : i + length] = True
            seen.add(w)
        gone.append(g)
    return gone


def digest(t, gone):
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
    return len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize("letters", ["ab", "abc", "a", "abcdefgh"])
def test_suffix_array(letters):
    rng = np.random.default_rng(len(letters))
    for n in [0, 1, 2, 3, 5, 8, 13, 40, 120, 300]:
        for _ in range(6):
            t = [ord(c) for c in rng.choice(list(letters), n)] + [0]
            if n > 10:
                t = t[: n // 2] * 2 + [0] if rng.random() < 0.3 else t
                t = [c for c in t[:-1] if c] + [0]
            assert sd.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_groups_are_lyndon_prefixes():
    t = [ord(c) for c in "banabanaabcabc"] + [0]
    group, previous, order = sd.lyndon_groups(t)
    n = len(t)
    for i in range(n):
        smaller = [j for j in range(i) if t[j:] < t[i:]]
        following = [j for j in range(i + 1, n) if t[j:] < t[i:]]
        assert previous[i] == (max(smaller) if smaller else -1)
        word = tuple(t[i : min(following) if following else n])
        assert all((group[i] == group[j]) == (word == tuple(t[j : min([k for k in range(j + 1, n) if t[k:] < t[j:]], default=n)])) for j in range(n))


def test_anchors_meet(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 64)
    rng = np.random.default_rng(1)
    shared = bytes(rng.integers(97, 123, 300, dtype=np.uint8))
    texts = [b"x" * 17 + shared, bytes(rng.integers(97, 123, 211, dtype=np.uint8)) + shared + b"zz", b"ab" * 90]
    t, pos, h = sd.anchors(texts, 24, 8)
    for k, text in enumerate(texts):
        mine = pos[t == k]
        assert all(((mine >= i) & (mine + 8 <= i + 24)).any() for i in range(len(text) - 23))
    a = {(p - 17, x) for k, p, x in zip(t, pos, h, strict=True) if k == 0 and p >= 17 + 24}
    b = {(p - 211, x) for k, p, x in zip(t, pos, h, strict=True) if k == 1}
    assert a <= b


def check(rows, docs, length=sd.LENGTH):
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0]))
    texts = [(t or "").encode() for _, t in order]
    got = sorted((r.doc_id is not None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    want = sorted((i is not None, i, *digest(t, g)) for (i, _), t, g in zip(order, texts, brute(texts, length), strict=True))
    assert got == want


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    check(sd.deduplicated(docs).drop("kept").collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_small_lengths(spark, docs_of):
    rng = np.random.default_rng(4)
    block = ["".join(rng.choice(list("abcd "), 60)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [block[k] for k in rng.integers(0, 6, 3)] + ["".join(rng.choice(list("abcd"), int(rng.integers(0, 30))))]
        rng.shuffle(parts)
        rows.append((i * 3, "".join(parts)[int(rng.integers(0, 20)) :]))
    rows += [(500, "ab" * 80), (501, "ab" * 50), (502, "é" * 60), (503, "")]
    check(sd.deduplicated(docs_of(rows), 20, 8).drop("kept").collect(), rows, 20)


def test_unions():
    rng = np.random.default_rng(6)
    for _ in range(50):
        n = int(rng.integers(0, 30))
        doc, start = rng.integers(0, 4, n), rng.integers(0, 60, n)
        stop = start + rng.integers(1, 12, n)
        covered = {(d, i) for d, s, e in zip(doc.tolist(), start.tolist(), stop.tolist(), strict=True) for i in range(s, e)}
        got = list(zip(*(x.tolist() for x in sd.unions(doc, start, stop)), strict=True))
        assert {(d, i) for d, s, e in got for i in range(s, e)} == covered
        assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("group,common", [(5, False), (2, True), (8_000, True)])
def test_large_groups(spark, docs_of, monkeypatch, group, common):
    """Groups beyond the limit go by narrow blocks, then by window; common
    anchors go by context and in narrow blocks."""
    monkeypatch.setattr(sd, "GROUP", group)
    if common:  # every second anchor

        def some(docs, length, seed):
            rows = sd.anchor_rows(docs, length, seed, np.zeros(0, np.int64)).select("h").where("h % 2 = 0").distinct().collect()
            return np.array(sorted(r[0] for r in rows), np.int64)

        monkeypatch.setattr(sd, "common_anchors", some)
    rng = np.random.default_rng(8)
    line = "".join(rng.choice(list("abcdefgh"), 45))
    long = "".join(rng.choice(list("abcdefgh"), 130))
    tail = lambda: "".join(rng.choice(list("xyz"), 3))
    rows = [(i, tail() * 4 + line + tail() + line[:20]) for i in range(40)]
    rows += [(100 + i, tail() + long[: 128 - i % 3] + tail() + line) for i in range(40)]
    check(sd.deduplicated(docs_of(rows), 50, 16).drop("kept").collect(), rows, 50)
    check(sd.deduplicated(docs_of(rows)).drop("kept").collect(), rows)


def test_odd_rows(spark, docs_of, odd_rows):
    rows = [r for r in odd_rows if r[0] != 8]
    check(sd.deduplicated(docs_of(rows)).drop("kept").collect(), rows)
    assert sd.deduplicated(docs_of(odd_rows)).count() == len(odd_rows)
    assert sd.deduplicated(docs_of([])).count() == 0
    twice = sd.deduplicated(docs_of([(1, "abc" * 60 + str(i)) for i in (0, 0, 1)])).collect()
    assert len(twice) == 3


def test_repeated_rows_are_one_document(spark, docs_of):
    rng = np.random.default_rng(9)
    line = "".join(rng.choice(list("abcdefgh"), 260))
    once = [(1, "abc" * 60 + "0"), (2, line), (3, "x" + line[40:220] + "y"), (4, "".join(rng.choice(list("abcdefgh"), 300))), (5, "short")]
    want = {r.doc_id: r for r in sd.deduplicated(docs_of(once)).drop("kept").collect()}
    check(want.values(), once)
    for parts in (1, 7):  # repeated within a batch, and in different ones
        got = sd.deduplicated(docs_of(once * 3).repartition(parts)).drop("kept").collect()
        assert sorted(got) == sorted([*want.values()] * 3)


def test_a_line_that_fills_the_corpus(spark, docs_of):
    """Found in the sample, dealt by context, removed like any other."""
    rng = np.random.default_rng(12)
    line = "".join(rng.choice(list("abcdefgh"), 150))
    rows = [(i, "".join(rng.choice(list("xyzuvw"), 40 + i % 7)) + line + "".join(rng.choice(list("xyzuvw"), 30))) for i in range(400)]
    docs = docs_of(rows).withColumn("h", sd.F.lit("mine")).withColumn("doc", sd.F.lit("mine")).withColumn("th", sd.F.lit("mine")).repartition(6)
    assert len(sd.common_anchors(sd.keyed(docs), 100, 32)) > 0
    check(sd.deduplicated(docs).drop("kept").collect(), rows)


def test_blocks_come_in_bounded_batches():
    text = b"".join(b"line %06d of a template that repeats and repeats over and over again\n" % (i % 700) for i in range(2000))
    rows = [(1, 0, max(0, p - 68), min(p, 68), text[max(0, p - 68) : p + 100], 12) for p in range(0, len(text) - 100, 31)]
    whole = list(sd.blocks_of(rows, 100, 32))
    parts = list(sd.blocks_of(rows, 100, 32, 500))
    assert len(whole) == 1 and len(parts) > 20 and max(b.num_rows for b in parts) < 520
    blocks = lambda batches: sum(b.num_rows for b in batches)
    assert blocks(whole) == blocks(parts)
    assert {c for b in whole for c in b.column(5).to_pylist()} == {c for b in parts for c in b.column(5).to_pylist()}
    assert [b.num_rows for b in sd.blocks_of([], 100, 32)] == [0]

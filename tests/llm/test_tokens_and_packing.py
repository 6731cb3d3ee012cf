import glob
import os
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ruleloom.llm import packing, token_orc, tokens
from ruleloom.llm.common import shared_path, table
from ruleloom.llm.tokens import WordEncoder, default_path


UNUSUAL = ["Kadıköy İ! done", "İ!", "J\u030c. \u0958?", "<|endoftext|> x"]
TOKENIZER = Tokenizer.from_file(default_path())


def ids_of(text, end):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_word_cache_is_exact(spark, small):
    own, tok = WordEncoder(default_path()), Tokenizer.from_file(default_path())
    texts = [r[0] for r in table(spark, small, "documents").select("text").collect()]
    texts += ["", "á ́b   c\td\r\n'S it's <|endoftext|> x<|endoftext|>y  z", "é" * 50, "ẞİ ΣΣ"]
    got = own.encode([t.encode() for t in texts])
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


ODD_LETTERS = ["İ", "I\u0307", "J\u030c", "H\u0331", "T\u0308", "W\u030a", "ǰ", "ẞ", "Σ", "ς", "ŉ", "Ǆ", "\u0958", "\ufb1d", "ﬁ", "K", "Å", "क्ष", "한", "\u1112\u1161", "字", "𐐀", "ª", "Ⅷ", "²", "x\u0301", "'s", "'T"]


def test_random_unicode_is_exact():
    """Words of any code points and final marks have the library's ids."""
    own, rng = WordEncoder(default_path()), np.random.default_rng(3)
    points = np.concatenate([np.arange(0x20, 0x3000), rng.integers(0x3000, 0x20000, 4000)])
    anything = [c for c in map(chr, points) if not 0xD800 <= ord(c) < 0xE000]
    marks, plain = list(".,!?;:'\"-)(_@#"), list("abcdefgXYZéüÖñß")
    kinds = [anything, ODD_LETTERS, marks, plain, [" "]]
    texts = ["İ!", "Kadıköy İ! done", "J\u030c. j\u030c", "<|endoftext|>İ?"]
    for _ in range(100_000):
        pick = rng.choice(5, int(rng.integers(1, 9)), p=[0.25, 0.2, 0.2, 0.25, 0.1])
        texts.append("".join(kinds[k][int(rng.integers(len(kinds[k])))] for k in pick))
    for s in range(0, len(texts), 5000):
        some = texts[s : s + 5000]
        got = own.encode([t.encode() for t in some])
        for t, g, w in zip(some, got, TOKENIZER.encode_batch(some, add_special_tokens=False), strict=True):
            assert np.frombuffer(g, "<u4").tolist() == w.ids, ascii(t)


def test_table_smaller_than_a_text(monkeypatch):
    monkeypatch.setattr(tokens, "SLOTS", 64)
    own, texts = WordEncoder(default_path()), [" ".join(f"w{i:x}q, Ab{i}\n" for i in range(n)) for n in (3, 500, 0, 40)]
    for turn in (1 << 20, 100):
        monkeypatch.setattr(tokens, "TURN_BYTES", turn)
        for t, g in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(g, "<u4").tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids
    long = b" a  <|endoftext|>\n" + b"x" * 300 + b" " + b"y " * 200
    assert b"".join(tokens.turns(long)) == long
    assert own.encode([long, b"y"])[0] == array("I", TOKENIZER.encode(long.decode(), add_special_tokens=False).ids).tobytes()


def test_orc_round_trip(spark, small, docs_of):
    docs = table(spark, small, "documents").select("doc_id", "text").union(docs_of(list(enumerate(UNUSUAL, 10**9))).select("doc_id", "text"))
    got = {r.doc_id: r for r in token_orc.round_trip(docs).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = ids_of(r.text, 2)
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == docs.count()


def test_orc_lookup_and_odd_rows(spark, docs_of, odd_rows):
    path = shared_path(spark, "t")
    token_orc.write(docs_of(odd_rows).withColumn("ids", token_orc.F.lit("clash")), path)
    (row,) = token_orc.lookup(spark, path, [5]).collect()
    assert row.ids == ids_of("same text here", 2).tolist()
    assert token_orc.digests(spark, path).count() == len(odd_rows)
    empty = shared_path(spark, "t")
    token_orc.write(docs_of([]), empty)
    assert token_orc.digests(spark, empty).count() == 0


def test_orc_files_have_indexes_and_filters(spark, docs_of):
    """Stripes, row indexes and Bloom filters are in the files, ids are run-
    length encoded, and a lookup reads what can hold the id alone."""
    import pyarrow.orc as orc

    docs = docs_of([(3 * i, f"word{i % 7} " * (1 + i % 40)) for i in range(6000)])
    path = shared_path(spark, "t")
    token_orc.write(docs, path, partitions=3)
    files = sorted(glob.glob(f"{path.removeprefix('file:')}/*.orc"))
    assert len(files) == 3
    for name in files:
        f = orc.ORCFile(name)
        assert f.nstripes >= 1 and f.row_index_stride == 2000 and f.nrows > 1000
        raw = open(name, "rb").read()
        assert len(raw) < 0.5 * 4 * sum(len(x) for x in f.read(["ids"]).column("ids").to_pylist())  # 4 bytes an id, as plain
    plain = shared_path(spark, "t")
    token_orc.encoded(docs, 2, default_path(), 3).write.options(**{**token_orc.OPTIONS, "orc.bloom.filter.columns": ""}).orc(plain)
    sizes = [sum(os.path.getsize(x) for x in glob.glob(f"{p.removeprefix('file:')}/*.orc")) for p in (path, plain)]
    assert sizes[0] > sizes[1]  # filters take room
    rows = token_orc.lookup(spark, path, [3000])
    assert rows.collect()[0].ids == ids_of("word6 " * (1 + 1000 % 40), 2).tolist()
    # what the scan gives to the filter: at most one group of rows
    assert scanned(rows) <= 2000
    # ids between two others: only a Bloom filter can tell, but for 1 in 100
    with_filters, without = (sum(scanned(token_orc.lookup(spark, p, [i])) > 0 for i in (3001, 7502, 10001, 12001, 15001, 16502)) for p in (path, plain))
    assert with_filters <= 2 and without == 6


def scanned(df):
    """Rows that the scan read."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        p = plan.pop()
        if p.nodeName().startswith("Scan"):
            found.append(p.metrics().apply("numOutputRows").value())
        plan += [p.children().apply(i) for i in range(p.children().size())]
    assert found
    return sum(found)


def check_packed(rows, texts, most=4096, longest=4096):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids, at = ids_of(text, 1), 0
        cut = sorted(by_doc[doc], key=lambda r: r.piece)
        for k, r in enumerate(cut):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == longest or k == len(cut) - 1
            at += r.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most
    return len(by_seq), sum(r.length for r in rows)


def test_packing(spark, small, docs_of):
    docs = table(spark, small, "documents").select("doc_id", "text").union(docs_of(list(enumerate(UNUSUAL, 10**9))).select("doc_id", "text"))
    n, total = check_packed(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert n <= -(-total // 4096) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_documents_and_attention_bind(spark, small, rule):
    """The query's path with capacities that run out before tokens do."""
    docs = table(spark, small, "documents").limit(150)
    texts = {r.doc_id: r.text for r in docs.collect()}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    used = {}
    for capacity in (packing.Capacity(), packing.Capacity(documents=3), packing.Capacity(attention=1_000_000)):
        rows = packing.pack(docs, capacity=capacity, rule=rule).collect()
        used[capacity] = check_packed(rows, texts, 4096, capacity.longest)[0]
        seqs = defaultdict(list)
        for r in rows:
            seqs[r.sequence_id].append(r.length)
        assert max(map(len, seqs.values())) <= capacity.documents and max(sum(x * x for x in s) for s in seqs.values()) <= capacity.attention
        if capacity.documents == 3:
            assert max(map(len, seqs.values())) == 3
        assert len(seqs) <= 1.1 * max(sum(map(sum, seqs.values())) / 4096, len(rows) / capacity.documents, sum(x * x for s in seqs.values() for x in s) / capacity.attention) + 2
    assert used[packing.Capacity(documents=3)] > used[packing.Capacity()] < used[packing.Capacity(attention=1_000_000)]


def test_packing_odd_rows(spark, docs_of, odd_rows):
    rows = [r for r in odd_rows if r[0] != 8]
    clash = docs_of(rows)
    for name in ("piece", "length", "rank", "salt", "own", "base", "start", "sequence_id"):
        clash = clash.withColumn(name, packing.F.lit("mine"))
    check_packed(packing.pack(clash).collect(), dict(rows))
    # repeated rows and equal ids are packed one by one
    twice = packing.pack(docs_of([(1, "a b c"), (1, "a b c"), (1, "d")])).collect()
    assert sorted((r.piece, r.length, r.ids_crc32 == zlib.crc32(ids_of("d", 1).tobytes())) for r in twice) == [(0, 2, True), (0, 4, False), (0, 4, False)]
    assert len({(r.sequence_id, r.offset) for r in twice}) == 3
    check_packed(packing.pack(docs_of(rows)).collect(), dict(rows))
    assert packing.pack(docs_of(odd_rows)).count() >= len(odd_rows)
    assert packing.pack(docs_of([])).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_holds_every_capacity(rule):
    rng = np.random.default_rng(1)
    counts = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 101), 40, replace=False), rng.integers(1, 50, 40), strict=True)}
    capacity = packing.Capacity(100, 4, 10_000)
    runs, made = packing.plan(counts, capacity, rule)
    seqs, ranks = defaultdict(list), defaultdict(set)
    for length, rank, k, seq, offset in runs.tolist():
        for i in range(k):
            seqs[seq + i].append((offset, length))
            ranks[length].add(rank + i)
    assert {k: len(v) for k, v in ranks.items()} == counts and len(seqs) == made
    for items in seqs.values():
        assert len(items) <= 4 and sum(x * x for _, x in items) <= 10_000
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 100


def test_plan_size_does_not_follow_the_input():
    few = {k: 50 + k % 7 for k in range(1, 1000)}
    many = {k: v * 1000 for k, v in few.items()}
    a, b = packing.plan(few, packing.Capacity(1000, 1000, 10**6))[0], packing.plan(many, packing.Capacity(1000, 1000, 10**6))[0]
    assert len(b) < 3 * len(a)

import hashlib
import math
import re
from collections import defaultdict

import pytest

from ruleloom.llm import pii
from ruleloom.llm.common import table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"(?<![^\W_@.%+-])(?<![@._%+-])[^\W\d_]{4,}(?![\w@%+-]|\.[^\W_])")


def digits(v):
    return [int(c) for c in v if c.isdigit()]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def brute(text):
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    }


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, v in spans.items() for s, e in sorted(v))


TRICKY = [
    "a@b.c_d@e.f", "a@b.c@d.e", "x@y z@w.q.", "a@b..c a.b@c-d.e.f-", "é@a.b ü.x@é.y", "..@..@a.b", "a@b.c.d@e.f",
    "1.2.3.4.5.6.7.8", "256.1.1.1 0255.001.1.1", "1.2.3", "9999.1.1.1.1 11.22.33.44", "00000000000000000001.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111-1", "4111  1111 1111 1111 1", "é4111111111111111", "1-2-3-4-5-6-7-8-9-0-1-2-8",
    "+1 (555) 123-4567.", "+49 30 1234567 +1", "++1 2 3 4 5 6 7 8 9", "+1()()()()()(", "+12345678", "+1234567890123456", "+1 2\n3 4567890",
    "mail a.b+c@d.e, 10.0.0.1; call +1.202.555.0143",
]


@pytest.fixture(scope="module")
def whole(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    return {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in pii.personal_data(docs).collect()}


def check(row, text):
    want = brute(text)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(len(v) for v in want.values()), text
    assert row.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), text
    spans = row.spans.split(",") if row.spans else []
    assert [s for s in spans if not s.startswith("term:")] == [s for s in listed(want).split(",") if s]


def test_whole_table(whole):
    texts, rows = whole
    assert texts.keys() == rows.keys()
    for i, t in texts.items():
        check(rows[i], t)
    assert sum(r.n_email > 0 for r in rows.values()) > 10


def test_tricky(spark, docs_of):
    rows = {r.doc_id: r for r in pii.personal_data(docs_of(list(enumerate(TRICKY)))).collect()}
    for i, t in enumerate(TRICKY):
        check(rows[i], t)


def test_odd_and_long(spark, docs_of, odd_rows):
    long = ["1" * 60000, "a" * 60000 + "@", "1-" * 30000, "a@" + "b." * 30000 + "c", "+1" + "(" * 60000, "1." * 30000 + "1"]
    docs = docs_of([*odd_rows, *enumerate(long, 100)])
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(odd_rows) + len(long)
    by = {r.doc_id: r for r in rows}
    assert by[103].n_email == 1 and by[0].spans == "" and by[105].n_ip == 7500
    assert pii.personal_data(docs_of([])).count() == 0


def disclosure(texts):
    """Brute-force disclosing terms over a list of texts."""
    known, near = defaultdict(set), defaultdict(set)
    words = defaultdict(set)
    for n, t in enumerate(texts):
        for w in TERM.finditer(t.lower()):
            words[w[0]].add(n)
        for kind, spans in brute(t).items():
            for s, e in spans:
                key = (kind, t[s:e])
                known[key].add(n)
                a, b = max(0, s - pii.CONTEXT), min(len(t), e + pii.CONTEXT)
                for w in TERM.finditer(t.lower()):
                    inside = (w.start() >= a and w.end() <= s and (a == 0 or not t[a : w.start()].strip() or " " in t[a : w.start()])) or (w.start() >= e and w.end() <= b)
                    if inside:
                        near[key, w[0]].add(n)
    n = len(texts)
    return {(k, w) for (k, w), x in near.items() if len({texts[i] for i in x}) >= pii.SUPPORT and len(known[k]) < n and math.log(len(x) * n / (len(words[w]) * len(known[k]))) >= pii.THRESHOLD * math.log(n / len(known[k]))}


def test_terms_that_disclose(spark, docs_of):
    texts = [f"note {i}: the zeppelin captain writes to ada@x.org about item {i}" for i in range(4)]
    texts += [f"plain text {i} about nothing, the item and the captain" for i in range(12)]
    texts += [f"write to bob{i}@y.org about item" for i in range(4)]
    texts += texts[:1] * 5
    want = disclosure(texts)
    assert {w for _, w in want} == {"zeppelin", "writes"} or {w for _, w in want} >= {"zeppelin"}
    docs = docs_of(list(enumerate(texts)))
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for i, t in enumerate(texts):
        got = {t[int(a) : int(b)] for k, a, b in (s.split(":") for s in rows[i].spans.split(",") if s) if k == "term"}
        assert got == {w for (_, v), w in want if v in t}, t
    clean = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert "<EMAIL>" in clean[0].text and "<TERM>" in clean[0].text and "ada@" not in clean[0].text
    assert clean[5].text == texts[5] and clean[0].n_chars == len(clean[0].text)


def test_sanitised_keeps_rows_and_columns(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows + [(50, "ip 10.0.0.1 card 4111 1111 1111 1111 +1 202 555 0143 é x@y.zz.")])
    out = pii.sanitised(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.text for r in out.where("doc_id = 50").collect()} == {"ip <IP> card <CARD> <PHONE> é <EMAIL>."}
    assert {r.text for r in out.where("doc_id = 0").collect()} == {None}


def test_terms_of_whole_documents(spark, docs_of):
    """Far from the value, every occurrence, and for what values share."""
    far = "filler words go here " * 10
    texts = [f"Zeppelin {i} {far} ada@x.org {far} of the zeppelin" for i in range(4)]
    texts += [f"harpoon {i} {far} user{i}@whale.org" for i in range(7)]
    texts += [f"plain {i} {far} of nothing" for i in range(40)]
    rows = pii.personal_data(docs_of(list(enumerate(texts)))).collect()
    for r in rows:
        t = texts[r.doc_id]
        got = [(int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"]
        assert got == [m.span() for m in re.finditer("zeppelin|harpoon", t.lower())], t


def test_clashing_columns(spark, docs_of):
    names = ["marks", "Marks_", "mark_id", "mark_h", "h", "of", "of_h", "wanted", "words", "entities", "email", "ip", "card", "phone", "term", "e", "t", "spans"]
    docs = docs_of([(1, "write to ada@x.org, 10.0.0.1"), (2, None), (None, "x@y.zz")])
    for name in names:
        docs = docs.withColumn(name, pii.F.lit("mine"))
    rows = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert pii.sanitised(docs).columns == docs.columns
    assert rows[1].text == "write to <EMAIL>, <IP>" and rows[1].n_chars == 22 and rows[2].text is None and rows[None].text == "<EMAIL>"
    assert all(r[n] == "mine" for r in rows.values() for n in names)
    assert {r.n_email for r in pii.personal_data(docs).collect()} == {0, 1}


def test_many_spans_in_one_text(spark):
    """Folds go block by block: far more spans than a block has, and letters
    of several bytes between them."""
    n = 12000
    text = "".join(f"é\U0001f600 user{i}@mail{i % 50}.example.org, 10.0.{i % 300}.7 said hello\n" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    row = {r.doc_id: r for r in pii.personal_data(docs).collect()}[1]
    emails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    ips = [m.span() for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", text) if all(int(x) <= 255 for x in m[0].split("."))]
    assert row.n_email == n and row.n_ip == len(ips)
    assert row.spans == ",".join([*(f"email:{a}:{b}" for a, b in emails), *(f"ip:{a}:{b}" for a, b in ips)])
    want = list(text)
    for tag, spans in (("<EMAIL>", emails), ("<IP>", ips)):
        for a, b in spans:
            want[a:b] = [tag, *[""] * (b - a - 1)]
    assert {r.doc_id: r.text for r in pii.sanitised(docs).collect()} == {1: "".join(want), 2: "plain"}


def test_scanned_equals_a_running_fold(spark):
    values = [(i * 7919) % 1000 for i in range(3 * pii.BLOCK + 5)]
    for n in (0, 1, pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, len(values)):
        df = spark.createDataFrame([(values[:n],)], "x array<bigint>")
        most = pii.scanned(pii.F.col("x"), lambda a, b: pii.F.greatest(a, b), pii.F.lit(0).cast("bigint"))
        got = df.select(pii.before(pii.F.col("x")), most).first()
        assert got[0] == [sum(values[:i]) for i in range(n)] and got[1] == [max([0, *values[:i]]) for i in range(n)]

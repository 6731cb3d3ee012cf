import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from ruleloom.llm import langid
from ruleloom.llm.common import table


def test_tables_equal_plain_convolution():
    rng = np.random.default_rng(0)
    net = langid.train([(b"the cat sat on the mat", "en"), (b"der hund und die katze", "de")] * 20, epochs=2)
    text = bytes(rng.integers(0, 256, 300, dtype=np.uint8))
    codes, counts = langid.window_codes([text])
    got = net.window_probabilities(codes, net.tables(), counts.cumsum() * langid.WINDOW)
    assert counts.tolist() == [3] == [len(got)]
    padded = np.concatenate([codes, np.zeros(4, np.int64)])
    for k in range(3):
        peaks = []
        for w, f in zip(langid.WIDTHS, net.filters, strict=True):
            peaks.append(np.max([sum(f[o][padded[j + o]] for o in range(w)) for j in range(k * langid.WINDOW, (k + 1) * langid.WINDOW)], axis=0))
        z = np.exp(np.maximum(np.concatenate(peaks) + net.bias, 0) @ net.out + net.out_bias)
        assert np.allclose(z / z.sum(), got[k], atol=1e-3)


def test_spans_equal_one_span(monkeypatch):
    """Every window a span of its own, so that every end lies at an edge."""
    rng = np.random.default_rng(1)
    net = langid.train([(b"the cat sat on the mat", "en"), (b"der hund und die katze", "de")] * 20, epochs=2)
    texts = [bytes(rng.integers(32, 256, n, dtype=np.uint8)) for n in (1, 60, 123, 124, 125, 127, 128, 129, 380, 5000)]
    codes, counts = langid.window_codes(texts)
    ends = counts.cumsum() * langid.WINDOW
    whole = net.window_probabilities(codes, net.tables(), ends)
    for t, n, end in zip(texts, counts, counts.cumsum(), strict=True):
        alone = net.window_probabilities(langid.window_codes([t])[0], net.tables(), np.array([n * langid.WINDOW]))
        assert np.allclose(alone, whole[end - n : end], atol=1e-6)
    for span in (1, 2, 5):
        monkeypatch.setattr(langid, "SPAN_WINDOWS", span)
        assert np.allclose(net.window_probabilities(codes, net.tables(), ends), whole, atol=1e-6)


def test_memory_follows_bytes():
    """A text takes a few bytes for each of its own: as a worker may hold
    much from other stages, a batch mustn't take some twenty times its size."""
    net = langid.train([(b"the cat sat on the mat", "en"), (b"der hund und die katze", "de")] * 20, epochs=1)
    tables, text = net.tables(), b"the cat sat on the mat " * 400_000
    tracemalloc.start()
    try:
        langid.answers(net, tables, [text])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8 * len(text)


def test_answers_by_hand(spark, small):
    """Language and score of every text, by plain convolution over all of its
    windows."""
    docs = table(spark, small, "documents")
    net = langid.train(langid.sample(docs))

    def mean(text):
        n = (len(text) + 4 + langid.WINDOW - 1) // langid.WINDOW
        x = np.zeros((n * langid.WINDOW + 4, langid.CODES), np.float32)
        x[np.arange(len(x)), [langid.CODE[b] for b in text.ljust(n * langid.WINDOW + 4)]] = 1
        peaks = []
        for w, f in zip(langid.WIDTHS, net.filters, strict=True):
            r = sum(x[o : o + n * langid.WINDOW] @ f[o] for o in range(w))
            peaks.append(r.reshape(n, langid.WINDOW, -1).max(axis=1))
        z = np.maximum(np.concatenate(peaks, axis=1) + net.bias, 0) @ net.out + net.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return (p / p.sum(axis=1, keepdims=True)).mean(axis=0)

    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    equal = {}
    for r in docs.collect():
        equal.setdefault(r.text, set()).add((got[r.doc_id].lang_pred, round(got[r.doc_id].score, 5)))
        if not any(map(str.isalpha, r.text)):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        p = mean(r.text.encode())
        assert abs(got[r.doc_id].score - p.max()) < 1e-3
        assert got[r.doc_id].lang_pred == net.languages[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-3
    assert all(len(answers) == 1 for answers in equal.values())


def test_crops_reach_the_whole_text():
    text = b"".join(b"%07d " % i for i in range(4000))
    found = langid.crops(text + b"the end")
    assert not langid.crops(text) and len(found) == 1 and found[0].endswith(b"the end")
    long = text.replace(b" ", b"a")
    assert len(langid.crops(long)) == len(long) // langid.CROP_EVERY and langid.crops(long)[-1] == long[-langid.CROP_BYTES :] and langid.crops(b"ab") == [b"ab"]


def test_sample_is_bounded_in_bytes(spark):
    long = "dies ist ein langer satz ueber nichts " * 10_000  # 380,000 bytes, 185 crops
    rows = [(i, f"{i} {long}", "de") for i in range(40)] + [(100 + i, f"this is a short text {i}", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    every = langid.sample(docs)
    assert {lang for _, lang in every} == {"de", "en"}
    for budget in (1 << 17, 1 << 19):
        some = langid.sample(docs, budget=budget)
        assert 0 < sum(len(c) for c, _ in some) <= budget
        assert {lang for _, lang in some} == {"de", "en"} and len(some) < len(every)
        assert some == langid.sample(docs.repartition(3), budget=budget)
    assert langid.sample(docs, budget=100) == []
    one_id = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert 0 < len({c for c, lang in langid.sample(one_id, rows=20) if lang == "en"}) <= 20


def test_ties_and_clashing_columns(spark):
    assert langid.answers(langid.Network(["aa", "bb"], [np.zeros((w, langid.CODES, langid.FILTERS), np.float32) for w in langid.WIDTHS], np.zeros(48, np.float32), np.zeros((48, 2), np.float32), np.zeros(2, np.float32)), (np.zeros((langid.CODES**2, 48), np.float32),) * 2, [b"some text"])[0][0] == "aa"
    rows = [(i, f"plain words of one language {i}", "en", -i, 0.5, "x") for i in range(30)] + [(99, "12 34", "en", 0, 0.1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, bin long, score double, crop string")
    assert langid.identify(docs).columns == ["doc_id", "held_out", "lang_pred", "score"]
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows[:30]


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 150 and np.mean(held) >= 0.97


def test_held_out_labels_are_not_read(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    hidden = docs.withColumn("lang", langid.F.when(~langid.held_out(), langid.F.col("lang")))
    other = docs.withColumn("lang", langid.F.when(langid.held_out(), "xx").otherwise(langid.F.col("lang"))).withColumn("source", langid.F.lit("z"))
    assert sorted(map(tuple, langid.identify(hidden).collect())) == sorted(map(tuple, langid.identify(other).collect()))


def test_odd_rows(spark, docs_of, odd_rows):
    rows = {r.doc_id: r for r in langid.identify(docs_of(odd_rows).withColumn("score", langid.F.lit("clash"))).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and rows[0].score == 0
    assert rows[3].lang_pred == "en" and rows[4].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify(docs_of(odd_rows).withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs_of([])).count() == 0
    kept = langid.keep_known(docs_of(odd_rows))
    assert kept.columns == docs_of(odd_rows).columns and {0, 1, 2}.isdisjoint(r.doc_id for r in kept.collect())

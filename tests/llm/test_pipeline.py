import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ruleloom.llm import langid, packing
from ruleloom.llm.common import table
from ruleloom.llm.tokens import default_path

from .test_decontam import brute as brute_hits
from .test_pii import brute as brute_pii
from .test_simhash import brute_components, brute_fp


def test_stages_one_by_one(spark, small):
    docs = table(spark, small, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.written(stage(spark, seen[-1], small), f"test-{name}"))
    rows = [{r.doc_id: r for r in df.collect()} for df in seen[:-1]]
    assert all(df.columns == columns for df in seen[:-1])
    # language: what the classifier can't tell goes, the rest is as it was
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert rows[1] == {i: r for i, r in rows[0].items() if found[i].lang_pred != "und" and found[i].score >= 0.4}
    assert len(rows[1]) > 0.95 * len(rows[0])
    # near duplicates: the smallest id of each component
    label = brute_components([(i, brute_fp(r.text)) for i, r in rows[1].items()])
    assert rows[2] == {i: r for i, r in rows[1].items() if label[i] == i}
    # decontamination: no window is left, clean documents are as they were
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    hit = {i: brute_hits(r.text, items) for i, r in rows[2].items() if i % 4 == 0}
    for i, (n, words, _) in hit.items():
        if not words:
            assert rows[3][i] == rows[2][i]
        elif len(words) > 0.5 * n:
            assert i not in rows[3]
        else:
            assert len(rows[3][i].text) < len(rows[2][i].text)
    # personal data: every base span is replaced, no document goes
    assert rows[4].keys() == rows[3].keys()
    for i, r in rows[3].items():
        assert not any(brute_pii(rows[4][i].text).values()), (i, r.text)
        if not any(brute_pii(r.text).values()) and r.text != rows[4][i].text:
            raise AssertionError(i)
    # packing: every token of every document, in sequences that hold it
    tok = Tokenizer.from_file(default_path())
    packed = seen[-1].collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in rows[4].items()}
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    documents = {}
    for r in packed:
        documents[r.sequence_id] = documents.get(r.sequence_id, 0) + 1
    # the limit of documents binds: a sequence is at it, and without it some hold more
    assert max(documents.values()) == corpus_pipeline.DOCUMENTS
    free = packing.pack(seen[-2]).groupBy("sequence_id").count().agg(F.max("count")).first()[0]
    assert free > corpus_pipeline.DOCUMENTS
    assert max(fill.values()) <= 4096 and len(fill) <= np.ceil(sum(fill.values()) / 4096) + 1


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns[:2] == ["doc_id", "piece"] and out.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES][1].startswith("simhash")

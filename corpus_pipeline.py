"""A training-corpus pipeline over ``documents``: five stages, each written as
Parquet in the shared folder and read again as the next one's documents.

1. language ID: documents without letters, or whose language can't be told, go;
2. SimHash near-dedup: one document of each component stays, the smallest id;
3. benchmark decontamination: hit passages are cut out, and a document that is
   mostly hit goes;
4. PII: personal data and terms that disclose it are replaced by their kind;
5. best-fit packing: the pieces of what is left, with their sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm import decontam, langid, packing, pii, simhash
from ruleloom.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, capacity=packing.Capacity(documents=DOCUMENTS))


#: Most documents of a packed sequence: starts of documents are a field of fixed
#: width. It binds where texts are short (tested), at about one sequence in 100
#: more; pieces are cut as by tokens alone.
DOCUMENTS = 16

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", sanitisation),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models and tokenizer ids are beyond SQL; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

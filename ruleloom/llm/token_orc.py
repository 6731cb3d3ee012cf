"""Token ids as ORC (operator 10).

Documents are dealt by ranges of ascending id, encoded with a public
tokenizer, and written as ORC: one row a document with its ids as an integer
list, which ORC stores run-length encoded in stripes, with row indexes and a
Bloom filter on the document id. Files hold disjoint id ranges in order, so a
lookup prunes files and stripes by their minimum, maximum and Bloom filters,
and a full read splits by stripes.

Columns: doc_id long, part int (the file's place in the order), local_start
long (ids before it in its part), n_tokens long, ids array<int>.

Defined cases: a null text counts as empty and gives the end id alone; a null
id sorts first; rows with equal ids are ordered by text; an empty table gives
an empty file set that reads back as no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import arrow_map, byte_texts, shared_path, shuffle_partitions
from ruleloom.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"

OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
    "orc.compress": "ZSTD",
}


def encoded(docs: DataFrame, end_id: int, vocabulary: str, partitions: int) -> DataFrame:
    """One row a document, dealt and sorted by id, with ids and the end id."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encode = TaskContext.get().partitionId(), 0, encoder(vocabulary).encode
        for b in batches:
            ids = [x + tail for x in encode(byte_texts(b.column(1)))]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            ends = sizes.cumsum()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.full(len(ids), part, np.int32)), pa.array(ends - sizes + seen), pa.array(sizes), lists], ["doc_id", "part", "local_start", "n_tokens", "ids"])
            seen += int(ends[-1]) if len(ends) else 0

    dealt = docs.select("doc_id", "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    return arrow_map(dealt, run, SCHEMA)


def write(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str | None = None, partitions: int | None = None) -> None:
    out = encoded(docs, end_id, vocabulary or default_path(), partitions or shuffle_partitions(docs.sparkSession))
    out.write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter reaches the stripes' statistics
    and Bloom filters."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def part_bases(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each part: one number a file."""
    sums = sorted((r[0], r[1]) for r in read(spark, path).groupBy("part").agg(F.sum("n_tokens")).collect())
    bases, total = {}, 0
    for part, n in sums:
        bases[part] = total
        total += n
    return bases


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files at ``path``."""
    bases = part_bases(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, part, local, ids = (b.column(i) for i in range(4))
            at, values = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            base = np.array([bases[p] for p in part.to_pylist()], np.int64)
            crc = np.array([zlib.crc32(values[4 * at[i] : 4 * at[i + 1]]) for i in range(len(ids))], np.int64)
            yield pa.RecordBatch.from_arrays([doc, pa.array(base + local.to_numpy()), pa.array(np.diff(at).astype(np.int64)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = read(spark, path).select("doc_id", "part", "local_start", "ids")
    return arrow_map(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Write ``docs`` to the shared folder and give the digests read back."""
    path = shared_path(docs.sparkSession, "token-orc")
    write(docs, path, end_id, vocabulary)
    return digests(docs.sparkSession, path)

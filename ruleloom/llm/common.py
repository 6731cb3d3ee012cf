"""Helpers that the training-data operators share.

Python operators work on Arrow batches and on the raw UTF-8 bytes of a text
column, so no text is decoded unless an operator needs code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.shared import shared_path, written

__all__ = ["arrow_map", "byte_texts", "dealt_join", "free_name", "shared_path", "shuffle_partitions", "table", "written"]

#: Rows and bytes of one Arrow batch; texts may be long, so batches stay small.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows and about
    ``BATCH_BYTES`` bytes. Spark reads these limits from the session when a
    plan runs, so they are set there, but only where the session has Spark's
    own values: what a user chose stays."""
    conf = df.sparkSession.conf
    for name, own, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if conf.get(f"spark.sql.execution.arrow.{name}") == own:
            conf.set(f"spark.sql.execution.arrow.{name}", str(value))
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from
    ``columns``, whose case Spark doesn't tell."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def dealt_join(rows: DataFrame, facts: DataFrame, key: str, by: list[str], total: int | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``key`` with ``facts``, which has ``n``, the number
    of rows that have the key. ``total`` is their sum, and has to be given
    where ``facts`` has several rows for a key.

    A key with more than its share of rows (``total`` over the number of
    partitions) is dealt over several tasks by a hash of ``by``, and its facts
    are repeated for each. There are fewer such keys than partitions, so they
    are broadcast."""
    parts = shuffle_partitions(rows.sparkSession)
    if total is None:
        total = facts.agg(F.sum("n")).first()[0] or 0
    share = max(1, math.ceil(total / parts))
    many = F.ceil(F.col("n") / share).cast("int")
    hot = facts.where(F.col("n") > share).select(F.col(key).alias("hot_key"), many.alias("hot_parts")).distinct()
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left").withColumn("part", F.pmod(F.xxhash64(*by), F.coalesce("hot_parts", F.lit(1))).cast("int")).drop("hot_key", "hot_parts")
    right = facts.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(many, F.lit(1)) - 1))).drop("n")
    return left.join(right, [key, "part"], how).drop("part")

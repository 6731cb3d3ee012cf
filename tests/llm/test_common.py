from collections import Counter

import pytest
from pyspark.sql import functions as F

from ruleloom.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
def test_dealt_join_equals_a_join(spark, how):
    """One key with most rows, and keys without facts."""
    rows = spark.createDataFrame([(i, 0 if i % 3 else i % 40) for i in range(600)], "id long, k long")
    facts = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 3").withColumn("fact", F.concat(F.lit("f"), "k"))
    got = common.dealt_join(rows, facts, "k", ["id"], how=how)
    want = rows.join(facts.drop("n"), "k", how)
    assert Counter(map(tuple, got.select("id", "k", "fact").collect())) == Counter(map(tuple, want.select("id", "k", "fact").collect()))


def test_free_name():
    assert common.free_name(["a", "Marks", "_marks"], "marks") == "__marks" and common.free_name([], "x") == "x"


def test_own_batch_limits_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "123")
        common.arrow_map(spark.range(5), lambda batches: batches, "id long")
        assert spark.conf.get(key) == "123"
    finally:
        spark.conf.set(key, before)

"""Baselines and violations as tables bucketed by identity."""

from collections import Counter

import pytest

from ruleloom import config as rules
from ruleloom.operators import baseline as base
from ruleloom.plans.rules import evaluate
from ruleloom.shared import written
from tests import trees
from tests.trees import relations

DOCUMENT = {"forbidden": [{"name": "a", "severity": "error", "from": {}, "to": {"path": ["^oven", "^flour"]}}, {"name": "o", "from": {"orphan": True}, "to": {}}]}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.fixture
def tables(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = written(evaluate(rules.from_dict(DOCUMENT), *relations(spark, trees.BAKERY)), "violations")
    known = base.generate(found).where("rule = 'o' or from like '%b%'").unionByName(base.frame(spark, [base.Entry("a", "gone.go"), base.Entry("a", "gone.go", "x")]))
    yield found, written(known, "baseline")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_same_rows_and_fewer_shuffles(tables):
    found, known = tables
    kept, rows = base.stored(known), base.stored(found)
    bag = lambda df: Counter(map(str, df.collect()))
    for run in (base.new, base.known, base.stale):
        want = bag(run(found, known))
        assert want and bag(run(found, kept)) == want and bag(run(rows, kept)) == want and bag(run(rows, known)) == want
    for run in (base.new, base.known):
        assert exchanges(run(found, known)) == 2 and exchanges(run(found, kept)) == 1 and exchanges(run(rows, kept)) == 0
    assert exchanges(base.stale(rows, kept)) == 0

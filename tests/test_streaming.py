import pytest

from ruleloom.plans.rules import evaluate
from ruleloom.streaming import edges
from tests import trees

RULES = {"forbidden": [{"name": "l", "severity": "error", "from": {"path": ["^recipes/"]}, "to": {"path": ["^oven"]}}], "allowed": [{"name": "a", "from": {}, "to": {"path": ["flour$"]}}]}


def test_stream_equals_table(spark, tmp_path):
    files, imports = trees.relations(spark, trees.BAKERY)
    imports.join(files, "path").write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "rows")).schema).parquet(str(tmp_path / "rows"))
    query = edges.violations(RULES, stream).writeStream.format("memory").queryName("found").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    from ruleloom import config

    key = lambda df: sorted((r["rule"], r["from"]["path"], r["from"]["line"], r["to"]["path"]) for r in df.collect())
    assert key(spark.table("found")) == key(evaluate(config.from_dict(RULES), files, imports)) != []


def test_graph_rules_are_refused(spark):
    with pytest.raises(ValueError, match="need the whole graph: o"):
        edges.violations({"forbidden": [{"name": "o", "from": {"orphan": True}, "to": {}}]}, spark.range(1))

"""Counts of a result stay in Spark."""

import pytest

from ruleloom.operators.baseline import Entry
from ruleloom.validate import validate_frames
from tests import trees
from tests.trees import relations

RULE = {"name": "a", "severity": "error", "from": {"path": ["^recipes/"]}, "to": {"path": ["^oven"]}}


@pytest.mark.parametrize(("baseline", "errors"), [(None, 1), ([], 1), ([Entry("a", "gone.go", "x")], 2)])
def test_counts_collect_nothing(spark, monkeypatch, baseline, errors):
    """Stale entries are errors."""
    result = validate_frames({"forbidden": [RULE]}, *relations(spark, trees.BAKERY), baseline)
    count = result.report.summary()["error"]
    assert count >= errors

    collected = []
    kind = type(result.violations)
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: collected.append(real(df)) or collected[-1])
    fresh = validate_frames({"forbidden": [RULE]}, *relations(spark, trees.BAKERY), baseline)
    assert fresh.error_count == count and fresh.exit_code == min(count, 255)
    assert all(len(rows) <= 1 and all("from" not in r for r in rows) for rows in collected)

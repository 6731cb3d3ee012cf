import pytest

from ruleloom.queries import CATALOGUE, flagship, oracle_sql, queries
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


#: No package has so many dependents in the smallest tables.
EMPTY = {"q_source_dependents_gt"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CATALOGUE)
def test_query(spark, con, name):
    assert (same(queries()[name](spark, SF), oracle_sql()[name], con) > 0) == (name not in EMPTY)


def test_flagship(spark):
    rows = flagship(spark, SF).collect()
    key = [(r.rule, r.severity, r.from_path, r.from_line, r.to_path or "", r.to_type or "", r.kind, r.to_import or "") for r in rows]
    assert rows and key == sorted(key)

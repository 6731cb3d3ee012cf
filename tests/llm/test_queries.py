import pytest

from ruleloom.llm import queries as q
from tests.oracle import connect, same


@pytest.mark.parametrize("name", q.oracle_sql())
def test_against_sql(spark, small, name):
    assert same(q.queries()[name](spark, small), q.oracle_sql()[name], connect(small)) > 0


def test_one_query_each():
    assert [int(n[2:].split("_")[0]) for n in q.queries()] == list(range(1, len(q.queries()) + 1))

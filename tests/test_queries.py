"""Every registered query against its SQL check."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare
from tests.conftest import SF

QUERIES, CHECKS = queries(), oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    message = compare(QUERIES[name](spark, SF), duck, CHECKS.get(name))
    assert message.startswith(("equal", "rows-only")), message
    assert not message.startswith("rows-only 0")


def test_entry(spark):
    assert {r["column"] for r in entry(spark).collect()} == {"value", "user_id", "event_type"}


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)
    assert len(CHECKS) >= 0.9 * len(QUERIES)

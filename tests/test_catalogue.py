"""Every registered query of the set engine against its SQL in DuckDB."""

import pytest

from tests.oracle import assert_same
from tidemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, small, name):
    assert_same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], small)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id"]
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())

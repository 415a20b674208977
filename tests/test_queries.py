from __future__ import annotations

import pytest
from compare import assert_same

from tidemill.plans.registry import QUERIES, SQL


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])

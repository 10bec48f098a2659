"""Every query next to its SQL on the second engine, at the smallest scale."""

import pytest

from checks.compare import difference
from checks.oracle import ORACLE
from checks.queries import QUERIES
from tests.conftest import SMALL


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, second_engine, name):
    assert difference(spark, second_engine, SMALL, name) is None

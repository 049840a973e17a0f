"""Every query of the core runs over the smallest tables; those with SQL give its rows."""

import pytest

from tesserakg.plans import catalogue
from tests.compare import compare

SMALL = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    assert compare(spark, name, catalogue.queries()[name], SQL.get(name), SMALL) == ""

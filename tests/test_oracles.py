from __future__ import annotations

import pytest

from gamelode.plans import catalogue
from tests.compare import difference, duck

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    got = catalogue.queries()[name](spark, sf).toPandas()
    assert difference(got, con.execute(SQL[name]).fetchdf()) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0

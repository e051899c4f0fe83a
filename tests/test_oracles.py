"""Every registered query of the graph engine against its SQL, on the smallest tables."""

import pytest

from codeloom.plans import catalogue
from tests.conftest import SMALL

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(agree, name):
    agree(catalogue.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SMALL).count() > 0

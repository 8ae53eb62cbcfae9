"""Every query that has SQL gives what DuckDB gives; run over the smallest tables."""
import pytest

import __spark_entry__ as E
from plumbline.plans import catalogue
from tests.compare import differ

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.sql()))
def test_equal(spark, name):
    assert differ(spark, DATA, catalogue.queries()[name], catalogue.sql()[name]) == ""


def test_entry(spark):
    assert E.entry(spark).columns == ["review_id", "y", "loo_rur", "loo_rsr", "loo_rtr"]
    assert set(E.oracle_sql()) <= set(E.queries())
